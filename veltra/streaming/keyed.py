"""Burdens over a stream of single observations, with keyed state: carriers are capped, repeats of an observation ignored.

A stream is (sample_id, gene, variant_id, event, weight): one observation that a sample carries a variant, named by event,
with the weight of the variant. The state holds, for each sample, gene and variant, the events that were counted, at most
``cap`` of them: a dosage is how many there are, and an event that comes again, whether it was counted or came behind the
cap, changes nothing. So a replayed batch or file gives the same sums, and the state is bounded by the variants of the
samples, whatever the stream repeats. What changed is emitted: the new sum of each sample and gene that a batch touched.

The key is one of ``BUCKETS`` numbers that samples are dealt to by hash, its state the table of their events: a batch asks
for no more states than that, however many samples there are, and handles the events of a key as arrays. What a batch
changes is written anew with the rest of its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .burden import run_once

#: The state store that such operators need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: Keys of the state. The state in a folder lies under them, so that this is no parameter of a run.
BUCKETS = 4096
COLUMNS = ["sample_id", "gene", "variant_id", "event", "weight"]
#: Rows that are dealt to buckets at a time.
HELD = 200_000


class CappedBurden(StatefulProcessor):
    """Of a key that is a sample, whose rows are its observations."""

    def __init__(self, cap: int = 2):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counted = handle.getValueState("counted", "events binary")  # a table of COLUMNS

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = self.observed(key, rows)
        state = self.counted.get()
        known = _table(state[0]) if state else new.slice(0, 0)
        events, sums = counted(known, new, self.cap)
        if sums.num_rows:
            self.counted.update((_bytes(events),))
            yield sums.to_pandas(use_threads=False)

    def observed(self, key: tuple, rows: Iterator[pd.DataFrame]) -> pa.Table:
        part = pd.concat(rows)
        columns = [[key[0]] * len(part), part["gene"], part["variant_id"].astype("int64"), part["event"].astype(str), part["weight"].astype(float)]
        return pa.table([pa.array(c) for c in columns], COLUMNS)

    def close(self) -> None:
        pass


class BucketBurden(CappedBurden):
    """Of a key that is a bucket of samples, whose rows are tables of COLUMNS."""

    def observed(self, key: tuple, rows: Iterator[pd.DataFrame]) -> pa.Table:
        return pa.concat_tables([_table(events) for part in rows for events in part["events"]])


def counted(known: pa.Table, new: pa.Table, cap: int) -> tuple[pa.Table, pa.Table]:
    """The events that count, of known ones and of new ones in the order they came; and (sample_id, gene, burden) of each
    sample and gene that new ones were added to."""
    t = pa.concat_tables([known, new]).combine_chunks()
    sample, gene, event = (_codes(t[c]) for c in ("sample_id", "gene", "event"))
    variant = np.asarray(pc.rank(t["variant_id"], tiebreaker="dense"), np.int64)  # in its order, so that sums don't depend on the stream's
    order = np.lexsort((event, variant, gene, sample))  # equal events in the order they came
    order = np.sort(order[_differs(order, sample, gene, variant, event)])
    order = order[np.lexsort((variant[order], gene[order], sample[order]))]
    start = np.flatnonzero(_differs(order, sample, gene, variant))
    size = np.diff(np.append(start, len(order)))
    kept = np.arange(len(order)) - np.repeat(start, size) < cap
    burden = np.minimum(size, cap) * np.asarray(t["weight"], float)[order[start]]  # the weight is that of the first event
    group = np.flatnonzero(_differs(order[start], sample, gene))
    changed = np.logical_or.reduceat(kept & (order >= known.num_rows), start[group])
    sums = t.select(COLUMNS[:2]).take(order[start[group]][changed])
    return t.take(order[kept]), sums.append_column("burden", pa.array(np.add.reduceat(burden, group)[changed]))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """The values as numbers."""
    return np.asarray(column.combine_chunks().dictionary_encode("encode").indices)


def _differs(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it in this order."""
    out = np.ones(len(order), bool)
    out[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    return out


def _bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4", use_threads=False)) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob, options=pa.ipc.IpcReadOptions(use_threads=False)).read_all()


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, events) of rows (bucket, *COLUMNS): those of a bucket as a table, so that a key gets few rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= HELD:
            yield _by_bucket(held)
            held = []
    if held:
        yield _by_bucket(held)


def _by_bucket(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches)
    bucket = np.asarray(t["bucket"])
    order = np.argsort(bucket, kind="stable")
    start = np.flatnonzero(_differs(order, bucket))
    rows = t.select(COLUMNS).take(order).combine_chunks()
    events = [_bytes(rows.slice(a, b - a)) for a, b in zip(start, np.append(start[1:], len(order)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[order[start]], pa.int32()), pa.array(events, pa.binary())], ["bucket", "events"])


def capped_burden(stream: DataFrame, cap: int = 2) -> DataFrame:
    """(sample_id, gene, burden): to be written in update mode; the last row of a key counts."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}
    bucket = F.pmod(F.xxhash64("sample_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = stream.select(bucket, "sample_id", "gene", F.col("variant_id").cast("long"), F.col("event").cast("string"), F.col("weight").cast("double"))
    return (
        rows.repartition("bucket")
        .mapInArrow(_dealt, "bucket int, events binary")
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=BucketBurden(cap), outputStructType=f"sample_id {kinds['sample_id']}, gene string, burden double", outputMode="Update", timeMode="None"
        )
    )


def run_capped(stream: DataFrame, folder: str, cap: int = 2) -> DataFrame:
    """Take in all that is there and stop: the latest burden of each key. A folder that is given again goes on from its state."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        conf.set(k, v)
    try:
        return run_once(capped_burden(stream, cap), ["sample_id", "gene"], folder)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
