"""Vector bin packing of examples into sequences by the dot-product heuristic.

An example is a vector: tokens, one segment, loss-bearing tokens. A sequence holds all three limits at once. One
sequence is open at a time; of the waiting examples that fit, it takes the one with the largest weighted dot product of
what the sequence has left and what the example asks for (each dimension as a share of its limit, weighted by the mean
demand of the waiting examples). If nothing fits and more than ``max_padding`` tokens are left, the best example is cut
to what is left. Whole sequences are cut from long examples first, so that only remainders wait.

Each task packs its own partition as a stream, with at most ``window`` waiting examples and ``window_tokens`` tokens, so
nothing is shuffled and memory is bounded. A sequence that ends short (the last of a task, or at the segment or loss
limit) is cut into sequences whose lengths are powers of two, which need no padding. The result depends only on the
rows of a partition and their order, so that a lost task gives the same sequences again.

Null texts are empty and still have their end id. Ids may be null or repeat: each row is an example of its own. An empty
table gives no piece. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import giving_back, table, written
from .tokens import WordEncoder, shared_encoder, slices, tokenizer_path


#: A conversation is packed in runs of about so many tokens.
RUN_TOKENS = 1 << 16


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 512
    loss_tokens: int = 4096
    max_padding: int = 16
    window: int = 1024
    window_tokens: int = 4_000_000


class Example:
    """What is left of an example: ids[at:], of which loss marks the loss-bearing ones (None: all)."""

    __slots__ = ("key", "ids", "loss", "at", "total", "base")

    def __init__(self, key, ids: np.ndarray, loss: np.ndarray | None, base: int = 0):
        """base: how many ids of the same document stand before these."""
        self.key, self.ids, self.loss, self.at, self.total, self.base = key, ids, loss, 0, len(ids), base

    def left(self) -> int:
        return self.total - self.at

    def loss_in(self, length: int) -> int:
        return length if self.loss is None else int(self.loss[self.at : self.at + length].sum())

    def fitting(self, tokens: int, loss: int) -> int:
        """The longest prefix within both."""
        n = min(tokens, self.left())
        if self.loss is None:
            return min(n, loss)
        return int(np.searchsorted(np.cumsum(self.loss[self.at : self.at + n]), loss, side="right"))


class Packer:
    """Gives lists of (example, start, length) for each sequence."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.waiting: list[Example] = []
        self.demand = np.zeros((0, 3))
        self.new: list[tuple[Example, np.ndarray]] = []
        self.tokens = 0

    def add(self, x: Example) -> Iterator[list]:
        whole = self.limits.tokens
        while x.left() >= whole and x.loss_in(whole) <= self.limits.loss_tokens:
            yield [self._take(x, whole)]
        if x.left():
            self.new.append((x, self._vector(x)))
            self.tokens += x.left()
        if len(self.waiting) + len(self.new) >= self.limits.window or self.tokens >= self.limits.window_tokens:
            yield from self._pack(self.limits.window // 2, self.limits.window_tokens // 2)

    def finish(self) -> Iterator[list]:
        yield from self._pack(0, 0)

    def _vector(self, x: Example) -> np.ndarray:
        return np.array([x.left(), 1, x.loss_in(x.left())]) / self.cap

    @staticmethod
    def _take(x: Example, n: int) -> tuple[Example, int, int]:
        start, x.at = x.at, x.at + n
        return x, start, n

    def _pack(self, keep: int, keep_tokens: int) -> Iterator[list]:
        if self.new:
            self.demand = np.vstack([self.demand, *[v[None] for _, v in self.new]])
            self.waiting += [x for x, _ in self.new]
            self.new = []
        free = np.ones(len(self.waiting), bool)
        n_free = len(self.waiting)
        while n_free > keep or (n_free and self.tokens > keep_tokens):
            left = np.ones(3)
            weight = self.demand[free].mean(axis=0)
            pieces = []
            while n_free:
                score = np.where(free, self.demand @ (weight * left), -1.0)
                fits = (self.demand <= left + 1e-9).all(axis=1)
                best = int(np.argmax(np.where(fits, score, -1.0)))
                if not (free[best] and fits[best]):
                    room = np.rint(left * self.cap).astype(int)
                    if room[0] <= self.limits.max_padding or room[1] < 1 or room[2] < 1:
                        break
                    best = int(np.argmax(score))
                    x = self.waiting[best]
                    n = x.fitting(int(room[0]), int(room[2]))
                    if n < 1:
                        break
                    pieces.append(self._take(x, n))
                    self.tokens -= n
                    self.demand[best] = self._vector(x)
                    if not x.left():
                        free[best], n_free = False, n_free - 1
                    break
                x = self.waiting[best]
                self.tokens -= x.left()
                pieces.append(self._take(x, x.left()))
                left = left - self.demand[best]
                free[best], n_free = False, n_free - 1
            yield from self._close(pieces)
        self.waiting = [x for x, f in zip(self.waiting, free, strict=True) if f]
        self.demand = self.demand[free]

    def _close(self, pieces: list) -> Iterator[list]:
        length = sum(n for _, _, n in pieces)
        if self.limits.tokens - length <= self.limits.max_padding:
            yield pieces
            return
        for bit in reversed(range(length.bit_length())):
            if length >> bit & 1:
                room, part = 1 << bit, []
                while room:
                    x, start, n = pieces.pop(0)
                    part.append((x, start, min(n, room)))
                    if n > room:
                        pieces.insert(0, (x, start + room, n - room))
                    room -= min(n, room)
                yield part


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def _pieces(examples: Iterator[Example], limits: Limits, partition: int, key_type: pa.DataType, key: str, with_ids: bool):
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
    types = [key_type] + [pa.int64()] * 7
    if with_ids:
        names, types = [*names, "ids"], [*types, pa.list_(pa.int32())]
    schema = pa.schema(list(zip(names, types, strict=True)))
    packer, rows, sequence = Packer(limits), [], partition << 40
    count = 0

    def emit(sequences):
        nonlocal sequence, count
        for pieces in sequences:
            offset = 0
            for x, start, n in pieces:
                ids = x.ids[start : start + n]
                loss = n if x.loss is None else int(x.loss[start : start + n].sum())
                row = (x.key, x.base + start, n, zlib.crc32(ids.tobytes()), x.total, sequence, offset, loss)
                rows.append((*row, ids.astype(np.int32)) if with_ids else row)
                offset, count = offset + n, count + n * with_ids
            sequence += 1

    def flush():
        nonlocal count
        columns = list(zip(*rows, strict=True))
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema=schema)
        rows.clear()
        count = 0
        return out

    for x in examples:
        emit(packer.add(x))
        if len(rows) >= 8192 or count > 4_000_000:
            yield flush()
    emit(packer.finish())
    if rows:
        yield flush()


def pack_texts(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    limits: Limits = Limits(),
    with_ids: bool = False,
    keep_words: bool = True,
) -> DataFrame:
    """Encode and pack texts, all of whose tokens bear loss; with_ids adds the ids of each piece.

    keep_words: whether a worker process keeps its cache of words from task to task, which is faster; without, the cache
    is a sixteenth of the size, texts are encoded a megabyte at a time, and the memory is free for what runs next.
    """
    key_field = docs.select(id_col).schema[0]

    def run(batches):
        from pyspark import TaskContext

        encoder = shared_encoder(tokenizer) if keep_words else WordEncoder(tokenizer, 1 << 16)
        most = (3 if keep_words else 1) << 20

        def examples():
            for batch in batches:
                for at, n in slices(batch.column(1), most):
                    ids, counts = encoder.encode(batch.column(1).slice(at, n), end_id)
                    for key, x in zip(batch.column(0).slice(at, n).to_pylist(), np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                        yield Example(key, x.astype("<u4"), None)  # a copy: a waiting example doesn't hold its neighbours

        batch_type = key_type[0]
        yield from _pieces(examples(), limits, TaskContext.get().partitionId(), batch_type, id_col, with_ids)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = [to_arrow_type(key_field.dataType)]
    schema = f"`{id_col}` {key_field.dataType.simpleString()}, {PIECES}" + (", ids array<int>" if with_ids else "")
    whole = run if keep_words else lambda batches: giving_back(run(batches))
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(whole, schema)


def pack_conversations(
    turns: DataFrame,
    tokenizer: str,
    end_id: int,
    limits: Limits = Limits(segments=64, loss_tokens=2048),
    loss_role: str = "assistant",
    with_ids: bool = False,
) -> DataFrame:
    """Pack conversations (conv_id, turn, role, text) as instruction data: only turns of loss_role bear loss.

    Each turn is encoded by itself and ends with end_id; a conversation is its turns in order. Turns are dealt out by
    ranges of (conv_id, turn), so that a conversation of any length, or one with a third of all turns, goes through
    several tasks, each of which packs what it has in runs of RUN_TOKENS; one turn must fit a task's memory. Starts and
    doc_tokens count over the whole conversation all the same.

    A row without a conv_id is a conversation of its own. A null turn comes first, a null text is empty, a null role bears
    no loss. Turns with the same number are ordered by a hash of role and text; repeated rows all count. An empty table
    gives no piece. Other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ranges = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("role", "text"))
    rows = rows.repartitionByRange(ranges, "conv_id", "turn", "tie").sortWithinPartitions("conv_id", "turn", "tie", "role", "text")
    rows = rows.select("conv_id", "role", "text")
    id_type = rows.schema[0].dataType
    key_type = pa.struct([("conv_id", to_arrow_type(id_type)), ("part", pa.int32()), ("lone", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        encoder, part = shared_encoder(tokenizer), TaskContext.get().partitionId()

        def examples():
            now, base, lone, held, bears = None, 0, 0, [], []

            def example():
                key = {"conv_id": now, "part": part, "lone": lone if now is None else None}
                return Example(key, np.concatenate(held), np.concatenate(bears), base)

            for batch in batches:
                for at, n in slices(batch.column(2)):
                    ids, counts = encoder.encode(batch.column(2).slice(at, n), end_id)
                    places = zip(*(batch.column(c).slice(at, n).to_pylist() for c in (0, 1)), strict=True)
                    for (key, role), x in zip(places, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                        if held and (key != now or key is None):
                            yield example()
                            base, lone, held, bears = 0, lone + 1, [], []
                        now = key
                        held.append(x.astype("<u4"))
                        bears.append(np.full(len(x), role == loss_role))
                        if sum(map(len, held)) >= RUN_TOKENS:
                            run = example()
                            base, held, bears = base + run.total, [np.zeros(0, "<u4")], [np.zeros(0, bool)]
                            yield run
            if held:
                yield example()

        yield from _pieces(examples(), limits, part, key_type, "example", with_ids)

    kind = f"struct<conv_id:{id_type.simpleString()},part:int,lone:bigint>"
    packed = rows.mapInArrow(run, f"example {kind}, {PIECES}" + (", ids array<int>" if with_ids else ""))
    packed = written(packed, "packed-turns").select("example.*", "*").drop("example", "doc_tokens")
    # A task's share of a conversation: what lies before it, and the whole.
    shares = packed.groupBy("conv_id", "part", "lone").agg(F.sum("length").alias("n"))
    whole = Window.partitionBy("conv_id", F.when(F.col("conv_id").isNull(), F.col("part")), "lone")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shares = shares.select(
        *[F.col(c).alias(f"__{c}") for c in ("conv_id", "part", "lone")],
        F.coalesce(before, F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("doc_tokens"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("conv_id", "part", "lone")]
    own = [c for c in packed.columns if c not in ("conv_id", "part", "lone", "start")]
    return packed.join(shares, same).select("conv_id", (F.col("start") + F.col("before")).alias("start"), "doc_tokens", *own)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def packing_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on instruction data: loss only on answers, so that all three limits bind."""
    return pack_conversations(table(spark, sf_dir, "conversations"), tokenizer_path("word_bpe_49k.json"), end_id=2)


QUERIES = {"op4_packing": op4_packing, "packing_conversations": packing_conversations}
ORACLES: dict[str, str] = {}
