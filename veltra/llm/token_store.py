"""A content-addressed store of token ids: chunks, recipes and Merkle manifests.

Layout, all Parquet in one folder that only Spark needs to reach:

- ``chunks``: digest (BLAKE2b, 16 bytes), n_ids, payload (little-endian ids of 2 or 4 bytes). A digest occurs once.
- ``recipes``: by ascending document id: id, row, part, local_start, n_tokens, digests of its chunks in order, root.
- ``manifest``: part, start, n_docs, n_tokens, root, width, store_root: one row for each range of ids, and in each of
  them the store's root over all.

A rolling polynomial hash over the last ``WINDOW`` ids cuts an id stream where its low bits are zero, so that equal
passages give equal chunks wherever they stand. Each document is cut by itself. A document's root is the Merkle root of
its chunks' digests, a part's that of its documents' roots, the store's that of its parts' roots. Reading back computes
all of them anew, from the payloads to the store's root, and raises if one doesn't agree, or if a chunk, a recipe or a
part is missing or stands there twice.

Null texts are empty: their stream is the end id alone. Rows may repeat an id; each is a document of its own, in the
order of their rows. Null ids come first. An empty table gives an empty store. Only the named columns are read. A text is
encoded as a whole by one task, which holds its words and ids, some twenty times its bytes; its chunks then go apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import broadcast_if_small, cut, new_dir, remove, table
from .tokens import id_type, shared_encoder, slices, tokenizer_path

WINDOW = 16
MEAN_BITS = 9
MIN_IDS = 64
MAX_IDS = 4096
BASE = np.uint64(0x9E3779B97F4A7C15)
BROADCAST_KEYS = 2_000_000

STAGED = "id long, row long, ord int, key long, digest binary, n_ids int, payload binary"
CHUNKS = "digest binary, n_ids int, payload binary"
RECIPES = "id long, row long, part int, local_start long, n_tokens long, digests array<binary>, root binary"
MANIFEST = "part int, start long, n_docs long, n_tokens long, root binary, width string, store_root binary"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(digests: list[bytes]) -> bytes:
    """Pairs are digested upwards; a node without a sibling moves up as it is; no node at all has the digest of nothing."""
    if not digests:
        return digest(b"")
    level = list(digests)
    while len(level) > 1:
        pairs = [digest(level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def cut_points(ids: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Positions after which the rolling hash over WINDOW ids allows a cut."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, max(0, len(ids) - WINDOW + 1), block):
        h, power, covered = ids[at : at + block + WINDOW - 1].astype(np.uint64) + np.uint64(1), BASE, 1
        with np.errstate(over="ignore"):
            while covered < WINDOW:  # two hashes of so many ids, side by side, are one of twice as many
                h = h[:-covered] * power + h[covered:]
                power, covered = power * power, 2 * covered
        found.append(np.flatnonzero((h >> np.uint64(64 - MEAN_BITS)) == 0) + (at + WINDOW))
    return np.concatenate(found)


def chunk_ends(cuts: np.ndarray, start: int, end: int) -> list[int]:
    """The ends of the chunks of ids[start:end]: allowed cuts at least MIN_IDS and at most MAX_IDS apart."""
    ends, last = [], start
    lo, hi = np.searchsorted(cuts, (start + MIN_IDS, end))
    for c in cuts[lo:hi].tolist():
        if c - last < MIN_IDS:
            continue
        while c - last > MAX_IDS:
            last += MAX_IDS
            ends.append(last)
        if c - last >= MIN_IDS:
            ends.append(c)
            last = c
    while end - last > MAX_IDS:
        last += MAX_IDS
        ends.append(last)
    if end > last or not ends:
        ends.append(end)
    return ends


def _staged(docs: DataFrame, tokenizer: str, end_id: int, width: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        encoder = shared_encoder(tokenizer)
        row = key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at, n in slices(batch.column(1)):
                ids, counts = encoder.encode(batch.column(1).slice(at, n), end_id)
                cuts, ends = cut_points(ids), np.cumsum(counts)
                chunks = [chunk_ends(cuts, e - c, e) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                per_doc = np.fromiter(map(len, chunks), np.int64, n)
                stops = np.fromiter((e for x in chunks for e in x), np.int64, int(per_doc.sum()))
                sizes = np.diff(stops, prepend=0)
                first = np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
                total, doc = len(stops), pa.array(np.repeat(np.arange(at, at + n), per_doc))
                # Chunks lie one behind another in one buffer: a payload is a place in it.
                raw = ids.astype(width).tobytes()
                bounds = np.concatenate(([0], stops * np.dtype(width).itemsize))
                view = memoryview(raw)
                digests = [digest(view[s:e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                columns = [
                    batch.column(0).take(doc),
                    pa.array(row + np.repeat(np.arange(n), per_doc)),
                    pa.array((np.arange(total) - first).astype(np.int32)),
                    pa.array(key + np.arange(total)),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes.astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), total, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw)]),
                ]
                row, key = row + n, key + total
                yield pa.RecordBatch.from_arrays(columns, ["id", "row", "ord", "key", "digest", "n_ids", "payload"])

    return docs.mapInArrow(run, STAGED)


def _laid_out(batches: Iterator[pa.RecordBatch]):
    """Number the documents of a range partition: local_start and the Merkle root of each."""
    from pyspark import TaskContext

    start, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = np.asarray(batch.column("n_tokens"))
        starts = start + np.cumsum(n) - n
        start += int(n.sum())
        lists = batch.column("digests").to_pylist()
        columns = [batch.column("id"), batch.column("row"), pa.array([part] * len(n), pa.int32()), pa.array(starts, pa.int64())]
        columns += [batch.column("n_tokens"), batch.column("digests"), pa.array([merkle_root(x) for x in lists], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "row", "part", "local_start", "n_tokens", "digests", "root"])


def _part_roots(batches: Iterator[pa.RecordBatch]):
    """The totals of the parts in a partition, whose rows are in order of part, id and row."""
    now, roots, tokens = None, [], 0
    out: list[tuple] = []
    for batch in batches:
        for part, n, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "root")), strict=True):
            if part != now and now is not None:
                out.append((now, len(roots), tokens, merkle_root(roots)))
                roots, tokens = [], 0
            now, tokens = part, tokens + n
            roots.append(root)
    if now is not None:
        out.append((now, len(roots), tokens, merkle_root(roots)))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    types = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "n_docs", "n_tokens", "root"])


def write_store(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: str | None = None,
) -> bytes:
    """Encode the texts and write the store; returns its root. width: "<u2" or "<u4"; by default the narrower one that
    holds all ids of the vocabulary and the end id. One that doesn't hold them raises."""
    spark, needed = docs.sparkSession, id_type(tokenizer, end_id)
    width = width or needed
    if width not in ("<u2", "<u4") or width < needed:
        raise ValueError(f"ids of this vocabulary need the width {needed}, not {width}")
    staging = f"{path}/staging"
    _staged(docs.select(F.col(id_col).cast("long"), F.col(text_col)), tokenizer, end_id, width).write.option(
        "compression", "none"
    ).parquet(staging)
    staged = spark.read.schema(STAGED).parquet(staging)

    # Which chunks are stored already: digests and keys move, payloads stay. A hot digest is summed up in each task.
    shared = staged.groupBy("digest").agg(F.min("key").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # Materialised: beyond the bound both sides are plain exchanges, whose hot digests adaptive execution splits.
    shared = broadcast_if_small(cut(shared), BROADCAST_KEYS // 8)
    again = staged.join(shared, "digest").where(F.col("key") != F.col("owner")).select("key")
    again_path = f"{path}/again"
    again.write.parquet(again_path)
    again = spark.read.schema("key long").parquet(again_path)
    chunks = staged.join(broadcast_if_small(again, BROADCAST_KEYS), "key", "left_anti")
    chunks.select("digest", "n_ids", "payload").write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipe = F.transform(F.array_sort(F.collect_list(F.struct("ord", "digest"))), lambda x: x["digest"])
    documents = staged.groupBy("id", "row").agg(F.sum("n_ids").cast("long").alias("n_tokens"), recipe.alias("digests"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents.repartitionByRange(ranges, "id", "row").sortWithinPartitions("id", "row")
    ordered.mapInArrow(_laid_out, RECIPES).write.parquet(f"{path}/recipes")

    start, rows = 0, []
    for part, n_docs, n_tokens, root in _part_totals(spark, path):
        rows.append((part, start, n_docs, n_tokens, root, width))
        start += n_tokens
    root = merkle_root([r[4] for r in rows])
    manifest = spark.createDataFrame(rows, "part int, start long, n_docs long, n_tokens long, root binary, width string")
    manifest.withColumn("store_root", F.lit(root)).coalesce(1).write.parquet(f"{path}/manifest")
    remove(spark, staging)
    remove(spark, again_path)
    return root


def _part_totals(spark: SparkSession, path: str) -> list[tuple[int, int, int, bytes]]:
    """(part, n_docs, n_tokens, root) from the recipes as they are. One row for each range: as many as there are partitions."""
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("part", "id", "row", "n_tokens", "root")
    per_part = recipes.repartition(ranges, "part").sortWithinPartitions("part", "id", "row")
    found = per_part.mapInArrow(_part_roots, "part int, n_docs long, n_tokens long, root binary").collect()
    return sorted((r.part, r.n_docs, r.n_tokens, bytes(r.root)) for r in found)


def verified_manifest(spark: SparkSession, path: str, root: bytes | None = None) -> tuple[DataFrame, str]:
    """The manifest (part, start), and the width, once the recipes have been found to agree with it in numbers, starts
    and roots; with root also with a root kept elsewhere, else a store could be changed together with its manifest."""
    rows = sorted(spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect(), key=lambda r: r.part)
    found, start = _part_totals(spark, path), 0
    if [(r.part, r.n_docs, r.n_tokens, bytes(r.root)) for r in rows] != found:
        raise ValueError("the recipes are not those of the manifest")
    for r in rows:
        if r.start != start:
            raise ValueError(f"part {r.part} of the manifest doesn't start where the one before ends")
        start += r.n_tokens
    whole = merkle_root([bytes(r.root) for r in rows])
    if any(bytes(r.store_root) != whole for r in rows) or (root is not None and root != whole):
        raise ValueError("the parts don't have the root of the store")
    if len({r.width for r in rows}) > 1:
        raise ValueError("the manifest has several widths")
    starts = spark.createDataFrame([(r.part, r.start) for r in rows], "part int, part_start long")
    return starts, rows[0].width if rows else "<u4"


def _shift_tables() -> np.ndarray:
    """tables[k, b, v]: the effect of 2**k zero bytes on a CRC-32 whose byte b is v."""
    tables = np.zeros((32, 4, 256), np.uint32)
    base = zlib.crc32(b"\0")
    for b in range(4):
        for v in range(256):
            tables[0, b, v] = zlib.crc32(b"\0", v << 8 * b) ^ base
    for k in range(1, 32):
        tables[k] = _shift(tables[k - 1].ravel(), tables[k - 1]).reshape(4, 256)
    return tables


def _shift(crc: np.ndarray, t: np.ndarray) -> np.ndarray:
    return t[0, crc & 255] ^ t[1, crc >> 8 & 255] ^ t[2, crc >> 16 & 255] ^ t[3, crc >> 24]


def combine_crcs(crcs: list[np.ndarray], lengths: list[np.ndarray]) -> np.ndarray:
    """CRC-32 of concatenations, given in each list the CRCs and byte lengths of the parts."""
    tables = _shift_tables()
    counts = np.array([len(x) for x in crcs])
    order = np.argsort(-counts, kind="stable")
    total = np.zeros(len(crcs), np.uint32)
    for r in range(int(counts.max(initial=0))):
        now = order[: int((counts > r).sum())]
        c = total[now]
        n = np.array([lengths[i][r] for i in now], np.int64)
        for k in range(int(n.max()).bit_length()):
            c = np.where(n >> k & 1, _shift(c, tables[k]), c)
        total[now] = c ^ np.array([crcs[i][r] for i in now], np.uint32)
    return total


def _checked(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest(payload) != key:
                raise ValueError(f"chunk {key.hex()} doesn't have its digest")
        yield batch


def _read_chunks(width: str):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in _checked(batches):
            crcs, sizes = [], []
            for payload in batch.column(1).to_pylist():
                ids = np.frombuffer(payload, width).astype("<u4")
                crcs.append(zlib.crc32(ids.tobytes()))
                sizes.append(len(ids))
            columns = [batch.column(0), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "crc", "n"])

    return run


def _summed_up(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        parts = batch.column("parts").to_pylist()
        for x, n, root in zip(parts, batch.column("n_tokens").to_pylist(), batch.column("root").to_pylist(), strict=True):
            if any(p["crc"] is None for p in x):
                raise ValueError("a chunk that a recipe names is missing")
            if merkle_root([p["digest"] for p in x]) != root or sum(p["n"] for p in x) != n:
                raise ValueError("a document's chunks don't have its root")
        crcs = [np.array([p["crc"] for p in x], np.int64).astype(np.uint32) for x in parts]
        sizes = [np.array([p["n"] for p in x], np.int64) for x in parts]
        columns = [batch.column(c) for c in ("id", "row", "start", "n_tokens")]
        columns += [pa.array(combine_crcs(crcs, [4 * x for x in sizes]).astype(np.int64), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "row", "start", "n_tokens", "ids_crc32"])


def read_recipes(spark: SparkSession, path: str, starts: DataFrame) -> DataFrame:
    """A row for each document, with its start among the ids of all. starts has a row for each range of ids only."""
    joined = spark.read.schema(RECIPES).parquet(f"{path}/recipes").join(F.broadcast(starts), "part")
    return joined.withColumn("start", F.col("part_start") + F.col("local_start"))


def read_digests(spark: SparkSession, path: str, root: bytes | None = None) -> DataFrame:
    """id, row, start, n_tokens and ids_crc32 of each document, from the files, all of whose roots are checked on the way.

    The CRC of a document is combined from those of its chunks, so that payloads aren't shuffled.
    """
    starts, width = verified_manifest(spark, path, root)
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("digest", "payload")
    sums = chunks.mapInArrow(_read_chunks(width), "digest binary, crc long, n long")
    own = ("id", "row", "start", "n_tokens", "root")
    pieces = read_recipes(spark, path, starts).select(*own, F.posexplode("digests").alias("ord", "digest"))
    found = pieces.join(sums, "digest", "left")
    part = F.struct("ord", "digest", "crc", "n")
    documents = found.groupBy(*own).agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return documents.mapInArrow(_summed_up, "id long, row long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, root: bytes | None = None) -> DataFrame:
    """id, row, start and payload (the ids in the store's width) of each document, put together from its chunks, each of
    which is digested anew."""
    starts, width = verified_manifest(spark, path, root)
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("digest", "payload").mapInArrow(_checked, "digest binary, payload binary")
    own = ("id", "row", "start", "n_tokens")
    pieces = read_recipes(spark, path, starts).select(*own, F.posexplode("digests").alias("ord", "digest"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "payload")))
    found = pieces.join(chunks, "digest", "left").groupBy(*own).agg(ordered.alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, F.coalesce(x["payload"], F.lit(b""))))
    found = found.select("id", "row", "start", "n_tokens", whole.alias("payload"))
    right = F.octet_length("payload") == F.col("n_tokens") * int(width[-1])
    wrong = F.raise_error(F.lit("a chunk that a recipe names is missing or stands there twice")).cast("binary")
    return found.select("id", "row", "start", F.when(right, F.col("payload")).otherwise(wrong).alias("payload"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_dir(spark, "token-store")
    root = write_store(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read_digests(spark, path, root).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {"op6_token_store": op6_token_store}
ORACLES: dict[str, str] = {}
