"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of 64 bits is 8 positional bytes. Two fingerprints at most ``radius`` bits apart differ in at most radius
bytes, so they share at least 8 - radius positional bytes: the guaranteed minimum matches.

Posting lists of single bytes would hold a 256th of all fingerprints each, and tallying them would take a 256th of all
pairs. A list is therefore keyed by ``WIDTH`` positional bytes at once, for each choice of positions. A pair that shares m
bytes meets in as many lists as there are choices among m, so that the tally of lists counts shared bytes: a pair with
the minimum of 4 meets in at least 4 lists of triples, one that shares only 3 bytes in a single one. Pairs are tallied
over the lists with two members, which are most; only those reaching the minimum are verified by their bits.

Longer lists are never paired up. They are searched breadth first, and bytes are compared there: a list of m
fingerprints gives at most m - 1 links, its spanning forest. A pair that meets in a longer list is linked or connected
there, so that its tally need not be whole. Lists longer than ``block`` are dealt out by pairs of blocks to several
tasks, so that no task holds more than two blocks.

Equal fingerprints are one node from the start. Components are those of all links within the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import cut, table

BLOCK = 2048
WIDTH = 3


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Votes of the XXH64 of the word shingles (repeats count); fewer words: one shingle; no word: 0."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= shingle:
        return one(joined, seed)
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    ends = ends[shingle - 1 :].tolist()
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), 16384):
        pairs = zip(starts[at : at + 16384], ends[at : at + 16384], strict=True)
        h = np.fromiter((one(joined[a:b], seed) for a, b in pairs), "<u8", len(starts[at : at + 16384]))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = np.array([fingerprint(x, shingle) for x in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)).mapInArrow(run, "id long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def width_of(radius: int) -> int:
    """Bytes in a key: no more than are shared for sure."""
    return min(WIDTH, 8 - radius)


def posting_keys(fp: Column, radius: int) -> list[Column]:
    """Keys of the posting lists: the bytes at each choice of positions."""
    width, keys = width_of(radius), []
    for k, chosen in enumerate(combinations(range(8), width)):
        key = F.lit(k << 8 * width).cast("long")
        for place, i in enumerate(chosen):
            key = key + F.shiftleft(_byte(fp, i), 8 * place)
        keys.append(key)
    return keys


def fewest_lists(radius: int) -> int:
    """In how many lists a pair meets at least that shares the guaranteed minimum of bytes."""
    return comb(8 - radius, width_of(radius))


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fps: breadth first, each found node against those not yet found."""
    rest, a, b = np.arange(1, len(fps)), [], []
    front = np.zeros(1, np.int64)
    while len(rest):
        found = np.zeros(len(rest), bool)
        parent = np.zeros(len(rest), np.int64)
        for at in range(0, len(front), 256):
            some = front[at : at + 256]
            open_ = np.flatnonzero(~found)
            if not len(open_):
                break
            x = fps[some][:, None] ^ fps[rest[open_]][None, :]
            shared = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2)
            ok = (shared >= 8 - radius) & (np.bitwise_count(x) <= radius)
            hit = ok.any(axis=0)
            found[open_[hit]] = True
            parent[open_[hit]] = some[ok[:, hit].argmax(axis=0)]
        if found.any():
            a.append(parent[found])
            b.append(rest[found])
            front, rest = rest[found], rest[~found]
        else:
            front, rest = rest[:1], rest[1:]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _list_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]):
        names = ["lo", "hi"]
        held_keys, held = np.zeros((0, 3), np.int64), np.zeros(0, np.uint64)
        for batch in _then_none(batches):
            if batch is not None:
                keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
                held_keys = np.concatenate([held_keys, keys])
                held = np.concatenate([held, np.asarray(batch.column(3)).view(np.uint64)])
            if not len(held):
                continue
            edges = np.flatnonzero((held_keys[1:] != held_keys[:-1]).any(axis=1)) + 1
            bounds = [0, *edges.tolist()] + ([len(held)] if batch is None else [])
            los, his = [], []
            for s, e in zip(bounds, bounds[1:]):
                if e - s > 1:
                    group = held[s:e]
                    a, b = forest(group, radius)
                    los.append(group[a])
                    his.append(group[b])
            if los:
                columns = [pa.array(np.concatenate(x).view(np.int64)) for x in (los, his)]
                yield pa.RecordBatch.from_arrays(columns, names)
            held_keys, held = held_keys[bounds[-1] :], held[bounds[-1] :]

    return run


def _then_none(batches):
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """distinct (fp) -> (lo, hi): links within the radius, enough to connect all that are reachable."""
    fp = F.col("fp")
    if radius > 7:
        raise ValueError("at least one byte must be shared: radius is at most 7")
    postings = distinct.select("fp", F.explode(F.array(*posting_keys(fp, radius))).alias("key"))
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    lists = cut(lists.where("n > 1"))
    tally = lists.where("n = 2").groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("met"))
    two = tally.where(F.col("met") >= fewest_lists(radius)).where(F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius).select("lo", "hi")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    longer = lists.where("n > 2").select("key", blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = postings.join(longer, "key").select("key", "fp", "blocks", own.alias("own"))
    members = members.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    more = dealt.mapInArrow(_list_links(radius), "lo long, hi long")
    return two.unionByName(more).distinct()


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4
) -> DataFrame:
    """A row for each row of docs: id, fingerprint (16 hex digits), component_id (smallest id reachable, its own included).

    Null and empty texts have fingerprint zero and are linked like any other. Rows without an id link others, too, and get
    the component that they are in; it is null if no row of it has an id. Ids are under 2**62. Rows that repeat an id with another text are judged by their own text.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    largest = rows.agg(F.max("id")).first()[0] or 0
    unnamed = F.lit(largest + 1) + F.monotonically_increasing_id()  # fingerprints of rows without an id come last
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("node")).withColumn("node", F.coalesce("node", unnamed)))
    lo = nodes.select(F.col("fp").alias("lo"), F.col("node").alias("b"))
    hi = nodes.select(F.col("fp").alias("hi"), F.col("node").alias("a"))
    by_fp = links(nodes.select("fp"), radius).join(lo, "lo").join(hi, "hi").select("a", "b")
    found = components(by_fp)
    smallest = F.coalesce(found["component"], nodes["node"])
    labels = nodes.join(found, nodes["node"] == found["node"], "left").select("fp", F.when(smallest <= largest, smallest).alias("component_id"))
    return rows.join(labels, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op3_simhash_dedup": op3_simhash_dedup}
ORACLES: dict[str, str] = {}
