"""Near copies by exact similarity of word shingles, found through a byte-position inverted index with count filtering.

A text is the set of its word shingles; two texts are near copies if the Jaccard similarity of their sets is at least
``similarity``. The fingerprint is POSITIONS bytes: at each position one byte of the shingle with the smallest hash under
that position's multiplier. Two texts of similarity s share a positional byte with probability s, so that the tally of
shared bytes estimates s. Posting lists are keyed by WIDTH bytes at once. At a similarity of exactly 0.8 a pair shares no
list, or fewer bytes than FEWEST, about once in 100,000 pairs; above that, less.

Pairs with enough shared bytes are candidates. Their components hold every near copy that was found, so each text goes
once to its component, where the sets themselves are compared: candidates only say what meets, never what is linked.
Lists and components are searched breadth first, for a spanning forest. Those with more than ``block`` members are dealt
out by pairs of blocks to several tasks.

Texts with the same set are one node from the start.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import broadcast_if_small, cut, giving_back, short_batches

POSITIONS = 96
WIDTH = 4
FEWEST = 60
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
BROADCAST_ROWS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 of the word shingles in order; fewer words: one shingle; no word: none."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, one = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([one(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-shingle] + 1)).tolist()
    pairs = zip(starts, ends[shingle - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((one(joined[a:b], 42) for a, b in pairs), np.uint64, len(starts)))


def multipliers() -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(f"position {i}") | 1 for i in range(POSITIONS)], np.uint64)


def sketch(s: np.ndarray, by: np.ndarray) -> bytes:
    """The positional bytes of a set that isn't empty."""
    low = np.full(len(by), ~np.uint64(0))
    for at in range(0, len(s), 1024):
        np.minimum(low, (s[at : at + 1024, None] * by).min(axis=0), out=low)
    return (low * MIX >> np.uint64(56)).astype(np.uint8).tobytes()


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.lit("text"), F.col(text_col))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, text_key, node, size, sketch) of each row: node is the hash of the set, size its number of shingles. Texts
    without words are one node without a sketch."""

    def run(batches: Iterator[pa.RecordBatch]):
        import xxhash

        by = multipliers()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(x, shingle) for x in part.column(2).to_pylist()]
                node = np.array([xxhash.xxh64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                found = pa.array([sketch(s, by) if len(s) else None for s in sets], pa.binary())
                columns = [part.column(0), part.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), found]
                yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "node", "size", "sketch"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text_col).alias("text_key"), F.col(text_col))
    short_batches(docs.sparkSession)
    return rows.mapInArrow(lambda batches: giving_back(run(batches)), "id long, text_key long, node long, size long, sketch binary")


def forest(n: int, close: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among n members: each found one against those not yet found, by close(one, rest)."""
    links, queue, rest = [], [], np.arange(n)
    while len(rest):
        if queue:
            one = queue.pop()
        else:
            one, rest = int(rest[0]), rest[1:]
        hit = close(one, rest)
        if hit.any():
            found = rest[hit].tolist()
            links += [(one, x) for x in found]
            queue += found
            rest = rest[~hit]
    return links


def by_tally(members: list[bytes]) -> list[tuple[int, int]]:
    s = np.frombuffer(b"".join(members), np.uint8).reshape(len(members), POSITIONS)
    return forest(len(members), lambda one, rest: (s[rest] == s[one]).sum(axis=1) >= FEWEST)


def by_sets(members: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links of exact similarity: one's shingles are marked, and the marks of each of the rest are counted."""
    sets = [np.frombuffer(x, np.uint64) for x in members]
    sizes = np.array([len(x) for x in sets])
    _, places = np.unique(np.concatenate(sets), return_inverse=True)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    marks = np.zeros(int(places.max()) + 1, bool)
    known, inside, starts = None, None, None

    def close(one: int, rest: np.ndarray) -> np.ndarray:
        nonlocal known, inside, starts
        if not len(rest):
            return np.zeros(0, bool)
        if known is not rest:
            known, inside = rest, np.concatenate([places[bounds[i] : bounds[i + 1]] for i in rest.tolist()])
            starts = np.concatenate(([0], np.cumsum(sizes[rest])[:-1]))
        own = places[bounds[one] : bounds[one + 1]]
        marks[own] = True
        common = np.add.reduceat(marks[inside], starts, dtype=np.int64)
        marks[own] = False
        return common / (sizes[one] + sizes[rest] - common) >= similarity

    return forest(len(sets), close)


def grouped(work: Callable[[list[bytes]], list[tuple[int, int]]]):
    """(key, i, j, node, payload) in order of the first three -> (a, b) of the links that work finds in each group."""

    def run(batches: Iterator[pa.RecordBatch]):
        group, nodes, members = None, [], []

        def links():
            found = work(members) if len(members) > 1 else []
            columns = [pa.array([nodes[x[k]] for x in found], pa.int64()) for k in range(2)]
            return pa.RecordBatch.from_arrays(columns, ["a", "b"])

        for batch in batches:
            for *of, node, payload in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                if of != group:
                    yield links()
                    group, nodes, members = of, [], []
                nodes.append(node)
                members.append(payload)
        yield links()

    return run


def met(members: DataFrame, work: Callable[[list[bytes]], list[tuple[int, int]]]) -> DataFrame:
    """members (key, blocks, node, payload) -> (a, b): the links inside each key, found by pairs of blocks."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = members.select("*", own.alias("own")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "payload")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    linked = grouped(work)
    return dealt.mapInArrow(lambda batches: giving_back(linked(batches)), "a long, b long")


def candidates(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """nodes (node, sketch) -> (a, b): links of at least FEWEST shared bytes, enough to connect all that share a list."""
    keys = [F.xxhash64(F.lit(i), F.substring("sketch", WIDTH * i + 1, WIDTH)) for i in range(POSITIONS // WIDTH)]
    postings = nodes.select("node", F.explode(F.array(*keys)).alias("key"))
    lists = postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b"), F.bit_xor(F.xxhash64("node")).alias("all")
    )
    # Lists with the same members are one.
    lists = cut(lists.where("n > 1").groupBy("n", "a", "b", "all").agg(F.min("key").alias("key")))
    x, y = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x")), nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"))
    same = lambda n, i: n + (F.substring("x", i, F.lit(1)) == F.substring("y", i, F.lit(1))).cast("int")
    tally = F.aggregate(F.sequence(F.lit(1), F.lit(POSITIONS)), F.lit(0), same)
    two = lists.where("n = 2").select("a", "b").join(x, "a").join(y, "b").where(tally >= FEWEST).select("a", "b")
    longer = lists.where("n > 2").select("key", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    members = postings.join(broadcast_if_small(longer, BROADCAST_ROWS), "key").join(nodes.select("node", "sketch"), "node")
    return two.unionByName(met(members.select("key", "blocks", "node", F.col("sketch").alias("payload")), by_tally))


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    block: int = BLOCK,
) -> DataFrame:
    """A row for each row of docs: id, text_key, component_id: the smallest id reachable by links of at least similarity.

    Null texts and texts without words are equal. A null id gets the component of its text, null if no row of that has an
    id. Rows that repeat an id with another text are judged by their own text. An empty table gives an empty result.
    """
    rows = cut(sketches(docs, id_col, text_col, shingle))
    nodes = cut(
        rows.groupBy("node").agg(
            F.min("id").alias("id"), F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("sketch").alias("sketch")
        )
    )
    found = components(candidates(nodes.where("sketch is not null"), block))
    wanted = cut(found.join(nodes.select("node", "text_key", "size"), "node"))
    of_component = wanted.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    blocks = F.ceil(F.greatest(F.col("n") / F.lit(block), F.col("total") / F.lit(BLOCK_SHINGLES))).cast("int")
    of_component = of_component.select("component", F.least(blocks, F.col("n")).cast("int").alias("blocks"))
    wanted = cut(wanted.join(of_component, "component").select("node", "text_key", F.col("component").alias("key"), "blocks"))
    texts = docs.select(text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    texts = texts.join(broadcast_if_small(wanted, BROADCAST_ROWS), "text_key")
    texts = texts.groupBy("key", "blocks", "node").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                payload = pa.array([shingle_set(x, shingle).tobytes() for x in part.column(3).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), payload], ["key", "blocks", "node", "payload"])

    members = texts.mapInArrow(sets, "key long, blocks int, node long, payload binary")
    exact = components(met(members, lambda group: by_sets(group, similarity)))
    labels = nodes.select("node", "id").join(exact, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = cut(labels)
    smallest = labels.groupBy("component").agg(F.min("id").alias("component_id"))
    labels = labels.join(smallest, "component").select("node", "component_id")
    return rows.join(labels, "node").select(F.col("id").alias(id_col), "text_key", "component_id")
