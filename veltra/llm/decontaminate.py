"""Benchmark decontamination by fingerprints of item-sized windows. DataFrame functions only.

Texts are words (lower case, cut at white space and ASCII punctuation) and word shingles (five words; an item with fewer
is one shingle). A window of a document is as long as a benchmark item. A window that shares no shingle with an item has
similarity zero, so windows are laid where a shingle of an item occurs, aligned with it, and at every place between two
such alignments that are less than a window apart: where a passage has words put in or left out, the best window may lie
between. A window is compared only with items of its size that have one of those shingles.

Each window and each item gets a SimHash fingerprint of 64 bits, voted by its shingles as often as they occur. A
multi-index of 8 blocks of 8 bits, by item, finds all fingerprints within ``radius`` bits: two at most radius apart agree
within radius // 8 bits in at least one block, and the index lists every block value within that distance. The pairs
found are verified by the exact weighted similarity, the cosine of the shingle counts.

Only positions move before windows are laid: texts are read a second time, for those rows that have a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import broadcast_if_small, cut, table

SHINGLE = 5
SIMILARITY = 0.8
#: A similarity of 0.8 differs in 13 bits on average, with a deviation of 3.2; blocks within 3 bits reach up to 31.
RADIUS = 31
LANES = 0x0000000100000001
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\s\p{Punct}]+"), "")


def shingles(w: Column, k: int) -> Column:
    """The hashes of all k-word shingles in order; none if there are fewer words."""
    whole = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(k)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return F.when(F.size(w) >= k, whole).otherwise(F.array().cast("array<long>"))


def simhash(h: Column) -> Column:
    """64 votes in 32 sums of two 32-bit lanes: lane j of sum b counts bit b + 32 j. Right for any array."""
    shift = lambda x, n: F.call_function("shiftrightunsigned", x, n)
    add = lambda sums, x: F.transform(sums, lambda s, b: s + shift(x, b).bitwiseAND(F.lit(LANES)))
    sums = F.aggregate(h, F.array_repeat(F.lit(0).cast("long"), 32), add)
    lanes = F.flatten(F.transform(F.array(F.lit(0), F.lit(32)), lambda j: F.transform(sums, lambda s: shift(s, j))))
    bit = lambda v, b: F.when(
        v.bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), b)
    ).otherwise(F.lit(0).cast("long"))
    return F.aggregate(F.transform(lanes, bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def shingles_of(w: Column, k: int) -> Column:
    return shingles(w, k) if k == SHINGLE else short_shingles(w, k)


def block_index(items: DataFrame, radius: int) -> DataFrame:
    """(item, block, value, item_fp) for every value within radius // 8 bits of the item's block."""
    near = radius // 8
    flips = [x for x in range(256) if x.bit_count() <= near]
    blocks = items.select("item", "item_fp", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block"))
    own = F.expr("shiftrightunsigned(item_fp, 8 * block)").bitwiseAND(F.lit(255))
    spread = blocks.withColumn("own", own).withColumn("flip", F.explode(F.array(*map(F.lit, flips))))
    return spread.select("item", "block", F.col("own").bitwiseXOR(F.col("flip")).alias("value"), "item_fp")


def benchmark_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, k, n, h): a key of id and words, shingle length, number and hashes of the shingles. Null items and
    items without words: none. Rows that repeat an item's id with another text are items of their own."""
    w = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w")).where("item_id is not null and size(w) > 0")
    k = F.least(F.size("w"), F.lit(SHINGLE))
    one = F.array(F.expr("aggregate(w, 42L, (a, x) -> xxhash64(a, x))"))
    h = F.when(k == SHINGLE, shingles(F.col("w"), SHINGLE)).otherwise(one)
    key = F.xxhash64("item_id", F.array_join("w", " "))
    return w.select(key.alias("item"), "item_id", k.alias("k"), h.alias("h")).withColumn("n", F.size("h")).dropDuplicates(["item"])


def item_shingles(items: DataFrame, similarity: float) -> DataFrame:
    """(item, k, n, x, lo, hi, c, norm, seed): the distinct shingles of each item with first and last place, number, and
    the item's sum of squared numbers. Seeds are the shingles in fewest items, until their squares are more than
    1 - similarity ** 2 of the sum: by Cauchy's inequality a window that shares none of them is under the similarity."""
    placed = items.select("item", "k", "n", F.posexplode("h").alias("at", "x"))
    own = placed.groupBy("item", "k", "n", "x").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("c"))
    own = own.join(own.groupBy("x").agg(F.count(F.lit(1)).alias("items")), "x")
    of_item, square = Window.partitionBy("item"), F.col("c") * F.col("c")
    rarest = of_item.orderBy("items", "lo").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumn("norm", F.sum(square).over(of_item)).withColumn("before", F.sum(square).over(rarest) - square)
    return own.withColumn("seed", F.col("before") <= F.col("norm") * (1 - similarity**2) + 1e-9).drop("items", "before")


def found_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    tries: int | None = None,
) -> DataFrame:
    """(id, item_id, similarity, start, n_words) of each document and item that it holds: the best window, the first of
    equals; start counts words from 0.

    Null and empty texts, and items without words, match nothing. A document with fewer words than an item is one
    window. Rows that share an id (or have none) are reported together, but windows never mix their texts; repeated rows
    are one. Texts and items may have any length, and every window that shares a shingle with an item is tried. tries, a
    number, is a faster way that may miss some: of items over ``tries`` shingles only ``tries`` windows to an item's length
    are tried, and those between alignments more than half of it apart are not.
    Empty tables give an empty result. radius=64 verifies whatever shares a seed.
    """
    scored = scored_windows(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity, radius, tries)
    best = scored.groupBy("id", "item_id").agg(
        F.max(F.struct("cosine", (-F.col("start")).alias("back"), (F.col("n") + F.col("k") - 1).alias("length"))).alias("b")
    )
    return best.select("id", "item_id", F.col("b.cosine").alias("similarity"), (-F.col("b.back")).alias("start"), F.col("b.length").alias("n_words"))


def text_key(text: Column) -> Column:
    """With the id it tells rows apart: rows equal in both have the same windows."""
    return F.xxhash64(F.lit("text"), text)


def _same(a: DataFrame, b: DataFrame, *more: str) -> Column:
    """Rows of the same document, and equal in more columns."""
    out = a["id"].eqNullSafe(b["id"]) & (a["row"] == b["row"])
    for c in more:
        out = out & (a[c] == b[c])
    return out


def scored_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str,
    text_col: str,
    item_col: str,
    item_text_col: str,
    similarity: float,
    radius: int,
    tries: int | None,
) -> DataFrame:
    """(id, row, item_id, start, n, k, cosine) of each window that holds an item; row is the text's key."""
    items = benchmark_items(benchmark, item_col, item_text_col)
    items = cut(items.withColumn("item_fp", simhash(F.col("h"))))
    lengths = sorted(r.k for r in items.select("k").distinct().collect())  # at most SHINGLE numbers
    own = cut(item_shingles(items, similarity))
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("row"), F.col(text_col).alias("t"))

    # Which rows share a seed of which items: one pass over all texts for all lengths of shingles.
    cut_up = texts.select("id", "row", words(F.col("t")).alias("w"))
    every = [shingles_of(F.col("w"), k) for k in lengths or [SHINGLE]]
    every = F.flatten(F.array(*every)) if len(every) > 1 else every[0]
    # outer: else Spark infers a filter on the shingles and pushes it below the words, which it then cuts for each word
    met = cut_up.select("id", "row", every.alias("all")).select("id", "row", F.explode_outer("all").alias("x"))
    seeds = cut(own.where("seed").select("x", "item", "k"))
    met = cut(met.join(broadcast_if_small(seeds, BROADCAST_ROWS), "x").select("id", "row", "item", "k").distinct())

    # The shingles of those rows, in order.
    rows = cut(met.select("id", "row").distinct())
    rows_ = broadcast_if_small(rows.select(F.col("id").alias("__id"), F.col("row").alias("__row")), BROADCAST_ROWS)
    wanted = texts.join(rows_, F.col("id").eqNullSafe(F.col("__id")) & (F.col("row") == F.col("__row")), "left_semi")
    wanted = wanted.dropDuplicates(["id", "row"]).select("id", "row", words(F.col("t")).alias("w"))
    of_k = [F.struct(F.lit(k).alias("k"), shingles_of(F.col("w"), k).alias("all")) for k in lengths or [SHINGLE]]
    arrays = cut(wanted.select("id", "row", F.explode(F.array(*of_k)).alias("s")).select("id", "row", "s.*").where(F.size("all") > 0))

    # Where shingles of an item stand, and so where its windows start.
    sought = met.join(own.select("item", "n", "x", "lo", "hi"), "item")
    placed = arrays.select("id", "row", "k", F.size("all").alias("size"), F.posexplode("all").alias("pos", "x"))
    hits = sought.join(placed, _same(sought, placed, "k", "x"))
    hits = hits.select(sought["id"], sought["row"], "item", sought["k"], "n", "size", F.explode(F.array(F.col("pos") - F.col("lo"), F.col("pos") - F.col("hi"))).alias("at"))
    start = F.greatest(F.lit(0), F.least(F.col("at"), F.col("size") - F.col("n")))
    starts = hits.select("id", "row", "item", "k", "n", start.alias("start")).distinct()
    following = F.lead("start").over(Window.partitionBy("id", "row", "item").orderBy("start"))
    between = following - F.col("start") > 1
    if tries is None:  # a window holds none of an item's shingles only where two places are more than its length apart
        stride = F.when(following - F.col("start") <= 2 * F.col("n"), F.lit(1)).otherwise(following - F.col("start"))
    else:
        between = between & (following - F.col("start") <= F.col("n") / 2)
        stride = F.greatest(F.lit(1), F.floor(F.col("n") / tries).cast("int"))
    tried = F.when(between, F.sequence(F.col("start"), following - 1, stride)).otherwise(F.array("start"))
    starts = starts.withColumn("tried", tried).select("id", "row", "item", "k", "n", F.explode("tried").alias("start"))
    windows = starts.join(arrays, _same(starts, arrays, "k")).select(
        starts["id"], starts["row"], "item", starts["k"], "n", "start", F.slice("all", F.col("start") + 1, F.col("n")).alias("window")
    )
    windows = cut(windows.withColumn("fp", simhash(F.col("window"))))

    if radius < 64:
        index = broadcast_if_small(cut(block_index(items, radius)), BROADCAST_ROWS)
        blocks = windows.select("id", "row", "item", "start", "fp", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("block"))
        value = F.expr("shiftrightunsigned(fp, 8 * block)").bitwiseAND(F.lit(255))
        near = blocks.withColumn("value", value).join(index, ["item", "block", "value"])
        near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
        near = near.select("id", "row", "item", "start").distinct()
        windows = windows.join(near, _same(windows, near, "item", "start"), "left_semi")

    # The exact cosine of the counts: shingle by shingle, so that the work is linear in a window's length.
    key = ("id", "row", "item", "k", "n", "start")
    counts = windows.select(*key, F.explode("window").alias("x")).groupBy(*key, "x").agg(F.count(F.lit(1)).alias("m"))
    counts = counts.join(own.select("item", "x", "c"), ["item", "x"], "left")
    sums = counts.groupBy(*key).agg(F.sum(F.col("m") * F.col("c")).alias("dot"), F.sum(F.col("m") * F.col("m")).alias("own"))
    named = items.select("item", "item_id").join(own.groupBy("item").agg(F.first("norm").alias("norm")), "item")
    scored = sums.join(named, "item").withColumn("cosine", F.col("dot") / F.sqrt(F.col("norm").cast("double") * F.col("own")))
    return scored.where(F.col("cosine") >= similarity).select("id", "row", "item_id", "start", "n", "k", "cosine")


def short_shingles(w: Column, k: int) -> Column:
    def one(i: Column) -> Column:
        h = F.lit(42).cast("long")
        for j in range(k):
            h = F.xxhash64(h, F.get(w, i + j))
        return h

    whole = F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(k)), one)
    return F.when(F.size(w) >= k, whole).otherwise(F.array().cast("array<long>"))


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    tries: int | None = None,
) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item. Rows that share an id are judged each by its own text;
    rows without an id cannot be told apart later, so that all of them go if one holds an item."""
    found = scored_windows(docs, benchmark, id_col, text_col, item_col, item_text_col, similarity, radius, tries)
    row = lambda of, key: F.when(of.isNull(), F.lit(0)).otherwise(key)
    bad = cut(found.select(F.col("id").alias("__id"), row(F.col("id"), F.col("row")).alias("__row")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (row(F.col(id_col), text_key(F.col(text_col))) == F.col("__row"))
    return docs.join(broadcast_if_small(bad, BROADCAST_ROWS), same, "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = found_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES = {"op5_decontaminate": op5_decontaminate}
ORACLES: dict[str, str] = {}
