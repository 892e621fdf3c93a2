"""Order statistics of groups of any size: no task, window or buffer holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import d
from ..session import broadcast_if_small, cut

BROADCAST_ROWS = 1_000_000
#: A value with more than this share of all rows is heavy: there are fewer than 1 / HEAVY of them.
HEAVY = 1e-4
#: Bins of a round of selection, and rows of a bin that one sorted list may hold.
BINS, FEW = 1024, 4096


def ranges(df: DataFrame, *by: str) -> DataFrame:
    """df in as many ranges of by as there are shuffle partitions, materialised, with the number of each in __part. A group
    with many rows is in many ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()))


def running_totals(df: DataFrame, by: list[str], order: str, amount: str) -> DataFrame:
    """df with upto and total: the sum of amount in the group up to and with the row in order, and of the whole group.

    order tells the rows of a group apart. Each range adds up its own rows; what a group has in earlier ranges, one number
    a range, is added.
    """
    placed = ranges(df, *by, order)
    sums = placed.groupBy("__part", *by).agg(F.sum(amount).alias("__own"))
    whole = Window.partitionBy(*by)
    carried = F.sum("__own").over(whole.orderBy("__part")) - F.col("__own")
    sums = sums.select("__part", *by, carried.alias("__before"), F.sum("__own").over(whole).alias("total"))
    inside = F.sum(amount).over(Window.partitionBy("__part", *by).orderBy(order))
    both = placed.withColumn("__upto", inside).join(sums, ["__part", *by])
    return both.withColumn("upto", F.col("__before") + F.col("__upto")).drop("__part", "__before", "__upto")


def average_ranks(df: DataFrame, by: list[str], value: str, times: str | None = None) -> DataFrame:
    """Adds rank (ties get their mean), n and ties. Equal values are counted before they are ordered.
    With times, a row counts as so many.

    The ranks go back to the rows by group and value. Of the heavy ones there are few, whatever the size of df: they are
    broadcast, so that no task gets all rows of a frequent value. Rows whose group or value is null are left out.
    """
    counts = df.where(" and ".join(f"`{c}` is not null" for c in (*by, value))).groupBy(*by, value).agg((F.count(F.lit(1)) if times is None else F.sum(times)).alias("ties"))
    totals = running_totals(counts, by, value, "ties")
    mean = (F.col("upto") - (F.col("ties") - 1) / 2).cast("double")
    ranks = cut(totals.select(*by, value, mean.alias("rank"), F.col("total").alias("n"), "ties"))
    rows = ranks.agg(F.sum("ties")).first()[0] or 0
    heavy = F.col("ties") > rows * HEAVY + 1000
    many = ranks.where(heavy)  # fewer than 1 / HEAVY
    on = [*by, value]
    if not many.limit(1).count():
        return df.join(ranks, on)
    light = df.join(F.broadcast(many.select(*on)), on, "left_anti").join(ranks.where(~heavy), on)
    return light.unionByName(df.join(F.broadcast(many), on))


def _targets(sizes: DataFrame, by: list[str], ps: list[float]) -> DataFrame:
    """(by, rank): the places, from 0, that the percentiles of each group lie on or between."""
    at = [(F.col("n") - 1) * d(p) for p in ps]
    places = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
    return sizes.withColumn("rank", F.explode(places))


def _sized(rows: DataFrame, by: list[str]) -> DataFrame:
    return cut(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))


def values_at(rows: DataFrame, by: list[str], targets: DataFrame) -> DataFrame:
    """(by, rank, v): the values at the places of targets (by, rank from 0, n, lo, hi) among the x of rows (by, x).

    Rounds of histograms: all groups and places at once, the range of each is cut into BINS bins, the bin that holds the
    place becomes its range, from the least to the largest value that is in it. Only counts of bins are shuffled. A range
    with one value is done; one with FEW rows or less is sorted. rows is read once a round: materialise it.
    """
    cell = [*by, "lo", "hi"]
    targets = cut(targets.select(*by, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")))
    wide = (F.col("lo") < F.col("hi")) & (F.col("inside") > FEW)
    while (open_ := targets.where(wide)).limit(1).count():
        cells = broadcast_if_small(cut(open_.select(*cell).distinct()), BROADCAST_ROWS)
        share = F.try_divide(F.col("x") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        inside = rows.join(cells, by).where("x between lo and hi").withColumn("bin", F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        bins = inside.groupBy(*cell, "bin").agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("a"), F.max("x").alias("b"))
        upto = F.sum("c").over(Window.partitionBy(*cell).orderBy("bin")) - F.col("c")  # BINS rows at most
        bins = bins.withColumn("upto", upto)
        here = F.col("rank") - F.col("below") - F.col("upto")
        nearer = open_.join(bins, cell).where((here >= 0) & (here < F.col("c")))
        nearer = nearer.select(*by, "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("below") + F.col("upto")).alias("below"), F.col("c").alias("inside"))
        targets = cut(targets.where(~wide).unionByName(nearer))
    short = cut(targets.where("lo < hi").select(*cell).distinct())
    listed = rows.join(broadcast_if_small(short, BROADCAST_ROWS), by).where("x between lo and hi")
    listed = listed.groupBy(*cell).agg(F.sort_array(F.collect_list("x")).alias("xs"))  # FEW at most
    found = targets.join(listed, cell, "left")
    at = F.coalesce(F.get("xs", (F.col("rank") - F.col("below")).cast("int")), F.col("lo"))
    return found.select(*by, "rank", at.alias("v"))


def percentiles(df: DataFrame, by: list[str], value: str, ps: list[float]) -> DataFrame:
    """(by, n, q): the exact percentiles, interpolated between neighbours, as an array; nulls and NaN don't count."""
    x = F.col(value).cast("double")
    rows = df.select(*by, x.alias("x")).where(" and ".join(["x is not null", "not isnan(x)", *(f"`{c}` is not null" for c in by)]))
    rows = cut(rows)  # read once a round: a sum of doubles computed anew need not be the same
    sizes = _sized(rows, by)
    found = values_at(rows, by, _targets(sizes, by, ps)).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))

    def one(p: float):
        h = (F.col("n") - 1) * d(p)
        low, high = F.floor(h).cast("long"), F.ceil(h).cast("long")
        a, b = F.col("at")[low], F.col("at")[high]
        return F.when(low == high, a).otherwise((high - h) * a + (h - low) * b)

    return sizes.join(found, by).select(*by, "n", F.array(*map(one, ps)).alias("q"))


def smallest(df: DataFrame, by: list[str], value: str, k: int, tie: str) -> DataFrame:
    """The k rows of each group with the smallest value; of equal values those with the smaller tie. value, a number that is
    never null, should tell most rows of a group apart. The k-th value of each group is selected, not sorted for."""
    if k <= 0:
        return df.limit(0)
    df = cut(df)
    rows = df.select(*by, F.col(value).alias("x"))
    sizes = _sized(rows, by)
    last = cut(values_at(rows, by, sizes.withColumn("rank", F.least(F.lit(k), "n").cast("long") - 1)).withColumnRenamed("v", "__last"))
    near = df.join(broadcast_if_small(last, BROADCAST_ROWS), by)
    sure = near.where(F.col(value) < F.col("__last"))
    before = cut(sure.groupBy(*by).agg(F.count(F.lit(1)).alias("__sure")))
    equal = near.where(F.col(value) == F.col("__last")).join(broadcast_if_small(before, BROADCAST_ROWS), by, "left")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(tie)) + F.coalesce("__sure", F.lit(0))
    equal = equal.withColumn("__place", place).where(F.col("__place") <= F.col("rank") + 1)
    return sure.select(*df.columns).unionByName(equal.select(*df.columns))
