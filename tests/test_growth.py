"""What is read once, told in equal shares and held in parts, whatever the size of the tables."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from veltra.operators import bundles, characterize, clustering, inference, resample
from veltra.operators.burden import mean_scores


def counted(spark, df):
    """df, and how many of its rows have been worked out so far."""
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(look, df.schema), seen


def labelled(spark, n=400, pathways=3):
    rng = np.random.default_rng(7)
    rows = [(i, f"g{i % 3}", f"p{j}", float(np.round(rng.normal() + (j == 0) * (i % 3), 1))) for i in range(n) for j in range(pathways)]
    return spark.createDataFrame(rows, "sample_id long, grp string, pathway string, score double").repartition(3)


def test_points_of_a_small_file_are_dealt_out(spark):
    """A table that is one partition and small enough to be coalesced stays in parts where its samples are held."""
    scores = labelled(spark).drop("grp").coalesce(1)
    sizes = [r["count"] for r in clustering.wide(scores, ["p0", "p1", "p2"]).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and max(sizes) < 200


def test_enrichment_reads_the_scores_once(spark):
    rows = labelled(spark)
    watched, seen = counted(spark, rows)
    found = {(r.pathway, r.grp): (r.effect_size, r.p) for r in characterize.enrichment(watched).collect()}
    assert seen.value == 1200 and len(found) == 9


def test_ranks_of_counted_scores(spark):
    """Kruskal-Wallis from rows that stand for equal scores, against ranks of all rows; a group of one is left out."""
    rows = labelled(spark).unionByName(spark.createDataFrame([(900, "lone", "p1", 0.3), (901, "g1", "p2", None)], "sample_id long, grp string, pathway string, score double"))
    found = {r.pathway: (r.h, r.df) for r in inference.kruskal_wallis(rows).collect()}
    table = rows.where("grp <> 'lone' and score is not null").toPandas()
    for p, t in table.groupby("pathway"):
        rank, n = t["score"].rank().to_numpy(), len(t)
        q = sum(rank[(t["grp"] == g).to_numpy()].sum() ** 2 / (t["grp"] == g).sum() for g in set(t["grp"]))
        ties = t["score"].value_counts().to_numpy().astype(float)
        h = (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - (ties**3 - ties).sum() / (n**3 - n))
        assert found[p] == (pytest.approx(h), 2), p


def test_weight_schemes_read_the_genotypes_once(spark):
    variants = spark.createDataFrame([(v, f"G{v % 4}", ("frameshift_variant", "missense_variant", "synonymous_variant")[v % 3], float(3 * v)) for v in range(12)], "variant_id long, gene string, consequence string, cadd double")
    genotypes = spark.createDataFrame([(s, v, 1 + (s * v) % 2) for s in range(60) for v in range(12) if (s * 7 + v * v) % 3], "sample_id long, variant_id long, dosage int")
    sets = spark.createDataFrame([("a", "G0"), ("a", "G1"), ("b", "G2"), ("b", "G3"), ("b", "G3"), ("c", "G1")], "pathway string, gene string")
    groups = spark.range(63).select(F.col("id").alias("sample_id"), F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("grp"))
    watched, seen = counted(spark, genotypes)
    found = {(r.scheme, r.pathway): r.effect_size for r in bundles.weight_sensitivity(variants, watched, sets, groups).collect()}
    assert seen.value == genotypes.count() and len(found) == 10
    from veltra.functions.weights import scheme_weight
    from veltra.operators import burden as B

    for scheme in ("default", "uniform"):
        own = B.gene_burden(variants, genotypes, scheme_weight(F.col("consequence"), F.col("cadd"), scheme)).toPandas()
        cells = {(r.sample_id, r.gene): r.burden for r in own.itertuples()}
        for p, genes in (("a", ["G0", "G1"]), ("b", ["G2", "G3", "G3"])):
            x = np.array([sum(cells.get((s, g), 0.0) for g in genes) / len(genes) for s in range(63)])
            a, b = x[::2], x[1::2]
            pooled = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(x) - 2)
            assert found[scheme, p] == pytest.approx(abs(a.mean() - b.mean()) / np.sqrt(pooled))


def plain(i, iterations, n, seed=42):
    it = iterations[:, None]
    x = np.broadcast_to(i, (len(it), len(i)))
    for r in range(resample.ROUNDS):
        turn = np.full_like(it, r)
        key = resample.mixed_numbers(resample.mixed_numbers(turn, it, seed), turn, seed) % n
        other = (key - x) % n
        bit = resample.mixed_numbers(np.maximum(x, other), it * 64 + r, seed) // 65536 % 2
        x = np.where(bit == 1, other, x)
    return x


def test_permuted_numbers_are_the_plain_ones_in_less_time():
    for n in (1, 2, 1000, 5_400_000, resample.PRIME):
        i = np.unique(np.minimum(n - 1, np.concatenate([np.arange(min(n, 70)), n - 1 - np.arange(min(n, 30))])))
        its = np.concatenate([np.arange(1, 40), [10**6, 3 * 10**7]])
        assert (resample.permuted_numbers(i, its, n) == plain(i, its, n)).all()
    i, its, took = np.arange(1024) + 70_000, np.arange(1, 401), []
    for f in (plain, resample.permuted_numbers):
        began = time.process_time()
        f(i, its, 5_400_000)
        took.append(time.process_time() - began)
    assert took[1] < 0.7 * took[0]
    with pytest.raises(ValueError, match="more than"):
        resample.permuted_numbers(i, its, resample.PRIME + 1)


@pytest.mark.parametrize("draws", [1 << 24, 1000])
def test_draws_of_blocks_are_told_without_rows(spark, monkeypatch, draws):
    monkeypatch.setattr(resample, "DRAWS", draws)
    n, its = 3000, 5
    found = {(r.it, r.sblock): r.c for r in resample._hits(spark, n, its, 42).collect()}
    for it in range(1, its + 1):
        want = np.bincount(resample.mixed_numbers(np.arange(n), np.full(n, it)) % n // resample.SAMPLES)
        assert [found[it, b] for b in range(3)] == want.tolist()
    assert resample._hits(spark, 0, its, 42).count() == 0


def test_blocks_are_dealt_in_equal_shares(spark, monkeypatch):
    """Each task has one part of the blocks of samples, and emits no more columns than there are pathways."""
    monkeypatch.setattr(resample, "SAMPLES", 8)
    monkeypatch.setattr(resample, "PARTS", 6)
    rows, products, emitted = labelled(spark, 240), resample._products, spark.sparkContext.accumulator(0)

    def watched(*args):
        run = products(*args)

        def look(batches):
            for b in run(batches):
                emitted.add(1)
                assert set(np.diff(b.column(3).offsets.to_numpy())) == {3}
                yield b

        return look

    monkeypatch.setattr(resample, "_products", watched)
    sums = resample.permuted_sums(rows.drop("grp"), rows.select("sample_id", "grp").distinct(), 4)
    assert {(r.it, r.pathway): r.n for r in sums.groupBy("it", "pathway").agg(F.sum("n").alias("n")).collect()} == {(t, f"p{j}"): 240 for t in range(1, 5) for j in range(3)}
    assert emitted.value == 6 * 3  # tasks by groups


def test_statistics_read_the_scores_once(spark):
    rows = labelled(spark, 120)
    watched, seen = counted(spark, rows.drop("grp"))
    out = bundles.statistical_rigor(watched, rows.select("sample_id", "grp").distinct(), n_permutations=10, n_bootstrap=10).collect()
    assert seen.value == 360 and len(out) == 3


def test_labels_of_an_iteration_are_dealt_in_less_time():
    """In place, a pair mixed once, the same as telling for each number where it goes."""
    for n in (1, 2, 3, 1000, 70_001):
        labels = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
        for it in (1, 2, 999, 10**6):
            assert (resample.permuted_labels(labels, it) == labels[resample.permuted_numbers(np.arange(n), np.array([it]), n)[0]]).all()
    labels, took = np.zeros(300_000, np.uint8), []
    for f in (lambda: resample.permuted_numbers(np.arange(len(labels)), np.array([7]), len(labels)), lambda: resample.permuted_labels(labels, 7)):
        began = time.process_time()
        f()
        took.append(time.process_time() - began)
    assert took[1] < 0.7 * took[0]


@pytest.mark.parametrize("groups", [1, 2, 5, 20, 300])
def test_dealt_labels_give_the_sums_of_samples_of_their_own(spark, monkeypatch, groups):
    """Labels come to the blocks in bits; of too many samples or groups a task works out those of its own."""
    rows = labelled(spark, 2100, 2).where("sample_id % 50 <> 3 or pathway <> 'p1'")
    of = resample.matrix(rows.drop("grp"), rows.select("sample_id", F.concat(F.lit("g"), F.col("sample_id") % groups).alias("grp")).distinct())
    told, found = [], []
    dealt = resample._dealt
    monkeypatch.setattr(resample, "_dealt", lambda *a: told.append(1) or dealt(*a))
    for most in (1 << 25, 0):
        monkeypatch.setattr(resample, "DEALT", most)
        found.append({(r.it, r.pathway, r.grp): (r.n, r.s, r.ss) for r in resample.permuted_sums(None, None, 6, of=of).collect()})
    assert len(told) == (groups <= 256) and found[0].keys() == found[1].keys()
    assert all(found[0][k] == pytest.approx(found[1][k], abs=1e-9) for k in found[0])
    assert sum(v[0] for k, v in found[0].items() if k[:2] == (6, "p1")) == 2058


def test_statistics_make_the_matrix_once(spark, monkeypatch):
    """Unless there are samples without a score, from which no resample is drawn."""
    rows, numbered_labels, calls = labelled(spark, 120), resample._numbered_labels, []
    labels = rows.select("sample_id", "grp").distinct()
    monkeypatch.setattr(resample, "_numbered_labels", lambda x: calls.append(1) or numbered_labels(x))
    for more, times in ((0, 1), (4, 2)):
        all_labels = labels.unionByName(spark.range(1000, 1000 + more).select(F.col("id").alias("sample_id"), F.lit("g1").alias("grp")))
        calls.clear()
        found = {r.pathway: r for r in bundles.statistical_rigor(rows.drop("grp"), all_labels, n_permutations=10, n_bootstrap=10).collect()}
        assert len(calls) == times
        p = {r.pathway: r.p for r in resample.permutation_p(rows.drop("grp"), all_labels, 10).collect()}
        ci = {r.pathway: (r.lo, r.hi) for r in resample.bootstrap_ci(rows, 10).collect()}
        size = {r.pathway: r.effect_size for r in inference.max_pairwise_d(rows).collect()}
        assert {k: v.p for k, v in found.items()} == p
        assert all((v.lo, v.hi, v.effect_size) == pytest.approx((*ci[k], size[k])) for k, v in found.items())


def test_scores_are_added_up_by_number(spark):
    """The name of a pathway is not met by each burden; a gene listed twice counts twice, samples without burdens have zeros."""
    burden = spark.createDataFrame([(s, f"G{g}", float(s + g)) for s in range(5) for g in range(4)], "sample_id long, gene string, burden double")
    sets = spark.createDataFrame([("a", "G0"), ("a", "G1"), ("a", "G1"), ("b", "G2"), ("b", "none"), ("b", "G3"), ("c", "G3")], "pathway string, gene string")
    out = mean_scores(burden, sets, spark.range(7).select(F.col("id").alias("sample_id")), ["burden"])
    dealt = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(sample_id" in x and ", 4)" in x]
    assert dealt and not any("pathway" in x for x in dealt)
    found = {(r.sample_id, r.pathway): r.burden for r in out.collect()}
    assert found == pytest.approx({(s, p): v if s < 5 else 0 for s in range(7) for p, v in (("a", (3 * s + 2) / 3), ("b", (2 * s + 5) / 2))})
