import hashlib

import pytest

from veltra.llm import exact_dedup

from .util import AWKWARD, docs


def brute(rows, keep):
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    out = []
    for key, text in rows:
        group = groups[text or ""]
        ids = [k for k in group if k is not None]
        best = (max(ids) if keep == "largest" else min(ids)) if ids else None
        out.append((key, best, len(group), best == key, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_groups(spark, keep):
    found = exact_dedup.exact_groups(docs(spark), keep=keep).collect()
    assert sorted(map(tuple, found), key=str) == brute([r[:2] for r in AWKWARD], keep)
    assert exact_dedup.exact_groups(docs(spark, []), keep=keep).count() == 0


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_any_number_of_rounds(spark, rounds):
    rows = [(i, f"text {i % 37}") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    merged = exact_dedup.tree_merge(exact_dedup.digested(df, "doc_id", df.text), rounds=rounds).collect()
    assert sorted((r.low, r.high, r.copies) for r in merged) == sorted(
        (i, max(range(i, 500, 37)), len(range(i, 500, 37))) for i in range(37)
    )


def test_own_normalisation(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], "doc_id long, text string")
    text = F.lower(F.regexp_replace("text", r"\s+", " "))
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(df, text=text).collect()} == {1: 1, 2: 1, 3: 3}
