import random

import corpus_pipeline
from veltra.llm import near_copies

from .util import AWKWARD, DOCS, docs

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(ids, texts):
    sets = [plain_set(t) for t in texts]
    holders, label = {}, list(range(len(sets)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, s in enumerate(sets):
        common = {}
        for x in s or {None}:
            for j in holders.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            holders[x].append(i)
        for j, n in common.items():
            if not s or n / (len(s) + len(sets[j]) - n) >= 0.8:
                label[root(i)] = root(j)
    first = {}
    for i, x in enumerate(ids):
        if x is not None:
            first[root(i)] = min(x, first.get(root(i), x))
    return [first.get(root(i)) for i in range(len(ids))]


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


def test_the_stage_takes_all_pairs_of_similarity(spark):
    """Texts with 0 to 8 of 200 words changed (0.8 is passed at four), among all others of a table."""
    rng = random.Random(4)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows += [(100000 + 10 * g + k, " ".join(edited(rng, base, rng.randint(0, 8)))) for k in range(4)]
    expected = {i for (i, _), c in zip(rows, plain_groups(*zip(*rows))) if i == c}
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == expected


def test_blocks_and_awkward_rows(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [*AWKWARD, *((50 + k, " ".join(edited(rng, base, rng.randint(0, 5))), "en", "a", 1) for k in range(60))]
    expected = plain_groups([r[0] for r in rows], [r[1] for r in rows])
    for block in (7, 2048):
        found = near_copies.near_copies(docs(spark, rows), block=block).collect()
        assert sorted((r.doc_id or -1, r.component_id) for r in found) == sorted((r[0] or -1, c) for r, c in zip(rows, expected))
    assert near_copies.near_copies(docs(spark, [])).count() == 0


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rows = [(1, "a b c d e f", "en", "a", 1), (2, "A b c d e  f", "en", "a", 1), (2, "quite another text", "en", "a", 1)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, rows[0][1]), (2, rows[2][1])]
