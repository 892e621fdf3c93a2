import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veltra.llm import line_dedup

from .util import AWKWARD, docs


def bag(a, b):
    """A lower bound of the edits."""
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(spark, rows, k=2, min_chars=20):
    """The rule over all pairs of lines: (id, kept text, n_lines, n_dropped) of each row."""
    judged = [(i, n, x.strip(" \t\r")) for i, t in rows for n, x in enumerate((t or "").split("\n")) if len(x.strip(" \t\r")) >= min_chars]
    texts = sorted({x for _, _, x in judged})
    table = spark.createDataFrame([(x,) for x in texts], "line string").withColumn("h", F.xxhash64("line")) if texts else None
    h = {r.line: r.h for r in table.collect()} if texts else {}
    near = {b for b in texts for a in texts if h[a] < h[b] and abs(len(a) - len(b)) <= k and bag(a, b) <= k and edits(a, b) <= k}
    order = lambda p: (p[0] is not None, p[0] or 0, p[1])
    first = {}
    for i, n, x in judged:
        first[x] = min(first.get(x, (i, n)), (i, n), key=order)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        all_ = t.split("\n")
        kept = []
        for n, raw in enumerate(all_):
            x = raw.strip(" \t\r")
            if len(x) < min_chars or (x not in near and first[x] == (i, n)):
                kept.append(raw)
        out.append((i, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df).collect()), key=str)


def test_awkward_rows(spark):
    rows = [r for r in AWKWARD if r[0] != 7]
    assert found(docs(spark, rows)) == plain(spark, [r[:2] for r in rows])
    out = line_dedup.dedup_lines(docs(spark).withColumn("n_lines", F.lit("x")))
    assert out.count() == len(AWKWARD) and set(docs(spark).columns) <= set(out.columns)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


def test_near_and_equal_lines(spark):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcde é🙂", k=rng.randint(14, 60))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "y"])
            lines.append(rng.choice(["", " "]) + "".join(x) + rng.choice(["", "\r"]))
        rows.append((i, "\n".join(lines)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == plain(spark, rows)


def test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert found(df) == plain(spark, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("k", [1, 2, 3])
def test_automaton_is_the_edit_distance(spark, k):
    rng = random.Random(k)
    pairs = [("", ""), ("a", ""), ("", "abc"), ("🙂é", "é🙂"), ("abc", "abc")]
    for _ in range(300):
        a = "".join(rng.choices("ab🙂", k=rng.randint(0, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", line_dedup.within(F.col("a"), F.col("b"), k).alias("y")).collect()
    assert all(r.y == (edits(r.a, r.b) <= k) for r in rows)


def test_many_variants_of_one_line(spark):
    """Hot lists: variants a word or two apart, of which few are near copies, among many equal lines."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(300)]
    base = rng.choices(words, k=12)
    rows = []
    for i in range(120):
        x = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            x[rng.randrange(12)] = rng.choice(words)
        if rng.random() < 0.3:
            x[3] = x[3] + rng.choice("xyz")
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == plain(spark, rows)


def test_parity_bounds_the_edits(spark):
    rng = random.Random(11)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choices("abcd ", k=rng.randint(20, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "a"])
        pairs.append((a, "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string")
    of = lambda c: line_dedup.parity(line_dedup.wide(F.col(c)))
    assert df.where(F.bit_count(of("a").bitwiseXOR(of("b"))) > 8).count() == 0


def test_a_very_long_line_in_several_documents(spark):
    """Its parity is taken in linear work: 300,000 characters, eight variants."""
    rng = random.Random(12)
    line = "".join(rng.choices("abcdefgh é🙂", k=300_000))
    rows = [(i, line[:150_000] + "xy"[i % 2] * (i % 3) + line[150_000:] + "\nshort") for i in range(8)]
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(len(t) > 1000 for t in kept.values()) == 1
