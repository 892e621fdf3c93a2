import inspect
import random
import re
from collections import Counter

from veltra.llm import decontaminate

from .util import AWKWARD, docs

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", (text or "").lower()) if w]


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def plain(rows, items, similarity=0.8):
    """(id, item): the best cosine over all windows of the item's size."""
    out = {}
    for item, text in items:
        iw = words(text)
        if not iw:
            continue
        k = min(5, len(iw))
        a = shingles(iw, k)
        for i, t in rows:
            w = words(t)
            for s in range(max(1, len(w) - len(iw) + 1)):
                b = shingles(w[s : s + len(iw)], k)
                if b:
                    dot = sum(n * b[x] for x, n in a.items())
                    c = dot / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5
                    if c >= similarity and c > out.get((i, item), 0):
                        out[i, item] = c
    return out


def test_tables(spark):
    d = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    b = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.op5_decontaminate(spark, SF).collect()}
    expected = plain(d, b)
    assert found.keys() == expected.keys() and all(abs(found[x] - expected[x]) < 1e-9 for x in found)


def test_planted_passages(spark):
    """Whole items, items with single words changed, put in or left out; changed too much; items of a few words."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([8, 30, 45, 60])))) for i in range(12)] + [(90, "one two three"), (91, "solo"), (92, None), (93, " ! "), (94, "e1 e2 e3 e4 e5")]
    rows = []
    for i in range(80):
        x = words(rng.choice(items[:12])[1])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            at = rng.randrange(len(x))
            x[at : at + rng.randint(0, 1)] = rng.choice([[], ["zz"], ["yy"]])
        x = [w.upper() + rng.choice(["", ",", "###"]) for w in x]
        before, after = (rng.choices(vocabulary, k=rng.randint(0, 30)) for _ in range(2))
        rows.append((i, " ".join(before + x + after)))
    rows += [(100, "x one  TWO, three y"), (101, "solo"), (102, "e1 e2 e3 e4 e5"), (103, "e1 e2 e3 e4"), (104, None), (105, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.id, r.item_id): r.similarity for r in decontaminate.found_pairs(d, b).collect()}
    expected = plain(rows, items)
    sure = {x for x, c in expected.items() if c > 0.85}
    assert found.keys() <= expected.keys() and sure <= found.keys()
    assert {(100, 90), (101, 91), (102, 94)} <= found.keys()
    kept = {r.doc_id for r in decontaminate.decontaminate(d, b).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in found}


def test_awkward_rows(spark):
    b = spark.createDataFrame([(1, AWKWARD[0][1]), (None, "short"), (3, None)], "item_id long, text string")
    found = decontaminate.found_pairs(docs(spark), b).collect()
    assert sorted((str(r.id), r.item_id, r.start) for r in found) == [("0", 1, 0), ("1", 1, 0), ("None", 1, 0)]
    kept = decontaminate.decontaminate(docs(spark), b)
    assert kept.columns == docs(spark).columns and kept.count() == len(AWKWARD) - 4
    assert decontaminate.found_pairs(docs(spark, []), b).count() == 0
    assert decontaminate.found_pairs(docs(spark), b.limit(0)).count() == 0


def test_rows_of_one_id_are_judged_each_by_itself(spark):
    """Clean rows with the id of a leak stay; and no row's windows hide another's, with an id or without."""
    item = " ".join(f"i{k}" for k in range(30))
    other = " ".join(["i0 i1 i2 i3 i4", *(f"o{k}" for k in range(25))])
    rows = [(i, t) for i in (1, None, 2, 3, 4, 5) for t in (other, item, "clean text of its own")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    kept = decontaminate.decontaminate(d, b).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(r for r in rows if r[0] is not None and r[1] != item)
    assert Counter(r.id for r in decontaminate.found_pairs(d, b).collect()) == Counter([1, None, 2, 3, 4, 5])


def test_items_of_any_length_and_repetition(spark):
    """An item of 70,000 words among others, in a document with some words changed and put in; one of a single word over
    and over; shingles that all items share."""
    rng = random.Random(3)
    long = [f"w{i}" for i in range(70_000)]
    changed = list(long)
    for at in range(500, 70_000, 2000):
        changed[at] = "zz"
    changed.insert(30_000, "put in")
    same = ["over"] * 33_000
    start = "the following are questions about".split()
    items = [(0, " ".join(long)), (1, " ".join(same))] + [(2 + k, " ".join(start + [f"q{k}x{j}" for j in range(20)])) for k in range(30)]
    rows = [(0, " ".join(["before"] * 20 + changed + ["behind"] * 20)), (1, " ".join(same[:100])), (2, " ".join(same + ["over"] * 3))]
    rows += [(10 + k, " ".join(["a", "b"] + start + [f"q{k}x{j}" for j in range(20)] + ["c"])) for k in range(0, 30, 7)]
    rows += [(100 + k, " ".join(start + rng.choices(["e", "f", "g", "h"], k=30))) for k in range(20)]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.id, r.item_id): r.similarity for r in decontaminate.found_pairs(d, b).collect()}
    # Document 1 is one window whose counts point the same way as the item's.
    assert found.keys() == {(0, 0), (1, 1), (2, 1)} | {(10 + k, 2 + k) for k in range(0, 30, 7)}
    assert found[2, 1] == found[1, 1] == 1.0 and 0.9 < found[0, 0] < 1.0


def test_items_that_share_an_id_are_apart(spark):
    one, two = (" ".join(f"{x}{k}" for k in range(12)) for x in "ab")
    b = spark.createDataFrame([(5, one), (5, two), (5, one)], "item_id long, text string")
    d = spark.createDataFrame([(1, one), (2, two), (3, one + " " + two), (4, "c " * 12)], "doc_id long, text string")
    assert sorted((r.id, r.item_id, r.similarity) for r in decontaminate.found_pairs(d, b).collect()) == [(1, 5, 1.0), (2, 5, 1.0), (3, 5, 1.0)]


def test_recall_at_the_threshold(spark):
    """Pairs of all similarities, many near 0.8: the radius finds what verification of everything finds."""
    rng = random.Random(8)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(rng.randint(20, 70)))) for i in range(60)]
    rows = []
    for n in range(300):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((n, " ".join(["x"] * rng.randint(0, 9) + w)))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    every = {(r.id, r.item_id): r.similarity for r in decontaminate.found_pairs(d, b, radius=64).collect()}
    assert {(r.id, r.item_id): r.similarity for r in decontaminate.found_pairs(d, b).collect()} == every
    expected = plain(rows, items)
    assert every.keys() == expected.keys() and all(abs(every[x] - expected[x]) < 1e-9 for x in every)
    assert sum(c < 0.85 for c in every.values()) > 10


def test_items_over_the_tried_windows(spark):
    """Items of 300 words, with blocks put in and left out: windows between two places are tried in steps, or all of them."""
    rng = random.Random(5)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(300))) for i in range(10)]
    rows = []
    for n in range(60):
        w = items[n % 10][1].split()
        for _ in range(rng.randint(0, 3)):
            at, size = rng.randrange(len(w)), rng.randint(1, 30)
            w[at : at + rng.choice([0, size])] = [f"x{rng.random()}" for _ in range(rng.choice([0, size]))]
        rows.append((n, " ".join(["before"] * rng.randint(0, 40) + w + ["behind"] * rng.randint(0, 40))))
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    of = lambda **how: {(r.id, r.item_id): r.similarity for r in decontaminate.found_pairs(d, b, **how).collect()}
    expected, every, some = plain(rows, items), of(tries=None, radius=64), of()
    assert every.keys() == expected.keys() and all(abs(every[x] - expected[x]) < 1e-9 for x in every)
    assert some.keys() == every.keys() and len(every) > 30 and all(some[x] <= every[x] + 1e-12 for x in some)


def test_how_many_pairs_the_index_passes(spark):
    """The figure that README gives: blocks of eight bits within three pass nearly all pairs of fingerprints, the radius less
    than half. Seeds keep the pairs few; the fingerprints lose none within the radius."""
    rng = random.Random(6)
    items = spark.createDataFrame([(i, rng.getrandbits(64) - (1 << 63)) for i in range(40)], "item long, item_fp long")
    index = decontaminate.block_index(items, decontaminate.RADIUS)
    met = {(r.item, r.block, r.value) for r in index.collect()}
    fps = {r.item: r.item_fp & (1 << 64) - 1 for r in items.collect()}
    passed = near = total = 0
    for _ in range(500):
        fp = rng.getrandbits(64)
        for i, own in fps.items():
            total += 1
            close = (fp ^ own).bit_count() <= decontaminate.RADIUS
            found = any((i, k, fp >> 8 * k & 255) in met for k in range(8))
            passed += found
            near += close
            assert found or not close
    assert 0.95 < passed / total < 0.99 and 0.4 < near / total < 0.5


def test_all_windows_are_tried_unless_asked_otherwise():
    for f in (decontaminate.found_pairs, decontaminate.decontaminate):
        assert inspect.signature(f).parameters["tries"].default is None
