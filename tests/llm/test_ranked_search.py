import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from veltra.llm import postings, ranked_search

from .util import AWKWARD, docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string, shard string, w long"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(rows, items, k):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t, *_ in rows if terms(t)]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text, *_ in items:
        scored = []
        for i, c, size in counted:
            m = 50 + (50 * size * n) // total
            w = lambda t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
            score = sum(w(t) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def found(spark, rows, items, k=50, n_items=2000, postings=1 << 20, parts=3):
    index = ranked_search.write_index(docs(spark, rows).repartition(parts), postings=postings)
    q = spark.createDataFrame([(*x, "x", 1) for x in items], ITEMS)
    out = ranked_search.search(index, q, k, items=n_items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, out.collect()), key=str)


def prose(n, seed=0):
    draw = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "naïve", "x1"]
    size = draw.geometric(0.02, n)
    return [(int(i), " ".join(words[min(len(words) - 1, int(j))] for j in draw.zipf(1.3, s)), "en", "a", 0) for i, s in enumerate(size)]


@pytest.mark.parametrize(("cap", "k", "n_items"), [(1 << 20, 50, 2000), (50, 7, 3), (1, 1, 1)])
def test_equals_brute_force(spark, cap, k, n_items):
    rows = prose(400)
    rows += [(1000 + i, rows[5][1], "en", "hot", 0) for i in range(200)]  # a third are copies: ties by id
    items = [(i, rows[7 * i][1]) for i in range(8)] + [(3, "W1 w2, W2! x1 ÉTÉ"), (None, "w9"), (50, ""), (51, None), (52, "absent …")]
    assert found(spark, rows, items, k, n_items, cap) == brute(rows, items, k)


def test_awkward_rows(spark):
    items = [(1, "quick BROWN fox"), (2, "word short"), (3, "größe ΣΑΣ é́")]
    assert found(spark, AWKWARD, items, postings=3) == brute(AWKWARD, items, 50)
    assert found(spark, [], items) == []
    assert found(spark, AWKWARD, []) == []
    assert found(spark, [(1, None, None, None, None), (2, " . ", None, None, None)], items) == []


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(postings, "PIECE", 64)
    texts = ["ab " * 100, None, "", "x" * 500 + " y", "Ünï-çöde " * 40, ",", "tail"]
    got = [[] for _ in texts]
    for lo, _, own, which in postings.pieces(pa.array(texts)):
        for t, i in zip(own.to_pylist(), which.tolist(), strict=True):
            got[lo + i].append(t.decode())
    assert got == [terms(t) for t in texts]
    whole = pa.array(["skip", *texts])[1:]
    assert sum(len(x[2]) for x in postings.pieces(whole)) == sum(map(len, got))


def test_numbers_come_back():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**56, 5])
    data, ends = postings.packed(values)
    assert postings.unpacked(data.tobytes()).tolist() == values.tolist()
    assert postings.unpacked(data[ends[3] : ends[6]].tobytes()).tolist() == [128, 300, 16383]
    assert len(postings.unpacked(b"")) == 0


def test_heap_merge_gives_whole_documents():
    draw = np.random.default_rng(1)
    lists = [(np.sort(draw.choice(50_000, n, replace=False)), draw.integers(1, 9, n)) for n in (1, 40, 9000, 30_000, 0)]
    want = np.zeros(50_000, int)
    for d, a in lists:
        want[d] += a
    got = list(ranked_search.documents_in_order(lists, block=16))
    at, sums = (np.concatenate(x) for x in zip(*got, strict=True))
    assert len(got) > 1 and (np.diff(at) > 0).all()
    assert (at == np.flatnonzero(want)).all() and (sums == want[at]).all()
