import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from veltra.llm import components, simhash_dedup

from .util import AWKWARD, docs

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=4):
    label = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    members = {}
    for k, x in zip(label, ids):
        if x is not None:
            members.setdefault(k, []).append(x)
    return [min(members[k]) if k in members else None for k in label]


def test_fingerprint_is_the_plain_one():
    rng = random.Random(3)
    texts = [x[1] for x in AWKWARD] + [" ".join(rng.choices("a bb CCC Éé ß".split(), k=n)) for n in range(12)]
    assert [simhash_dedup.fingerprint(x) for x in texts] == [plain_fingerprint(x) for x in texts]


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    expected = {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps))}
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.op3_simhash_dedup(spark, SF).collect()}
    assert found == expected


def test_awkward_rows(spark):
    found = simhash_dedup.near_groups(docs(spark)).collect()
    fps = [plain_fingerprint(r[1]) for r in AWKWARD]
    expected = Counter(zip([r[0] for r in AWKWARD], plain_components([r[0] for r in AWKWARD], fps)))
    assert Counter((r.doc_id, r.component_id) for r in found) == expected
    assert simhash_dedup.near_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_links_connect_what_all_pairs_connect(spark, block):
    """Dense clusters, chains and strangers: the links give the components of all pairs within the radius."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(40):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 5)):
                y ^= 1 << b
            fps.add(y)
            x = y if rng.random() < 0.2 else x
    fps = sorted(fps)
    ids = list(range(len(fps)))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(ids, signed)), "node long, fp long")
    place = dict(zip(signed, ids))
    pairs = [(place[r.lo], place[r.hi]) for r in simhash_dedup.links(df.select("fp"), 4, block).collect()]
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in pairs)
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert [found.get(i, i) for i in ids] == plain_components(ids, fps)


@pytest.mark.parametrize("radius", [3, 4, 5, 6])
def test_every_pair_in_reach_shares_enough_posting_lists(spark, radius):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    rows = []
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, radius)):
            y ^= 1 << b
        rows.append(tuple(np.array([x, y], np.uint64).view(np.int64).tolist()))
    df = spark.createDataFrame(rows, "x long, y long")
    a, b = (F.array(*simhash_dedup.posting_keys(F.col(c), radius)) for c in "xy")
    assert df.where(F.size(F.array_intersect(a, b)) < simhash_dedup.fewest_lists(radius)).count() == 0
    assert {3: 10, 4: 4, 5: 1, 6: 1}[radius] == simhash_dedup.fewest_lists(radius)


def test_the_tally_drops_pairs_that_share_too_few_bytes(spark):
    """Three shared bytes are one list of triples, four are four: only the second pair reaches the minimum."""
    df = spark.createDataFrame([(0x0101010101010101,), (0x0202020202010101,), (0x4040404040404040,), (0x4141414140404040,)], "fp long")
    assert {(r.lo, r.hi) for r in simhash_dedup.links(df, 4).collect()} == {(0x4040404040404040, 0x4141414140404040)}


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1000, 1100)] + [(5, i) for i in range(6, 200)] + [(7, 7), (300, 301), (301, 300)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1000 for i in range(1000, 1101)} | {i: 5 for i in range(5, 200)} | {300: 300, 301: 300}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """1 - null - 3 in steps of four bits; null - null apart from them; null beside 9."""
    fps = [(1, 0), (None, 0b1111), (3, 0b11111111), (None, 0xFFFF << 40), (None, 0xFFFFF << 40), (9, -1), (None, -1), (-5, 0xFF << 20)]
    made = spark.createDataFrame(fps, "id long, fp long")
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda *a: made)
    found = simhash_dedup.near_groups(made).collect()
    labels = plain_components([x[0] for x in fps], [x[1] & (1 << 64) - 1 for x in fps])
    expected = Counter((x[0], f"{x[1] & (1 << 64) - 1:016x}", c) for x, c in zip(fps, labels))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == expected
    assert labels == [1, 1, 1, None, None, 9, 9, -5]
