import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veltra.llm import packing, token_store
from veltra.llm.tokens import WordEncoder, tokenizer_path

from .util import AWKWARD, docs

PATH = tokenizer_path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda x: np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_word_encoder_equals_library(plain):
    texts = [x[1] for x in AWKWARD] + ["It's 'd don't a　b\x1cc", "...,", " . ", "a\tb\x0bc", "x.\x01.", "\x01 \x01"]
    for size in (1 << 20, 8):
        assert WordEncoder(PATH, size).encode_batch(texts) == [plain(x) for x in texts]


def check_pieces(rows, expected, capacity=4096):
    """Every id in one piece, sequences gapless and within their capacity."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    for key, ids in expected.items():
        at = 0
        for p in sorted(by_doc[key], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) // 4
            assert p.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + p.length)])
            at += p.length
        assert at == len(ids) // 4
    assert set(by_doc) == set(expected)
    return padding / max(1, sum(r.length for r in rows))


def test_packing_whole_table(spark, plain):
    rows = packing.op4_packing(spark, SF).collect()
    end = np.array([2], "<u4").tobytes()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert check_pieces(rows, {r.doc_id: plain(r.text) + end for r in texts}) < 0.005


def test_packing_awkward_rows(spark, plain):
    rows = [r for r in AWKWARD if r[0] is not None][:-1]
    out = packing.pack_texts(docs(spark, rows), PATH, 2, with_ids=True).collect()
    end = np.array([2], "<u4").tobytes()
    check_pieces(out, {r[0]: plain(r[1]) + end for r in rows})
    assert all(len(r.ids) == r.length for r in out)
    assert packing.pack_texts(docs(spark), PATH, 2).count() >= len(AWKWARD)
    assert packing.pack_texts(docs(spark, []), PATH, 2).count() == 0


def held(rows):
    """(segments, tokens, loss-bearing tokens) of each sequence."""
    sequences = {}
    for r in rows:
        n, tokens, loss = sequences.get(r.sequence_id, (0, 0, 0))
        sequences[r.sequence_id] = (n + 1, tokens + r.length, loss + r.loss_tokens)
    return list(sequences.values())


def test_packing_holds_all_limits(spark):
    limits = packing.Limits(tokens=256, segments=3, loss_tokens=100, max_padding=4)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    out = packing.pack_conversations(turns, PATH, 2, limits).collect()
    found = held(out)
    assert all(n <= 3 and t <= 256 and x <= 100 for n, t, x in found)
    assert any(n == 3 for n, _, _ in found) and any(x == 100 for _, _, x in found) and any(t == 256 for _, t, _ in found)
    whole = {}
    for r in out:
        whole[r.conv_id] = whole.get(r.conv_id, 0) + r.length
    assert all(whole[r.conv_id] == r.doc_tokens for r in out)


def conversations(turns, plain):
    """conv_id -> ids and loss marks; rows without an id one by one, as a sorted list."""
    end = np.array([2], "<u4").tobytes()
    texts, lone = {}, []
    for key, turn, role, text in turns:
        ids = np.frombuffer(plain(text) + end, "<u4")
        if key is None:
            lone.append((ids.tolist(), int(len(ids) * (role == "assistant"))))
        else:
            texts.setdefault(key, []).append((turn is not None, turn or 0, ids, role == "assistant"))
    return texts, sorted(lone)


def test_packing_conversations_awkward_rows(spark, plain, monkeypatch):
    """Nulls in any column, repeated rows, a conversation that goes through all tasks, turns beyond a run's tokens."""
    monkeypatch.setattr(packing, "RUN_TOKENS", 50)
    turns = [(1, 0, "user", "hello there"), (1, 1, "assistant", "hi"), (None, 0, "user", "one"), (None, 0, "assistant", "two two"), (None, 0, "user", "one")]
    turns += [(2, None, None, None), (2, 3, "assistant", "x y z"), (3, 0, "user", ""), (4, 5, None, "a role is missing"), (9, 1, "assistant", "word " * 900)]
    turns += [(7, t, ("user", "assistant")[t % 2], f"turn {t} of a very long talk") for t in range(400)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("start", F.lit("x"))
    limits = packing.Limits(tokens=64, segments=5, loss_tokens=40, max_padding=4)
    out = packing.pack_conversations(df.repartition(3), PATH, 2, limits, with_ids=True).collect()
    assert all(n <= 5 and t <= 64 and x <= 40 for n, t, x in held(out))
    texts, lone = conversations(turns, plain)
    for key, parts in texts.items():
        expected = np.concatenate([x for *_, x, _ in sorted(parts, key=lambda p: p[:2])])
        pieces = sorted((r for r in out if r.conv_id == key), key=lambda r: r.start)
        assert [r.start for r in pieces] == [0, *np.cumsum([r.length for r in pieces])[:-1].tolist()]
        assert [i for r in pieces for i in r.ids] == expected.tolist() and {r.doc_tokens for r in pieces} == {len(expected)}
        assert sum(r.loss_tokens for r in pieces) == sum(len(x) for *_, x, y in parts if y)
    assert sorted((r.ids, r.loss_tokens) for r in out if r.conv_id is None) == lone
    assert packing.pack_conversations(df.limit(0), PATH, 2).count() == 0


def test_packing_conversations_whole_table(spark, plain):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = packing.packing_conversations(spark, SF).collect()
    texts, _ = conversations(turns, plain)
    assert {r.conv_id: r.doc_tokens for r in out} == {k: sum(len(x) for *_, x, _ in v) for k, v in texts.items()}
    assert all(n <= 64 and t <= 4096 and x <= 2048 for n, t, x in held(out))


def test_store_round_trip(spark, plain, tmp_path):
    path, end = str(tmp_path / "store"), np.array([1], "<u4").tobytes()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    token_store.write_store(spark.createDataFrame(texts, "doc_id long, text string"), path, PATH, 1)
    found = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_digests(spark, path).collect()}
    whole = {r.id: bytes(r.payload) for r in token_store.read_documents(spark, path).collect()}
    at = 0
    for key, text in sorted(texts):
        ids = plain(text) + end
        assert found[key] == (at, len(ids) // 4, zlib.crc32(ids))
        assert np.frombuffer(whole[key], "<u2").astype("<u4").tobytes() == ids
        at += len(ids) // 4
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert chunks.agg({"n_ids": "sum"}).first()[0] < at


def test_store_awkward_rows(spark, plain, tmp_path):
    path, end = str(tmp_path / "store"), np.array([1], "<u4").tobytes()
    token_store.write_store(docs(spark), path, PATH, 1)
    rows = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == [None, None, 0, 1, 2, 3, 4, 5, 6, 7, 7]
    assert sorted(r.ids_crc32 for r in rows) == sorted(zlib.crc32(plain(x[1]) + end) for x in AWKWARD)
    empty = str(tmp_path / "empty")
    token_store.write_store(docs(spark, []), empty, PATH, 1)
    assert token_store.read_digests(spark, empty).count() == 0


def test_store_finds_damage(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(docs(spark), path, PATH, 1)
    chunks = spark.read.parquet(f"{path}/chunks")
    chunks.withColumn("payload", F.concat("payload", F.lit(b"\0\0"))).write.parquet(f"{path}/worse")
    (tmp_path / "store" / "chunks").rename(tmp_path / "store" / "good")
    (tmp_path / "store" / "worse").rename(tmp_path / "store" / "chunks")
    with pytest.raises(Exception, match="digest"):
        token_store.read_digests(spark, path).collect()


def test_store_finds_what_is_missing(spark, tmp_path):
    """A chunk, half of the recipes, a part of the manifest that is gone; a chunk or recipes that stand there twice; a
    manifest that was changed."""
    path = tmp_path / "store"
    root = token_store.write_store(spark.read.parquet(f"{SF}/documents.parquet"), str(path), PATH, 1)
    chunks, recipes, manifest = (spark.read.parquet(f"{path}/{x}") for x in ("chunks", "recipes", "manifest"))
    one = bytes(chunks.first().digest)
    other = manifest.withColumn("n_docs", F.col("n_docs") + 1)
    worse = {
        "chunks": [chunks.where(F.col("digest") != one), chunks.unionByName(chunks.where(F.col("digest") == one))],
        "recipes": [recipes.where("id % 2 = 0"), recipes.where("id != 5"), recipes.unionByName(recipes.where("id = 5"))],
        "manifest": [manifest.where("part != 1"), other, manifest.limit(0)],
    }
    assert token_store.read_digests(spark, str(path), root).count() == 200
    with pytest.raises(ValueError, match="root"):
        token_store.read_digests(spark, str(path), b"another")
    for name, tables in worse.items():
        for i, table in enumerate(tables):
            table.write.parquet(f"{path}/worse-{name}-{i}")
            (path / name).rename(path / "good")
            (path / f"worse-{name}-{i}").rename(path / name)
            for read in (token_store.read_digests, token_store.read_documents):
                with pytest.raises(Exception, match="manifest|root|missing"):
                    read(spark, str(path), root).collect()
            (path / name).rename(path / f"worse-{name}-{i}")
            (path / "good").rename(path / name)


def test_store_width(spark, tmp_path):
    few = docs(spark).limit(3)
    for end_id, width in ((1, "u2"), (70_000, "<u2")):
        with pytest.raises(ValueError, match="width"):
            token_store.write_store(few, str(tmp_path / "none"), PATH, end_id, width=width)
    path = str(tmp_path / "wide")
    token_store.write_store(few, path, PATH, 70_000)
    whole = token_store.read_documents(spark, path).collect()
    assert all(np.frombuffer(r.payload, "<u4")[-1] == 70_000 for r in whole)


def test_long_text_without_spaces(plain):
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("语言abc😀é"), 40_000)), "x" * 100_000, "ab,." * 20_000]
    encoder = WordEncoder(PATH)
    assert encoder.encode_batch(texts) == [plain(x) for x in texts]
    assert sum(map(len, encoder.young)) < 1000


def test_crc_combination():
    rng = np.random.default_rng(1)
    texts = [[rng.bytes(int(n)) for n in rng.integers(0, 40, int(k))] for k in rng.integers(0, 6, 50)]
    crcs = [np.array([zlib.crc32(x) for x in t], np.uint32) for t in texts]
    found = token_store.combine_crcs(crcs, [np.array([len(x) for x in t], np.int64) for t in texts])
    assert found.tolist() == [zlib.crc32(b"".join(t)) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_a_tokenizer_that_keeps_white_space_is_refused(name):
    with pytest.raises(ValueError, match="white space"):
        WordEncoder(tokenizer_path(name))
