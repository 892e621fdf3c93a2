import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from veltra.llm import langid
from veltra.llm.tokens import tokenizer_path

from .test_decontaminate import plain as plain_leaks
from .test_line_dedup import plain as plain_lines
from .test_near_copies import plain_groups
from .util import docs

SF = "/root/testdata/sf0.001"


def test_run_against_plain_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    predict = langid.Classifier(langid.learn_outside_fold(table)).predict
    rows = [(r.doc_id, r.text) for r in table.collect() if not predict(r.text)[3]]
    rows = [(i, t) for i, t, *_ in plain_lines(spark, rows)]
    groups = plain_groups([i for i, _ in rows], [t for _, t in rows])  # five-word shingles, Jaccard similarity of 0.8
    rows = [r for r, g in zip(rows, groups) if r[0] == g]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaks = {i for i, _ in plain_leaks(rows, items)}
    rows = [r for r in rows if r[0] not in leaks]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, x in rows}
    found = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
        found[r.doc_id] = found.get(r.doc_id, 0) + r.length
    assert found == {i: len(x) // 4 for i, x in ids.items()}


def test_stages_keep_the_columns_and_take_awkward_rows(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "benchmark", "packing"] and corpus_pipeline.ORACLE_SQL is None
    for rows in (None, []):
        for name, stage in corpus_pipeline.STAGES:
            df = docs(spark) if rows is None else docs(spark, [])
            out = stage(spark, df, SF)
            if name != "packing":
                assert Counter(out.columns) == Counter(df.columns)
            assert out.count() >= 0
