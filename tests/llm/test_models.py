"""Language identification, toxicity, token counts and page extraction."""

import html
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veltra.llm import html_extract, langid, token_counts, toxicity
from veltra.llm.tokens import tokenizer_path

from .util import AWKWARD, docs

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    rows = langid.op7_langid(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) < 0.01 * len(rows)


def test_language_of_awkward_rows(spark):
    model = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"), sample_docs=100)
    found = langid.classify(docs(spark), model).collect()
    assert len(found) == len(AWKWARD)
    for r in found:
        letters = {k: any(c.isalpha() for c in t or "") for k, t, *_ in AWKWARD}
        if r.doc_id is not None and not letters[r.doc_id]:
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        elif r.doc_id is not None:
            assert r.lang_pred in model.dictionaries
    kept = langid.accepted(docs(spark), model)
    assert kept.columns == docs(spark).columns and kept.where("text is null").count() == 0
    empty = langid.learn(docs(spark, []))
    assert empty.dictionaries == {} and langid.classify(docs(spark), empty).where("lang_pred = 'und'").count() == len(AWKWARD)
    assert langid.classify(docs(spark, []), model).count() == 0


def test_other_languages_and_junk_are_rejected(spark):
    import base64
    import random

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    predict = langid.Classifier(langid.learn_outside_fold(docs)).predict
    dutch = (
        "De gemeente heeft gisteren besloten dat er volgend jaar meer geld naar het onderwijs gaat, omdat veel scholen al jaren "
        "te weinig leraren hebben. Ook de ouders willen graag dat hun kinderen beter leren lezen en schrijven. De wethouder zei "
        "dat zij binnenkort met een nieuw plan komt, waarin staat hoeveel leraren er bij komen."
    )
    junk = base64.b64encode(random.Random(2).randbytes(1500)).decode()
    assert predict(dutch)[3] and predict(junk)[3]


def test_close_sizes_are_rejected():
    model = langid.Model({"a": b"same words here", "b": b"same words here"})
    assert langid.Classifier(model).predict("same words")[3]


def test_toxicity_of_unseen_documents(spark):
    """On the table with some thousand labels: the smaller ones have two dozen toxic documents to learn from."""
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    seen = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) != 0
    chain = toxicity.fit(docs_, labels.where(seen), toxicity.CATEGORIES)
    assert [x.category for x in chain.links] == ["low_quality", "toxic"] and len(chain.links[1].earlier) == 1
    rows = toxicity.score(docs_, chain).withColumnRenamed("toxic", "pred").join(labels.where(~seen), "doc_id").join(
        docs_.select("doc_id", "text"), "doc_id"
    ).collect()
    insults = re.compile(r"idiot|worthless|pathetic|clown|trash|disgusting|stupid|scum|loser|moron")
    marked = [r for r in rows if r.toxic and len(insults.findall(r.text.lower())) >= 2]
    clean = [r for r in rows if not r.toxic]
    assert len(marked) > 50
    assert sum(r.pred for r in marked) >= 0.95 * len(marked)
    assert sum(r.pred for r in clean) <= 0.005 * len(clean)


def test_chain_feeds_earlier_categories_forward():
    """The second category is the first or a word of its own, with words of the first too rare for the second link alone."""
    rng = np.random.default_rng(0)
    texts, a, b = [], [], []
    for i in range(600):
        mark, own = rng.random() < 0.3, rng.random() < 0.1
        words = {f"w{k}" for k in rng.integers(0, 50, 8)} | ({f"a{i % 7}"} if mark else set()) | ({"own"} if own else set())
        texts.append(words)
        a.append(mark)
        b.append(mark or own)
    chain = toxicity.fit_chain(texts, {"a": np.array(a, float), "b": np.array(b, float)})
    assert chain.links[1].earlier[0] > 0
    p = chain.predict("own")
    assert p[0] < 0.5 < p[1]


def test_toxicity_of_awkward_rows(spark):
    labels = spark.createDataFrame([(0, 1, 0), (5, 0, 1), (5, 0, 0), (None, 1, 1), (99, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs(spark), labels, toxicity.CATEGORIES)
    assert toxicity.score(docs(spark), chain).count() == len(AWKWARD)
    assert toxicity.score(docs(spark, []), chain).count() == 0
    none = toxicity.fit(docs(spark, []), labels, toxicity.CATEGORIES)
    assert none.links == [] and toxicity.score(docs(spark), none).schema == toxicity.score(docs(spark), chain).schema
    some = toxicity.fit(docs(spark), labels.withColumn("quality", F.lit(None)), toxicity.CATEGORIES)
    found = toxicity.score(docs(spark), some).first()
    assert found.p_low_quality is None and found.low_quality is None and found.p_toxic is not None


@pytest.fixture(scope="module")
def unigram():
    from tokenizers import Regex, Tokenizer, models, normalizers, pre_tokenizers

    pieces = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.normalizer = normalizers.Replace(Regex(r"[\t-\r ]+"), " ")
    t.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    return t


def test_counts_are_the_library_s(spark, unigram):
    rows = token_counts.op9_token_counts(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in rows:
        assert r.n_tokens == len(unigram.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_counts_of_awkward_texts(spark, unigram):
    counter = token_counts.UnigramCounter(token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model")), 16)
    texts = ["", " ", " a", "a ", "a  b\n\nc", "日本語 🙂🙂 x\x01", "<s> <0x0A> <unk>", "▁▁ a▁b", "\x85 　x", "aaaaaaaaaaaaaaaaaaaa", "İ ǅ"]
    texts += [t for _, t, *_ in AWKWARD if t]
    assert [counter.count(t) for t in texts] == [len(unigram.encode(t, add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_tokens(docs(spark), tokenizer_path("piece_bpe_32k.model")).count() == len(AWKWARD)
    assert token_counts.count_tokens(docs(spark, []), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_counts_with_ties_and_without_bytes():
    from tokenizers import Tokenizer, models

    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -1.5), ("▁", -1.0)]
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    counter = token_counts.UnigramCounter(pieces)
    rng = np.random.default_rng(2)
    for _ in range(300):
        w = "▁" + "".join(rng.choice(list("abbax"), rng.integers(0, 12)))
        assert counter.word(w) == len(library.encode(w, add_special_tokens=False).ids), w


def article(page):
    """The one layout of the tables, read by its tags."""
    inner = page[page.index("<article>") : page.index("</article>")]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"<(?:/?p|/?h1|article)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_pages_of_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    found = html_extract.op2_html_extract(spark, SF).collect()
    assert len(found) == len(pages)
    for r in found:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_unseen_layouts():
    model = html_extract.default_model()
    right = total = 0
    for page, labels in html_extract.labelled_pages(150, seed=1234):
        nodes = html_extract.parse(page)
        found = [p >= 0.5 for x, p in zip(nodes, model.marginals(nodes)) if x.is_text]
        right, total = right + sum(a == b for a, b in zip(found, labels)), total + len(labels)
    assert right / total > 0.97


def test_a_page_with_every_kind_of_boilerplate():
    page = """<html><head><title>t</title><style>x</style></head><body><header class=site-header><p>Site name</p></header>
    <nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></nav><div class="cookie-notice">We use cookies. Accept?</div>
    <main><article class="post"><h1>A title &amp; more</h1><p>First  paragraph,
    with <a href=x>a link</a> and some text.<div class="ad"><p>Buy now! Great offer.</p></div><p>Second paragraph ends.
    <ul><li>one thing to know.<li>another thing to know.</ul><script>if (a<b) "</p>"</script>
    <form class=newsletter><label>Your mail</label><input><button>Subscribe</button></form></article>
    <section class="comments"><h3>Comments</h3><div class=comment><p>I liked this very much. Thank you!</p></div></section></main>
    <aside class="sidebar"><h3>Related</h3><ul><li><a href=c>Other story</a></li></ul></aside>
    <footer>&copy; 2020 Someone. All rights.</footer></body></html>"""
    assert html_extract.extract(page, html_extract.default_model()).split("\n") == [
        "A title & more",
        "First paragraph, with a link and some text.",
        "Second paragraph ends.",
        "one thing to know.",
        "another thing to know.",
    ]


def test_marginals_are_those_of_all_states():
    """Sum-product against the sum over all assignments of small trees."""
    import itertools
    import math

    model = html_extract.default_model()
    page = "<div class=menu><p>a b</p></div><article><p>Some text. More text.</p><p>x</p></article>"
    nodes = html_extract.parse(page)
    own = [sum(model.weights.get(f, 0.0) for f in fs) for fs in html_extract.features(nodes)]
    total, content = 0.0, [0.0] * len(nodes)
    for states in itertools.product((0, 1), repeat=len(nodes)):
        p = 1.0
        for i, s in enumerate(states):
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, own[i]))))
            p *= q if s else 1 - q
            if i:
                p *= model.edges[html_extract.kind(nodes[i])][states[nodes[i].parent]][s]
        total += p
        for i, s in enumerate(states):
            content[i] += p * s
    assert np.allclose(model.marginals(nodes), [c / total for c in content])


@pytest.mark.parametrize("page", [None, "", "   ", "plain text only.", "<", "<p", "<p>a<b>c", "</p></div>", "<!--", "<script>x", "<a href='x", "<div>" * 3000 + "x", "<p title=\"a'b\">q</p>" * 50])
def test_broken_pages(page):
    assert isinstance(html_extract.extract(page, html_extract.default_model()), str)


def test_extraction_of_awkward_rows(spark):
    rows = [(1, None, None, "old"), (None, "u", "<article><p>Some words here.</p></article>", "old"), (2, "u", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit("x"))
    found = html_extract.extract_pages(pages, html_extract.default_model()).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in found) == [("1", "", 0), ("2", "", 0), ("None", "Some words here.", 16)]
    assert html_extract.extract_pages(pages.limit(0), html_extract.default_model()).count() == 0


def runs(page):
    return [x.text for x in html_extract.parse(page) if x.is_text]


def test_markup_is_read_by_its_own_rules():
    assert runs("<p>a \" b</p><a title='x > y' href=/z>the chart</a>") == ['a " b', "the chart"]
    assert runs("<p>The area is <math><mi>x</mi></math> squared") == ["The area is x squared"]
    assert runs("<div>x<div hidden>no<p>no</p></div>y<p style='display: none'>no</p><p style='overflow: hidden'>z") == ["x", "y", "z"]
    assert runs("<noscript>a</noscript> <object>b</object> <canvas>c</canvas>") == ["a b c"]
    assert runs("1 < 2 <!-- > --><p title=\"it's\">ok</p>z</ p>") == ["1 < 2", "ok", "z</ p>"]
    assert runs('<i b="c>no end of a quote</i>') == ["no end of a quote"]
    names = [x.names for x in html_extract.parse("<div data-id=menu style='overflow: hidden' class='siteHeader top'>x") if x.tag == "div"]
    assert names == [("site", "header", "top")]


@pytest.mark.parametrize(
    "page", ["a<b " * 60000, "<p>x<i>y" * 20000, "<div>" * 40000 + "x", "<i>" * 60000, "<a b='" * 40000, "</script " * 30000, "<" * 300000,
             "<a " + " " * 300000, "<table><tr><td>a" * 20000, "<div>" * 30000 + "</p>" * 30000, "<script>" * 20000, "<!--" * 60000]
)
def test_bad_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_extract.parse(page)
    assert time.process_time() - began < 3


def test_languages_against_plain_compression(spark):
    """Every document once more with the library's own calls, one at a time."""
    import zstandard

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = langid.learn_outside_fold(table)
    learned = [r for r in table.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None]
    for lang, words in model.dictionaries.items():
        own = [r.text.lower() for r in learned if r.lang == lang and len(r.text) <= 1000]
        assert sorted(words.decode().split("\n")) == sorted("\n".join(own).split("\n"))  # few enough to be all of them

    def size(text, lang):
        raw = text.lower().encode()
        raw = b" ".join([raw] * 4) if len(raw) < 256 else raw
        d = zstandard.ZstdCompressionDict(model.dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        total = 0
        for at in range(0, len(raw), 4096):
            c = zstandard.ZstdCompressor(level=11, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            total += len(c.compress(raw[at : at + 4096]))
        return total

    same = 0
    rows = table.collect()
    found = {r.doc_id: r for r in langid.classify(table, model).collect()}
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert found[r.doc_id].lang_pred == "und"
            same += 1
            continue
        sizes = {lang: size(r.text, lang) for lang in sorted(model.dictionaries)}
        best, second = sorted(sizes.values())[:2]
        same += sizes[found[r.doc_id].lang_pred] == best
        assert found[r.doc_id].rejected == ((second - best) / second < langid.MIN_MARGIN) or abs((second - best) / second - langid.MIN_MARGIN) < 0.01
    assert same >= 0.99 * len(rows)


def plain_logistic(x, y, l2):
    """Newton's method on a dense matrix; the last column is the bias."""
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, l2), 1e-6)
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        w = w - np.linalg.solve(h, x.T @ (p - y) + penalty * w)
    return w


def test_chain_against_a_plain_one():
    """Two links by Newton's method on dense matrices, the second with log-odds of models that didn't see the document."""
    rng = np.random.default_rng(4)
    texts = [{f"w{k}" for k in range(6) if rng.random() < 0.4} for _ in range(300)]
    a = np.array([("w0" in t) ^ (rng.random() < 0.2) for t in texts], float)
    b = np.array([((a[i] > 0) or "w1" in t) ^ (rng.random() < 0.15) for i, t in enumerate(texts)], float)
    words = toxicity.vocabulary_of(texts, 3, 100)
    x = np.array([[w in t for w in words] for t in texts], float)

    def fit(x, y, use, extra):
        total, positive, share = use.sum(), (use * y).sum(), (x * use[:, None]).sum(0) / use.sum()
        spread = np.sqrt(positive * (1 - positive / total) * share * (1 - share))
        good = np.abs((x * (use * y)[:, None]).sum(0) - positive * share) >= toxicity.MIN_Z * spread
        m = np.column_stack([x * good, extra, np.ones(len(x))])
        w = plain_logistic(m[use > 0], y[use > 0], 0.3)
        w[: x.shape[1]] *= good
        return w

    none, every, fold = np.zeros((300, 0)), np.ones(300), np.arange(300) % 5
    first = fit(x, a, every, none)
    odds = np.zeros(300)
    for f in range(5):
        w = fit(x, a, (fold != f).astype(float), none)
        odds[fold == f] = (np.column_stack([x, np.ones(300)]) @ w)[fold == f]
    second = fit(x, b, every, odds[:, None])
    chain = toxicity.fit_chain(texts, {"a": a, "b": b})
    for r in texts[:100]:
        row = np.array([w in r for w in words], float)
        own = min(30, max(-30, row @ first[: len(words)] + first[-1]))
        # A document's words as the library sees them.
        text = " ".join(sorted(r))
        z = row @ second[: len(words)] + second[len(words)] * own + second[-1]
        got = [own_ for own_ in predict_words(chain, r)]
        assert got[0] == pytest.approx(1 / (1 + np.exp(-own)), abs=1e-3) and got[1] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-3), text


def predict_words(chain, words):
    """A chain's probabilities of a set of features."""
    odds = []
    for link in chain.links:
        z = link.bias + sum(link.weights.get(w, 0.0) for w in words) + sum(w * o for w, o in zip(link.earlier, odds))
        odds.append(max(-30.0, min(30.0, z)))
    return [1 / (1 + np.exp(-z)) for z in odds]


def test_tokens_of_a_text_without_spaces(unigram):
    """The ring of positions holds as far back as the longest piece."""
    rng = np.random.default_rng(6)
    counter = token_counts.UnigramCounter(token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model")))
    for text in ("".join(rng.choice(list("abcdefghitnoe語言é"), 5000)), "thequickbrownfox" * 400):
        assert counter.count(text) == len(unigram.encode(text, add_special_tokens=False).ids)
    assert not any(len(w) > token_counts.LONGEST for w in counter.cache)
