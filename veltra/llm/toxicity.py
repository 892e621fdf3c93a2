"""Toxicity by a chain of linear classifiers.

Categories are predicted in a fixed order. Each link is a logistic regression over features of the whole text (words,
beginnings of words, shape; present or not) and the log-odds of all earlier categories. A later link is trained with out-of-fold log-odds of the earlier
ones: each training document's come from a model that didn't see it, so that the later link learns how far to trust
predictions, not labels. At prediction, the earlier links trained on all folds feed the later ones.

Fitted on a bounded sample: about ``max_docs`` labelled documents (by a hash of their id) and ``max_words`` features, those
in most sampled documents, which are counted on the cluster; only their numbers come to the driver. Prediction covers
every row and whole texts; a text is read by one task, which holds its words.

A category without any label is unknown: its probability and its flag are null in every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numeric import minimise
from .shared import broadcast_if_small, cut, table, written

MIN_Z = 4.0
WORD = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """The distinct words of the whole text in lower case; their first 6 and 8 letters; first 5 letters that at least
    three distinct words share; and, in steps, the shares of capitals and of characters outside words."""
    text = text or ""
    plain = WORD.findall(text)
    words = set(map(str.lower, plain))
    found = set(words)
    found.update("6^" + w[:6] for w in words if len(w) > 6)
    found.update("8^" + w[:8] for w in words if len(w) > 8)
    found.update("3x" + p for p, c in Counter(w[:5] for w in words if len(w) > 5).items() if c >= 3)
    if plain:
        found.add(f"capitals={10 * sum(map(str.isupper, plain)) // len(plain)}")
        found.add(f"others={20 * (len(text) - sum(map(len, plain))) // len(text)}")
    return found


@dataclass
class Link:
    category: str
    weights: dict[str, float]
    earlier: list[float]
    bias: float


@dataclass
class Chain:
    links: list[Link] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)

    def predict(self, text: str | None) -> list[float]:
        """The probability of each category that has a link, in the chain's order."""
        words, odds = features_of(text), []
        for link in self.links:
            known = words & link.weights.keys()
            z = link.bias + sum(map(link.weights.__getitem__, known)) + sum(w * o for w, o in zip(link.earlier, odds, strict=True))
            odds.append(max(-30.0, min(30.0, z)))
        return [1.0 / (1.0 + math.exp(-z)) for z in odds]


class Design:
    """A sparse 0/1 matrix of documents by words, and dense columns behind it."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, n_docs: int, n_words: int):
        self.rows, self.cols, self.n_docs, self.n_words = rows, cols, n_docs, n_words

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=w[self.cols], minlength=self.n_docs)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, weights=r[self.rows], minlength=self.n_words)


def fit_logistic(x: Design, dense: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float = 1.0, steps: int = 100) -> np.ndarray:
    """Weights of words, dense columns and bias, on the documents in use (0/1), by L-BFGS.

    Words whose association with the label, on those documents, is under MIN_Z standard deviations get no weight: they
    are most of a vocabulary, and together would explain any label.
    """
    n, k = x.n_words, dense.shape[1]
    total, positive = max(1.0, use.sum()), (use * y).sum()
    share = x.transposed(use) / total
    spread = np.sqrt(np.maximum(1e-12, positive * (1 - positive / total) * share * (1 - share)))
    good = (np.abs(x.transposed(use * y) - positive * share) >= MIN_Z * spread) & (share > 0)
    here = good[x.cols]
    x = Design(x.rows[here], x.cols[here], x.n_docs, n)
    penalty = np.concatenate([np.full(n + k, l2), [1e-6]])

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = x.times(w[:n]) + dense @ w[n : n + k] + w[-1]
        r = use * (1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y)
        value = (use * (np.logaddexp(0.0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum()
        return value, np.concatenate([x.transposed(r), dense.T @ r, [r.sum()]]) + penalty * w

    return minimise(loss, np.zeros(n + k + 1), steps)


def vocabulary_of(texts: list[set[str]], min_docs: int, max_words: int) -> list[str]:
    df = Counter(w for t in texts for w in t)
    return sorted((w for w, c in df.items() if c >= min_docs), key=lambda w: (-df[w], w))[:max_words]


def fit_chain(texts: list[set[str]], labels: dict[str, np.ndarray], min_docs: int = 3, max_words: int = 200_000, **options) -> Chain:
    """labels: for each category in the chain's order an array of 0 and 1 (NaN: not labelled, not used for that link)."""
    vocabulary = vocabulary_of(texts, min_docs, max_words)
    index = {w: i for i, w in enumerate(vocabulary)}
    return fit_numbered([[index[w] for w in t if w in index] for t in texts], vocabulary, labels, **options)


def fit_numbered(texts: list[list[int]], vocabulary: list[str], labels: dict[str, np.ndarray], folds: int = 5, l2: float = 0.3) -> Chain:
    """texts: the numbers, in the vocabulary, of each document's features."""
    pairs = [(i, j) for i, t in enumerate(texts) for j in t]
    rows, cols = np.array(pairs, np.int64).reshape(-1, 2).T
    x = Design(rows, cols, len(texts), len(vocabulary))
    fold = np.arange(len(texts)) % folds
    odds, chain = np.zeros((len(texts), 0)), Chain(categories=list(labels))
    for category, y in labels.items():
        known = ~np.isnan(y)
        y = np.nan_to_num(y)
        if not known.any():
            continue
        w = fit_logistic(x, odds, y, known.astype(float), l2)
        n = len(vocabulary)
        weights = {v: float(a) for v, a in zip(vocabulary, w[:n], strict=True) if a}
        chain.links.append(Link(category, weights, w[n:-1].tolist(), float(w[-1])))
        if category == list(labels)[-1]:
            break
        out = np.zeros(len(texts))
        for f in range(folds):
            v = fit_logistic(x, odds, y, (known & (fold != f)).astype(float), l2)
            z = x.times(v[:n]) + odds @ v[n:-1] + v[-1]
            out[fold == f] = np.clip(z, -30, 30)[fold == f]
        odds = np.column_stack([odds, out])
    return chain


def fit(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    id_col: str = "doc_id",
    text_col: str = "text",
    max_docs: int = 5000,
    min_docs: int = 3,
    max_words: int = 200_000,
    **options,
) -> Chain:
    """categories: name -> SQL expression over labels that is 1, 0 or null, in the chain's order.

    Repeated labels of a document count as their largest; labels of unknown documents and null ids are left out. A
    document that stands in docs twice is learned from twice.
    """
    spark, whole = docs.sparkSession, 1 << 30
    rows = labels.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), *[F.expr(e).cast("double").alias(f"y{i}") for i, e in enumerate(categories.values())]
    )
    rows = rows.groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))])
    n = rows.count()
    place = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(whole))
    sample = rows.where(place < F.lit(math.ceil(whole * min(1.0, max_docs / max(1, n))))).collect()
    schema = "id long, " + ", ".join(f"y{i} double" for i in range(len(categories)))
    chosen = spark.createDataFrame([tuple(r) for r in sample], schema)

    def distinct_features(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                words = pa.array([sorted(features_of(x)) for x in part.column(1).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), words, *part.columns[2:]], ["id", "words", *(f"y{i}" for i in range(len(categories)))])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    joined = texts.join(F.broadcast(chosen), "id")  # max_docs rows at most, but for chance
    found = joined.mapInArrow(distinct_features, f"id long, words array<string>, {schema[9:]}")
    # The key is written with the words: beside their explosion it would be made anew for each of them.
    found = written(found.withColumn("text", F.xxhash64("words")), "labelled-words")
    each = found.select("id", "text", F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    kept = cut(counts.orderBy(F.desc("n"), "word").limit(max_words).select("word", F.xxhash64("word").alias("key"), "n"))
    own = kept.toArrow()  # max_words rows at most
    order = sorted(zip(own["word"].to_pylist(), own["key"].to_pylist(), own["n"].to_pylist(), strict=True), key=lambda x: (-x[2], x[0]))
    vocabulary, number = [w for w, _, _ in order], {key: i for i, (_, key, _) in enumerate(order)}
    known = each.distinct().join(broadcast_if_small(kept.select("word", "key"), max_words), "word").groupBy("id", "text").agg(F.collect_list("key").alias("keys"))
    known = known.toArrow()  # a row for each of max_docs documents, with keys of the vocabulary only
    known = {(i, t): [number[k] for k in keys] for i, t, keys in zip(*(known[c].to_pylist() for c in ("id", "text", "keys")), strict=True)}
    found = found.select("id", "text", *[f"y{i}" for i in range(len(categories))]).collect()
    found = sorted(found, key=lambda r: (r.id, r.text))
    ys = {c: np.array([np.nan if r[f"y{i}"] is None else r[f"y{i}"] for r in found], float) for i, c in enumerate(categories)}
    return fit_numbered([sorted(known.get((r.id, r.text), [])) for r in found], vocabulary, ys, **options)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row for each row of docs: id, p_<category> and <category> (whether p is over the threshold) for each category.

    Null and empty texts have no feature and get the bias alone. Of a category without labels both columns are null, so
    that the schema is the same whatever is labelled. An empty table gives an empty result.
    """
    key_field = docs.select(id_col).schema[0]
    link = {x.category: i for i, x in enumerate(chain.links)}
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]):
        predict = shared.value.predict
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                p = np.array([predict(x) for x in part.column(1).to_pylist()]).reshape(part.num_rows, len(link))
                columns, heads = [part.column(0)], [id_col]
                for name in chain.categories:
                    i = link.get(name)
                    columns += [pa.nulls(len(p), pa.float64()), pa.nulls(len(p), pa.bool_())] if i is None else [pa.array(p[:, i]), pa.array(p[:, i] > threshold)]
                    heads += [f"p_{name}", name]
                yield pa.RecordBatch.from_arrays(columns, heads)

    more = "".join(f", `p_{x}` double, `{x}` boolean" for x in chain.categories)
    schema = f"`{id_col}` {key_field.dataType.simpleString()}{more}"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels"), CATEGORIES))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
