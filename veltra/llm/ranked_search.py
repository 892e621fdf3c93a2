"""Ranked lexical search: an index of compressed postings in shards, searched document at a time.

**Index.** Each task cuts its documents into shards of about ``postings`` postings, whole documents each. Within a shard
documents are numbered in the order of their ids. A row is a term of a shard with its posting list: gaps of document
numbers and term frequencies, in bytes of seven bits. One more row a shard (term null) holds the ids and lengths of its
documents. Nothing is shuffled; the rows are written to the shared folder. Memory is that of one shard, whatever the
length of a text, which is read in pieces.

**Search.** The lists of query terms go to the task of their shard. There an item's lists are merged by a heap of blocks
of postings, keyed by the first document of each list that isn't read yet: all documents before the top of the heap are
complete, get their score and are offered to the item's result heap (k entries, worst on top: score, then id), which is
kept over all shards of the task. A shard whose lists cannot reach the worst of a full heap is passed over. The heaps of
all tasks, k rows an item at most, are then merged.

Items are dealt into blocks of ITEMS, each searched by itself, so that neither the driver nor a task holds more, however
many there are. Scores are 64-bit integers throughout.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .postings import packed, pieces, unpacked
from .shared import broadcast_if_small, cut, giving_back, short_batches, table, written

#: Postings of a shard; a shard is larger by the last batch, or by one long document.
POSTINGS = 1 << 20
#: Items that are searched together, and postings of a list that go through the heap together.
ITEMS, BLOCK = 2000, 512
#: Rows of query terms that are broadcast to the index at most.
BROADCAST_ROWS = 200_000

INDEX = "shard long, term binary, df long, total long, postings binary"
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int64()), ("total", pa.int64()), ("postings", pa.binary())])


class _Shard:
    """Documents and postings of a shard in the making."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[np.ndarray] = []
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        base, n = len(self.ids), np.zeros(len(texts), np.int64)
        self.ids += ids.to_pylist()
        for lo, hi, terms, which in pieces(texts):
            n[lo:hi] += np.bincount(which, minlength=hi - lo)
            own = terms.dictionary_encode()
            codes = np.asarray(own.indices).astype(np.int64)
            pairs, tf = np.unique(codes * (hi - lo) + which, return_counts=True)
            number = np.array([self.terms.setdefault(t, len(self.terms)) for t in own.dictionary.to_pylist()], np.int64)
            self.found.append((number[pairs // (hi - lo)], pairs % (hi - lo) + (base + lo), tf))
            self.size += len(pairs)
        self.lengths.append(n)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        lengths = np.concatenate(self.lengths)
        absent = np.array([x is None for x in self.ids])
        ids = np.array([x or 0 for x in self.ids], np.int64)
        order = np.lexsort((ids, absent))
        order = order[lengths[order] > 0]  # documents without terms aren't numbered
        number = np.full(len(ids), -1, np.int64)
        number[order] = np.arange(len(order))
        head = np.concatenate((ids[order], lengths[order], [int(absent[order].sum())])).tobytes()
        yield self._batch([shard], [None], [len(order)], [int(lengths.sum())], pa.array([head], pa.binary()))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.found, strict=True))
        names = pa.array(list(self.terms), pa.binary())
        in_order = np.asarray(pc.array_sort_indices(names))
        rank = np.empty(len(in_order), np.int64)
        rank[in_order] = np.arange(len(in_order))
        key = rank[term] * len(order) + number[doc]
        at = np.argsort(key, kind="stable")
        key, tf = key[at], tf[at]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))  # a long document comes in pieces
        key, tf = key[first], np.add.reduceat(tf, first)
        term, doc = key // len(order), key % len(order)
        lists = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        gap = doc - np.concatenate(([0], doc[:-1]))
        gap[lists] = doc[lists]
        data, ends = packed(np.column_stack((gap, tf)).ravel())
        df, total = np.diff(np.append(lists, len(term))), np.add.reduceat(tf, lists)
        offsets = ends[2 * np.append(lists, len(term))].astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        whole = self._batch(np.full(len(lists), shard), names.take(pa.array(in_order)), df, total, blobs)
        for i in range(0, len(lists), 20_000):
            yield whole.slice(i, 20_000)

    @staticmethod
    def _batch(shard, term, df, total, blobs) -> pa.RecordBatch:
        ints = [pa.array(x, pa.int64()) for x in (shard, df, total)]
        term = term if isinstance(term, pa.Array) else pa.array(term, pa.binary())
        return pa.RecordBatch.from_arrays([ints[0], term, ints[1], ints[2], blobs], schema=_INDEX)


def _shards(postings: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            shard.add(batch.column(0), batch.column(1))
            if shard.size >= postings:
                yield from shard.rows(name)
                name, shard = name + 1, _Shard()
        yield from shard.rows(name)

    return lambda batches: giving_back(run(batches))


def write_index(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", postings: int = POSTINGS) -> DataFrame:
    """The index of docs, written to path (or the shared folder) and read back.

    Null texts and texts without terms aren't in it. Ids are integers; rows without an id are indexed like others, and rows
    that repeat an id, or a whole row, are documents each. Other columns of docs are not read.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(_shards(postings), INDEX), "index", path)


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, id, text) -> (item, id, term): the distinct terms of each item."""
    for batch in batches:
        found: dict[int, set[bytes]] = defaultdict(set)
        for lo, _, terms, which in pieces(batch.column(2)):
            for t, i in zip(terms.to_pylist(), which.tolist(), strict=True):
                found[lo + i].add(t)
        at = [i for i, terms in found.items() for _ in terms]
        terms = pa.array([t for terms in found.values() for t in sorted(terms)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)), terms], ["item", "id", "term"])


def documents_in_order(lists: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """lists of (document numbers, ascending, and what each adds) -> whole documents with their sums, in order, some at a
    time. The heap holds the next block of each list by its first document."""
    heap = [(int(docs[0]), i, 0) for i, (docs, _) in enumerate(lists) if len(docs)]
    heapq.heapify(heap)
    docs, adds, held, room = [], [], 0, max(8192, 2 * block * len(lists))
    while heap:
        _, i, at = heap[0]
        own, part = lists[i]
        docs.append(own[at : at + block])
        adds.append(part[at : at + block])
        held += len(docs[-1])
        if at + block < len(own):
            heapq.heapreplace(heap, (int(own[at + block]), i, at + block))
        else:
            heapq.heappop(heap)
        if held < room and heap:
            continue
        d, a = np.concatenate(docs), np.concatenate(adds)
        order = np.argsort(d, kind="stable")
        d, a = d[order], a[order]
        whole = np.searchsorted(d, heap[0][0]) if heap else len(d)
        if whole:
            first = np.flatnonzero(np.concatenate(([True], d[1:whole] != d[: whole - 1])))
            yield d[first], np.add.reduceat(a[:whole], first)
        docs, adds, held = [d[whole:]], [a[whole:]], len(d) - whole


def _offer(best: list[tuple[int, int, int]], k: int, scores: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
    """Offers documents to a heap of k entries: (score, 1 if there is an id, the id turned round), the worst on top."""
    good = scores >= best[0][0] if len(best) == k else scores > 0
    scores, ids, absent = scores[good], ids[good], absent[good]
    for i in np.lexsort((ids, absent, -scores))[:k].tolist():
        entry = (int(scores[i]), int(not absent[i]), -int(ids[i]))
        if len(best) < k:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        else:
            break


def _search(k: int, n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by block, shard and term (null first) -> the k best of each item over the shards of the task."""

    def searched(head: bytes, lists: list, best: dict) -> None:
        raw = np.frombuffer(head, np.int64)
        n = len(raw) // 2
        ids, lengths, absent = raw[:n], raw[n : 2 * n], np.arange(n) >= n - int(raw[-1])
        m = 50 + (50 * lengths * n_docs) // n_terms
        by_item = defaultdict(list)
        for data, w, items in lists:
            pairs = unpacked(data).reshape(-1, 2)
            docs, tf = np.cumsum(pairs[:, 0]), pairs[:, 1]
            adds = w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[docs]))
            most = int(adds.max())
            for item in items:
                by_item[item["item"], item["id"]].append((most, docs, adds))
        for item, own in by_item.items():
            heap = best[item]
            if len(heap) == k and sum(x[0] for x in own) < heap[0][0]:
                continue
            for docs, scores in documents_in_order([x[1:] for x in own]):
                _offer(heap, k, scores, ids[docs], absent[docs])

    def results(best: dict) -> pa.RecordBatch:
        flat = [(*item, -x if there else None, score) for item, heap in best.items() for score, there, x in heap]
        columns = list(zip(*flat, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item", "id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, lists, best = (None, None), b"", [], defaultdict(list)
        for batch in batches:
            for block, shard, term, data, w, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (block, shard) != now:
                    if lists:
                        searched(head, lists, best)
                    if block != now[0]:
                        yield results(best)
                        best.clear()
                    now, head, lists = (block, shard), b"", []
                if term is None:
                    head = data
                else:
                    lists.append((data, w, items))
        if lists:
            searched(head, lists, best)
        yield results(best)

    return lambda batches: giving_back(run(batches))


def search(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", items: int = ITEMS) -> DataFrame:
    """The k best documents of each row of queries with a score above 0: id_col, rank (from 1), doc_id, score; equal scores
    by ascending id, documents without an id last.

    Each row of queries is an item, those that repeat an id or have none, too. Items without terms (null, empty) and an
    empty index give no rows. Other columns of queries are not read.
    """
    spark = index.sparkSession
    short_batches(spark)
    n_docs, n_terms = index.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    rows = cut(queries.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")))
    blocks = -(-rows.count() // items) or 1
    terms = cut(rows.mapInArrow(_query_terms, "item long, id long, term binary"))
    lists = index.where("term is not null")
    df = lists.select("term", "df").join(broadcast_if_small(terms.select("term").distinct(), BROADCAST_ROWS), "term").groupBy("term").agg(F.sum("df").alias("n"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("n") + 1))).cast("long")
    wanted = terms.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block"), "term").agg(F.collect_list(F.struct("item", "id")).alias("items"))
    wanted = cut(wanted.join(df.select("term", weight.alias("w")), "term").where("w > 0"))
    own = lists.join(broadcast_if_small(wanted, BROADCAST_ROWS), "term").select("block", "shard", "term", "postings", "w", "items")
    heads = index.where("term is null").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "term", "postings", F.lit(0).cast("long").alias("w"), F.lit(None).cast(own.schema["items"].dataType).alias("items")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.unionByName(heads).repartition(n, "block", "shard").sortWithinPartitions("block", "shard", "term")
    found = dealt.mapInArrow(_search(k, int(n_docs), max(1, int(n_terms))), "item long, id long, doc_id long, score long")
    best_first = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias(id_col), "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(write_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


QUERIES = {"op11_ranked_search": op11_ranked_search}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLES = {
    "op11_ranked_search": f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
    sized AS (SELECT r, doc_id, terms, len(terms) AS n FROM docs WHERE len(terms) > 0),
    corpus AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM sized),
    postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM sized) GROUP BY r, term),
    weights AS (
        SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, corpus GROUP BY term, nn
    ),
    items AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS terms FROM benchmark WHERE text IS NOT NULL),
    wanted AS (SELECT DISTINCT i, item_id, unnest(terms) AS term FROM items),
    scored AS (
        SELECT i, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll))))::BIGINT AS score
        FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN sized USING (r), corpus GROUP BY i, item_id, doc_id, r
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
    """,
}
