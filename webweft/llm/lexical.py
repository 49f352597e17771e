"""Ranked lexical search with a two-level quantised index.

The index has one row a document: the terms of the queries that it holds, and for each the impact in one byte (how much its
frequency counts in a document of that length, rounded up to a multiple of STEP) beside the exact frequency.  A term's
weight times its bytes bounds what it adds to a score from above; a byte less, from below.  A first reading of terms and
bytes takes each query's k greatest lower bounds; no document whose upper bound is below the least of these can be among the k
best.  A second reading scores in integers, exactly, every document whose upper bound reaches it, ties included.

All of a document's terms are in its row, so bounds and scores are sums within a task; what is shuffled is k rows a query and
task.  Queries are taken in blocks of about QUERIES (a block's terms and weights, whose size is that of its texts, go to every
task); the index is made and read once a block.

Score, all in 64-bit integers but for w: N documents have a term, all have L terms, a document n of them; df documents hold
the term, tf times; w = floor(1000 ln((2N + 2) / (2 df + 1))); m = 10 + (90 n N) div L; the score adds up
w * ((10^9 tf) div (1000 tf + 8 m)) over the query's terms, each once.

Defined cases: a null or empty text has no terms; each row is a document of its own, so repeated rows count and are ranked
each; rows with a null doc_id count in N, L and df but are not ranked; queries with a null id are left out, those that share
an id are one, with the terms of all their texts; queries without a term found have no rows; empty tables give an empty one;
extra columns are not read."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Impacts are multiples of STEP, in one byte; frequencies and lengths never count for a million or more.
STEP = 4096
#: Queries in a block, documents scored at a time, and tasks whose best are put together before the last step.
QUERIES, DOCS, PARTS = 512, 512, 64

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters A-Z (in lower case), digits and characters beyond ASCII, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_KEEP).split()


def impact(tf, m):
    """What the frequency counts for, below a million: integers or arrays of them."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def spread(n, docs: int, total: int):
    """m of documents with n terms."""
    if len(n) and 90 * int(n.max()) * docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * docs // total for x in n], np.int64)
    return 10 + 90 * n * docs // total


class Queries:
    """A block of queries: their terms numbered, and of each number the queries that have it."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        held: dict[int, set[bytes]] = {}
        for i, text in rows:
            held.setdefault(i, set()).update(terms(text))
        self.ids = sorted(held)
        self.number: dict[bytes, int] = {}
        at = [(self.number.setdefault(t, len(self.number)), k) for k, i in enumerate(self.ids) for t in sorted(held[i])]
        at.sort()
        self.query = np.array([k for _, k in at], np.int64)
        self.first = np.searchsorted(np.array([t for t, _ in at], np.int64), np.arange(len(self.number) + 1))
        self.weight = np.zeros(len(self.number), np.int64)

    def weigh(self, docs: int, df: dict[int, int]) -> None:
        for t in range(len(self.weight)):
            self.weight[t] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df.get(t, 0) + 1)))

    def sums(self, size: np.ndarray, term: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
        """For each of `values` (one a posting) times the term's weight: sums by document and query.  size: postings of
        each document.  The sums are integers below 2^53, so adding them up in doubles is exact."""
        n = self.first[term + 1] - self.first[term]
        posting = np.repeat(np.arange(len(term)), n)
        within = np.arange(len(posting)) - np.repeat(np.cumsum(n) - n, n)
        key = np.repeat(np.arange(len(size)), size)[posting] * len(self.ids) + self.query[self.first[term[posting]] + within]
        shape = (len(size), len(self.ids))
        return [np.bincount(key, weights=(self.weight[term] * v)[posting], minlength=shape[0] * shape[1]).reshape(shape) for v in values]


def index(docs: DataFrame, queries: Queries) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row of docs(doc_id, text): n terms in all, and those of the queries."""
    number = docs.sparkSession.sparkContext.broadcast(queries.number)  # the terms of one block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in batches:
            ns, found = [], []
            for t in batch.column(1):
                words = terms(t.as_py())
                ns.append(len(words))
                found.append(sorted(Counter(known[w] for w in words if w in known).items()))
            lists = [pa.array([[p[k] for p in f] for f in found], pa.list_(pa.int32() if k == 0 else pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def quantised(rows: DataFrame, docs: int, total: int) -> DataFrame:
    """The index with `impacts` (array<tinyint>): the byte less 128."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                size, (_, tf) = _flat(part, "terms", "tfs")
                m = np.repeat(spread(part.column("n").to_numpy(), docs, total), size)
                level = -(-impact(tf, m) // STEP) - 128
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(level.astype(np.int8)))], names=[*part.schema.names, "impacts"])

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>, impacts array<tinyint>")


def _flat(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the lists in each row, and the lists' values one after another."""
    columns = [batch.column(c) for c in names]
    size = np.diff(columns[0].offsets.to_numpy()).astype(np.int64)
    return size, [c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in columns]


def _bounds(block: Queries, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    size, (term, level) = _flat(part, "terms", "impacts")
    level += 128
    return tuple(block.sums(size, term, level * STEP, np.maximum((level - 1) * STEP + 1, 0)))


def thresholds(rows: DataFrame, queries: Queries, k: int) -> np.ndarray:
    """Of each query of the block the kth greatest lower bound; 1 where fewer documents have one."""
    held = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        best = np.zeros((k, len(block.ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                best = np.partition(np.concatenate([best, _bounds(block, batch.slice(at, DOCS))[1]]), -k, axis=0)[-k:]
        rank, query = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(best[rank, query].astype(np.int64))], names=["query", "low"])

    found = rows.select("terms", "impacts").mapInArrow(run, "query int, low long")
    lows = _best(found, [F.desc("low")], k).groupBy("query").agg(F.count("*").alias("n"), F.min("low").alias("low")).where(F.col("n") == k).collect()
    out = np.ones(len(queries.ids), np.int64)
    for r in lows:  # one a query of the block
        out[r["query"]] = max(1, r["low"])
    return out


def _best(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows of each query, by groups of tasks before all together."""
    for key in (["query", F.pmod(F.spark_partition_id(), F.lit(PARTS))], ["query"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("rank") <= k)
    return rows


def rescored(rows: DataFrame, queries: Queries, least: np.ndarray, docs: int, total: int, k: int) -> DataFrame:
    """(query, doc_id, score): of each task and query the k best of all documents whose upper bound reaches the query's
    least."""
    held = rows.sparkSession.sparkContext.broadcast((queries, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bar = held.value
        best = np.empty((0, 3), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS):
                part = batch.slice(at, DOCS)
                reach = _bounds(block, part)[0] >= bar
                some = np.flatnonzero(reach.any(axis=1))
                if not len(some):
                    continue
                part = part.take(pa.array(some))
                size, (term, tf) = _flat(part, "terms", "tfs")
                m = np.repeat(spread(part.column("n").to_numpy(), docs, total), size)
                score = block.sums(size, term, impact(tf, m))[0].astype(np.int64)
                doc, query = np.nonzero(reach[some] & (score > 0))
                best = np.concatenate([best, np.stack([query, part.column("doc_id").to_numpy()[doc], score[doc, query]], 1)])
                best = best[np.lexsort((best[:, 1], -best[:, 2], best[:, 0]))]
                rank = np.arange(len(best)) - np.searchsorted(best[:, 0], best[:, 0])
                best = best[rank < k]
        yield pa.RecordBatch.from_arrays([pa.array(best[:, 0].astype(np.int32)), pa.array(best[:, 1]), pa.array(best[:, 2])], names=["query", "doc_id", "score"])

    return rows.mapInArrow(run, "query int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, queries: int = QUERIES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each of items(item_id, text) the k best of docs(doc_id, text), equal scores
    by doc_id."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    blocks = -(-items.count() // queries)
    of = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        block = Queries([tuple(r) for r in items.where(of == b).collect()])  # about `queries` texts
        if not block.number:
            continue
        rows = stored(index(docs, block), "terms")
        total = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not total[0]:
            continue
        held = rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row a term of the block
        block.weigh(total[0], {r["term"]: r["count"] for r in held})
        rows = stored(quantised(rows.where("doc_id is not null and size(terms) > 0"), *total), "impacts")
        found = rescored(rows, block, thresholds(rows, block, k), *total, k)
        best = _best(found, [F.desc("score"), "doc_id"], k)
        names = spark.createDataFrame(list(enumerate(block.ids)), "query int, item_id long")
        out = out.unionByName(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of each item."""
    return ranked(docs, items)
