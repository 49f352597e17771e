"""Nearest neighbours with a vantage-point tree per shard.

Pivots (rows of lowest hash, at most PIVOT_BYTES of them) cut space into cells; a cell's rows are dealt by id hash to
shards of about SHARD_ROWS, so a cell with a third of all rows is many shards.  Each shard builds one tree (vantage
point, median radius, two halves, down to leaves of LEAF rows); a subtree is skipped when the triangle inequality's
lower bound, times `factor`, exceeds the query's tenth distance so far.  factor 1 is exact; larger factors skip more.

A query first asks one shard of its own cell; the tenth distance found there bounds the second round, which asks only
shards of cells that the triangle inequality (times `factor`) lets hold something nearer.  Rows go to their shard
once; a shard's queries stream past its tree, so a task holds one shard and one batch.  A shard asked by over
QUERY_ROWS queries is copied once for every QUERY_ROWS of them.

Distances are Euclidean, in double precision, on the vectors as given; ties go to the smaller vec_id.  Defined cases:
vectors that are null, empty, zero or hold null or non-finite components take no part, on either side; vectors of
different length are never compared; rows with the query's own vec_id are no candidates, so repeated rows of one id
are not each other's neighbours; a repeated query is asked once; extra columns are not read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import batch_rows, clean, matrix, pivots

SHARD_ROWS, QUERY_ROWS, LEAF = 4096, 65536, 96
#: Rows a pivot stands for, the pivots' bytes a length, and those of a block of distances.
PIVOT_ROWS, PIVOT_BYTES, SLICE_BYTES = 2048, 32 << 20, 16 << 20
#: Partitions that shards are dealt to, at most; a partition takes its shards one after another.
MOST_PARTS = 1 << 14
FACTOR = 1.0


class Tree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order = np.lexsort((ids,))
        self.ids, self.x, self.leaf = ids[order], x[order], leaf
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        # The vantage point: of a few rows, the one whose distances to the others spread most.
        tried = rows[:: max(1, len(rows) // 5)][:5]
        apart = [np.sqrt(((self.x[rows] - self.x[t]) ** 2).sum(1)) for t in tried]
        best = int(np.argmax([d.std() for d in apart]))
        point, d = tried[best], apart[best]
        by = np.argsort(d, kind="stable")
        half = len(rows) // 2
        near, far = by[:half], by[half:]
        if d[by[0]] == d[by[-1]]:  # all alike: no split helps, but leaves stay small
            return [point, (d[by[0]], d[by[-1]]), (d[by[0]], d[by[-1]]), self._build(rows[near]), self._build(rows[far])]
        return [point, (d[near].min(), d[near].max()), (d[far].min(), d[far].max()), self._build(rows[near]), self._build(rows[far])]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float = FACTOR, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(distances, ids), each (queries, k), padded with infinity and the largest id.  Nothing beyond a query's
        limit is looked for."""
        self.q, self.own, self.k, self.factor = q, own, k, factor
        self.limit = np.full(len(q), np.inf) if limit is None else limit
        self.best = np.full((len(q), k), np.inf)
        self.who = np.full((len(q), k), np.iinfo(np.int64).max)
        self._visit(self.root, np.arange(len(q)))
        return self.best, self.who

    def _visit(self, node, asked: np.ndarray) -> None:
        if not len(asked):
            return
        if isinstance(node, np.ndarray):
            size = max(1, SLICE_BYTES // max(1, 8 * len(node) * self.x.shape[1]))
            for at in range(0, len(asked), size):
                self._leaf(node, asked[at : at + size])
            return
        point, near, far, left, right = node
        d = np.sqrt(((self.q[asked] - self.x[point]) ** 2).sum(1))
        first = d <= (near[1] + far[0]) / 2
        for turn in (0, 1):
            for child, (low, high), here in ((left, near, first), (right, far, ~first)):
                mine = here if turn == 0 else ~here
                a, da = asked[mine], d[mine]
                bound = np.maximum(np.maximum(low - da, da - high), 0.0)
                self._visit(child, a[bound * self.factor <= np.minimum(self.best[a, -1], self.limit[a]) * (1 + 1e-12) + 1e-9])

    def _leaf(self, rows: np.ndarray, asked: np.ndarray) -> None:
        d = np.sqrt(((self.q[asked][:, None, :] - self.x[rows][None, :, :]) ** 2).sum(2))
        ids = self.ids[rows]
        d[self.own[asked][:, None] == ids[None, :]] = np.inf
        all_d = np.concatenate([self.best[asked], d], 1)
        all_i = np.concatenate([self.who[asked], np.broadcast_to(ids, d.shape)], 1)
        all_i[np.isinf(all_d)] = np.iinfo(np.int64).max
        order = np.lexsort((all_i, all_d), axis=1)[:, : self.k]
        self.best[asked], self.who[asked] = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)


def _answers(rows: DataFrame, k: int, factor: float) -> DataFrame:
    """rows(shard, part, ask, limit, __id, __vec) of both kinds to (query_id, vec_id, score).  A partition's rows come
    shard by shard, those that make the tree before those that ask."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, tree = None, [], None
        for frame in frames:
            for (shard, part, ask), same in frame.groupby(["shard", "part", "ask"], sort=True):
                if (shard, part) != at:
                    at, held, tree = (shard, part), [], None
                if not ask:
                    held.append(same[["__id", "__vec"]])
                    continue
                if not held:
                    continue
                if tree is None:
                    base = pd.concat(held)
                    tree = Tree(base["__id"].to_numpy(), matrix(base["__vec"]))
                ids = same["__id"].to_numpy()
                d, who = tree.search(matrix(same["__vec"]), ids, k, factor, same["limit"].to_numpy())
                ok = np.isfinite(d)
                yield pd.DataFrame({"query_id": np.repeat(ids, k)[ok.ravel()], "vec_id": who[ok], "score": d[ok]})

    return rows.mapInPandas(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_: str = "vec_id", vec: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows, nearest first."""
    spark = rows.sparkSession
    base = clean(rows, id_, vec)
    asked = clean(queries, id_, vec).dropDuplicates(["__id"])
    marks = spark.sparkContext.broadcast(pivots(base.select("__vec"), lambda d: pivot_rows, PIVOT_BYTES))  # at most PIVOT_BYTES a length

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, same in frame.groupby(frame["__vec"].map(len)):
                p = marks.value.get(int(d))
                size = batch_rows(0 if p is None else len(p))
                for at in range(0, len(same), size):
                    part = same.iloc[at : at + size]
                    cell, far = np.zeros(len(part), np.int32), np.zeros(len(part))
                    if p is not None:
                        apart = _apart(matrix(part["__vec"]), p)
                        cell = apart.argmin(1).astype(np.int32)
                        far = apart[np.arange(len(part)), cell]
                    yield part.assign(dim=np.int32(d), cell=cell, far=far)

    placed = "__id long, __vec array<double>, dim int, cell int, far double"
    held = stored(base.mapInPandas(place, placed), "cells")
    asked = stored(asked.mapInPandas(place, placed), "queries")
    # One row a cell: bounded as the pivots are.
    sizes = held.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()
    first, cells = 0, {}
    for r in sorted(sizes):
        shards = -(-r["n"] // shard_rows)
        cells.setdefault(r["dim"], []).append((r["cell"], first, shards, r["radius"]))
        first += shards
    shape = spark.createDataFrame([(d, c, f, m) for d, v in cells.items() for c, f, m, _ in v], "dim int, cell int, first long, shards int")
    spread = lambda seed: (F.col("first") + F.pmod(F.xxhash64("__id", F.lit(seed)), F.col("shards"))).cast("long")
    base = held.join(F.broadcast(shape), ["dim", "cell"]).select(spread(1).alias("shard"), "__id", "__vec")

    def ask(routed: DataFrame) -> DataFrame:
        """routed(shard, limit, __id, __vec) with each shard's rows."""
        routed = stored(routed, "asked")
        many = routed.groupBy("shard").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / query_rows).cast("int")).select("shard", "parts")
        parted = lambda df, part: df.join(many, "shard").withColumn("part", part)
        left = parted(base, F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("shard", "part", F.lit(False).alias("ask"), F.lit(0.0).alias("limit"), "__id", "__vec")
        right = parted(routed, F.pmod(F.xxhash64("__id", F.lit(2)), F.col("parts")).cast("int")).select("shard", "part", F.lit(True).alias("ask"), "limit", "__id", "__vec")
        parts = max(8, min(MOST_PARTS, first))
        both = left.unionByName(right).repartition(parts, "shard", "part").sortWithinPartitions("shard", "part", "ask")
        return stored(_answers(both, k, factor), "found")

    own = asked.join(F.broadcast(shape), ["dim", "cell"]).select("__id", "__vec", "dim", "cell", spread(3).alias("shard"))
    one = ask(own.select("shard", F.lit(float("inf")).alias("limit"), "__id", "__vec"))
    limit = one.groupBy(F.col("query_id").alias("__id")).agg(F.max("score").alias("limit"), F.count("*").alias("n")).select("__id", F.when(F.col("n") >= k, F.col("limit")).alias("limit"))
    bounded = own.join(limit, "__id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for d, same in frame.groupby("dim"):
                known, p = cells.get(int(d), []), marks.value.get(int(d))
                if not known:
                    continue
                number, begin, shards, radius = (np.array(c) for c in zip(*known, strict=True))
                size = batch_rows(len(number))
                for at in range(0, len(same), size):
                    part = same.iloc[at : at + size]
                    near = np.ones((len(part), len(number)), bool)
                    if p is not None:
                        x = matrix(part["__vec"])
                        low = np.maximum(_apart(x, p)[:, number] - radius[None, :], 0.0)
                        room = 1e-6 * (np.sqrt((x * x).sum(1)).max() + np.sqrt((p * p).sum(1)).max())
                        near = low * factor <= part["limit"].to_numpy()[:, None] * (1 + 1e-9) + room
                    i, j = np.nonzero(near)
                    for s in range(int(shards.max())):
                        some = shards[j] > s
                        to = begin[j[some]] + s
                        out = part.iloc[i[some]].assign(to=to)
                        yield out[out["to"] != out["shard"]][["to", "limit", "__id", "__vec"]]

    rest = bounded.mapInPandas(route, "to long, limit double, __id long, __vec array<double>").withColumnRenamed("to", "shard")
    return _top(one.unionByName(ask(rest)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _apart(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, a little off as sums of squares are; users of them allow for that."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * (x @ p.T), 0.0))


def digest(rows: DataFrame, **how) -> DataFrame:
    return nearest(rows, rows.where("vec_id % 100 = 0"), **how)
