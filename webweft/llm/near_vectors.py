"""Embedding near-dedup: an exact metric range join over pivot cells.

Vectors link at cosine >= 0.95, which on unit vectors is a Euclidean distance of at most sqrt(2 - 2*0.95).
Equal vectors are collapsed to one with a count.  Pivots (vectors of lowest hash) cut space into nearest-pivot
cells; by the triangle inequality a vector can link into another cell only if it lies within that distance of
the plane between both pivots, so it is replicated to exactly those cells (of smaller number: each cross pair
then meets once).  A cell's members are split into blocks of BLOCK_BYTES and every pair of blocks is one task, so
a cell that holds a third of all rows is many tasks.  Tasks return counts per vector and a spanning forest of
their links, never the pairs.

Cosines are taken in double precision on the vectors as given.  Defined cases: vectors that are null, empty,
zero or hold null or non-finite components, and rows with a null id, link with nothing (their component is their
id, and they are kept); vectors of different length do not link; repeated rows link with each other."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .vectors import batch_rows, clean, matrix, pivots, usable

COSINE = 0.95
#: A task holds two blocks; small blocks would be sent to more tasks each.  Products are taken SLICE_ROWS at a time.
BLOCK_BYTES, SLICE_ROWS = 8 << 20, 512
#: Pivots grow with the rows, up to so many bytes of them a length (262,144 of 64 components).
LEAST_PIVOTS, PIVOT_BYTES = 4, 128 << 20


def _cells(pivots: np.ndarray, reach: float):
    apart = np.sqrt(np.maximum(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(2), 0.0)) if len(pivots) <= 256 else None

    def assign(x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        u = x / np.sqrt((x * x).sum(1))[:, None]
        d2 = np.maximum(2 - 2 * (u @ pivots.T), 0.0)
        own = d2.argmin(1)
        mine = d2[np.arange(len(x)), own][:, None]
        gap = apart[own] if apart is not None else np.sqrt(np.maximum(2 - 2 * (pivots[own] @ pivots.T), 0.0))
        close = (d2 - mine) <= 2 * gap * reach + 1e-9  # distance to the plane between own and other pivot
        close &= np.arange(len(pivots))[None, :] < own[:, None]
        return own, [np.flatnonzero(c).tolist() for c in close]

    return assign


def _forest(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between rows i and columns j, the edges (label, least label of its component) and the columns' new
    labels.  Rows bear their ids a, columns the labels b that they had before."""
    la, lb = a.copy(), b.copy()
    while len(i):
        na, nb = la.copy(), lb.copy()
        np.minimum.at(na, i, lb[j])
        np.minimum.at(nb, j, na[i])
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    edges = np.stack([np.concatenate([a, b]), np.concatenate([la, lb])], 1)
    return np.unique(edges[edges[:, 0] != edges[:, 1]], axis=0), lb


def links(rows: DataFrame, cosine: float = COSINE, id_: str = "vec_id", vec: str = "embedding", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reps, counts, edges): reps(__rep, __n, __vec) are the distinct vectors, counts(__rep, links) the rows each
    links with besides its own, edges(a, b) a spanning forest of the links between reps."""
    spark = rows.sparkSession
    reps = stored(clean(rows, id_, vec).groupBy("__vec").agg(F.min("__id").alias("__rep"), F.count("*").alias("__n")), "vectors")
    reach = math.sqrt(max(0.0, 2 - 2 * cosine))
    by_length = pivots(reps.select("__vec"), lambda d: 4 * max(1, block_bytes // (8 * d)), PIVOT_BYTES, LEAST_PIVOTS)
    assign = {d: p / np.sqrt((p * p).sum(1))[:, None] for d, p in by_length.items()}
    shared = spark.sparkContext.broadcast(assign)  # at most PIVOT_BYTES a length

    def place(frames):
        cells = {d: _cells(p, reach) for d, p in shared.value.items()}
        for frame in frames:
            for d, same in frame.groupby(frame["__vec"].map(len)):
                size = batch_rows(len(shared.value.get(int(d), ())))
                for at in range(0, len(same), size):
                    part = same.iloc[at : at + size]
                    own, outs = cells[int(d)](matrix(part["__vec"])) if int(d) in cells else (np.zeros(len(part), np.int32), [[]] * len(part))
                    yield part.assign(dim=np.int32(d), own=own.astype(np.int32), outs=outs)

    placed = stored(reps.mapInPandas(place, "__vec array<double>, __rep long, __n long, dim int, own int, outs array<int>"), "cells")
    inner = placed.select("dim", F.col("own").alias("cell"), "__rep", "__n", "__vec", F.lit(True).alias("inner"))
    outer = placed.select("dim", F.explode("outs").alias("cell"), "__rep", "__n", "__vec", F.lit(False).alias("inner"))
    # Blocks of each cell: its own rows are blocks 0..k-1, visiting rows are blocks k..k+m-1.
    sizes = inner.select("dim", "cell", "inner").union(outer.select("dim", "cell", "inner")).groupBy("dim", "cell").agg(F.count_if("inner").alias("i"), F.count_if(~F.col("inner")).alias("o"))
    block_rows = F.greatest(F.lit(1), F.floor(F.lit(block_bytes) / (8 * F.col("dim"))))
    sizes = sizes.select("dim", "cell", F.ceil(F.col("i") / block_rows).cast("int").alias("k"), F.ceil(F.col("o") / block_rows).cast("int").alias("m"))
    many = inner.union(outer).join(F.broadcast(sizes), ["dim", "cell"])  # sizes: a row a pivot
    block = F.when(F.col("inner"), F.pmod(F.xxhash64("__rep"), F.col("k"))).otherwise(F.col("k") + F.pmod(F.xxhash64("__rep"), F.greatest("m", F.lit(1)))).cast("int")
    many = many.where("k > 0").withColumn("block", block)
    # A block of own rows meets itself and every later block: task (low, high) gets both.
    as_low = F.when(F.col("inner"), F.transform(F.sequence(F.col("block"), F.col("k") + F.col("m") - 1), lambda h: F.struct(F.col("block").alias("low"), h.alias("high")))).otherwise(F.array().cast("array<struct<low:int,high:int>>"))
    top = F.when(F.col("inner"), F.col("block") - 1).otherwise(F.col("k") - 1)
    as_high = F.when(top >= 0, F.transform(F.sequence(F.lit(0), F.greatest(top, F.lit(0))), lambda l: F.struct(l.alias("low"), F.col("block").alias("high")))).otherwise(F.array().cast("array<struct<low:int,high:int>>"))
    tasks = many.withColumn("task", F.explode(F.concat(as_low, as_high))).select("dim", "cell", "task.low", "task.high", "block", "__rep", "__n", "__vec")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        low, high = frame["low"].iloc[0], frame["high"].iloc[0]
        frame = frame.sort_values("__rep", kind="stable")
        left, right = frame[frame["block"] == low], frame[frame["block"] == high]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        a, b = matrix(left["__vec"]), matrix(right["__vec"])
        ia, ib = left["__rep"].to_numpy(), right["__rep"].to_numpy()
        na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
        n_a, n_b = left["__n"].to_numpy(), right["__n"].to_numpy()
        seen_a, seen_b, label, forest = np.zeros(len(a)), np.zeros(len(b)), ib.copy(), []
        for at in range(0, len(a), SLICE_ROWS):
            x, upto = a[at : at + SLICE_ROWS], min(len(a), at + SLICE_ROWS)
            c = (x @ b.T) / na[at:upto, None] / nb[None, :]
            linked = c >= cosine
            for i, j in zip(*np.nonzero(np.abs(c - cosine) < 1e-12), strict=True):  # at the edge: without rounding
                linked[i, j] = math.fsum(x[i] * b[j]) / (math.sqrt(math.fsum(x[i] * x[i])) * math.sqrt(math.fsum(b[j] * b[j]))) >= cosine
            if low == high:
                linked[np.arange(len(x)), np.arange(at, upto)] = False
            i, j = np.nonzero(linked)
            seen_a[at:upto] = np.bincount(i, n_b[j], len(x))
            seen_b += np.bincount(j, n_a[at + i], len(b))
            edges, label = _forest(i, j, ia[at:upto], label)
            forest.append(edges)
        forest = np.unique(np.concatenate(forest), axis=0)
        sides = [(ia, seen_a), (ib, seen_b)][: 1 if low == high else 2]
        out = [pd.DataFrame({"a": ids[n > 0], "b": -1, "n": n[n > 0]}) for ids, n in sides]
        found = pd.concat([*out, pd.DataFrame({"a": forest[:, 0], "b": forest[:, 1], "n": 0})])
        return found.astype("int64")

    found = stored(tasks.groupBy("dim", "cell", "low", "high").applyInPandas(compare, "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("__rep")).agg(F.sum("n").alias("links"))
    return reps, counts, found.where("n = 0").select("a", "b")


def digest(rows: DataFrame, cosine: float = COSINE, **how) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    reps, counts, edges = links(rows, cosine, **how)
    comps = components(edges)
    known = reps.join(counts, "__rep", "left").join(comps, F.col("__rep") == F.col("node"), "left")
    known = known.select(F.col("__vec").alias("__v"), (F.coalesce("links", F.lit(0)) + F.col("__n") - 1).alias("links"), F.coalesce("comp", "__rep").alias("comp"))
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("__e"))
    key = F.when(usable("__e") & F.col("vec_id").isNotNull(), F.col("__e"))
    both = out.withColumn("__e", key).join(known, F.col("__e") == F.col("__v"), "left")
    comp = F.coalesce("comp", "vec_id")
    return both.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"))
