"""Shared plumbing: table access, shared-storage materialisation, connected components, shingle fingerprints."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import bucketed, discard, shared_dir, stored  # noqa: F401

WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of the batches in which texts go to Python, and Spark's own number, which stands for "not set".
BATCH_ROWS, USUAL_ROWS = 1000, 10000


def in_small_batches(docs: DataFrame) -> DataFrame:
    """docs, in a session whose batches for Python are small: a batch is held whole by the executor's JVM, outside its heap, and
    again by the worker.  The setting is the session's, as plans are run later; another number that the user has set stays."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == str(USUAL_ROWS):
        conf.set(key, str(BATCH_ROWS))
    return docs


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed c0, c1, ..., and each name's new one: beside them no other name can clash."""
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*inner.values()), inner


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """The evaluation fold: crc32 of the id's decimal text divisible by five (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


#: An edge list of at most this many rows may go to one task.
FEW_EDGES = 1 << 16


def _union_find(frames):
    import pandas as pd

    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    for frame in frames:
        for u, v in zip(frame["u"].tolist(), frame["v"].tolist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"node": nodes, "comp": [root(x) for x in nodes]}).astype("int64")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b) as (node, comp), comp the smallest node; only nodes with an edge.

    Up to FEW_EDGES edges (a megabyte), one task's union-find.  Beyond, alternating large-star / small-star: every step is a groupBy with map-side minimum and a join, so no
    node's neighbourhood is ever gathered in one task.  Loops until a round changes no edge."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    if e.count() <= FEW_EDGES:
        return e.coalesce(1).mapInPandas(_union_find, "node long, comp long")
    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()
        e = stored(e, "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v"), F.col("v"))).distinct()


# --- word shingles -----------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}
_PIECE = 1 << 20


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _powers:
        with np.errstate(over="ignore"):
            grow = np.full(_PIECE + 1, _BASE, np.uint64)
            shrink = np.full(_PIECE + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            grow[0] = shrink[0] = 1
            _powers["up"], _powers["down"] = np.multiply.accumulate(grow), np.multiply.accumulate(shrink)
            _powers["byte"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return _powers["up"], _powers["down"], _powers["byte"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over a uint64 array."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


def _piece(words: list[bytes], k: int) -> np.ndarray:
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    if len(data) > _PIECE:
        if len(words) <= k:  # k words of over a megabyte: hash the shingle's bytes directly
            import hashlib

            return np.frombuffer(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), "<u8").copy()
        half = len(words) // 2
        return np.concatenate([_piece(words[: max(half, 1) + k - 1], k), _piece(words[max(half, 1) :], k)]) if half + k - 1 < len(words) else np.concatenate([_piece(words[i : i + k], k) for i in range(len(words) - k + 1)])
    up, down, byte = _tables()
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte[data] * up[: len(data)], dtype=np.uint64)])
        end = np.flatnonzero(data == 32)
        start = np.concatenate([np.zeros(1, np.int64), end[:-1] + 1])
        k = min(k, len(end))
        s, e = start[: len(end) - k + 1], end[k - 1 :]
        return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of the k-word shingles of the whole text (A-Z lower-cased; words are
    runs without the six ASCII white-space characters; fewer than k words: one shingle of all of them)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(_piece(words, k)) if words else np.empty(0, np.uint64)
