"""Mixing sources to target weights.

Each source's documents, in a fixed order, are one stream of words packed into blocks of `block` words.  Every
output shard draws multinomial source counts for its slots; a source's slots, numbered over all shards in shard
order, are mapped through a pseudorandom permutation of its block indexes (a new one for each pass over the source),
and blocks join slots by index.  So the draw says how each shard is composed, and with the permutation which shard
and slot every block goes to; another seed deals otherwise.  A source's quota (whole blocks, nearest to its target)
is a bound on its draws: slots drawn beyond it stay unused, and what the draws left short is dealt by closing
shards, numbered after the drawn ones.

Sources weigh `weights` in turn by code point order of their names, null last.  Targets share the total size by
weight; a target stops at `most` times its source's size and the excess goes to the others by weight.
Defined cases: a null or empty text has size 0 and is never taken; no rows give no rows; repeated rows are
separate documents; a null doc_id is ordered first; only the columns named are read.

The source table (name, size) is the one thing brought to the driver: one row per source, refused beyond
MAX_SOURCES rather than cut."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, shielded, stored, text_or_empty

MAX_SOURCES = 1 << 18
WEIGHTS = (5.0, 2.0, 1.0)
BLOCK = 64
SHARD_SLOTS = 4096
#: Shards whose counts are summed together, and blocks of the sources for each task that deals slots.
STRETCH, SLOTS_A_TASK = 4096, 1 << 17


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> list[float]:
    """Targets of sources given in order; what a capped source leaves goes to the rest by weight."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    cap = [most * s for s in sizes]
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        share = left / sum(w[i] for i in open_)
        full = [i for i in open_ if share * w[i] > cap[i]]
        if not full:
            for i in open_:
                out[i] = share * w[i]
            break
        for i in full:
            out[i] = cap[i]
            left -= cap[i]
            open_.discard(i)
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of range(n): a four-round Feistel network over the next even power of two, walked
    until the value falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}:{r}".encode(), digest_size=8).digest(), "big")) for r in range(4)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> np.uint64(half), v & mask
        with np.errstate(over="ignore"):
            for k in keys:
                f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    v = once(index.astype(np.uint64))
    while (out := v >= n).any():
        v[out] = once(v[out])
    return v.astype(np.int64)


def draw(shard: int, slots: int, share: np.ndarray, seed: int) -> np.ndarray:
    """How many of a shard's slots each source gets: one multinomial draw, the same on every rerun."""
    return np.random.default_rng([seed, shard]).multinomial(slots, share)


def _sized(docs: DataFrame, id_: str, source: str, text: str) -> DataFrame:
    size = F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")
    return docs.select(F.col(id_).alias("__id"), F.col(source).alias("__source"), F.xxhash64(text).alias("__tie"), size.alias("__size"))


def quotas(sizes: list[int], target: list[float], most: float, block: int) -> list[int]:
    """Blocks each source gives: whole passes first, then as many blocks as bring it nearest to its target."""
    out = []
    for s, t in zip(sizes, target, strict=True):
        b, whole = -(-s // block), int(min(most, t / s)) if s else 0
        out.append(whole * b + min(b, round((t - whole * s) / block)) if whole < most else whole * b)
    return out


def _before(rows: DataFrame, key: str, order: str, value: str, group: int) -> DataFrame:
    """rows with `at`: the sum of value over the key's rows that are earlier in order.  Sums are taken inside stretches
    of `group` numbers of order and over the stretches, so no key's rows meet in one task."""
    rows = rows.withColumn("__stretch", F.expr(f"{order} div {group}"))
    sums = rows.groupBy(key, "__stretch").agg(F.sum(value).alias("__sum"))
    upto = Window.partitionBy(key).orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "__stretch", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__base"))
    inside = Window.partitionBy(key, "__stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [key, "__stretch"])
    return out.withColumn("at", F.col("__base") + F.col("__in")).drop("__in", "__base", "__stretch")


def composition(spark: SparkSession, quota: list[int], seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, __rank, drawn, n, at): what each shard drew of each source, what it uses (draws stop at the source's
    quota), and the number of the source's slots in earlier shards.  Closing shards have drawn 0."""
    total = sum(quota)
    shards = -(-total // shard_slots)
    share, kept = np.array(quota, float) / max(1, total), np.flatnonzero(quota)

    def counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                n = draw(int(shard), shard_slots, share, seed)[kept]
                yield pd.DataFrame({"shard": np.int64(shard), "__rank": kept[n > 0], "drawn": n[n > 0]}).astype({"__rank": "int32", "drawn": "int64"})

    drawn = spark.range(shards, numPartitions=max(1, min(shards, 256))).mapInPandas(counts, "shard long, __rank int, drawn long")
    known = spark.createDataFrame([(int(k), int(quota[k])) for k in kept], "__rank int, quota long")  # bounded: MAX_SOURCES rows
    # Drawn once: sums, slots and closing shards all read it.
    drawn = _before(stored(drawn, "drawn"), "__rank", "shard", "drawn", STRETCH).join(F.broadcast(known), "__rank")
    drawn = drawn.withColumn("n", F.greatest(F.lit(0), F.least("drawn", F.col("quota") - F.col("at"))).cast("long"))
    used = drawn.groupBy("__rank").agg(F.sum("n").alias("at"))
    short = known.join(used, "__rank", "left").withColumn("at", F.coalesce("at", F.lit(0))).withColumn("left", F.col("quota") - F.col("at")).where("left > 0")
    # A closing shard holds shard_slots slots of one source at most.
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(left - 1) div {shard_slots}")))
    short = short.withColumn("__part", part).select(
        (F.lit(shards) + F.col("__part")).alias("shard"), "__rank", F.lit(0).cast("long").alias("drawn"), F.least(F.lit(shard_slots).cast("long"), F.col("left") - F.col("__part") * shard_slots).alias("n"), (F.col("at") + F.col("__part") * shard_slots).alias("at")
    )
    return drawn.select("shard", "__rank", "drawn", "n", "at").unionByName(short)


def slots(made: DataFrame, blocks: list[int], seed: int) -> DataFrame:
    """(shard, slot, __rank, __pass, __block) of every used slot; slot counts a source's own slots of the shard."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                rank, at, n = int(r[1]), int(r[3]), int(r[2])
                b = blocks[rank]
                j = np.arange(at, at + n)
                for p in np.unique(j // b):
                    mine = j[j // b == p]
                    yield pd.DataFrame({"shard": np.int64(r[0]), "slot": (mine - at).astype("int32"), "__rank": np.int32(rank), "__pass": np.int32(p), "__block": permuted(mine % b, b, (seed << 40) ^ (rank << 8) ^ int(p))})

    total = made.where("n > 0").select("shard", "__rank", "n", "at")
    # A number of partitions that grows with the slots; given, so that adaptive execution does not merge them.
    parts = max(8, -(-sum(blocks) // SLOTS_A_TASK))
    return total.repartition(parts, "__rank", "shard").mapInPandas(run, "shard long, slot int, __rank int, __pass int, __block long")


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, block: int = BLOCK, seed: int = 7, id_: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document and pass that takes a part of it: __id, __source, __size, __tie, source_size, target,
    __pass (0..), taken (words), ranges (array of start, length in words, shard, slot, by start).
    Documents of which nothing is taken have one row with taken 0 and a null __pass."""
    spark = docs.sparkSession
    rows = stored(_sized(docs, id_, source, text), "sizes")
    per = rows.groupBy("__source").agg(F.sum("__size").alias("size"), F.count("*").alias("docs"))
    found = sorted(per.limit(MAX_SOURCES + 1).collect(), key=lambda r: (r["__source"] is None, (r["__source"] or "").encode()))
    if len(found) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources: pass a coarser source column")
    sizes = [int(r["size"]) for r in found]
    target = targets(sizes, weights, most)
    info = [(r["__source"], k, sizes[k], target[k], math.isqrt(int(r["docs"])) + 1) for k, r in enumerate(found)]
    sources = spark.createDataFrame(info, "__name string, __rank int, source_size long, target double, __buckets int")
    # Bounded: MAX_SOURCES rows.
    known = rows.join(F.broadcast(sources), F.col("__source").eqNullSafe(F.col("__name"))).drop("__name")
    known = known.withColumn("__bucket", F.pmod(F.xxhash64("__id", "__tie"), F.col("__buckets")).cast("int"))
    # Offsets: order and sum inside buckets, then add the sums of the buckets before.  A source of n documents has
    # sqrt(n) buckets of sqrt(n), so neither step gathers the source.
    before = known.groupBy("__rank", "__bucket").agg(F.sum("__size").alias("__words"))
    upto = Window.partitionBy("__rank").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("__rank", "__bucket", F.coalesce(F.sum("__words").over(upto), F.lit(0)).alias("__first"))
    inside = Window.partitionBy("__rank", "__bucket").orderBy("__id", "__tie", "__size")
    placed = known.withColumn("__row", F.row_number().over(inside)).withColumn("__end", F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(before, ["__rank", "__bucket"]).withColumn("__from", F.col("__first") + F.col("__end") - F.col("__size"))
    pieces = placed.where("__size > 0").withColumn("__block", F.explode(F.sequence(F.expr(f"__from div {block}"), F.expr(f"(__from + __size - 1) div {block}"))))

    made = stored(composition(spark, quotas(sizes, target, most, block), seed), "composition")
    where = slots(made, [-(-s // block) for s in sizes], seed)
    # The small table of shards says nothing of how many slots it makes: no broadcast.
    taken = pieces.join(where.hint("merge"), ["__rank", "__block"])
    start = F.greatest(F.col("__block") * block, "__from")
    length = F.least((F.col("__block") + 1) * block, F.col("__from") + F.col("__size")) - start
    taken = taken.withColumn("__range", F.struct((start - F.col("__from")).alias("start"), length.alias("length"), "shard", "slot"))
    key = ["__rank", "__bucket", "__row"]
    taken = taken.groupBy(*key, "__pass").agg(F.sum("__range.length").alias("taken"), F.array_sort(F.collect_list("__range")).alias("ranges"))
    return placed.join(taken, key, "left").select("__id", "__source", "__size", "__tie", "source_size", "target", "__pass", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "ranges", *key)


def digest(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (over all passes), and where it went: n_shards
    (output shards that hold words of it) and first_shard (the lowest; null where nothing is taken)."""
    p = plan(docs, **how)
    shards = F.array_distinct(F.flatten(F.collect_list(F.col("ranges.shard"))))
    per = p.groupBy("__rank", "__bucket", "__row").agg(*[F.first(c).alias(c) for c in ("__id", "__size", "source_size", "target")], F.sum("taken").alias("taken"), shards.alias("shards"))
    return per.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", "taken", F.size("shards").cast("long").alias("n_shards"), F.array_min("shards").alias("first_shard"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents, with the columns of docs: one row per document and pass, with the words that pass takes (the
    text unchanged where it takes all, else the taken words joined by spaces) and n_chars, if there is one, set anew.

    Rows that share doc_id, source and text count as separate documents; their mix keeps each one's other columns (which
    of them keeps which part of the words is not said, their words being the same).  No column name is reserved."""
    cols = docs.columns
    p = plan(docs, **how).where("taken > 0").select("__id", "__tie", "__size", "__source", "__rank", "__bucket", "__row", "ranges")
    # Repeated rows (same id and text) are numbered on both sides alike, so each keeps its own other columns.
    same = ["__id", "__source", "__tie"]
    per = p.groupBy(*same, "__size", "__rank", "__bucket", "__row").agg(F.collect_list("ranges").alias("__lists"))
    texts, inner = shielded(docs)
    texts = texts.withColumn("__id", F.col(inner["doc_id"])).withColumn("__source", F.col(inner["source"])).withColumn("__tie", F.xxhash64(inner["text"]))
    often = stored(per.groupBy(*same).agg(F.count("*").alias("__n")).where("__n > 1").select(*same), "repeated")
    if not often.isEmpty():
        nth = lambda d, order: d.withColumn("__nth", F.row_number().over(Window.partitionBy(*same).orderBy(*order)))
        # Numbers past the repeats of a document stay with it: a document of size 0 is in neither side.
        per, texts = nth(per, ["__bucket", "__row"]), nth(texts, [F.xxhash64(*inner.values())])
    else:
        per, texts = per.withColumn("__nth", F.lit(1)), texts.withColumn("__nth", F.lit(1))
    left, right = texts.alias("l"), per.alias("r")
    on = F.col("l.__id").eqNullSafe(F.col("r.__id")) & F.col("l.__source").eqNullSafe(F.col("r.__source")) & (F.col("l.__tie") == F.col("r.__tie")) & (F.col("l.__nth") == F.col("r.__nth"))
    both = left.join(right, on).select(*[f"l.{i}" for i in inner.values()], "r.__size", F.explode("r.__lists").alias("__ranges"))
    text = F.col(inner["text"])
    # The words are found once a row: an array of one element gives them a name.
    some = F.element_at(F.transform(F.array(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), lambda words: F.array_join(F.flatten(F.transform("__ranges", lambda r: F.slice(words, (r["start"] + 1).cast("int"), r["length"].cast("int")))), " ")), 1)
    n = F.aggregate("__ranges", F.lit(0).cast("long"), lambda a, r: a + r["length"])
    both = both.withColumn("__new", F.when(n == F.col("__size"), text).otherwise(some))
    new = {"text": F.col("__new")} | ({"n_chars": F.length("__new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in cols else {})
    return both.select(*[new.get(c, F.col(inner[c])).alias(c) for c in cols])
