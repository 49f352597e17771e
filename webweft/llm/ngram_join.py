"""N-gram Jaccard join: a grouped prefix join over word shingles, exact at any size of group.

1. Shingle sets are fingerprinted from whole texts; documents with equal sets are one node (the smallest doc_id).
2. Shingles are ordered: those in very many documents last, others by hash (any one order is right; this one
   keeps boilerplate out of prefixes).  A set of n shingles has a prefix of n - ceil(t*n) + 1; sets as similar
   as t share a prefix shingle.
3. Nodes with the same size and the same prefix are one group.  Links inside groups come first; a group whose
   members are then in several classes splits by class.
4. Groups that share a prefix shingle are pairs if their sizes, the shingle's places and short parity sketches
   allow similarity t.
5. Pairs are expanded to members.  Parity sketches (one bit per hash slot, flipped by each shingle; twice as many
   slots as shingles) drop pairs first: sets differ by at least as many shingles as their sketches differ in bits,
   so no link is lost.  The rest are verified on the members' full sets, taken from their texts.

Only classes (connected components) are asked for, so a bucket never emits all its pairs: each round compares
a few of its items with all others, leaves out pairs already in one class, and drops a bucket when the rest of
it is in one class.  Every pair in a bucket is compared, filtered or found in one class in the end.  Buckets of
frequent shingles, and large groups, are dealt to SLICES slices with their pivots copied to each, so no bucket is one
task's.

Defined cases: null or blank text has an empty set, links with nothing and is its own class; repeated rows are
one node; a row with a null doc_id takes its class from rows with an equal set and joins no classes itself;
only doc_id and text are read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, components, discard, shielded, shingles, stored

#: Shingles in over max(HEAVY_LEAST, documents / HEAVY_SHARE) documents' prefix regions come last in the order.
#: Hence at most HEAVY_SHARE times the mean region length of them: a bounded list that every task may hold.
HEAVY_LEAST, HEAVY_SHARE = 256, 1 << 14
#: Parts of a bucket that many items may share (a heavy shingle's, or a group of over LARGE members).
SLICES, LARGE = 64, 512
_FLUSH = 1 << 21
#: Longs in the parity sketch of a short text; longer texts double it until it has two bits a shingle.
SKETCH_LONGS = 16


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def needed(n1: Column, n2: Column, num: int, den: int) -> Column:
    """The least intersection at which den * inter >= num * union."""
    return F.ceil(num * (n1 + n2) / (num + den) - 1e-9)


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of shingles in each hash slot, as longs.  Slots are a power of two, so the sketch of
    half as many slots is the XOR of a sketch's halves."""
    slots = 64 * SKETCH_LONGS
    while slots < 2 * len(s):
        slots *= 2
    odd = np.bincount((s & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(x: Column, longs: Column) -> Column:
    """The sketch x at a smaller power of two of longs."""

    def parity(i: Column) -> Column:
        return F.aggregate(F.sequence(i, F.size(x) - 1, longs), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(x, j)))

    return F.when(F.size(x) == longs, x).otherwise(F.transform(F.sequence(F.lit(0), longs - 1), parity))


def bits_apart(x: Column, y: Column) -> Column:
    """The number of bits in which two sketches differ, at the size of the smaller one."""
    longs = F.least(F.size(x), F.size(y))
    each = F.zip_with(_folded(x, longs), _folded(y, longs), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    return F.aggregate(each, F.lit(0), lambda acc, v: acc + v)


def allowed(n1: Column, n2: Column, num: int, den: int) -> Column:
    """The most shingles in which sets of these sizes may differ."""
    return n1 + n2 - 2 * needed(n1, n2, num, den)


def _texts(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield i, t.as_py()


def heavy(docs: DataFrame, k: int, num: int, den: int) -> np.ndarray:
    """Very frequent shingles, sorted.  A task reports what it met at least twice; what it met once cannot add up
    to the threshold, which is above the number of tasks' reports for any shingle worth deferring."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            some = n > 1
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some].astype(np.int64))], names=["h", "n"])

        held, size = [], 0
        for _, t in _texts(batches):
            s = shingles(t, k)
            if len(s):
                held.append(s[: 2 * prefix_length(len(s), num, den)])
                size += len(held[-1])
            if size > _FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    limit = max(HEAVY_LEAST, docs.count() // HEAVY_SHARE)
    rows = docs.select("doc_id", "text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    # Which shingles are in the list changes the work, never the links; so the list may be bounded.
    found = rows.orderBy(F.desc("n"), "h").limit(1 << 20).select("h").toPandas()["h"].to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, fp (128-bit fingerprint of the set), sketch, m0 and m1 (the sketch in two longs), prefix (shingles
    in the global order) and light (how many of all the set's shingles are not heavy; heavy ones come after them)."""
    often = docs.sparkSession.sparkContext.broadcast(heavy(docs, k, num, den))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = often.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                ids, ns, fps, parity, short, lists, light = [], [], [], [], [], [], []
                for i, t in _texts([batch.slice(at, 1024)]):
                    s = shingles(t, k)
                    ids.append(i)
                    ns.append(len(s))
                    fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    parity.append(sketch(s))
                    short.append(np.bitwise_xor.reduce(parity[-1].reshape(-1, 2), axis=0))
                    light.append(len(s))
                    if len(last) and len(s):
                        where = np.minimum(np.searchsorted(last, s), len(last) - 1)
                        late = last[where] == s
                        if late.any():
                            s = np.concatenate([s[~late], s[late]])
                            light[-1] -= int(late.sum())
                    lists.append(s[: prefix_length(len(s), num, den)].view(np.int64) if len(s) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(fps, pa.binary()), pa.array(parity, pa.list_(pa.int64())), *(pa.array([int(m[j]) for m in short], pa.int64()) for j in (0, 1)), pa.array(lists, pa.list_(pa.int64())), pa.array(light, pa.int64())], names=["doc_id", "n", "fp", "sketch", "m0", "m1", "prefix", "light"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, fp binary, sketch array<long>, m0 long, m1 long, prefix array<long>, light long")


def sketched(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs(a, b) of nodes(node, n, sketch) those whose sketches allow the similarity."""
    one = pairs.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    both = one.join(nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    return both.where(bits_apart(F.col("sa"), F.col("sb")) <= allowed(F.col("na"), F.col("nb"), num, den)).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Of pairs(a, b) those whose sets reach the similarity."""
    one = pairs.join(texts.select(F.col("__id").alias("a"), F.col("__text").alias("ta")), "a")
    both = one.join(texts.select(F.col("__id").alias("b"), F.col("__text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                for v, c in ((x, 2), (y, 3)):
                    if v not in cache:
                        if len(cache) > 512:
                            cache.clear()
                            cache[x] = shingles(batch.column(2)[i].as_py(), k)
                        cache[v] = shingles(batch.column(c)[i].as_py(), k)
                s, t = cache[x], cache[y]
                both = len(s) + len(t) - len(np.union1d(s, t))
                if den * both >= num * (len(s) + len(t) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


class _Classes:
    """Node to class, for nodes that have a link; grows as links are found."""

    def __init__(self, spark):
        self.table = spark.createDataFrame([], "node long, comp long")

    def on(self, df: DataFrame, node: str, name: str) -> DataFrame:
        """df with the class of a node column."""
        t = self.table.select(F.col("node").alias("__node"), F.col("comp").alias("__comp"))
        return df.join(t, F.col(node) == F.col("__node"), "left").withColumn(name, F.coalesce("__comp", node)).drop("__node", "__comp")

    def add(self, links: DataFrame) -> None:
        """Take in links(a, b) between nodes."""
        if not links.isEmpty():
            self.table = stored(components(self.table.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(links)), "classes")


def _slice(item: Column, slices: Column) -> Column:
    return F.pmod(F.xxhash64(item), slices).cast("int")


def _rounds(items: DataFrame, classes: _Classes, check, num: int, den: int) -> None:
    """Compare the items of each bucket.  items(bucket, slices, slice, item, n, pos, m0, m1); check(pairs) finds links and
    adds them.  m0 and m1 are null where an item stands for several sets, which its own sketch says nothing of.

    A round takes some p items of each bucket as pivots (the first by number; then 64, 4096, 4096, ... by hash: later
    rounds have few buckets) and pairs them with the other items that are in other classes.  Joins go by bucket and slice."""
    p, turn, columns = 1, 0, ("bucket", "slices", "slice", "item", "n", "pos", "m0", "m1")
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    while True:
        now = classes.on(items, "item", "cls")
        # Buckets whose items are all in one class are done.
        open_ = now.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.max("slices").alias("slices"), F.count("*").alias("c"), F.min("item").alias("first")).where("lo <> hi")
        open_ = open_.select("bucket", every.alias("slice"), "c", "first")
        now = now.join(open_, ["bucket", "slice"])
        chosen = (F.col("item") == F.col("first")) if p == 1 else (F.pmod(F.xxhash64("item", F.lit(turn)), F.ceil(F.col("c") / p).cast("long")) == 0)
        now = stored(now.select(*columns, "cls", chosen.alias("pivot")), "open")
        if now.isEmpty():
            return
        pivots = stored(now.where("pivot").select("bucket", "item", "n", "pos", "m0", "m1", "cls", every.alias("slice")), "pivots")
        a, b = pivots.alias("a"), now.alias("b")
        fit = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= needed(F.col("a.n"), F.col("b.n"), num, den)
        fit &= (num * F.col("a.n") <= den * F.col("b.n")) & (num * F.col("b.n") <= den * F.col("a.n"))
        apart = F.bit_count(F.col("a.m0").bitwiseXOR(F.col("b.m0"))) + F.bit_count(F.col("a.m1").bitwiseXOR(F.col("b.m1")))
        fit &= F.coalesce(apart <= allowed(F.col("a.n"), F.col("b.n"), num, den), F.lit(True))
        other = ~F.col("b.pivot") | (F.col("a.item") < F.col("b.item"))
        pairs = b.join(a, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.slice") == F.col("b.slice")) & other & (F.col("a.cls") != F.col("b.cls")) & fit)
        pairs = stored(pairs.select(F.least("a.item", "b.item").alias("a"), F.greatest("a.item", "b.item").alias("b")).distinct(), "pairs")
        check(pairs)
        old, items = items, stored(now.where("not pivot").select(*columns), "items")
        discard(now, pivots, pairs, *[old] * hasattr(old, "stored_at"))
        p, turn = min(p * 64, 1 << 12), turn + 1


def classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (see the module's text)."""
    component = F.coalesce("comp", F.when(F.col("n") == 0, F.col("doc_id")))
    return _marked(docs, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _marked(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One row per document: doc_id, n, fp, comp (null where the set is empty, or only rows without a doc_id have it) and
    first (whether the row's doc_id and set are those that stand for its class)."""
    spark = docs.sparkSession
    found_sets = stored(prefixes(docs, k, num, den), "found")
    sets = stored(found_sets.select("doc_id", "n", "fp"), "sets")
    full = found_sets.where("n > 0")
    nodes = full.where("doc_id is not null").groupBy("n", "fp").agg(F.min("doc_id").alias("doc"), *(F.first(c).alias(c) for c in ("sketch", "m0", "m1", "prefix", "light")))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers are fixed once written
    discard(found_sets)
    found = _Classes(spark)

    # Only groups of several nodes are written; where they are few, joining them moves no prefix.
    key = [F.col("n"), F.xxhash64("prefix").alias("p1"), F.hash("prefix").alias("p2")]
    groups = nodes.groupBy(*key).agg(F.min("node").alias("gid"), F.count("*").alias("members")).where("members > 1")
    groups = stored(groups.select("n", "p1", "p2", "gid", "members"), "groups")
    named = nodes.select(*key, "node", "m0", "m1", "prefix", "light").join(groups, ["n", "p1", "p2"], "left")
    members = stored(named.where("gid is not null").select("gid", "node", "n", "m0", "m1", "members"), "members")
    places = named.where("gid is null or gid = node").select("node", "n", "light", F.posexplode("prefix").alias("pos", "bucket"))
    places = places.withColumn("slices", F.when(F.col("pos") >= F.col("light"), SLICES).otherwise(1)).withColumn("slice", _slice(F.col("node"), F.col("slices")))
    places = places.withColumn("c", F.count("*").over(Window.partitionBy("bucket", "slice"))).where("c > 1 or slices > 1")
    # Most shingles are in one place only; what is left takes up the short sketches, unless it stands for a group.
    places = places.select("bucket", "slices", "slice", F.col("node").alias("item"), "n", "pos").join(nodes.select(F.col("node").alias("item"), "m0", "m1"), "item")
    places = places.join(members.where("gid = node").select(F.col("gid").alias("item"), "gid"), "item", "left")
    places = stored(places.select("bucket", "slices", "slice", "item", "n", "pos", *(F.when(F.col("gid").isNull(), F.col(m)).alias(m) for m in ("m0", "m1"))), "places")
    wide, nodes = nodes, bucketed(nodes.select("node", "doc", "n", "fp", "sketch"), "node", "named")
    discard(wide)

    # Texts are moved once; each comparison then fetches those it asks for.
    texts = bucketed(docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").alias("__text")).where("doc is not null"), "doc", "texts")
    often = stored(sets.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("doc")), "repeated")
    often = None if often.isEmpty() else often

    def check(pairs: DataFrame) -> None:
        likely = stored(sketched(pairs, nodes, num, den), "likely")
        asked = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct().join(nodes.select("node", "doc", "fp"), "node")
        fetched = stored(_node_texts(texts, often, asked, k), "fetched")
        links = stored(verified(likely, fetched, k, num, den), "links")
        found.add(links)
        discard(likely, fetched, links)

    inside = members.withColumn("slices", F.when(F.col("members") > LARGE, SLICES).otherwise(1))
    inside = inside.select(F.col("gid").alias("bucket"), "slices", _slice(F.col("node"), F.col("slices")).alias("slice"), F.col("node").alias("item"), "n", F.lit(0).alias("pos"), "m0", "m1")
    if not inside.isEmpty():
        _rounds(inside, found, check, num, den)
        # Groups of one class from here on.
        split = found.on(members.select("gid", "node"), "node", "cls")
        sub = split.groupBy("gid", "cls").agg(F.min("node").alias("sub"), F.count("*").alias("size"))
        sub = stored(split.join(sub, ["gid", "cls"]).select("gid", "node", "sub", "size"), "split")
        places = places.join(sub.where("node = sub").select(F.col("gid").alias("item"), "sub"), "item", "left").select("bucket", "slices", "slice", F.coalesce("sub", "item").alias("item"), "n", "pos", "m0", "m1")
        sub = sub.where("size > 1").select("sub", "node")
    else:
        sub = None

    def check_groups(pairs: DataFrame) -> None:
        check(pairs)
        if sub is None:
            return
        # Pairs of groups whose first members do not link: all their members, unless in one class by now.
        many = sub.where("node = sub").select(F.col("sub").alias("__many"))
        some = pairs.join(many, F.col("a") == F.col("__many"), "left_semi").union(pairs.join(many, F.col("b") == F.col("__many"), "left_semi")).distinct()
        left = found.on(found.on(some, "a", "ca"), "b", "cb").where("ca <> cb")
        wide = left.join(sub.withColumnRenamed("sub", "a").withColumnRenamed("node", "ma"), "a", "left").join(sub.withColumnRenamed("sub", "b").withColumnRenamed("node", "mb"), "b", "left")
        wide = wide.where("ma is not null or mb is not null").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
        wide = stored(wide.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"), "members")
        if not wide.isEmpty():
            check(wide)

    _rounds(places, found, check_groups, num, den)

    named = _with_lowest(stored(found.on(nodes.select("n", "fp", "node", "doc"), "node", "cls").select("n", "fp", "doc", "cls"), "named"))
    out = sets.select("doc_id", "n", "fp").join(named, ["n", "fp"], "left")
    first = (F.col("doc_id") == F.col("low.doc")) & (F.col("fp") == F.col("low.fp"))
    return out.select("doc_id", "n", "fp", F.col("low.doc").alias("comp"), F.coalesce(first, F.lit(False)).alias("first"))


def _with_lowest(named: DataFrame) -> DataFrame:
    """(n, fp, low) of named(n, fp, doc, cls): low is the smallest (doc, fp) of the class.  Classes with very many members, at
    most 65,536 of them, go to every task; the join by class has the others."""
    per = stored(named.groupBy("cls").agg(F.min(F.struct("doc", "fp")).alias("low"), F.count("*").alias("c")), "lowest")
    limit = max(256, named.count() >> 16)
    large = F.broadcast(per.where(F.col("c") > limit).select("cls", F.col("low").alias("__low")))
    both = named.join(large, "cls", "left")
    rest = both.where("__low is null").join(per.where(F.col("c") <= limit).select("cls", "low"), "cls").select("n", "fp", "low")
    return both.where("__low is not null").select("n", "fp", F.col("__low").alias("low")).unionByName(rest)


def _fingerprint(k: int):
    @F.udf("binary")
    def fingerprint(t):
        return hashlib.blake2b(shingles(t, k).tobytes(), digest_size=16).digest()

    return fingerprint


def _node_texts(texts: DataFrame, often: DataFrame | None, nodes: DataFrame, k: int) -> DataFrame:
    """(__id, __text): one text per node(node, doc, fp) of texts(doc, __text).  Where rows share a doc_id (it is in
    often), the one whose set is the node's."""
    both = texts.join(nodes.hint("shuffle_hash"), "doc")  # each task holds its share of three short columns
    if often is None:
        return both.select(F.col("node").alias("__id"), "__text")

    rest = both.join(often, "doc", "left_semi").where(_fingerprint(k)("__text") == F.col("fp")).groupBy("node").agg(F.min("__text").alias("__text"))
    return both.join(often, "doc", "left_anti").select("node", "__text").unionByName(rest).withColumnRenamed("node", "__id")


def deduplicated(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each class: the one of smallest doc_id (where rows share it with different texts, each is
    judged by its own text; of rows that share doc_id and set of shingles one stays).  Rows with a null doc_id and rows
    without words stay.  No column name is reserved."""
    marked = stored(_marked(docs, k, num, den).where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("__k"), "fp", "first"), "marked")
    twice = stored(marked.groupBy("__k").count().where("count > 1").select("__k"), "repeated")
    rows, inner = shielded(docs)
    rows = rows.withColumn("__id", F.col(inner["doc_id"]).cast("long"))
    same = F.col("__id") == F.col("__k")
    plain = [F.col(i).alias(c) for c, i in inner.items()]
    drop = marked.where("not first").join(twice, "__k", "left_anti").select("__k")
    rest = rows.join(drop, same, "left_anti")
    if twice.isEmpty():
        return rest.select(*plain)
    text = F.col(inner["text"])
    again = rest.join(twice, same, "left_semi").withColumn("fp", _fingerprint(k)(text)).withColumn("__empty", ~F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    blank = again.where("__empty")
    kept = again.where("not __empty").join(marked.where("first").select("__k", F.col("fp").alias("__fp")).distinct(), same & (F.col("fp") == F.col("__fp")), "left_semi")
    one = kept.withColumn("__h", F.row_number().over(Window.partitionBy("__id", "fp").orderBy(F.xxhash64(*inner.values())))).where("__h = 1")
    return rest.join(twice, same, "left_anti").select(*plain).unionByName(blank.select(*plain)).unionByName(one.select(*plain))
