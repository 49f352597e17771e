from collections import Counter, defaultdict

from webweft.llm import common, ngram_join
from webweft.llm.common import shingles, table

from .fixtures import DOCS, awkward, prose


def sets(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x1c", "\x01")
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    """(doc_id, size, component) by all pairs of rows that have an id."""
    s = [sets(r[1], k) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    index = defaultdict(list)
    for i, x in enumerate(s):
        for t in x:
            index[t].append(i)
    for i, x in enumerate(s):
        if rows[i][0] is None:
            continue
        near = Counter(j for t in x for j in index[t] if j < i and rows[j][0] is not None)
        for j, both in near.items():
            if den * both >= num * (len(x) + len(s[j]) - both):
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[root(i)] = min(low.get(root(i), r[0]), r[0])
    by_set = {frozenset(x): low[root(i)] for i, x in enumerate(s) if rows[i][0] is not None and x}
    return Counter((r[0], len(s[i]), low[root(i)] if r[0] is not None else by_set.get(frozenset(s[i])) if s[i] else None) for i, r in enumerate(rows))


def got(df, *how):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df, *how).collect())


def edited(text, at, word):
    w = text.split(" ")
    w[at % len(w)] = word
    return " ".join(w)


def test_shingles():
    for text in ("", "a", "A b", "a b c d", "a b c d e a b c d", "é É\tx\x0by\xa0z w", prose(2000, 9), "x" * 3_000_000 + " a b c d e", "w " * 700_000):
        assert len(shingles(text, 4)) == len(sets(text, 4))
    assert (shingles("The Cat sat on", 4) == shingles("the  cat\nsat on", 4)).all()


def test_edges(spark):
    base = [prose(60 + 20 * i, i) for i in range(6)]
    texts = [None, "", " ", "one", "ONE", "one two", "one two three four", *base]
    texts += [edited(b, 7 * j, f"edit{j}") for b in base for j in range(12)]
    texts += [base[0] + " " + base[1], base[1] + " " + base[0], base[2].upper(), base[3].replace(" ", "\n")]
    rows = awkward(texts) + [(3, base[4], None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert got(df, 4, 85, 100) == brute(rows, 4, 85, 100)
    assert not ngram_join.classes(df.limit(0)).collect()
    kept = [r.doc_id for r in ngram_join.deduplicated(df).collect()]
    assert kept.count(None) == 2 and kept.count(0) == 3  # a null id stays; so do rows without words
    worded = [i for i in kept if i is not None and i > 2]
    # Two rows have doc_id 3 and different texts: each stands for a class of its own.
    assert sorted(worded) == sorted([3, *{c for i, n, c in brute(rows, 5, 80, 100) if n and i is not None and c == i}])


def test_deduplicated_rows_and_clashing_columns(spark):
    """Rows that share a doc_id are judged by their own texts; no column name is reserved."""
    a, b, c = prose(80, 1), prose(80, 2), prose(80, 3)
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "y"), (3, b, "x"), (4, c, "x"), (4, c, "x"), (4, c, "z"), (5, None, "x"), (5, "", "x"), (None, a, "x")]
    names = "doc_id long, text string, `__k` string, `__doc` string, first boolean, fp int, n long, comp long"
    df = spark.createDataFrame([(*r, "p", True, 1, 2, 3) for r in rows], names)
    out = ngram_join.deduplicated(df)
    assert out.columns == df.columns
    kept = Counter((r.doc_id, r.text) for r in out.collect())
    assert kept == Counter({(1, a): 1, (2, b): 1, (4, c): 1, (5, None): 1, (5, ""): 1, (None, a): 1})


def test_hot_buckets(spark, monkeypatch):
    """Heavy buckets and large groups are dealt to slices; the classes stay the same."""
    monkeypatch.setattr(ngram_join, "HEAVY_LEAST", 10)
    monkeypatch.setattr(ngram_join, "LARGE", 8)
    monkeypatch.setattr(ngram_join, "SLICES", 5)
    line = prose(30, 5)
    rows = [(i, line + " " + prose(4 + i % 3, 100 + i)) for i in range(120)] + [(200 + i, edited(prose(90, 9), 3 * i, f"v{i % 40}")) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_chain_of_copies(spark, monkeypatch):
    """A large group of near copies whose ends do not link directly, and boilerplate that many share."""
    monkeypatch.setattr(ngram_join, "HEAVY_LEAST", 20)
    text = prose(120, 1)
    rows, i = [], 0
    for j in range(150):
        text = edited(text, 31 * j, f"v{j}")
        rows.append((i, text))
        i += 1
    for j in range(80):
        rows.append((i, prose(45, 77) + " " + prose(30 + j % 7, 1000 + j)))
        i += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_whole_table(spark, small):
    how = (4, 85, 100)
    df = table(spark, small, "documents")
    rows = [tuple(r) for r in df.collect()]
    want = brute(rows, *how)
    assert got(df, *how) == want
    assert sum(a != c for a, _, c in want) > 30


def test_components(spark, monkeypatch):
    """Both ways of finding components, on a path, a star and a ring."""
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7)]
    df = spark.createDataFrame(pairs, "a long, b long")
    want = {(i, 0) for i in range(41)} | {(100 + i, 100) for i in range(30)} | {(200 + i, 200) for i in range(9)}
    for few in (1 << 16, 0):
        monkeypatch.setattr(common, "FEW_EDGES", few)
        assert {tuple(r) for r in common.components(df).collect()} == want


def test_sketches_of_different_sizes(spark):
    """A sketch folds to each smaller size, and never differs in more bits than the sets in shingles."""
    import numpy as np
    from pyspark.sql import functions as F

    from webweft.llm import ngram_join

    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 9000, dtype=np.uint64))
    sets = [base[:300], base[:2000], base[:8000], np.union1d(base[500:8900], base[:10])]
    rows = [(i, j, ngram_join.sketch(a).tolist(), ngram_join.sketch(b).tolist()) for i, a in enumerate(sets) for j, b in enumerate(sets)]
    df = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>")
    for i, j, d in df.select("i", "j", ngram_join.bits_apart(F.col("a"), F.col("b")).alias("d")).collect():
        true = len(np.setxor1d(sets[i], sets[j]))
        assert d <= true and d % 2 == true % 2 and (i != j or d == 0)
