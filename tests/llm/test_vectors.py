from collections import Counter

import numpy as np

from webweft.llm import ann, near_vectors, vectors
from webweft.llm.common import table

ROWS = "vec_id long, embedding array<float>, label int, links int, comp long"


def awkward(seed=0, n=300, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[i % 12] * (1 + i % 3) + 0.15 * rng.normal(size=dim)).astype("float32").tolist(), 0, 1, 2) for i in range(n)]
    rows += [(n + i, rows[5][1], 0, 1, 2) for i in range(40)]
    rows += [(n + 40 + i, v, None, None, None) for i, v in enumerate([None, [], [0.0] * dim, [1.0, None] * 3, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [1.0, 2.0], [1.0, 2.1]])]
    return [*rows, rows[7], (None, rows[3][1], 1, 1, 1)]


def good(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute_near(rows, cosine):
    """n_links and component of every row, by all pairs."""
    use = [(k, np.array(r[1], float)) for k, r in enumerate(rows) if r[0] is not None and good(r[1])]
    up, links = {k: k for k in range(len(rows))}, Counter()

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, (i, x) in enumerate(use):
        for j, y in use[a + 1 :]:
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    low = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            low[root(k)] = min(low.get(root(k), r[0]), r[0])
    return Counter((r[0], links[k], low.get(root(k)) if r[0] is not None else None) for k, r in enumerate(rows))


def test_near(spark, monkeypatch):
    rows = awkward()
    df = spark.createDataFrame(rows, ROWS)
    for block, rows_at_once in ((1 << 20, 512), (16 * 48, 5)):
        monkeypatch.setattr(near_vectors, "SLICE_ROWS", rows_at_once)
        out = near_vectors.digest(df, block_bytes=block).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == brute_near(rows, near_vectors.COSINE)
        assert all(r.kept == (r.vec_id == r.component_id) or r.vec_id is None for r in out)
    assert not near_vectors.digest(df.limit(0)).collect()


def test_near_whole_table(spark, small):
    df = table(spark, small, "embeddings")
    rows = [tuple(r) for r in df.collect()]
    out = near_vectors.digest(df, block_bytes=64 * 8 * 64).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == brute_near(rows, near_vectors.COSINE)


def brute_ann(rows, k=10):
    use = [(r[0], np.array(r[1], float)) for r in rows if r[0] is not None and good(r[1])]
    out = {}
    for q, x in use:
        if q % 100 == 0 and q not in out:
            d = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in use if i != q and len(x) == len(y))
            out[q] = d[:k]
    return out


def test_ann(spark):
    rows = awkward(seed=2)
    df = spark.createDataFrame(rows, ROWS)
    for shard, pivot in ((4096, 10**6), (90, 10**6), (20, 30), (7, 5)):
        out = ann.digest(df, shard_rows=shard, query_rows=3, pivot_rows=pivot).collect()
        got = {}
        for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        want = brute_ann(rows)
        assert got.keys() == want.keys()
        for q in want:
            assert [i for _, i in got[q]] == [i for _, i in want[q]]
            assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], rtol=0, atol=1e-12)
    assert not ann.digest(df.limit(0)).collect()


def test_ann_recall_falls_with_factor():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(3000, 8)), rng.normal(size=(40, 8))
    tree = ann.Tree(np.arange(3000), x, leaf=32)
    own = np.full(40, -1)
    exact = tree.search(q, own, 10, 1.0)[1].copy()
    for i in range(40):
        assert set(exact[i]) == set(np.argsort(((x - q[i]) ** 2).sum(1))[:10])
    some = tree.search(q, own, 10, 2.0)[1]
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, some, strict=True)])
    print(f"recall at factor 2: {recall:.3f}")
    assert 0.5 < recall <= 1.0


def test_ann_whole_table(spark, small):
    df = table(spark, small, "embeddings")
    want = brute_ann([tuple(r) for r in df.collect()])
    got = {}
    for r in ann.digest(df, shard_rows=32, pivot_rows=40).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got == {q: {i for _, i in v} for q, v in want.items()}


def test_lengths_without_pivots(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIVOT_LENGTHS", 1)
    rows = [(10 * d + k, [1.0 + (k == 2)] * (d - 1) + [1.0 if k < 2 else -30.0]) for d in (2, 3, 4) for k in range(3)]
    got = near_vectors.digest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_bytes=16).collect()
    want = [(i, 1 if i % 10 < 2 else 0, i - 1 if i % 10 == 1 else i, i % 10 != 1) for i, _ in rows]
    assert sorted(map(tuple, got)) == want


def test_ann_hot_cell_and_recall(spark):
    """A third of all rows are one vector; and the whole search's recall at factors above one."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(1200)] + [(5000 + i, [1.0] * 6) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_ann(rows)
    for factor, least in ((1.0, 1.0), (1.5, 0.9), (2.5, 0.6)):
        got = {}
        for r in ann.digest(df, shard_rows=50, pivot_rows=60, factor=factor).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        recall = np.mean([len({i for _, i in got.get(q, [])} & {i for _, i in v}) / 10 for q, v in want.items()])
        print(f"recall of the whole search at factor {factor}: {recall:.3f}")
        assert recall >= least
        if factor == 1.0:
            assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
