import re
from collections import defaultdict

import numpy as np

from webweft.llm import source_mix
from webweft.llm.common import table

from .fixtures import frame, prose


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets():
    assert source_mix.targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    t = source_mix.targets([10, 1000, 1000])
    assert t[0] == 30 and abs(sum(t) - 2010) < 1e-9 and abs(t[1] - 2 * t[2]) < 1e-9
    assert source_mix.targets([]) == [] and source_mix.targets([0, 0]) == [0, 0]


def test_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        assert sorted(source_mix.permuted(np.arange(n), n, 5)) == list(range(n))
    assert list(source_mix.permuted(np.arange(50), 50, 1)) != list(source_mix.permuted(np.arange(50), 50, 2))


def check(rows, texts):
    """rows: (doc_id, source, result row)."""
    by = defaultdict(list)
    for source, r in rows:
        by[source].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    want = source_mix.targets([sum(r.size for r in by[s]) for s in order])
    for s, t in zip(order, want, strict=True):
        total = sum(r.size for r in by[s])
        assert all(r.source_size == total and abs(r.target - t) < 1e-6 and 0 <= r.taken <= 3 * r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= 1.5 * source_mix.BLOCK, (s, t)


def test_edges(spark):
    texts = ["a b c", "", None, "\t \n", "x\x0by\xa0z", *[prose(40 + 37 * i, i) for i in range(40)], prose(9000, 5)]
    docs = frame(spark, texts)
    out = source_mix.digest(docs).collect()
    assert len(out) == docs.count()
    assert all(r.size == size(texts[r.doc_id]) for r in out if r.doc_id is not None)
    assert sorted(map(str, out)) == sorted(map(str, source_mix.digest(docs.repartition(3)).collect()))
    source = {i: f"s{i % 3}" if i % 4 else None for i in range(len(texts))}
    check([(source.get(r.doc_id), r) for r in out], texts)
    assert not source_mix.digest(docs.limit(0)).collect()
    mix = source_mix.mixed(docs)
    assert mix.columns == docs.columns
    got, want = defaultdict(int), defaultdict(int)
    for r in mix.collect():
        got[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text)
    for r in out:
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == got


def test_whole_table(spark, small):
    docs = table(spark, small, "documents")
    source = {r.doc_id: (r.source, size(r.text)) for r in docs.collect()}
    out = source_mix.digest(docs).collect()
    assert len(out) == len(source) and all(source[r.doc_id][1] == r.size for r in out)
    check([(source[r.doc_id][0], r) for r in out], None)


def by_loops(sizes, quota, block, seed, shard_slots):
    """(shard, slot, source, pass, block) by plain loops."""
    total, used, out = sum(quota), [0] * len(quota), []
    share = np.array(quota, float) / max(1, total)
    blocks = [-(-s // block) for s in sizes]

    def deal(shard, k, n):
        for slot in range(n):
            j = used[k] + slot
            out.append((shard, slot, k, j // blocks[k], int(source_mix.permuted(np.array([j % blocks[k]]), blocks[k], (seed << 40) ^ (k << 8) ^ (j // blocks[k]))[0])))
        used[k] += n

    shards = -(-total // shard_slots)
    for shard in range(shards):
        for k, n in enumerate(source_mix.draw(shard, shard_slots, share, seed)):
            deal(shard, k, min(int(n), quota[k] - used[k]))
    for k, q in enumerate(quota):
        shard = shards
        while used[k] < q:
            deal(shard, k, min(shard_slots, q - used[k]))
            shard += 1
    return sorted(out)


def test_slots_by_plain_loops(spark):
    sizes, block = [700, 5, 3000, 0, 64 * 40], 8
    quota = source_mix.quotas(sizes, source_mix.targets(sizes), 3.0, block)
    seen = []
    for seed in (7, 8):
        made = source_mix.composition(spark, quota, seed, shard_slots=64)
        got = source_mix.slots(made, [-(-s // block) for s in sizes], seed).collect()
        assert sorted(tuple(r) for r in got) == by_loops(sizes, quota, block, seed, 64)
        drawn = made.where("drawn > 0").collect()
        assert all(r.drawn == source_mix.draw(r.shard, 64, np.array(quota) / sum(quota), seed)[r["__rank"]] for r in drawn)
        per = defaultdict(int)
        for r in drawn:
            per[r.shard] += r.drawn
        assert set(per.values()) == {64}
        seen.append({(r.shard, r["__rank"]): r.n for r in made.collect()})
    assert seen[0] != seen[1]  # the draw decides how shards are composed


def test_draw_decides_the_output(spark, small):
    docs = table(spark, small, "documents")
    a, again, b = (sorted(map(str, source_mix.digest(docs, seed=s).collect())) for s in (7, 7, 8))
    assert a == again and a != b


def test_mixed_words_by_plain_loops(spark):
    """The words of the mix, rebuilt from the plan's blocks with lists."""
    texts = [prose(30 + 41 * i, i) for i in range(30)]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", "p") for i, t in enumerate(texts)], "doc_id long, text string, source string, pass string")
    want = []
    for r in source_mix.plan(docs, block=16).where("taken > 0").collect():
        words = texts[r["__id"]].split()
        want.append((r["__id"], " ".join(w for x in r.ranges for w in words[x.start : x.start + x.length])))
    mix = source_mix.mixed(docs, block=16)
    assert mix.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in mix.collect()) == sorted(want)


def test_repeated_rows_and_clashing_columns(spark):
    cols = "doc_id long, text string, source string, n_chars int, `pass` string, `__id` long, `__tie` string, taken int, shard int, `__doc` int"
    rows = [(1, "a b c d", "x", 7, f"row{i}", 5, "t", 1, 2, i) for i in range(3)] + [(None, "e f", None, 3, "p", 1, "t", 1, 2, 9), (2, None, "x", None, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, cols)
    out = source_mix.mixed(docs, block=4).collect()
    assert out and set(out[0].asDict()) == set(docs.columns)
    taken = defaultdict(int)
    for r in source_mix.digest(docs, block=4).collect():
        taken[r.doc_id] += r.taken
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += size(r.text)
    assert {k: v for k, v in taken.items() if v} == got
    if taken[1] >= 12:
        assert {r["pass"] for r in out if r.doc_id == 1} == {"row0", "row1", "row2"}
    assert not source_mix.mixed(docs.limit(0)).collect()
