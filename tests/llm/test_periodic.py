"""Runs of words against all stretches, and the number of comparisons against the number of words."""

import hashlib
import random
import zlib

from webweft.llm import periodic
from webweft.llm.common import table

from .fixtures import frame, prose


def lyndon_plain(s):
    n, nxt, common = len(s), [], []
    for i in range(n):
        j = i + 1
        while j < n and s[j:] >= s[i:]:
            j += 1
        size = 0
        while j + size < n and s[i + size] == s[j + size]:
            size += 1
        nxt.append(j)
        common.append(size)
    return nxt, common


def runs_plain(s, least, times):
    """Every maximal stretch of every period whose smallest period it is."""
    found, n = [], len(s)
    for q in range(1, n // 2 + 1):
        same = [i + q < n and s[i] == s[i + q] for i in range(n)]
        i = 0
        while i < n:
            if not same[i]:
                i += 1
                continue
            end = i
            while end < n and same[end]:
                end += 1
            size, part = end - i + q, s[i : end + q]
            if size >= max(least, times * q) and not any(part[z:] == part[:-z] for z in range(1, q)):
                found.append((i, size, q))
            i = end
    return sorted(found)


def strings():
    rng = random.Random(5)
    for _ in range(3000):
        s = [rng.randrange(rng.choice([1, 2, 3, 4])) for _ in range(rng.randint(1, 30))]
        for _ in range(rng.randrange(4)):
            a = rng.randrange(len(s))
            b = rng.randint(a + 1, len(s))
            s = (s[:b] + s[a:b] * rng.randint(1, 3) + s[b:])[:90]
        yield s


def test_lyndon_arrays():
    for s in strings():
        assert periodic.lyndon(s) == lyndon_plain(s)


def test_runs():
    for s in strings():
        assert periodic.runs(s, 2, 2) == runs_plain(s, 2, 2)
        assert periodic.runs(s, 5, 3) == runs_plain(s, 5, 3)


class Counted(int):
    asked = 0

    def __eq__(self, other):
        Counted.asked += 1
        return int(self) == int(other)

    def __lt__(self, other):
        Counted.asked += 1
        return int(self) < int(other)

    __hash__ = int.__hash__


def test_comparisons_are_linear():
    fib = [0], [0, 1]
    while len(fib[1]) < 40000:
        fib = fib[1], fib[1] + fib[0]
    nested = [0]
    for k in range(1, 10):
        nested = nested * 3 + [k]
    rng = random.Random(1)
    for s in (fib[1], nested, [0] * 40000, ([0, 1] * 50 + [2]) * 400, [rng.randrange(2) for _ in range(40000)], list(range(40000))):
        Counted.asked = 0
        periodic.lyndon([Counted(x) for x in s])
        assert Counted.asked <= 6 * len(s)


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = runs_plain(words, 24, 3)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    top = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else None
    sha = [hashlib.sha256(x).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in found).encode(), b" ".join(w for i, w in enumerate(words) if i not in dropped))]
    return (doc_id, len(found), *(top or [None] * 3), 1000 * top[1] // top[2] if top else None, *sha)


TEXTS = [prose(200, 3), None, "", " \t ", "a " * 30, "x b c " * 9 + "d", "a b " * 11, "one word's\u00a0text a  b\na b\ta b" + " a b" * 12, prose(40, 9) + " " + (prose(9, 4) + " ") * 5 + prose(30, 2), "w " * 23, ("p q " * 12 + "r ") * 4, "A a " * 20]


def test_digest_small(spark):
    docs = frame(spark, TEXTS + [prose(90 + k, k) for k in range(150)])
    got = [tuple(r) for r in periodic.digest(docs).collect()]
    want = [plain_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(r[1] > 0 for r in got) > 10
    assert periodic.digest(docs.limit(0)).count() == 0


def test_whole_table(spark, tiny):
    docs = table(spark, tiny, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = periodic.digest(docs).collect()
    assert len(rows) == len(texts) and any(r.n_runs for r in rows)
    for r in rows:
        if len((texts[r.doc_id] or "").split()) < 600:
            assert tuple(r) == plain_row(r.doc_id, texts[r.doc_id])


def test_find_and_collapsed(spark):
    docs = frame(spark, TEXTS).withColumnRenamed("hash", "start")
    rows = docs.collect()
    got = sorted(map(str, map(tuple, periodic.find(docs).collect())))
    assert got == sorted(str((r.doc_id, *f)) for r in rows for f in runs_plain((r.text or "").encode().split(), 24, 3))
    out = periodic.collapsed(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert kept[4] == "a" and kept[5] == "x b c d" and kept[0] == TEXTS[0] and kept[1] is None and kept[3] == TEXTS[3]


def test_very_long_text(spark):
    text = prose(50000, 1) + " " + "on and on " * 100000
    (row,) = periodic.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row.n_runs >= 1 and row.period == 3 and row.length >= 300000 - 1
