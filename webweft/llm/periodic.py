"""Periodic runs of words after Ellert and Fischer: Lyndon arrays under both orders of the alphabet, in linear time, by
comparisons of words alone (no suffix structure, no hash).

One scan from the left keeps the suffixes that are smaller than all after them on a chain (previous smaller suffix).  A
position closes those of the chain that are greater; that is where their longest Lyndon words end.  Two things make it
linear.  Along the chain the common prefixes with the present suffix never shrink, and prefixes of neighbours in the
chain are known, so one position compares no word twice.  And the match that reaches farthest is kept: a position inside
it takes over what its counterpart in the earlier copy found, unless that reached the match's end; then comparing goes on
from there.  So every successful comparison moves that end on.

A run of period p has a Lyndon root [i, i + p) that is the longest Lyndon word at i under one of the orders, and the common
prefix found when it was closed says where the run ends.  Where the run begins is found by comparing to the left, less than a
period and only for its first root: a root after another one of the same run is known by the match between the two.

Texts are independent: rows pass one by one, without a shuffle.  Defined cases: a null or empty text has no words and no
runs; repeated rows and null ids are rows like others; an empty table gives an empty one."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import shielded

#: A run has so many words at least, and so many periods.
LEAST, TIMES = 24, 3
#: Rounds in which a text is cut at rare words; more would find the same runs in less text.
CUTS = 3


def lyndon(s: list[int]) -> tuple[list[int], list[int]]:
    """For each position the next smaller suffix's (the length of s where there is none; an end is smaller than any word)
    and the length of their common prefix."""
    n = len(s)
    nxt, common = [n] * n, [0] * n
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix, and the common prefix with it
    most = [0] * n  # the longest common prefix that the position met
    a = b = end = 0  # s[a:] and s[b:end] match, and no match reaches beyond end
    for i in range(1, n):
        j, length = i - 1, 0
        if i < end:
            shift, left = b - a, end - i
            k = i - shift
            if most[k] < left:
                low = before[k]
                if low >= a:
                    low += shift
                while j != low:
                    nxt[j], common[j] = i, common[j - shift]
                    j = before[j]
                before[i], shared[i], most[i] = low, shared[k], most[k]
                continue
            while j >= b and nxt[j - shift] == k and common[j - shift] < left:
                nxt[j], common[j] = i, common[j - shift]
                j = before[j]
            length = left
        while j >= 0:
            x, y = j + length, i + length
            while y < n and s[x] == s[y]:
                x += 1
                y += 1
            length = y - i
            a, b, end = j, i, y
            if y < n and s[x] < s[y]:
                before[i], shared[i] = j, length
                break
            nxt[j], common[j] = i, length
            here, j = shared[j], before[j]
            while j >= 0 and here > length:
                nxt[j], common[j] = i, length
                here, j = shared[j], before[j]
            if j >= 0 and here < length:
                before[i], shared[i] = j, here
                break
        most[i] = length
    return nxt, common


def _whole(s: np.ndarray, least: int, times: int) -> set[tuple[int, int, int]]:
    found, at = set(), np.arange(len(s))
    for order in (s, -s):
        words = order.tolist()
        nxt, common = lyndon(words)
        to, match = np.array(nxt), np.array(common)
        p = to - at
        some = (to < len(s)) & (match > (times - 2) * p) & (match + 2 * p > least)
        for i in np.flatnonzero(some).tolist():
            r, q = nxt[i], nxt[i] - i
            if i >= q and nxt[i - q] == i and common[i - q] >= q:
                continue
            back = 0
            while back < i and words[i - 1 - back] == words[r - 1 - back]:
                back += 1
            size = back + q + common[i]
            if size >= max(least, times * q):
                found.add((i - back, size, q))
    return found


def runs(words: list, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least `least` words and `times` periods (2 or more), by start,
    then period.

    A word met less than `times` times is in none, so the text is cut there first."""
    number: dict = {}
    s = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pieces = [(0, s)]
    for _ in range(CUTS):
        parts = []
        for offset, piece in pieces:
            _, inverse, n = np.unique(piece, return_inverse=True, return_counts=True)
            rare = np.flatnonzero(n[inverse] < times)
            if not len(rare):
                parts.append((offset, piece))
                continue
            edges = np.concatenate([[-1], rare, [len(piece)]])
            for k in np.flatnonzero(np.diff(edges) > least).tolist():
                parts.append((offset + int(edges[k]) + 1, piece[edges[k] + 1 : edges[k + 1]]))
        pieces = parts
    return sorted((offset + i, size, q) for offset, piece in pieces if len(piece) >= least for i, size, q in _whole(piece, least, times))


def collapse(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run has after its first period."""
    if not found:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, size, q in found:
        depth[start + q] += 1
        depth[start + size] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def words_of(text: str | None) -> list[bytes]:
    """Runs of what is not one of the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def find(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc_id, start, length, period), one row a run of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _columns(batch):
                rows = [(i, *r) for i, t in zip(ids, texts, strict=True) for r in runs(words_of(t), least, times)]
                yield _batch(rows, ["doc_id", "start", "length", "period"], [pa.int64()] * 4)

    return _two(docs).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with each text that has runs replaced by the words it keeps, joined by one space; other texts, and all other
    columns whatever their names, stay as they are."""
    kept, (rows, inner) = docs.columns, shielded(docs)
    text = inner["text"]
    schema = StructType([StructField(f.name, StringType()) if f.name == text else f for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                new = []
                for t in part.column(text).to_pylist():
                    words = words_of(t)
                    found = runs(words, least, times)
                    new.append(b" ".join(collapse(words, found)).decode("utf-8", "surrogatepass") if found else t)
                columns = [pa.array(new, pa.string()) if c == text else part.column(c) for c in part.schema.names]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return rows.mapInArrow(run, schema).toDF(*kept)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the registered query: in a tenth of the ids (by CRC-32) the tail repeats its first words."""
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


_FIELDS = {"doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its runs' number, the one of greatest exponent, digests of all runs and of what is kept."""

    def one(doc_id, text):
        words = planted(doc_id, words_of(text))
        found = runs(words)
        listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
        top = [None] * 4
        if found:
            best = found[0]
            for r in found[1:]:  # by start, then period: of equal exponents the first stays
                if r[1] * best[2] > best[1] * r[2]:
                    best = r
            top = [*best, 1000 * best[1] // best[2]]
        return doc_id, len(found), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapse(words, found))).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _columns(batch):
                yield _batch([one(i, t) for i, t in zip(ids, texts, strict=True)], list(_FIELDS), list(_FIELDS.values()))

    return _two(docs).mapInArrow(run, ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in _FIELDS.items()))


def _two(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _columns(batch: pa.RecordBatch, rows: int = 256):
    for at in range(0, batch.num_rows, rows):
        part = batch.slice(at, rows)
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
