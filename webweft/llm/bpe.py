"""Byte-pair encoding and decoding with a public vocabulary file.

A text is cut at added tokens, normalised, split into words, and each word's bytes are merged: a priority queue
holds (rank, position) of adjacent pairs, symbols sit in a doubly linked list, and an entry whose pair has
changed since it was queued is skipped.  Workers remember the ids of frequent words in a bounded table (it only
saves work).  A null or empty text has no ids and decodes to the empty string."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Words whose ids a worker remembers, in each of two generations; about 200 bytes each.
REMEMBERED = 250_000


#: Fixed value: the word pattern that find_ascii is a form of.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable Latin-1, else letters from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _newer() -> str:
    """Letters and numbers of the regex library that the Unicode version of the tokenizers library (or, without
    it, of Python) does not hold."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    doubtful = "".join(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    try:
        from tokenizers import Regex, pre_tokenizers
    except ImportError:
        return doubtful
    split = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed", invert=True)
    known = {c for c, _ in split.pre_tokenize_str(doubtful)}
    return "".join(c for c in doubtful if c not in known)


class WordBPE:
    """encode(text) -> array of ids; decode(ids) -> text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocab
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*ids.values(), *self.added.values()]) + 1)
        for text, i in [*ids.items(), *self.added.items()]:
            self.strings[i] = text
        letters = byte_letters()
        self.single = [ids[c] for c in letters]
        self.last = [ids[c + self.suffix] for c in letters]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = self.find_rare = regex.compile(pattern).findall
        pattern_is_other = pattern != WORDS
        self.newer = frozenset(_newer())
        if self.newer:
            # The file's library has no letters or digits that its Unicode version does not know.  Large character
            # sets are slow, so only texts that hold such a character take this pattern.
            some = "".join(self.newer)
            for kind in ("L", "N"):
                pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[\\p{{{kind}}}--[{some}]]")
            pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{some}]]")
            self.find_rare = regex.compile(pattern, regex.V1).findall
        self.first_newer = min(self.newer, default="")
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else None
        # A text without the letters that all added tokens begin with needs no cutting.
        stem = os.path.commonprefix(list(self.added))
        self.begins = (lambda text: stem in text) if stem else (lambda text: True)
        # What the pattern says about lower-cased ASCII.
        self.find_ascii = self.find if pattern_is_other else re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def word_ids(self, word: str) -> list[int]:
        """Merge one word; lowest rank first, leftmost among equals."""
        raw = word.encode("utf-8", "surrogatepass")
        ids = [self.single[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        n = len(ids)
        if n == 1:
            return ids
        merges = self.merges
        prev, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        queue = [(hit[0], i, hit[1], ids[i], ids[i + 1]) for i in range(n - 1) if (hit := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new, left, right = heapq.heappop(queue)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != left or ids[j] != right:
                continue  # stale: one side has been merged since
            ids[i], alive[j] = new, False
            k = after[i] = after[j]
            if k >= 0:
                prev[k] = i
                if hit := merges.get((new, ids[k])):
                    heapq.heappush(queue, (hit[0], i, hit[1], new, ids[k]))
            h = prev[i]
            if h >= 0 and (hit := merges.get((ids[h], new))):
                heapq.heappush(queue, (hit[0], h, hit[1], ids[h], new))
        return [x for x, live in zip(ids, alive, strict=True) if live]

    def _segment(self, text: str) -> bytes:
        if text.isascii():
            words = self.find_ascii(text.lower())
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
            rare = self.newer and max(text) >= self.first_newer and not self.newer.isdisjoint(text)
            words = (self.find_rare if rare else self.find)(text)
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    word = words[k]
                    ids = known.get(word)
                    if ids is None:
                        ids = self.older.get(word) or array("I", self.word_ids(word)).tobytes()
                        if len(known) >= REMEMBERED:
                            self.older, known = known, {}
                            self.known = known
                        if len(word) <= 64:
                            known[word] = ids
                    found[k] = ids
        return b"".join(found)

    def encode(self, text: str | None) -> array:
        out = array("I")
        if not text:
            return out
        for k, part in enumerate(self.cut(text) if self.cut and self.begins(text) else [text]):
            if k % 2:
                out.append(self.added[part])
            elif part:
                out.frombytes(self._segment(part))
        return out

    def decode(self, ids) -> str:
        """The vocabulary strings of the ids in order, a space between two (the file names no decoder)."""
        return " ".join(map(self.strings.__getitem__, ids))


_loaded: dict[str, WordBPE] = {}


def load(path: str | None = None) -> WordBPE:
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def _little(ids: array) -> bytes:
    import sys

    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with `ids` (array<int>) and `decoded` appended; where docs has a column so named, the new one takes underscores
    behind its name until it is free.  Repeated rows, null ids and empty tables need no care."""
    kept = docs.columns
    ids_name, decoded_name = (free(kept, n) for n in ("ids", "decoded"))
    schema = StructType([*docs.schema.fields, StructField(ids_name, ArrayType(IntegerType())), StructField(decoded_name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in _slices(batch):
                ids = [bpe.encode(t) for t in part.column(text).to_pylist()]
                columns = [part.column(k) for k in range(len(kept))]
                columns += [pa.array([list(i) for i in ids], pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, ids_name, decoded_name])

    return docs.mapInArrow(run, schema)


def free(taken: list[str], name: str) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: n_tokens, SHA-256 of the ids (little-endian, 32 bits each) and of the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = bpe.encode(text.as_py())
                rows.append((doc_id, len(ids), hashlib.sha256(_little(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids).encode("utf-8", "replace")).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
