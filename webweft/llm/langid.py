"""Language identification with language-bitmask n-gram filters.

Training keeps, for each language, the letter n-grams (2 to 4 letters, word edges counting as letters) that are
common in it and not far more common elsewhere.  A bit-sliced Bloom filter holds them all: each slot is a bit
mask over the languages, adding an n-gram ORs the language's bit into k slots, and a look-up ANDs k slots, which
gives every language that contains the n-gram at once.  A text's n-grams are counted per language (popcounts),
each count is corrected for the language's false-positive rate, and the largest corrected share decides.

Learns only from rows with a non-null lang and crc32(doc_id) mod 5 not 0: per language the SAMPLE texts of lowest
hash, read whole.  An n-gram is learned if its share of its language's n-grams is LEAST or more, so a language has
1 / LEAST of them at most; that bounds what comes to the driver.  Defined cases: null text or no letter gives `und`
and score 0; a text none of whose n-grams is known gives the first learned language and score 0; nothing to learn
from gives `und` everywhere; rows that share doc_id, lang and text are learned once; columns of docs are kept (those
named __lang and __lang_score are replaced)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, mix, shielded, stored

SAMPLE = 1500
ORDERS = (2, 3, 4)
#: Rows (a language and a long) that may be broadcast.
FEW_CHOSEN = 1 << 19
#: An n-gram belongs to a language if its frequency there reaches LEAST and SHARE times its highest frequency.
LEAST, SHARE = 1e-5, 0.2
SLOT_BITS, HASHES = 21, 3
PIECE = 1 << 18
_letter: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if not _letter:
        _letter["is"] = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
    return _letter["is"]


def grams(text: str | None):
    """Arrays of n-gram hashes of a text, piece by piece (pieces overlap, so no n-gram is lost)."""
    if not text:
        return
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letters = _letters()
    c = np.where(letters[codes], codes, 0).astype(np.uint64)
    c = np.concatenate([np.zeros(1, np.uint64), c, np.zeros(1, np.uint64)])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # one edge between words
    with np.errstate(over="ignore"):
        for at in range(0, len(c), PIECE):
            p = c[at : at + PIECE + max(ORDERS) - 1]
            for n in ORDERS:
                m = min(PIECE, len(p) - n + 1)
                if m <= 0:
                    continue
                h = np.full(m, np.uint64(n))
                ok = np.zeros(m, bool)
                for i in range(n):
                    h = h * np.uint64(0x100000001B3) + p[i : i + m]
                    ok |= p[i : i + m] != 0
                for i in range(1, n - 1):
                    ok &= p[i : i + m] != 0  # an edge only at either end
                yield mix(h[ok])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, h, n, whole): sums of a few texts at a time; the row marked `whole` has the number of all n-grams."""
    for frame in frames:
        for lang, same in frame.groupby("lang"):
            total, seen, held = 0, [], 0
            for text in same["text"]:
                for h in grams(text):
                    seen.append(np.unique(h, return_counts=True))
                    total, held = total + len(h), held + len(seen[-1][0])
                if held > 1 << 21:
                    seen = [_merge(seen)]
                    held = len(seen[0][0])
            h, n = _merge(seen) if seen else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pd.DataFrame({"lang": lang, "h": np.append(h.view(np.int64), 0), "n": np.append(n, total), "whole": np.append(np.zeros(len(h), bool), True)})


def _merge(parts):
    h, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return h, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


class Filters:
    """The bit-sliced filter: `masks[plane, slot]` holds 64 languages' bits a plane."""

    def __init__(self, langs: list[str], per_lang: list[np.ndarray], bits: int = SLOT_BITS, hashes: int = HASHES):
        self.langs, self.bits, self.hashes = langs, bits, hashes
        self.masks = np.zeros((-(-max(1, len(langs)) // 64), 1 << bits), np.uint64)
        self.rate = np.zeros(len(langs))
        for l, h in enumerate(per_lang):
            for s in self._slots(h):
                self.masks[l // 64, s] |= np.uint64(1 << (l % 64))
            self.rate[l] = ((self.masks[l // 64] >> np.uint64(l % 64)) & np.uint64(1)).mean() ** hashes

    def _slots(self, h: np.ndarray):
        for k in range(self.hashes):
            yield ((h >> np.uint64(k * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def lookup(self, h: np.ndarray, plane: int = 0) -> np.ndarray:
        """For each n-gram the mask of the languages that contain it."""
        out = None
        for s in self._slots(h):
            out = self.masks[plane, s] if out is None else out & self.masks[plane, s]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return "und", 0.0
        counts, total = np.zeros(len(self.langs)), 0
        for h in grams(text):
            total += len(h)
            for plane in range(len(self.masks)):
                found = self.lookup(h, plane)
                for l in range(plane * 64, min(len(self.langs), plane * 64 + 64)):
                    counts[l] += np.count_nonzero(found & np.uint64(1 << (l % 64)))
        right = np.maximum(0.0, (counts - total * self.rate) / (1 - np.minimum(self.rate, 0.999)))
        if not right.sum():
            return self.langs[0], 0.0
        best = int(right.argmax())
        return self.langs[best], float(right[best] / right.sum())


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, text): per language the `sample` learnable texts of lowest hash.  Only texts whose hash is in the part of
    all hashes that holds some 1.5 times as many are ranked, so no task ranks a language's rows."""
    h = F.xxhash64("doc_id", "lang", "text")
    rows = docs.select("doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = rows.select("lang", h.alias("__h")).distinct()
    many = ids.groupBy("lang").agg(F.count("*").alias("__many"))
    place = F.col("__h").cast("double") / 2.0**64 + 0.5
    few = ids.join(many, "lang").where(place * F.col("__many") <= 1.5 * sample + 50)
    chosen = stored(few.withColumn("__n", F.row_number().over(Window.partitionBy("lang").orderBy("__h"))).where(F.col("__n") <= sample).select("lang", "__h"), "chosen")
    if chosen.count() <= FEW_CHOSEN:  # else the texts are shuffled
        chosen = F.broadcast(chosen)
    picked = rows.withColumn("__h", h).join(chosen, ["lang", "__h"], "left_semi")
    return picked.groupBy("lang", "__h").agg(F.min("text").alias("text")).select("lang", "text")


def learned(docs: DataFrame, sample: int) -> dict[str, np.ndarray]:
    """Each language's n-gram hashes."""
    counts = sampled(docs, sample).mapInPandas(_counts, "lang string, h long, n long, whole boolean").groupBy("lang", "h", "whole").agg(F.sum("n").alias("n"))
    totals = counts.where("whole").select("lang", F.col("n").alias("total"))
    often = counts.where("not whole").join(totals, "lang").where((F.col("n") >= 2) & (F.col("n") >= LEAST * F.col("total")))
    often = often.withColumn("f", F.col("n") / F.col("total"))
    top = often.groupBy("h").agg(F.max("f").alias("top"))
    kept = often.join(top, "h").where(F.col("f") >= SHARE * F.col("top"))
    # At most 1 / LEAST longs a language.
    found = kept.groupBy("lang").agg(F.array_sort(F.collect_list("h")).alias("h")).collect()
    empty = {r["lang"]: np.empty(0, np.uint64) for r in totals.select("lang").collect()}
    return empty | {r["lang"]: np.array(r["h"], np.int64).view(np.uint64) for r in found}


def train(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    found = learned(docs, sample)
    langs = sorted(found, key=str.encode)
    return Filters(langs, [found[k] for k in langs])


def predict(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """docs with `__lang` and `__lang_score`."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # 16 MB a 64 languages

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        f = shared.value
        return pd.DataFrame([f.predict(t) for t in texts], columns=["lang", "score"]).astype({"lang": "object", "score": "float64"})

    kept = [c for c in docs.columns if c not in ("__lang", "__lang_score")]
    out, inner = shielded(docs)
    out = out.withColumn("__p", run(inner[text]))
    return out.select(*[F.col(inner[c]).alias(c) for c in kept], F.col("__p.lang").alias("__lang"), F.col("__p.score").alias("__lang_score"))


def digest(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    out = predict(docs.select("doc_id", "text"), train(docs, sample))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__lang_score").alias("score"))
