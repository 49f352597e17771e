import zlib

import numpy as np

from webweft.llm import langid
from webweft.llm.common import table

from .fixtures import frame


def test_filter_holds_everything():
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for _ in range(70)]
    f = langid.Filters([f"l{i}" for i in range(70)], sets)
    for i, s in enumerate(sets):
        assert ((f.lookup(s, i // 64) >> np.uint64(i % 64)) & np.uint64(1)).all()
    other = rng.integers(0, 1 << 63, 20000, dtype=np.uint64)
    hits = ((f.lookup(other, 0) >> np.uint64(3)) & np.uint64(1)).mean()
    assert abs(hits - f.rate[3]) < 0.01


def test_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    out = langid.digest(docs)
    rows = out.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    right = np.mean([r.lang_pred == r.lang for r in rows if r.lang])
    print(f"held-out accuracy {right:.4f}")
    assert right > 0.97 and out.count() == docs.count()


def test_edges(spark):
    texts = ["the and of with that", None, "", "123 !!", "der die und nicht mit", "x" * 100000, "日本語"] * 6
    docs = frame(spark, texts)
    out = langid.digest(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None and not langid.has_letter(texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "und")
    assert {r.lang_pred for r in langid.digest(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false")).collect()} == set()
    from pyspark.sql import functions as F

    assert {r.lang_pred for r in langid.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def gram_words(text):
    """The n-grams of a text as strings, by plain slicing: words of letters with an edge at both ends."""
    import re

    out = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        word = "".join(c for c in word if c.isalpha())
        padded = f"\0{word}\0"
        out += [padded[i : i + n] for n in langid.ORDERS for i in range(len(padded) - n + 1)]
    return out


def test_by_plain_counts(spark, small):
    """The learned n-grams and the predictions against counters and sets of strings."""
    from collections import Counter

    docs = table(spark, small, "documents").where("length(text) < 3000")
    rows = [r for r in docs.collect() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 5]
    counts = {}
    for r in rows:
        counts.setdefault(r.lang, Counter()).update(gram_words(r.text))
    total = {k: sum(c.values()) for k, c in counts.items()}
    share = {k: {g: n / total[k] for g, n in c.items() if n >= max(2, langid.LEAST * total[k])} for k, c in counts.items()}
    top = Counter()
    for f in share.values():
        for g, v in f.items():
            top[g] = max(top[g], v)
    want = {k: {g for g, v in f.items() if v >= langid.SHARE * top[g]} for k, f in share.items()}
    got = langid.learned(docs, 10**6)
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    filters = langid.train(docs, 10**6)
    same = 0
    for r in rows[:300]:
        hits = Counter(k for g in gram_words(r.text) for k in want if g in want[k])
        same += filters.predict(r.text)[0] == max(sorted(want), key=lambda k: hits[k])
    assert same >= 298  # the filters' false positives are corrected in the mean only


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"word{i} text", "en" if i % 3 else "de") for i in range(3000)] * 2, "doc_id long, text string, lang string")
    n = {r.lang: r["count"] for r in langid.sampled(docs, 50).groupBy("lang").count().collect()}
    assert n == {"en": 50, "de": 50}


def test_rare_letters_and_clashing_columns(spark):
    text = chr(0x30000) * 30 + " " + chr(0x31350) * 5
    assert langid.has_letter(text) and sum(len(h) for h in langid.grams(text)) > 0
    docs = spark.createDataFrame([(1, text, "zz", 5, "p")] * 2 + [(k, "the and", "en", 1, None) for k in range(2, 9)], "doc_id long, text string, lang string, `__lang` int, `__p` string")
    out = langid.predict(docs, langid.train(docs))
    assert out.columns == ["doc_id", "text", "lang", "__p", "__lang", "__lang_score"]
    assert {r["__lang"] for r in out.where("doc_id = 1").collect()} == {"zz"}
