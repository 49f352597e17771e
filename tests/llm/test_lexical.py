"""Ranking against every document's exact score, and the bounds against the scores."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from webweft.llm import lexical
from webweft.llm.common import table

from .fixtures import WORDS, frame, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, k):
    held = [(i, words(t)) for i, t in docs]
    n_docs, total = sum(bool(w) for _, w in held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in asked.items():
        rows = []
        for doc_id, w in held:
            if doc_id is None or not w:
                continue
            tf, m = Counter(w), 100 - 90 + (90 * len(w) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if t in tf)
            if score > 0:
                rows.append((-score, doc_id))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(rows)[:k])]
    return sorted(out)


ITEMS = [(1, "the and of"), (1, "thing thing sound"), (2, "THE7 \u00e9t\u00e9 x"), (3, None), (4, ""), (5, "absent words only"), (None, "the"), (6, "water light never ing20 " * 40), (7, "\u00c9t\u00c9 a-b_c 9"), (6, "water light never ing20 " * 40)]


@pytest.mark.parametrize("queries", [512, 1])
def test_small(spark, queries):
    texts = [prose(5 + 13 * (k % 29), k % 90) for k in range(400)] + [None, "", " !? ", "\u00e9t\u00e9 \u00c9t\u00e9 a-b_c A,B", "the " * 30000, prose(20000, 5)]
    docs = frame(spark, texts)
    items = spark.createDataFrame([(*i, 5) for i in ITEMS], "item_id long, text string, doc_id int")
    got = lexical.ranked(docs, items, queries=queries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain([(r.doc_id, r.text) for r in docs.collect()], ITEMS, 10)


def test_ties_at_the_last_place(spark):
    docs = spark.createDataFrame([(500 - i, "alpha beta" if i % 3 else "alpha gamma delta") for i in range(400)], "doc_id long, text string").repartition(7)
    got = lexical.ranked(docs, spark.createDataFrame([(1, "beta"), (2, "alpha delta")], "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == plain([(r.doc_id, r.text) for r in docs.collect()], [(1, "beta"), (2, "alpha delta")], 10)


def test_empty_tables(spark):
    docs, items = frame(spark, [prose(9, 1)]), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(docs.where("text is null"), items).count() == 0


def test_bounds_hold_and_bytes_suffice():
    rng = np.random.default_rng(3)
    tf, m = rng.integers(1, 10**6, 10000), rng.integers(10, 10**7, 10000)
    exact = lexical.impact(tf, m)
    level = -(-exact // lexical.STEP)
    assert level.min() >= 0 and level.max() <= 255 and lexical.impact(10**9, 10) // lexical.STEP < 255
    assert (level * lexical.STEP >= exact).all() and (np.maximum((level - 1) * lexical.STEP + 1, 0) <= exact).all()


def test_bounds_spare_most_documents(spark, small):
    """The first level leaves few documents to score, and none of the best is lost."""
    docs = table(spark, small, "documents").select("doc_id", "text")
    block = lexical.Queries([tuple(r) for r in table(spark, small, "benchmark").select("item_id", "text").collect()])
    rows = lexical.index(docs, block).cache()
    total = [rows.where("n > 0").count(), rows.groupBy().sum("n").first()[0]]
    block.weigh(total[0], {r["term"]: r["count"] for r in rows.selectExpr("explode(terms) AS term").groupBy("term").count().collect()})
    rows = lexical.quantised(rows, *total)
    bar = lexical.thresholds(rows, block, 10)
    best = lexical.rescored(rows, block, bar, *total, 10).collect()
    least = {q: sorted((r.score for r in best if r["query"] == q), reverse=True)[9] for q in range(len(block.ids))}
    assert all(bar[q] <= s for q, s in least.items()) and all(bar[q] >= s * 0.8 for q, s in least.items())


def test_terms():
    assert lexical.terms("A-B_\u00c9t9\u00a0z\x7fQ") == ["a".encode(), b"b", "\u00c9t9\u00a0z".encode(), b"q"]
    assert len(WORDS) > 3
