"""The pipeline's stages, one by one, against plain Python, and on awkward tables."""

import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from webweft.llm import bpe, pii, quality, source_mix
from webweft.llm.common import table

from .fixtures import prose
from .test_ngram_join import brute
from .test_source_mix import size

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, pass string, `__doc` string, `__id` int, ids int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A small corpus with the awkward rows, and its labels, as Parquet."""
    where = str(tmp_path_factory.mktemp("corpus"))
    texts = [prose(50 + 3 * i, i) for i in range(60)]
    texts += [texts[3], texts[3] + " one more", "BUY NOW!! " * 40, "%%% *** " * 60, "", None, " \t", "mail ab.cd@x.org, card 4111 1111 1111 1111 " + prose(40, 900)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "p", "d", i, 1) for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], (None, texts[9], None, None, None, None, None, None, None), (4, texts[11], "en", "s1", 1, "p", "d", 77, 1), (None,) * 9]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{where}/documents.parquet")
    junk = [(1000 + i, "BUY NOW!! " * (20 + i), "en", "s0", 1, "p", "d", 1, 1) for i in range(40)]
    spark.createDataFrame(junk, COLUMNS).write.mode("append").parquet(f"{where}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(1000 + i, 0, 0) for i in range(40)] + [(None, 1, None), (5, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def plain(rows):
    return Counter(tuple(r) for r in rows)


def test_stages(spark, corpus):
    docs = table(spark, corpus, "documents")
    columns = docs.columns
    model = quality.train(docs, table(spark, corpus, "labels"))
    net, a, b, lex, _ = model

    # Quality: rows whose own score, worked out here, reaches the threshold.
    import numpy as np

    def kept(r):
        x = np.array([quality.features(r.text, lex)])
        return 1 / (1 + np.exp(-np.clip(a * quality._forward(x, net)[1][0] + b, -30, 30))) >= 0.3

    good = corpus_pipeline.keep_good(spark, docs, corpus)
    assert good.columns == columns
    before, after = docs.collect(), good.collect()
    assert plain(after) == plain([r for r in before if kept(r)])
    assert not any(r.text and r.text.startswith("BUY NOW") for r in after) and {r.doc_id for r in after} >= set(range(60))

    # Near duplicates: one row of each class, all rows without words or id.
    one = corpus_pipeline.one_of_each(spark, good, corpus)
    assert one.columns == columns
    rows = one.collect()
    classes = Counter(c for (i, n, c), _ in brute([tuple(r)[:2] for r in after], 5, 80, 100).items() if n and i is not None)
    worded = [r for r in rows if r.doc_id is not None and (r.text or "").split()]
    assert {r.doc_id for r in worded} == set(classes) and not plain(rows) - plain(after)
    assert plain(r for r in rows if r not in worded) == plain(r for r in after if r.doc_id is None or not (r.text or "").split())

    # Personal data: nothing else changes.
    hidden = corpus_pipeline.pseudonymised(spark, one, corpus)
    assert hidden.columns == columns
    found = {(r.doc_id, r["__id"]): r for r in hidden.collect()}
    for r in rows:
        new = found[(r.doc_id, r["__id"])]
        if r.text and "@" in r.text:
            assert "4111" not in new.text and "ab.cd@" not in new.text and len(new.text) == len(r.text) and new.text.endswith(prose(40, 900))
        else:
            assert new.text == r.text
        assert new.n_chars == (None if new.text is None else len(new.text))

    # Mixing: the words of the mix are those of the documents, near each source's target.
    mix = corpus_pipeline.mixed(spark, hidden, corpus)
    assert mix.columns == columns
    words, total, taken = {}, defaultdict(int), defaultdict(int)
    for r in found.values():
        words.setdefault(r.doc_id, Counter()).update((r.text or "").split())
        total[r.source] += size(r.text)
    for r in mix.collect():
        assert not Counter(r.text.split()) - words[r.doc_id] and r.n_chars == len(r.text)
        taken[r.source] += size(r.text)
    order = sorted(total, key=lambda s: (s is None, s or ""))
    for s, t in zip(order, source_mix.targets([total[s] for s in order]), strict=True):
        assert abs(taken[s] - t) <= 1.5 * source_mix.BLOCK

    # Encoding: as the tokenizers library; the column named ids stays.
    lib = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())
    out = corpus_pipeline.encoded(spark, mix, corpus)
    assert out.columns == [*columns, "ids_", "decoded"]
    for r in out.collect():
        want = lib.encode(r.text, add_special_tokens=False).ids
        assert list(r.ids_) == want and r.decoded == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, corpus, name):
    docs = table(spark, corpus, "documents").limit(0)
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, corpus)
    assert out.columns[: len(docs.columns)] == docs.columns and not out.collect()


def test_run(spark, tiny):
    docs = table(spark, tiny, "documents")
    out = corpus_pipeline.run(spark, tiny)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    rows = out.collect()
    assert rows and all(r.n_chars == len(r.text) for r in rows)
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    assert not any(re.search(r"[\w.]+@[\w.]+\w", r.text) and r.text in {d.text for d in docs.collect()} for r in rows)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert pii.KEY_SETTING


def test_python_gets_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for own, left in (("10000", "1000"), ("77", "77")):
            spark.conf.set(key, own)
            corpus_pipeline.encoded(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
            assert spark.conf.get(key) == left
    finally:
        spark.conf.set(key, before)
