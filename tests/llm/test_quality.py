import zlib

import numpy as np

from webweft.llm import quality
from webweft.llm.common import table

from .fixtures import frame, prose


def test_risk_separates():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1.5, 1, (3000, 5)), rng.normal(-1.5, 1, (3000, 5))
    good[:, 0] = bad[:, 0] = 5.0  # log of the number of words
    net = quality.fit(good[:1000], np.concatenate([good[1000:2000], bad[:500]]), 2 / 3, steps=400)
    assert (quality._forward(good[2000:], net)[1] > 0).mean() > 0.93 and (quality._forward(bad[500:], net)[1] < 0).mean() > 0.93


def test_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality.train(docs, labels)
    share = labels.where("quality = 1").count() / labels.count()
    print(f"estimated prior {model[-1]:.3f}, share of label 1 {share:.3f}")
    assert abs(model[-1] - share) < 0.08
    out = quality.digest(docs, labels, model=model)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    right = np.mean([r.predicted == r.quality for r in rows])
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([[(g > b) + 0.5 * (g == b) for g in good] for b in bad])
    print(f"held-out accuracy {right:.3f}, AUC {auc:.3f}, good kept {np.mean([g >= 0.3 for g in good]):.3f}, bad dropped {np.mean([b < 0.3 for b in bad]):.3f}")
    assert right > 0.95 and auc > 0.95


def test_edges(spark):
    docs = frame(spark, ["", None, prose(20000, 2), "a"])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.digest(docs, none).collect()
    assert len(out) == docs.count() and {r.score for r in out} == {0.5}
    assert not quality.digest(docs.limit(0), none).collect()
    texts = [prose(60, i) if i % 2 else "BUY NOW!! " * (5 + i) for i in range(60)] + ["", None]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    out = quality.digest(frame(spark, texts), labels).collect()
    assert len(out) == 66 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)


def test_no_negative_label_is_read(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    scores = lambda ls: {r.doc_id: r.score for r in quality.digest(docs, ls, sample=300).collect()}
    assert scores(labels) == scores(labels.where("quality = 1"))


def test_scores_by_plain_loops(spark, small):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    net, a, b, lex, prior = model = quality.train(docs, labels, sample=300)
    out = {r.doc_id: r.score for r in quality.digest(docs, labels, model=model).collect()}
    for r in docs.limit(100).collect():
        n = len((r.text or "").split())
        x = [(v - m) / s * (n / (n + quality.FEW_WORDS) if k else 1) for k, (v, m, s) in enumerate(zip(quality.features(r.text, lex), net["mean"], net["std"], strict=True))]
        hidden = [np.tanh(sum(v * w for v, w in zip(x, column, strict=True)) + c) for column, c in zip(net["w1"].T, net["b1"], strict=True)]
        margin = sum(h * w for h, w in zip(hidden, net["w2"][:, 0], strict=True)) + net["b2"][0]
        assert abs(out[r.doc_id] - 1 / (1 + np.exp(-(a * margin + b)))) < 1e-9


def test_prior_and_map():
    rng = np.random.default_rng(5)
    p, n = rng.normal(2, 1, 4000), rng.normal(-2, 1, 4000)
    for share in (0.2, 0.5, 0.85):
        k = int(4000 * share)
        u = np.concatenate([rng.normal(2, 1, k), n[: 4000 - k]])
        assert abs(quality.prior_of(p, u) - share) < 0.06
        a, b = quality.calibrate(p, u, share)
        true = np.concatenate([np.ones(k), np.zeros(4000 - k)])
        q = np.clip(1 / (1 + np.exp(-(a * u + b))), 1e-9, 1 - 1e-9)
        assert abs(q.mean() - share) < 0.03 and -np.mean(true * np.log(q) + (1 - true) * np.log(1 - q)) < 0.15


def test_clashing_columns(spark):
    texts = [prose(60, i) if i % 2 else "BUY NOW!! " * (5 + i) for i in range(80)]
    docs = spark.createDataFrame([(i, t, 7, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, `__score` int, `__s` string, `__row` int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and {(r["__score"], r["__s"], r["__row"]) for r in kept.collect()} <= {(7, "s", 1)}
