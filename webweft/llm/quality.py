"""Quality classifier by positive-unlabelled learning.

Trusted positives (quality = 1) and unlabelled documents train a small network whose loss is the non-negative
unbiased risk: pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)); where the bracket turns negative the step climbs back on
it.  No negative label is read.  The class prior pi is estimated from positives and unlabelled rows alone: of a first
network, kept from half of the rows, the threshold above which the rest of both shows the least ratio of unlabelled to
positive shares bounds it (best bin).  The margin becomes a probability by the logistic map that minimises the unbiased
log loss on the same two samples.

Inputs are shape statistics of the text and two lexical ones: how much commoner its distinct words are, by hash, in
positives than in unlabelled texts.  Only the text is an input.  Training rows are those whose crc32(doc_id) mod 5 is
not 0.  Bounded samples, lowest id hash first: SAMPLE positives and 2 * SAMPLE unlabelled documents; in each, rows of
even hash make the lexicon, the others train.
Defined cases: null text counts as empty; without positives, every score is 0.5; a doc_id labelled twice takes the
higher label; rows that share a doc_id are scored each by its own text; empty tables give no rows; columns of docs are
kept (those named __score and __predicted are replaced)."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, shielded, stored

SAMPLE = 4000
THRESHOLD = 0.3
#: Hash buckets of the lexicon, and the count at which a bucket's own evidence weighs as much as none.
LEX_BITS, LEX_PULL = 15, 10.0
#: Words at which a text's shares weigh half.
FEW_WORDS = 4.0
#: Logarithm of a number of words from which texts count as equally long.
LONG = 6.0
_ODD = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_FEATURES = 19


def buckets(words) -> np.ndarray:
    """The lexicon buckets of distinct words."""
    mask = (1 << LEX_BITS) - 1
    return np.array([zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & mask for w in words], np.int64)


def lexicon(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int) -> np.ndarray:
    """Per bucket the log ratio of its share of positive and of unlabelled texts, drawn to 0 where counts are low."""
    ratio = np.log((positive + 0.5) / (n_positive + 1)) - np.log((unlabelled + 0.5) / (n_unlabelled + 1))
    seen = positive + unlabelled
    return np.clip(ratio, -4, 4) * seen / (seen + LEX_PULL)


def features(text: str | None, lex: np.ndarray | None = None) -> list[float]:
    """Shape statistics of a text and its two lexical ones."""
    text = text or ""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * (_FEATURES - 1) + [1.0]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ends = Counter(w[-1] for w in words)
    upper = sum(map(str.isupper, words))
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    bare = sum(v for k, v in counts.items() if not any(map(str.isalnum, k)))
    odd = len(_ODD.findall(text))
    digits = sum(any(c.isdigit() for c in w) for w in counts)
    letters = sum(map(len, counts)) / len(counts)
    strange = sum(v for c, v in ends.items() if not c.isalnum() and c not in ".,;:!?'\")")
    trails = sum(v for k, v in counts.items() if len(k) > 2 and not k[-1].isalnum() and not k[-2].isalnum())
    lexical = lex[buckets(counts)] if lex is not None else np.zeros(1)
    return [
        min(math.log1p(n), LONG),
        math.log1p(size / n),
        math.log1p(len(counts)) / math.log1p(n),
        counts.most_common(1)[0][1] / n,
        math.sqrt(repeats / n),
        upper / n,
        bare / n,
        math.sqrt(odd / size),
        digits / len(counts),
        math.log1p(letters),
        (ends["."] + ends["!"] + ends["?"]) / n,
        strange / n,
        trails / n,
        len(set(lines)) / len(lines),
        min(math.log1p(n / len(lines)), LONG),
        sum(map(str.islower, words)) / n,
        float(lexical.mean()),
        float((lexical < -0.3).mean()),
        0.0,
    ]


def _standard(x: np.ndarray, p: dict[str, np.ndarray]) -> np.ndarray:
    """Features in standard units; shares of a text of few words say little, so they are drawn to the mean."""
    n = np.expm1(x[:, :1])
    z = (x - p["mean"]) / p["std"] * (n / (n + FEW_WORDS))
    z[:, 0] = (x[:, 0] - p["mean"][0]) / p["std"][0]
    return z


def _forward(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(_standard(x, p) @ p["w1"] + p["b1"])
    return h, (h @ p["w2"] + p["b2"])[:, 0]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, hidden: int = 12, rate: float = 0.02, seed: int = 3) -> dict[str, np.ndarray]:
    """Minimise the non-negative risk with Adam over mini-batches; the loss is the sigmoid loss."""
    rng = np.random.default_rng(seed)
    d = positive.shape[1]
    both = np.concatenate([positive, unlabelled])
    p = {"mean": both.mean(0), "std": both.std(0) + 1e-6, "w1": rng.normal(0, 1 / math.sqrt(d), (d, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, 1 / math.sqrt(hidden), (hidden, 1)), "b2": np.zeros(1)}
    names = ("w1", "b1", "w2", "b2")
    m, v = {k: np.zeros_like(p[k]) for k in names}, {k: np.zeros_like(p[k]) for k in names}
    for step in range(1, steps + 1):
        xp, xu = positive[rng.integers(0, len(positive), 256)], unlabelled[rng.integers(0, len(unlabelled), 512)]
        x = np.concatenate([xp, xu])
        h, g = _forward(x, p)
        s = 1 / (1 + np.exp(np.clip(g, -30, 30)))  # sigmoid loss of a positive; 1 - s of a negative
        slope, np_, nu = s * (1 - s), len(xp), len(xu)
        rest = (1 - s[np_:]).mean() - prior * (1 - s[:np_]).mean()
        dg = np.zeros_like(g)
        if rest >= 0:
            dg[:np_] = (-prior * slope[:np_] - prior * slope[:np_]) / np_
            dg[np_:] = slope[np_:] / nu
        else:  # climb on the bracket alone
            dg[:np_], dg[np_:] = prior * slope[:np_] / np_, -slope[np_:] / nu
        dh = (dg[:, None] @ p["w2"].T) * (1 - h * h)
        z = _standard(x, p)
        grad = {"w2": h.T @ dg[:, None], "b2": dg.sum(keepdims=True), "w1": z.T @ dh, "b1": dh.sum(0)}
        lr = rate * (1 - step / (steps + 1))
        for k in names:
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * v[k] + 0.001 * grad[k] ** 2
            p[k] = p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) - lr * 1e-4 * p[k]
    return p


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from both sides' margins: the ratio of their shares above the
    threshold where that ratio, with room for chance, is least."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    at = np.unique(positive)
    p = 1 - np.searchsorted(np.sort(positive), at, "left") / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), at, "left") / len(unlabelled)
    room = math.sqrt(math.log(4 / delta) / (2 * len(positive))) + math.sqrt(math.log(4 / delta) / (2 * len(unlabelled)))
    best = int(np.argmin((u + room) / p))
    return float(min(0.98, max(0.02, u[best] / p[best])))


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 60) -> tuple[float, float]:
    """a, b of the logistic map sigmoid(a * margin + b): least unbiased log loss mean_u softplus(z) - prior * mean_p z, which
    is convex, by damped Newton steps with a little ridge."""
    w, ridge = np.array([1.0, 0.0]), 1e-3
    xp, xu = (np.stack([m, np.ones_like(m)], 1) for m in (positive, unlabelled))
    up = xp.mean(0) * prior

    def loss(w):
        return np.logaddexp(0, xu @ w).mean() - up @ w + ridge / 2 * (w @ w)

    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(xu @ w, -30, 30)))
        grad = xu.T @ q / len(xu) - up + ridge * w
        step = np.linalg.solve((xu * (q * (1 - q))[:, None]).T @ xu / len(xu) + ridge * np.eye(2), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return float(max(w[0], 1e-3)), float(w[1])


def _sample(ids: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text, __h) of the n rows of ids with the lowest id hash (a bounded sample, so it may be broadcast)."""
    chosen = ids.select("doc_id", F.xxhash64("doc_id").alias("__h")).orderBy("__h", "doc_id").limit(n)
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__h").agg(F.min("text").alias("text"))


def _word_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, n): texts that hold a word of bucket h; bucket -1 has the number of texts."""
    total = np.zeros((1 << LEX_BITS) + 1, np.int64)
    for frame in frames:
        for text in frame["text"]:
            total[np.unique(buckets(set((text or "").split())))] += 1
            total[-1] += 1
    h = np.flatnonzero(total)
    yield pd.DataFrame({"h": np.where(h == 1 << LEX_BITS, -1, h).astype(np.int64), "n": total[h]})


def _lexical_counts(rows: DataFrame) -> tuple[np.ndarray, int]:
    found = rows.mapInPandas(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    out, size = np.zeros(1 << LEX_BITS), 0
    for r in found:
        if r["h"] < 0:
            size = int(r["n"])
        else:
            out[r["h"]] = r["n"]
    return out, size


def _measured(rows: DataFrame, lex: np.ndarray) -> np.ndarray:
    @F.pandas_udf("array<double>")
    def measured(text: pd.Series) -> pd.Series:
        return text.map(lambda t: features(t, lex))

    found = sorted((r["doc_id"], r["x"]) for r in rows.select("doc_id", measured("text").alias("x")).collect())
    return np.array([x for _, x in found], float).reshape(-1, _FEATURES)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """(net, a, b, lexicon, prior) of the model, or a constant score where there are no positives to learn from."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    good = labels.where(~held_out() & (F.col("quality") == 1)).select("doc_id").distinct()
    web_ids = texts.where(~held_out()).select("doc_id").distinct()
    positive, web = stored(_sample(good, texts, sample), "positives"), stored(_sample(web_ids, texts, 2 * sample), "unlabelled")
    even = F.col("__h") % 2 == 0
    (p, n_p), (u, n_u) = _lexical_counts(positive.where(even)), _lexical_counts(web.where(even))
    lex = lexicon(p, u, n_p, n_u)
    xp, xu = _measured(positive.where(~even), lex), _measured(web.where(~even), lex)
    if len(xp) < 2 or len(xu) < 2:
        return 0.5
    first = fit(xp[::2], xu[::2], 0.5, steps=600)
    prior = prior_of(_forward(xp[1::2], first)[1], _forward(xu[1::2], first)[1])
    net = fit(xp, xu, prior)
    return net, *calibrate(_forward(xp, net)[1], _forward(xu, net)[1], prior), lex, prior


def _scored(docs: DataFrame, model) -> tuple[DataFrame, dict[str, str]]:
    """docs as shielded, with `__s`."""
    out, inner = shielded(docs)
    if isinstance(model, float):
        return out.withColumn("__s", F.lit(model)), inner
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon's 256 KB and some hundred weights

    @F.pandas_udf("double")
    def scorer(text: pd.Series) -> pd.Series:
        net, a, b, lex, _ = shared.value
        if not len(text):
            return pd.Series([], dtype=float)
        x = np.array([features(t, lex) for t in text], float)
        return pd.Series(1 / (1 + np.exp(-np.clip(a * _forward(x, net)[1] + b, -30, 30))))

    return out.withColumn("__s", scorer(inner["text"])), inner


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, model=None) -> DataFrame:
    """docs with `__score` (double) and `__predicted` (int)."""
    scored, inner = _scored(docs, train(docs, labels, sample) if model is None else model)
    kept = [F.col(inner[c]).alias(c) for c in docs.columns if c not in ("__score", "__predicted")]
    return scored.select(*kept, F.col("__s").alias("__score"), F.when(F.col("__s") >= threshold, 1).otherwise(0).alias("__predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that the classifier accepts, with the columns of docs whatever their names."""
    scored, inner = _scored(docs, train(docs, labels, sample))
    return scored.where(F.col("__s") >= threshold).select(*[F.col(i).alias(c) for c, i in inner.items()])


def digest(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    out = score(docs.select("doc_id", "text"), labels, **how)
    return out.select("doc_id", held_out().alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").cast("int").alias("predicted"))
