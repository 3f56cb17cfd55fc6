"""Operator 5: a quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled set is web text
whatever its label. With class prior pi and a loss l the non-negative risk is
pi R_p(+) + max(0, R_u(-) - pi R_p(-)); a step is taken against the second term
where it is negative, so that the model does not fit it below zero (Kiryo et
al. 2017). The model is a network of one hidden layer on features of the whole
text; the loss is logistic, so the score estimates the chance of label 1.

Held out are the rows whose crc32 of the id has remainder 2 by 4; labels, and
any text the model is fitted on, come from the other rows. The prior is the
share of positives among labelled rows there. Fitting takes at most
``MAX_FIT`` rows of each set, chosen by a hash of the id; every row is scored.

Cases: null and empty texts have zero features and a score; repeated rows are
each scored; a null id is not held out and not labelled; without a trusted
positive every score is the prior (0.5 if there is no label); an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, saved
from .quality_rules import CLASSES, base_counts, histograms

MAX_FIT, FOLDS, HELD_OUT, THRESHOLD = 12_000, 4, 2, 0.7
WIDTH, HIDDEN, EPOCHS, RATE, DECAY, SEED = CLASSES + 12, 16, 60, 0.01, 1e-4, 7


def features(text: str) -> np.ndarray:
    """Shares and means that describe a text's form; none depends on its language or topic."""
    n_words, chars, symbols, dup_lines, repeated = base_counts(text)
    if not n_words:
        return np.zeros(WIDTH)
    cls, words = histograms(text)
    share = cls / cls.sum()
    data = text.encode()
    lower = data.lower()
    tokens = ALNUM.findall(lower)
    seen = Counter(tokens)
    lines = [x for x in data.split(b"\n") if x.strip()]
    pieces = data.split()
    n = len(tokens) or 1
    runs = sum(a == b for a, b in zip(pieces, pieces[1:]))
    freq = np.array(list(seen.values()) or [1], float) / n
    return np.array([
        *share, np.log1p(n_words) / 10, chars / n_words / 10, symbols / (len(text) or 1), dup_lines / max(1, len(lines)), repeated / n_words,
        len(seen) / n, words[:-1].sum() / n, runs / n_words, -(freq * np.log(freq)).sum() / np.log(n + 1),
        data.count(b" | ") / n_words,
        data.count(b"!") / len(data), np.log1p(len(lines)) / 5,
    ])


def _forward(x: np.ndarray, w: dict) -> tuple[np.ndarray, np.ndarray]:
    h = np.tanh(x @ w["a"] + w["b"])
    return h, h @ w["c"] + w["d"]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = SEED) -> dict:
    """Weights of the network that minimises the non-negative risk, and the scaling of its inputs."""
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled])
    mean, std = both.mean(0), both.std(0) + 1e-6
    p, u = np.clip((positive - mean) / std, -8, 8), np.clip((unlabelled - mean) / std, -8, 8)
    w = {"a": rng.normal(0, 0.3, (p.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    m, v, t, size = {k: 0 * x for k, x in w.items()}, {k: 0 * x for k, x in w.items()}, 0, 512
    sigmoid = lambda z: 1 / (1 + np.exp(-z))

    def grad(x: np.ndarray, g: np.ndarray) -> dict:
        h, _ = _forward(x, w)
        back = np.outer(g, w["c"]) * (1 - h * h)
        return {"a": x.T @ back, "b": back.sum(0), "c": h.T @ g, "d": np.array([g.sum()])}

    for _ in range(EPOCHS):
        order_u, order_p = rng.permutation(len(u)), rng.permutation(max(len(p), len(u))) % len(p)
        for at in range(0, len(u), size):
            xu, xp = u[order_u[at:at + size]], p[order_p[at:at + size]]
            zu, zp = _forward(xu, w)[1], _forward(xp, w)[1]
            rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp_plus, gp_minus, gu = -prior * (1 - sigmoid(zp)) / len(xp), prior * sigmoid(zp) / len(xp), sigmoid(zu) / len(xu)
            parts = [(xp, gp_plus), (xp, -gp_minus), (xu, gu)] if rest >= 0 else [(xp, gp_minus), (xu, -gu)]
            total = {k: sum(g[k] for g in (grad(x, z) for x, z in parts)) + DECAY * w[k] for k in w}
            t += 1
            for k, g in total.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w | {"mean": mean, "std": std}


def predict(x: np.ndarray, w: dict) -> np.ndarray:
    z = _forward(np.clip((x - w["mean"]) / w["std"], -8, 8), w)[1]
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _sample(rows: DataFrame, bound: int) -> np.ndarray:
    """At most about ``bound`` rows' features, chosen by a hash of the id."""
    n = rows.count()
    if n > bound:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    got = rows.select("x").toArrow()["x"]
    return np.array(got.to_pylist(), float).reshape(len(got), WIDTH)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def score_quality(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([features(t.as_py() or "") for t in b["text"]], pa.list_(pa.float64()))], names=["doc_id", "x"])

    measured = saved(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
                     .mapInArrow(measure, "doc_id long, x array<double>"))
    marks = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label"))
             .where((fold(F.col("doc_id")) != HELD_OUT) & F.col("label").isNotNull()))
    rate = marks.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    prior = min(0.99, max(0.01, 0.5 if rate is None else rate))
    open_rows = measured.where(fold(F.col("doc_id")) != HELD_OUT)
    positive = _sample(open_rows.join(marks.where("label = 1").select("doc_id").distinct(), "doc_id", "left_semi"), max_fit)
    model = fit(positive, _sample(open_rows, max_fit), prior) if len(positive) else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].flatten().to_numpy().reshape(b.num_rows, WIDTH)
            got = predict(x, shared.value) if shared.value and b.num_rows else np.full(b.num_rows, prior)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(got, pa.float64())], names=["doc_id", "score"])

    return (measured.mapInArrow(score, "doc_id long, score double")
            .select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
