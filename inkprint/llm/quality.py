"""Quality classifier by positive-unlabelled learning.

A small network over style features of the whole text minimises the non-negative unbiased risk: trusted positives carry
the positive part, unlabelled web text the negative part, weighted by an estimated share of positives (the class prior),
and the estimate of the negative risk is never let below zero.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import held_out, whole_text

FIT_ROWS = 24_000  # documents the network is fit on, in expectation; the only bound
CUTOFF = 0.7  # of the registered decision
HIDDEN, EPOCHS, BATCH, RATE, SEED = 24, 60, 2048, 0.01, 7
_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 32, 10, 13, 9]] = True
N_FEATURES = 34


def features(text: str) -> list[float]:
    """Style features of a whole text, in time linear in its length. Nothing but the text is read."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * N_FEATURES
    h = np.bincount(raw, minlength=256)
    words = text.split()
    n_words = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:]))
    lines = text.split("\n")
    letters = h[65:91].sum() + h[97:123].sum() + h[128:].sum()
    same = (raw[1:] == raw[:-1]) & ~_ALPHA[raw[1:]]
    runs = int((same[1:] & same[:-1]).sum())
    count = lambda chars: sum(int(h[ord(c)]) for c in chars)
    upper = int(h[65:91].sum())
    shout = sum(map(str.isupper, words))
    bare = sum(not w[:1].isalnum() for w in words)
    per_word = lambda x: x / n_words
    rates = [per_word(count(c)) for c in ("!", "|", "#", "$", "%", "&", "*", ",", ".", "?;:", "\"'", "()[]{}<>", "/\\", "-_=+", "0123456789")]
    rates += [per_word(x) for x in (again, shout, bare, runs, upper, len(lines))]
    shares = [letters / n, upper / max(1, letters), int(h[128:].sum()) / n, distinct / n_words, len(set(lines)) / len(lines)]
    sizes = [np.log1p(n_words) / 5, np.log1p(n / n_words) / 3, np.log1p(max(map(len, words), default=0)) / 4,
             np.log1p(n_words / len(lines)) / 5]
    seen = [float(x > 0) for x in (runs, again, shout, count("|"))]
    return [float(x) for x in (*np.sqrt(rates), *shares, *sizes, *seen)]


def feature_frame(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, N_FEATURES)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        # rounded, so that equal texts score alike whatever else is in their batch
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30))), 9)


def constant(prior: float) -> Model:
    """The model of a table without usable labels: every score is the prior."""
    odds = float(np.log(prior / (1 - prior)))
    return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), [
        np.zeros((N_FEATURES, 1)), np.zeros(1), np.zeros(1), np.array(odds)], prior)


def fit_network(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise the non-negative unbiased risk with the logistic loss, by Adam on batches of both sets.

    risk = prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]); when the second part of a batch is
    negative, the step goes up its gradient instead."""
    rng = np.random.default_rng(SEED)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    norm = lambda x: np.clip((x - mean) / scale, -6, 6)
    p, u = norm(positive), norm(unlabelled)
    w = [rng.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log(prior / (1 - prior)))]
    m, v, step = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def gradient(x, back):
        """Gradients of sum(back * logit)."""
        hidden = np.tanh(x @ w[0] + w[1])
        inner = np.outer(back, w[2]) * (1 - hidden * hidden)
        return [x.T @ inner, inner.sum(0), hidden.T @ back, back.sum()]

    def logit(x):
        return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]

    batches = max(1, -(-max(len(p), len(u)) // BATCH))
    for epoch in range(EPOCHS):
        rate = RATE * (0.5 * (1 + np.cos(np.pi * epoch / EPOCHS)) + 0.02)
        for pi, ui in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)):
            xp, xu = p[pi], u[ui]
            if not len(xp) or not len(xu):
                continue
            zp, zu = logit(xp), logit(xu)
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            gp_plus = -prior * (1 - sigmoid(zp)) / len(xp)
            gp_minus, gu_minus = -prior * sigmoid(zp) / len(xp), sigmoid(zu) / len(xu)
            if negative >= 0:
                parts = gradient(xp, gp_plus + gp_minus), gradient(xu, gu_minus)
            else:
                parts = gradient(xp, -gp_minus), gradient(xu, -gu_minus)
            step += 1
            for i, g in enumerate(a + b for a, b in zip(*parts)):
                g = g + 1e-4 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, w, prior)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int) -> DataFrame:
    """Rows a model may learn from: ids and texts of a hash sample of about ``fit_rows`` documents whose label is not
    held out, with the label where there is one. Ids that are null, or repeated in ``labels``, count once at most."""
    rows = docs.select("doc_id", whole_text().alias("text")).where(F.col("doc_id").isNotNull() & ~held_out())
    total = max(1, docs.count())
    # of the documents three in four may be learnt from
    share = min(1.0, fit_rows / (0.75 * total))
    rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("label")).where(
        F.col("_id").isNotNull() & F.col("label").isNotNull()).groupBy("_id").agg(F.max("label").alias("label"))
    return rows.join(known, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on a bounded hash sample (``fit_rows``, in expectation). Trusted positives are its rows labelled 1, unlabelled
    text all its rows; the class prior is estimated as the share of ones among its labels. Held-out rows take no part.
    Only features reach the driver. Without labels of both kinds every score is the prior (0.5 if unknown)."""
    @F.pandas_udf("binary")  # packed: rows of numbers would take the driver ten times the room
    def featured(texts: pd.Series) -> pd.Series:
        return pd.Series([row.astype(np.float32).tobytes() for row in feature_frame(texts)])

    sample = training_rows(docs, labels, "quality", fit_rows)
    rows = sample.select("doc_id", "label", featured("text").alias("x")).toPandas().sort_values("doc_id")
    known = rows["label"].notna()
    positive = rows[known & (rows["label"] == 1)]
    if not len(positive) or len(positive) == known.sum():
        share = (len(positive) + 1) / (known.sum() + 2)
        return constant(float(share))
    x = lambda r: np.frombuffer(b"".join(map(bytes, r["x"])), np.float32).reshape(-1, N_FEATURES).astype(np.float64)
    return fit_network(x(positive), x(rows), float(len(positive) / known.sum()))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``quality_score`` (0 to 1) computed from the whole text alone. A null text is empty and gets
    the score of an empty text. All rows and columns stay, so an existing column of that name is replaced."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_frame(texts)))
    return docs.withColumn("quality_score", score(whole_text()))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of at least ``CUTOFF``) for every row of ``docs``."""
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"),
                       (F.col("quality_score") >= CUTOFF).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``CUTOFF``, with their columns. Repeated rows are decided alike."""
    return scored(docs, fit(docs, labels)).where(F.col("quality_score") >= CUTOFF).select(*[f"`{c}`" for c in docs.columns])
