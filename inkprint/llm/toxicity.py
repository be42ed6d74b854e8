"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling over the
whole text; trained in numpy, with a threshold per language, the language being told from the text itself."""

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import held_out, materialised, whole_text, worker_table
from inkprint.llm.quality import training_rows

FIT_ROWS = 8_000  # labelled documents the network is fit on, in expectation
FIT_WORDS = 1_000  # words per document of the fit, on average at most; documents of any length take part
CUTOFF = 0.3  # of the registered decision
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
STEMS = (4, 5, 6, 7)  # a word is embedded as the sum of itself and its first letters, so that inflected forms share
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.02, 11
LEAST_TOXIC = 20  # documents of class 1 that all languages together lend to the threshold of each
FINEST, WIDEST = 256, 4  # logit bins per unit; thresholds lie within plus or minus so much
LEAST_STEPS = 200  # of the optimiser, however few documents there are
LEAST_SEEN = 5  # training documents a bucket must occur in to have an embedding (fewer where few are toxic)
CHUNK = 1 << 12  # words convolved at once
CACHE_WORDS = 300_000
PAD = BUCKETS
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
# Frequent function words that tell the languages apart.
MARKERS = {
    "en": "the of and to is that it for with was this are by from",
    "fr": "le les des et une du qui dans pour est au sur par",
    "de": "der die und das den von zu mit sich ist nicht ein dem",
    "es": "el los las y con una del al se su lo como",
}
LANGUAGES = list(MARKERS)


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS


def buckets(found: list[str]) -> np.ndarray:
    """The buckets of words as written, a row each: the word in lower case without punctuation around it, and its stems."""
    crc, rows = zlib.crc32, []
    for word in found:
        w = word.strip(_STRIP).lower().encode("utf-8", "replace")
        row, stem, at = [crc(w) % BUCKETS], 0, 0
        for n in STEMS:  # first bytes; the hash of one continues that of the shorter one
            if len(w) <= n:
                break
            stem, at = crc(w[at:n], stem), n
            row.append((stem ^ 0x5BD1E995) % BUCKETS)
        rows.append(row + [PAD] * (1 + len(STEMS) - len(row)))
    return np.array(rows, np.int32).reshape(-1, 1 + len(STEMS))


class Words:
    """Per word of a text, what ``describe`` says of it (a row of numbers); words met before are remembered, up to
    ``CACHE_WORDS`` of them, as long as the worker lives."""

    def __init__(self, describe):
        self.describe, self.known, sample = describe, {}, describe(["a"])
        self.rows = np.zeros((CACHE_WORDS, sample.shape[1]), sample.dtype)

    def __call__(self, text: str) -> np.ndarray:
        words = text.split()
        ids = list(map(self.known.get, words))
        try:
            return self.rows[np.array(ids, np.int64)]
        except TypeError:  # some word is new
            new = list(dict.fromkeys([w for w, x in zip(words, ids) if x is None]))
        rows, start = self.describe(new), len(self.known)
        room = min(len(new), CACHE_WORDS - start)
        self.rows[start:start + room] = rows[:room]
        self.known.update(zip(new[:room], range(start, start + room)))
        if room == len(new):
            return self.rows[np.array(list(map(self.known.get, words)), np.int64)]
        own = {w: -1 - i for i, w in enumerate(new)}  # of this text only
        at = np.array([own[w] if x is None else x for w, x in zip(words, ids)], np.int64)
        return np.where((at < 0)[:, None], rows[np.maximum(0, -1 - at)], self.rows[np.maximum(0, at)])


def marker_table() -> np.ndarray:
    """Language number per bucket (0: none)."""
    table = np.zeros(BUCKETS, np.int8)
    for n, name in enumerate(LANGUAGES, 1):
        for word in MARKERS[name].split():
            table[bucket(word)] = n
    return table


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS + 1 rows; the last one, of zeros, pads
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    offset: float
    thresholds: list[float]  # logit per language, the first for none

    def words(self) -> Words:
        """Per word: its embedding, and the number of the language it speaks for."""
        table = marker_table()

        def describe(found: list[str]) -> np.ndarray:
            ids = buckets(found)
            return np.hstack([self.embedding[ids].sum(1), table[ids[:, :1]]]).astype(np.float32)
        return Words(describe)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest response of every filter over the whole text, read in overlapping chunks."""
        best = np.full(FILTERS * len(WIDTHS), -np.inf)
        reach = max(WIDTHS) - 1
        x = np.vstack([x if len(x) else np.zeros((1, DIM), np.float32), np.zeros((reach, DIM), np.float32)])
        steps = np.hstack([f[j] for f in self.filters for j in range(len(f))]).astype(np.float32)
        for at in range(0, len(x) - reach, CHUNK):
            y = x[at:at + CHUNK + reach] @ steps
            n, column = len(y) - reach, 0
            for k, width in enumerate(WIDTHS):
                z = y[:n, column:column + FILTERS]
                for j in range(1, width):
                    z = z + y[j:j + n, column + j * FILTERS:column + (j + 1) * FILTERS]
                s, column = slice(k * FILTERS, (k + 1) * FILTERS), column + width * FILTERS
                best[s] = np.maximum(best[s], z.max(0))
        return np.maximum(0, best + self.bias)

    def judge(self, rows: np.ndarray) -> tuple[float, int]:
        """Logit and language of a text given as rows of ``words``."""
        votes = np.bincount(rows[:, DIM].astype(np.int64), minlength=len(LANGUAGES) + 1)[1:]
        language = int(votes.argmax()) + 1 if votes.any() else 0
        return float(self.pooled(rows[:, :DIM]) @ self.out + self.offset), language


def _seen(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per class and bucket, the number of documents it occurs in."""
    counts = np.zeros((2, BUCKETS + 1))
    for ids, label in zip(docs, y):
        counts[label, np.unique(ids)] += 1
    counts[:, PAD] = 0
    return counts


def fit_network(docs: list[np.ndarray], y: np.ndarray) -> Model:
    """Logistic loss by Adam on batches; gradients reach the words that won the pooling. ``docs`` holds the buckets of the
    words, a row each. Embeddings start from class log odds in one dimension and small noise in the others."""
    rng = np.random.default_rng(SEED)
    counts, sizes = _seen(docs, y), np.bincount(y, minlength=2)
    seen = counts.sum(0)
    odds = np.log((counts[1] + 0.5) / (sizes[1] + 1)) - np.log((counts[0] + 0.5) / (sizes[0] + 1))
    used = (seen >= np.clip(sizes[1] // 20, 2, LEAST_SEEN))[:, None]
    e = rng.normal(0, 0.05, (BUCKETS + 1, DIM)) * used
    e[:, 0] = np.clip(odds * seen / (seen + 10), -2, 4) / 3 * used[:, 0]
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, :FILTERS // 2] += 1.0 / len(f)
    total = FILTERS * len(WIDTHS)
    p = {"bias": np.zeros(total), "out": np.full(total, 0.3), "offset": np.array(-2.0)} | {f"f{k}": f for k, f in enumerate(filters)}
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    reach = max(WIDTHS) - 1
    wide = 1 + len(STEMS)
    pads = [np.full((n, wide), PAD, np.int32) for n in (reach, reach + 1)]
    batches = max(1, len(docs) // BATCH, sum(map(len, docs)) // (BATCH * FIT_WORDS))
    epochs = max(EPOCHS, -(-LEAST_STEPS // batches))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs) + 1e-3
        order = rng.permutation(len(docs))
        for batch in np.array_split(order, batches):
            # every document is followed by padding, an empty one also stands on some
            padded = [x for i in batch for x in (docs[i], pads[len(docs[i]) == 0])]
            ids = np.concatenate(padded).astype(np.int64)
            sizes = np.array([len(a) + len(b) for a, b in zip(padded[::2], padded[1::2])])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            x = np.vstack([sum(e[ids[:, j]] for j in range(wide)), np.zeros((reach, DIM))])
            n, winners, top = len(ids), [], []
            for k, width in enumerate(WIDTHS):
                z = sum(x[j:j + n] @ p[f"f{k}"][j] for j in range(width))
                # a window must start on a word of its own document, not on the padding behind it
                ends = starts + np.maximum(1, sizes - reach)
                where = np.array([z[a:b].argmax(0) + a for a, b in zip(starts, ends)])
                winners.append(where)
                top.append(np.take_along_axis(z, where, 0))
            h = np.hstack(top) + p["bias"]
            active = h > 0
            h = h * active
            prob = 1 / (1 + np.exp(-np.clip(h @ p["out"] + p["offset"], -30, 30)))
            back = (prob - y[batch]) / len(batch)
            g = {"out": h.T @ back + 1e-4 * p["out"], "offset": back.sum()}
            gh = np.outer(back, p["out"]) * active
            g["bias"] = gh.sum(0)
            change = []
            for k, width in enumerate(WIDTHS):
                gk, where = gh[:, k * FILTERS:(k + 1) * FILTERS], winners[k]
                f = np.zeros_like(p[f"f{k}"])
                for j in range(width):
                    xs = x[where + j]
                    f[j] = np.einsum("bfd,bf->df", xs, gk)
                    slope = (gk[:, :, None] * p[f"f{k}"][j].T[None]).reshape(-1, DIM)
                    moved = np.abs(slope).sum(1) > 0
                    at = ids[np.minimum(where + j, n - 1).ravel()[moved]]
                    change.append((at.ravel(), np.repeat(slope[moved], wide, 0)))
                g[f"f{k}"] = f + 1e-4 * p[f"f{k}"]
            at = np.concatenate([c[0] for c in change])
            np.add.at(e, at, -2 * rate * np.concatenate([c[1] for c in change]) * used[at])
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] * g[k]
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(e.astype(np.float32), [p[f"f{k}"] for k in range(len(WIDTHS))], p["bias"], p["out"],
                 float(p["offset"]), [float(np.log(CUTOFF / (1 - CUTOFF)))] * (len(LANGUAGES) + 1))


def threshold(counts: np.ndarray) -> float:
    """Where the F1 of class 1 is highest, a quarter down the gap there. ``counts``: documents per logit bin and class."""
    down = np.flatnonzero(counts.sum(1))[::-1]
    hits, found = np.cumsum(counts[down, 1]), np.cumsum(counts[down].sum(1))
    best = int((2 * hits / (found + hits[-1])).argmax())
    low = down[best] / FINEST - WIDEST
    ahead = (down[best + 1] + 1) / FINEST - WIDEST if best + 1 < len(down) else low - 1
    return float(np.clip(0.75 * low + 0.25 * ahead, -WIDEST, WIDEST))


def calibrate(model: Model, counts: np.ndarray) -> None:
    """Set each language's threshold from ``counts`` (language, logit bin, class) of documents kept out of the fit. All
    languages together count as ``LEAST_TOXIC`` documents of class 1 besides the language's own, so that a language
    with few of them stays near the common threshold and no number of documents switches from one to the other."""
    every = counts.sum(0)
    if every[:, 1].any():
        model.thresholds = [threshold(own + every * (LEAST_TOXIC / every[:, 1].sum())) for own in counts]


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[Model, DataFrame] | None:
    """The network without thresholds, and the ids it is fit on: a bounded hash sample (four fifths of ``fit_rows``
    documents, ``FIT_WORDS`` words each on average at most, in expectation) of the labelled documents that are not held
    out, without regard to their lengths. None if there are no labels of both kinds."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    total, marked = max(1, docs.count()), max(1, known.count())
    sample = training_rows(docs, labels, "toxic", fit_rows * max(1, -(-total // marked))).where(F.col("label").isNotNull())
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20))
    sample = materialised(sample.withColumn("place", place).withColumn("n_words", F.size(F.split("text", r"\s+"))))
    n_words = sample.agg(F.sum("n_words")).first()[0] or 0
    share = 0.8 * min(1.0, fit_rows * FIT_WORDS / max(1, n_words))  # at least a fifth is left for the thresholds
    sample = sample.where(F.col("place") < int(share * (1 << 20)))
    ids = Words(buckets)
    # the driver holds the texts of one partition at a time; of the others only their words' buckets
    rows = sorted(((r["doc_id"], ids(r["text"]), r["label"]) for r in sample.select("doc_id", "text", "label").toLocalIterator()),
                  key=lambda row: row[0])
    y = np.array([label == 1 for _, _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    return fit_network([words for _, words, _ in rows], y), sample.select("doc_id").distinct()


def judged(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with a column ``name``: logit and language of the whole text. A null text is empty."""
    owner = f"toxicity {zlib.crc32(model.embedding.tobytes() + model.out.tobytes())}"

    @F.pandas_udf("logit double, language int")
    def judge(texts: pd.Series) -> pd.DataFrame:
        words = worker_table(owner, model.words)
        found = [model.judge(words(t)) for t in texts]
        return pd.DataFrame({"logit": np.array([x[0] for x in found], np.float64),
                             "language": np.array([x[1] for x in found], np.int32)})
    return docs.withColumn(name, judge(whole_text()))


def calibration_counts(rows: DataFrame, labels: DataFrame, fitted: DataFrame, name: str) -> np.ndarray:
    """Documents per language, logit bin and class among all rows with a label that are neither held out nor ``fitted``,
    whatever their length."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(
        (F.max(F.col("toxic").cast("int")) == 1).cast("int").alias("label"))
    known = known.where(~held_out()).join(fitted, "doc_id", "left_anti")
    n = 2 * WIDEST * FINEST
    place = F.floor((F.col(f"{name}.logit") + WIDEST) * FINEST)
    found = rows.select("doc_id", F.col(f"{name}.language").alias("language"), F.least(F.greatest(place, F.lit(0)), F.lit(n)).alias("bin"))
    counts = np.zeros((len(LANGUAGES) + 1, n + 1, 2))
    # at most one row per language, bin and class reaches the driver
    for r in found.join(known, "doc_id").groupBy("language", "bin", "label").agg(F.count("*").alias("n")).collect():
        counts[r["language"], r["bin"], r["label"]] += r["n"]
    return counts


def scored(docs: DataFrame, labels: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with a column ``toxicity_score`` (0 to 1) computed from the whole text alone: the
    probability moved so that the language's threshold lies at ``CUTOFF``. Every text is read by the network once; the
    thresholds come from what it says. A null text is empty and gets the score of an empty text; without a model every
    score is 0. An existing column of that name is replaced."""
    fitted = fit(docs, labels)
    if fitted is None:
        return docs.select(*[f"`{c}`" for c in keep]).withColumn("toxicity_score", F.lit(0.0))
    model, ids = fitted
    name = "_judged"
    while name in docs.columns:
        name += "_"
    rows = materialised(judged(docs, model, name).select(*[f"`{c}`" for c in keep], name))
    calibrate(model, calibration_counts(rows, labels, ids, name))
    limit = F.element_at(F.array(*map(F.lit, model.thresholds)), F.col(f"{name}.language") + 1)
    moved = F.col(f"{name}.logit") + float(np.log(CUTOFF / (1 - CUTOFF))) - limit
    score = 1 / (1 + F.exp(-F.least(F.greatest(moved, F.lit(-30.0)), F.lit(30.0))))
    return rows.withColumn("toxicity_score", score).drop(name)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of at least ``CUTOFF``) for every row of ``docs``."""
    rows = scored(docs.select("doc_id", "text"), labels, ["doc_id"])
    return rows.select("doc_id", held_out().alias("held_out"), F.col("toxicity_score").alias("score"),
                       (F.col("toxicity_score") >= CUTOFF).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below ``CUTOFF``, with their columns. Repeated rows are decided alike."""
    return scored(docs, labels, docs.columns).where(F.col("toxicity_score") < CUTOFF).select(*[f"`{c}`" for c in docs.columns])
