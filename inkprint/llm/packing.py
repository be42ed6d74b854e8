"""Packing of token sequences by non-negative least squares over length patterns.

Patterns of one to three lengths that fill a sequence exactly are enumerated, their repeat counts are fitted to the
histogram of piece lengths by non-negative least squares and rounded, and what is left over is packed best fit. The plan
depends on the histogram only (one bin per length); pieces are dealt to its slots by their rank within their length.
"""

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.common import materialised, partitions_of, whole_text, worker_table

SIZE = 2048
SEPARATOR = 0  # the id that ends a document
CACHE_WORDS = 700_000  # words whose ids a worker keeps
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes, equal to the library's. This tokenizer folds case, drops white space
    and never merges across it, nor across the border between letters and punctuation; so a text is encoded word by
    word, and known words come from a table. A plain word (letters up to U+012F, already normalised) goes straight to
    the library's merge model, any other through all of its steps."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        self.letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[bytes, bytes] = {b"": b""}

    def _keep(self, word: bytes, ids: bytes) -> bytes:
        if len(self.known) < CACHE_WORDS:
            self.known[word] = ids
        return ids

    def _plain(self, word: bytes) -> bytes | None:
        """Ids of a word of letters; None for other words."""
        if not word.isalpha():
            text = word.decode()
            if not text.isalpha() or max(text) >= "\u0130":
                return None
            text = self.letters.pre_tokenize_str(text.lower())[0][0]
        else:
            text = word.decode()
        return self._keep(word, array("I", [t.id for t in self.model.tokenize(text)]).tobytes())

    def _word(self, word: bytes) -> bytes:
        stem = word.rstrip(_PUNCTUATION)
        if stem:
            ids = self.known.get(stem) or self._plain(stem)
            if ids is not None:
                if len(stem) == len(word):
                    return ids
                run = word[len(stem):]
                return self._keep(word, ids + (self.known.get(run) or self._word(run)))
        ids = self.library.encode(word.decode(), add_special_tokens=False).ids
        return self._keep(word, array("I", ids).tobytes())

    def __call__(self, text: str) -> bytes:
        words = text.encode("utf-8", "replace").translate(_LOWER).replace(b"\n", b" ").split(b" ")
        ids = list(map(self.known.get, words))
        try:
            return b"".join(ids)
        except TypeError:  # some word is new
            known, word = self.known.get, self._word
            return b"".join([x if x is not None else (known(w) or word(w)) for w, x in zip(words, ids)])


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a vocabulary file; it outlives single tasks."""
    return worker_table(f"words {path}", lambda: WordEncoder(path))


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """Token pieces of every whole document: doc_id, piece (from 0), start (ids of the document before it), length,
    ids_crc32 (of the ids as unsigned little-endian 32-bit numbers). A document is its ids and then id 0; only longer
    ones are cut, into pieces of ``size``, of which the last may be shorter. A null text is empty: one piece of length
    1. Null ids stay null; repeated rows give repeated pieces."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, width, end = encoder(vocabulary), 4 * size, np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                for n, at in enumerate(range(0, len(ids), width)):
                    part = ids[at:at + width]
                    for column, value in zip(out, (doc, n, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    rows = docs.select(F.col("doc_id").cast("long"), whole_text())
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(histogram: np.ndarray, per_length: int = 32) -> np.ndarray:
    """Patterns of up to three occurring lengths that sum to the size exactly, as rows padded with zeros. All pairs; of
    the triples, up to ``per_length`` for every largest length."""
    size = len(histogram) - 1
    have = histogram > 0
    rows = [(size, 0, 0)] if have[size] else []
    rows += [(a, size - a, 0) for a in range((size + 1) // 2, size) if have[a] and have[size - a]]
    for a in range(-(-size // 3), size - 1):
        if have[a]:
            b = np.arange(-(-(size - a) // 2), min(a, size - a - 1) + 1)
            b = b[have[b] & have[size - a - b]]
            for x in b[np.unique(np.linspace(0, len(b) - 1, per_length).astype(int))] if len(b) else []:
                rows.append((a, int(x), int(size - a - x)))
    return np.array(rows, np.int64).reshape(-1, 3)


def fit_counts(shapes: np.ndarray, histogram: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative repeat counts w that minimise ||A w - histogram||², A[length, pattern] being how often a pattern uses
    a length: accelerated projected gradient on the sparse A."""
    bins = len(histogram)
    times = lambda w: np.bincount(shapes.ravel(), np.repeat(w, 3), bins)
    target = histogram.astype(float)
    back = lambda r: r[shapes].sum(1)

    def clean(v):
        v[0] = 0
        return v
    v = np.ones(len(shapes))
    for _ in range(20):  # largest eigenvalue of A'A
        v = back(clean(times(v)))
        norm = np.linalg.norm(v) or 1.0
        v /= norm
    rate = 1 / (norm * 1.01)
    w = y = np.zeros(len(shapes))
    t = 1.0
    for _ in range(steps):
        gradient = back(clean(times(y) - target))
        new = np.maximum(0, y - rate * gradient)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


def plan(histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that use up ``histogram`` (count per length, bin 0 empty)."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    size, made = len(left) - 1, []
    shapes = patterns(left)
    if len(shapes):
        fitted = fit_counts(shapes, left)
        for i in np.argsort(-fitted, kind="stable"):
            want = int(round(fitted[i]))
            if want < 1:
                break
            lengths, uses = np.unique(shapes[i][shapes[i] > 0], return_counts=True)
            n = min(want, int((left[lengths] // uses).min()))
            if n:
                left[lengths] -= n * uses
                made.append((tuple(int(x) for x in shapes[i] if x), n))
    while left.any():  # residuals: the largest length, then the longest one that still fits, and so on
        taken: dict[int, int] = {}
        room, shape = size, []
        while True:
            fits = np.flatnonzero(left[:room + 1])
            fits = [x for x in fits[::-1][:64] if left[x] > taken.get(int(x), 0)] if len(fits) else []
            if not fits:
                break
            x = int(fits[0])
            taken[x] = taken.get(x, 0) + 1
            shape.append(x)
            room -= x
        n = min(int(left[x]) // k for x, k in taken.items())
        for x, k in taken.items():
            left[x] -= n * k
        made.append((tuple(shape), n))
    return made


class Slots:
    """Where the r-th piece of a length goes: sequence and offset, from a plan."""

    def __init__(self, made: list[tuple[tuple[int, ...], int]]):
        parts: dict[int, list] = {}
        sequence = 0
        used: dict[int, int] = {}
        for shape, n in made:
            offsets: dict[int, list[int]] = {}
            at = 0
            for x in shape:
                offsets.setdefault(x, []).append(at)
                at += x
            for x, places in offsets.items():
                lo = used.get(x, 0)
                parts.setdefault(x, []).append((lo, sequence, places))
                used[x] = lo + n * len(places)
            sequence += n
        self.sequences = sequence
        table = lambda v, f: np.array([f(p) for p in v], np.int64)
        self.tables = {x: (
            table(v, lambda p: p[0]), table(v, lambda p: p[1]), table(v, lambda p: len(p[2])),
            np.cumsum([0] + [len(p[2]) for p in v[:-1]]), np.concatenate([p[2] for p in v]).astype(np.int64))
            for x, v in parts.items()}

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lows, bases, uses, firsts, offsets = self.tables[length]
        at = np.searchsorted(lows, ranks, side="right") - 1
        beyond = ranks - lows[at]
        return bases[at] + beyond // uses[at], offsets[firsts[at] + beyond % uses[at]]


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """Pack every document into sequences of at most ``size`` tokens: the columns of ``pieces``, sequence_id and offset,
    gapless from 0 within a sequence.

    A null text is empty and still a piece (its separator); null ids, empty tables and repeated rows are packed like any
    others; other columns are ignored. A length may hold any share of the rows: ranks within a length are counted per
    part of the table and added up."""
    cut = materialised(pieces(docs, vocabulary, size))
    # size + 1 counts at most, whatever the corpus
    counts = cut.groupBy("length").count().collect()
    histogram = np.zeros(size + 1, np.int64)
    for row in counts:
        histogram[row["length"]] = row["count"]
    slots = Slots(plan(histogram))
    parts = partitions_of(cut)
    keyed = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = F.sum("n").over(Window.partitionBy("_length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = keyed.groupBy(F.col("length").alias("_length"), F.col("part").alias("_part")).agg(
        F.count("*").alias("n")).select("_length", "_part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = keyed.withColumn("within", within).join(
        offsets, (F.col("length") == F.col("_length")) & (F.col("part") == F.col("_part"))).withColumn(
        "rank", F.col("within") + F.col("before")).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            sequence, offset = np.zeros(len(df), np.int64), np.zeros(len(df), np.int64)
            lengths, ranks = df["length"].to_numpy(), df["rank"].to_numpy()
            for x in np.unique(lengths):
                at = np.flatnonzero(lengths == x)
                sequence[at], offset[at] = slots.place(int(x), ranks[at])
            yield df.drop(columns="rank").assign(sequence_id=sequence, offset=offset)
    return ranked.mapInPandas(
        assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
