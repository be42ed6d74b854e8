"""Cross-tokenizer alignment with an identity-map fast path.

Two tokenizers cut the same bytes. Offsets where tokens of both end cut a text into groups; tokens of both sides whose
bytes overlap are linked. An array from every A id to the B id of the same bytes is made beforehand: a group of one
such A and B token is *regular* and is counted by its A id alone, in vectors as long as the vocabulary. Only the other
groups are shuffled: once per distinct group to count id pairs over the corpus, once per document and distinct group to
bring the counts back.

Neither tokenizer joins what stands before a blank or line end with what stands after it, so a text is cut there into
chunks, each chunk is encoded by itself, and chunks seen before are looked up.
"""

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkprint.llm.common import materialised

CACHE_SIZE = 24_000_000  # what the chunks that a task keeps may add up to: their characters, and ENTRY for each
ENTRY = 40
SLICE_CHARS = 1_000_000  # characters that are worked on together
_CHUNK = re.compile(r"[ \n]+[^ \n]*")
_ODD = re.compile(r"[^\S \n][ \n]")  # another kind of white space before a blank: the cut there would not be safe
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")
# Fixed value: how a byte-level vocabulary of this kind cuts a text before it merges bytes.
_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for themselves, the others,
    in ascending order, follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class Pair:
    """The two vocabularies: bytes per id, and the identity map (-1: no B id has the bytes)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        place = {x: i for i, x in enumerate(self.b_bytes) if self.b.is_byte(i)}
        place.update((x, i) for i, x in enumerate(self.b_bytes)
                     if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.identity = np.array([place.get(x, -1) for x in self.a_bytes], np.int32)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        # a piece with a line end, or with a blank after another character, would cross the border of a chunk
        self.cuts = not any("\n" in p or re.search("[^▁]▁", p) for p in pieces if len(p) > 1)
        self.blank = self.b.piece_to_id("▁")
        self.plain = self._plain_encoder()

    def _plain_encoder(self):
        """A quicker encoder of the same ids for ASCII chunks. It takes the vocabulary's ids as merge ranks, so it needs one
        in which every merge has the next id; None for others."""
        import tiktoken
        model = json.loads(self.a.to_str())["model"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        first = len(byte_letters())
        if any(model["vocab"].get(x + y) != first + n for n, (x, y) in enumerate(merges)):
            return None
        ranks = {x: i for i, x in enumerate(self.a_bytes[:first + len(merges)])}
        return tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def chunks(self, text: str) -> list[str]:
        """Pieces of ``text`` that both tokenizers encode independently of each other."""
        text = " " + text
        if not self.cuts:
            return [text]
        return _SAFE.split(text) if _ODD.search(text) else _CHUNK.findall(text)

    def alone(self, chunk: str) -> tuple[list[int], list[int]] | None:
        """Ids of both sides of one chunk; None where the bytes of either side are not the chunk's. B adds a blank in front
        of all but the empty text: a chunk's own first blank is left to it, and before a line end it is taken off again."""
        a = self.a.encode(chunk, add_special_tokens=False).ids
        b = [self.blank] if chunk == " " else self.b.encode(chunk.removeprefix(" ") if chunk[0] == " " else chunk)
        b = b if chunk[0] == " " else b[1:] if b[:1] == [self.blank] else []
        raw = chunk.encode()
        same = b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
        return (a, b) if same else None

    def together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A, of B, and tokens of either per chunk, of chunks that end in a character other than white space, encoded
        in a row; None where the tokens do not spell the chunks."""
        text = "".join(chunks)
        a = self.plain(text) if self.plain is not None and text.isascii() else self.a.encode(text, add_special_tokens=False).ids
        b = self.b.encode(text[1:]) if text[0] == " " else self.b.encode(text)[1:]
        raw = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        sides, ends = [], np.cumsum([len(c.encode()) for c in chunks])
        for ids, size in ((np.array(a, np.int32), self.a_size), (np.array(b, np.int32), self.b_size)):
            at = np.cumsum(size[ids])
            last = np.searchsorted(at, ends)
            if not np.array_equal(at[last], ends):
                return None
            sides.append((ids, np.diff(last + 1, prepend=0)))
        return sides[0][0], sides[1][0], sides[0][1], sides[1][1]


def groups(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]):
    """(A ids, B ids, linked id pairs) of each group of two token sequences over the same bytes."""
    i = j = 0
    first_a = first_b = 0
    end_a, end_b = (len(a_bytes[a[0]]), len(b_bytes[b[0]])) if a else (0, 0)
    pairs = []
    while i < len(a):
        pairs.append((a[i], b[j]))
        at_a, at_b = end_a, end_b
        if at_a <= at_b:
            i += 1
            if i < len(a):
                end_a += len(a_bytes[a[i]])
        if at_b <= at_a:
            j += 1
            if j < len(b):
                end_b += len(b_bytes[b[j]])
        if at_a == at_b:
            yield a[first_a:i], b[first_b:j], pairs
            first_a, first_b, pairs = i, j, []


_ENCODED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            "regular array<int>, regular_n array<int>, irregular array<string>, irregular_n array<int>")
_NAMES = [part.split()[0] for part in _ENCODED.split(", ")]


def _slices(rows, size: int):
    """Lists of rows with about ``size`` characters of text each."""
    part, held = [], 0
    for doc, text in rows:
        part.append((doc, text or ""))
        held += len(text or "")
        if held >= size:
            yield part
            part, held = [], 0
    yield part


class Rows:
    """A growing table of rows of numbers, end to end."""

    def __init__(self):
        self.flat, self.start, self.size = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        first = len(self.flat) + np.cumsum(size) - size
        self.flat, self.start, self.size = (np.concatenate(x) for x in ((self.flat, flat), (self.start, first), (self.size, size)))

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the rows at ``places``, and how many each has."""
        size = self.size[places]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return self.flat[np.repeat(self.start[places], size) + at], size


class Aligner:
    """Aligns documents, some at a time, and keeps what it knows of chunks up to a bounded size."""

    def __init__(self, path_a: str, path_b: str):
        self.pair = Pair(path_a, path_b)
        self.one = np.array([f"{i}|{j}" for i, j in enumerate(self.pair.identity)], object)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}  # of a chunk in the tables below
        self.texts: list[str] = []  # its groups as text
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups; 1 where it has no tokens
        self.regular, self.irregular = Rows(), Rows()  # A ids; places in ``names``
        self.names: dict[str, int] = {}  # irregular groups
        self.held = 0

    def _learn(self, chunks: list[str]) -> None:
        pair, rest = self.pair, []
        sets = ([], [])
        for c in chunks:
            (sets[c.isascii()] if pair.cuts and "▁" not in c and not c[-1].isspace() else rest).append(c)
        for part in sets:
            both = pair.together(part) if part else None
            if both is None:
                rest += part
            else:
                self._keep(part, *both, np.zeros(len(part), np.int64))
        found = [pair.alone(c) for c in rest]
        flat = lambda side: np.array([i for f in found if f for i in f[side]], np.int32)
        size = lambda side: np.array([len(f[side]) if f else 0 for f in found], np.int64)
        self._keep(rest, flat(0), flat(1), size(0), size(1), np.array([f is None for f in found], np.int64))

    def _keep(self, chunks: list[str], a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, none: np.ndarray) -> None:
        pair, n = self.pair, len(chunks)
        end_a, end_b = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        ends = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, np.int8)
        ends[end_a] += 1
        ends[end_b] += 1
        last_a, last_b = np.flatnonzero(ends[end_a] == 2), np.flatnonzero(ends[end_b] == 2)  # last tokens of every group
        first_a, first_b = (np.append(0, x[:-1] + 1)[:len(x)] for x in (last_a, last_b))
        chunk = np.repeat(np.arange(n), n_a)[last_a]
        n_groups = np.bincount(chunk, minlength=n)

        one = (first_a == last_a) & (first_b == last_b) & (pair.identity[a[first_a]] == b[first_b])
        texts, odd = self.one[a[first_a]], np.flatnonzero(~one)
        ids_a, ids_b = a.tolist(), b.tolist()
        spans = zip(*(x[odd].tolist() for x in (first_a, last_a, first_b, last_b)))
        others = [f"{','.join(map(str, ids_a[i:j + 1]))}|{','.join(map(str, ids_b[k:m + 1]))}" for i, j, k, m in spans]
        texts[odd] = others
        texts, borders = texts.tolist(), np.append(0, np.cumsum(n_groups)).tolist()
        self.place.update(zip(chunks, range(len(self.texts), len(self.texts) + n)))
        self.texts += [";".join(texts[i:j]) for i, j in zip(borders, borders[1:])]
        self.counts = np.concatenate([self.counts, np.stack([n_a, n_b, n_groups, none], axis=1)])
        self.regular.add(a[first_a[one]].astype(np.int64), np.bincount(chunk[one], minlength=n))
        self.irregular.add(np.array([self.names.setdefault(t, len(self.names)) for t in others], np.int64),
                           np.bincount(chunk[odd], minlength=n))
        self.held += sum(map(len, chunks)) + ENTRY * n

    @staticmethod
    def _distinct(table: Rows, places: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per document the distinct numbers of its chunks' rows: borders, numbers, counts."""
        numbers, size = table.of(places)
        wide = int(numbers.max(initial=0)) + 1
        seen, times = np.unique(np.repeat(doc, size) * wide + numbers, return_counts=True)
        return np.append(0, np.cumsum(np.bincount(seen // wide, minlength=n))), seen % wide, times

    def __call__(self, rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        if self.held > CACHE_SIZE:
            self._forget()
        cut = [self.pair.chunks(text) if text else [] for _, text in rows]
        every = [c for parts in cut for c in parts]
        new = {c for c, p in zip(every, map(self.place.get, every)) if p is None}
        if new:
            self._learn(list(new))
        n, places = len(rows), np.array(list(map(self.place.__getitem__, every)), np.int64)
        doc = np.repeat(np.arange(n), [len(parts) for parts in cut])
        bad = np.bincount(doc[self.counts[places, 3] > 0], minlength=n) > 0
        spelled = ~bad[doc]
        kept, doc = places[spelled], doc[spelled]
        n_a, n_b, n_groups = (np.bincount(doc, self.counts[kept, k], n).astype(np.int64) for k in range(3))
        texts, borders = [self.texts[p] for p in kept.tolist()], np.append(0, np.cumsum(np.bincount(doc, minlength=n))).tolist()
        digests = [hashlib.sha256(";".join(texts[i:j]).encode()).hexdigest() if j > i else "" for i, j in zip(borders, borders[1:])]
        at, ids, times = self._distinct(self.regular, kept, doc, n)
        odd_at, odd, odd_times = self._distinct(self.irregular, kept, doc, n)
        names = list(self.names)
        lists = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
        return pa.RecordBatch.from_arrays([
            pa.array([d for d, _ in rows], pa.int64()), pa.array(n_a), pa.array(n_b), pa.array(n_groups),
            pa.array(n_a + n_b - n_groups),  # in a group without an inner common end each further token adds one link
            pa.array(digests, pa.string()), lists(at, ids, pa.int32()), lists(at, times, pa.int32()),
            lists(odd_at, [names[i] for i in odd.tolist()], pa.string()), lists(odd_at, odd_times, pa.int32())], _NAMES)


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: token, group and link counts, the digest of its groups, its regular groups as distinct A ids
    with their counts, and its other groups as distinct texts with theirs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align_rows = Aligner(path_a, path_b)
        for batch in batches:
            for rows in _slices(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), SLICE_CHARS):
                yield align_rows(rows)
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, _ENCODED)


def _regular_counts(table: DataFrame, identity: np.ndarray) -> DataFrame:
    """a, b, n of regular groups: every task adds its documents to one vector as long as A's vocabulary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(identity), np.int64)
        for batch in batches:
            ids, n = (np.asarray(batch.column(k).flatten(), np.int64) for k in (0, 1))
            np.add.at(total, ids, n)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(identity[a].astype(np.int64)), pa.array(total[a]), pa.array(np.ones(len(a), bool))],
            ["a", "b", "n", "regular"])
    return table.select("regular", "regular_n").mapInArrow(run, "a long, b long, n long, regular boolean")


def _expanded(distinct: DataFrame, a_bytes: list[bytes], b_bytes: list[bytes]) -> DataFrame:
    """g, a, b, links (of that id pair in one such group), n (groups in the corpus)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, n in zip(batch["g"], batch["n"]):
                a, b = ([int(x) for x in side.split(",")] for side in text.split("|"))
                for _, _, pairs in groups(a, b, a_bytes, b_bytes):
                    out += [(text, x, y, links, n) for (x, y), links in Counter(pairs).items()]
            yield pd.DataFrame(out, columns=["g", "a", "b", "links", "n"])
    return distinct.mapInPandas(run, "g string, a long, b long, links long, n long")


def _with_regular_sums(table: DataFrame, count: np.ndarray, best: np.ndarray) -> DataFrame:
    """row, the document's columns, and the sums over its regular links."""
    names = ["row", *_NAMES[:6]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = (np.asarray(batch.column(k).flatten(), np.int64) for k in (len(names), len(names) + 1))
            sizes = np.diff(np.asarray(batch.column(len(names)).offsets, np.int64))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            sums = np.zeros((2, len(sizes)), np.int64)
            np.add.at(sums[0], doc, n * count[ids])
            np.add.at(sums[1], doc, n * best[ids])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(len(names))], pa.array(sums[0]), pa.array(sums[1])],
                [*names, "_sum", "_best"])
    columns = ", ".join(["row long", *_ENCODED.split(", ")[:6], "_sum long", "_best long"])
    return table.select(*names, "regular", "regular_n").mapInArrow(run, columns)


def pair_counts(table: DataFrame, pair: Pair) -> tuple[DataFrame, DataFrame]:
    """(links, counts): ``links`` has g, a, b, links of every distinct irregular group; ``counts`` has a, b, n (links of
    the pair in the whole corpus), best (n is its B id's highest) and regular (a and b have the same bytes)."""
    distinct = table.select(F.explode(F.arrays_zip("irregular", "irregular_n")).alias("x")).groupBy(
        F.col("x.irregular").alias("g")).agg(F.sum("x.irregular_n").alias("n"))
    links = materialised(_expanded(distinct, pair.a_bytes, pair.b_bytes))
    pairs = links.select("a", "b", (F.col("links") * F.col("n")).alias("n"), F.lit(False).alias("regular")).unionByName(
        _regular_counts(table, pair.identity))
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("regular").alias("regular"))
    # one row per A id at most in each group of the window: bounded by A's vocabulary
    best = F.col("n") == F.max("n").over(Window.partitionBy("b"))
    return links, materialised(counts.withColumn("best", best))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Align the tokens of a byte-level BPE (A) and a SentencePiece model (B) over every whole text of ``docs`` (doc_id,
    text), each with one blank in front: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose id pair is the most
    frequent of its B id in the corpus, ties included), count_sum (corpus counts summed over the links), groups_sha256
    (groups as ``a1,a2|b1``, joined by semicolons).

    Texts that are null or empty, or whose tokens of either side do not spell the text, have no tokens: zeros and an
    empty digest. Rows with a null id and repeated rows are documents like any other. Other columns are ignored. An empty
    table gives no rows. What is collected is as long as A's vocabulary."""
    pair = Pair(path_a, path_b)
    table = materialised(encoded(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()))
    links, counts = pair_counts(table, pair)
    count, best = np.zeros(len(pair.identity), np.int64), np.zeros(len(pair.identity), np.int64)
    for r in counts.where("regular").select("a", "n", "best").collect():
        count[r["a"]], best[r["a"]] = r["n"], r["best"]
    scores = links.select("g", "a", "b", "links").join(counts.select("a", "b", "n", "best"), ["a", "b"]).groupBy("g").agg(
        F.sum(F.col("links") * F.col("n")).alias("g_sum"), F.sum(F.col("links") * F.col("best").cast("long")).alias("g_best"))
    held = table.select("row", F.explode(F.arrays_zip("irregular", "irregular_n")).alias("x")).select(
        F.col("row").alias("_row"), F.col("x.irregular").alias("g"), F.col("x.irregular_n").alias("k"))
    rest = held.join(scores, "g").groupBy("_row").agg(
        F.sum(F.col("k") * F.col("g_sum")).alias("g_sum"), F.sum(F.col("k") * F.col("g_best")).alias("g_best"))
    rows = _with_regular_sums(table, count, best).join(rest, F.col("row") == F.col("_row"), "left")
    return rows.select(
        *_NAMES[:5], (F.col("_best") + F.coalesce("g_best", F.lit(0))).alias("n_best"),
        (F.col("_sum") + F.coalesce("g_sum", F.lit(0))).alias("count_sum"), "groups_sha256")
