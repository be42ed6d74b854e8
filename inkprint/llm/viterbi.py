"""SentencePiece encoding and decoding by a streaming Viterbi search.

The best segmentation under the vocabulary's scores is searched from left to right. Only the scores of the last
``longest piece`` positions are kept; ids are committed as soon as all surviving back-pointer paths meet in one boundary.
No piece reaches across the start of a run of spaces, or over a line end, so all paths meet there, and the ids of the
word runs between such places can be remembered.
"""

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import whole_text, worker_table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # as far below the lowest score as the library's unigram search puts an unknown character
CACHE_RUNS = 400_000
PART = 256  # texts that are encoded and decoded before their results are handed on
_RUN = re.compile(r" *[^ \n]+| +|\n+")


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.text: list[bytes] = []
        self.byte_ids = [0] * 256
        self.scores: dict[int, float] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                self.ids[piece] = i
                self.scores[i] = model.get_score(i)
                self.text.append(piece.replace(SPACE, " ").encode())
        #: id of every piece, and -1 for other beginnings of pieces
        self.beginnings = {p[:k]: -1 for p in self.ids for k in range(1, len(p))} | self.ids
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        #: whether all paths meet before every run of spaces and around line ends
        self.splits = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids)


class Stream:
    """Viterbi search over text that arrives in parts. ``feed`` and ``end`` return the ids that are certain by then.

    A character without a piece of its own is spelt in byte pieces. ``waiting`` is the longest stretch of characters that
    ever waited for its paths to meet."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # characters from the last committed boundary on
        self.score = [0.0]  # best score per position of ``text``, of which the last ``longest`` are still read
        self.back: list[tuple[int, int]] = [(0, -1)]  # per position: start of its best last piece, and the piece
        self.done = 0  # positions whose outgoing pieces have been tried
        self.waiting = 0

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        step = 4 * self.v.longest
        for at in range(0, len(part), step):
            self.text += part[at:at + step]
            self._advance(len(self.text) - self.v.longest + 1)
            self.waiting = max(self.waiting, len(self.text))
            out += self._commit()
        return out

    def end(self) -> list[int]:
        self._advance(len(self.text))
        out = self._path(len(self.text))
        self.__init__(self.v)
        return out

    def _advance(self, stop: int) -> None:
        text, score, back, v = self.text, self.score, self.back, self.v
        grown = len(text) + 1 - len(score)
        score += [float("-inf")] * grown
        back += [(-1, -1)] * grown
        find, scores, size = v.beginnings.get, v.scores, len(text)
        for i in range(self.done, stop):
            here = score[i]
            if here == float("-inf"):
                continue
            single, j = False, i + 1
            while j <= size:
                n = find(text[i:j])
                if n is None:
                    break
                if n >= 0:
                    single |= j == i + 1
                    total = here + scores[n]
                    if total > score[j]:
                        score[j], back[j] = total, (i, n)
                j += 1
            if not single and here + v.unknown > score[i + 1]:
                score[i + 1], back[i + 1] = here + v.unknown, (i, -1)
        self.done = max(self.done, stop)

    def _path(self, end: int) -> list[int]:
        parts = []
        while end > 0:
            start, piece = self.back[end]
            parts.append([piece] if piece >= 0 else [self.v.byte_ids[b] for b in self.text[start:end].encode("utf-8", "surrogatepass")])
            end = start
        return [x for p in reversed(parts) for x in p]

    def _commit(self) -> list[int]:
        """Ids up to the boundary that the paths of all positions which may still be extended have in common."""
        live = {i for i in range(max(0, self.done), len(self.score)) if self.score[i] > float("-inf")}
        while len(live) > 1:
            last = max(live)
            live.discard(last)
            live.add(self.back[last][0])
        meet = live.pop() if live else 0
        if meet <= 0:
            return []
        out = self._path(meet)
        base = self.score[meet]
        self.text, self.done = self.text[meet:], self.done - meet
        self.score = [s - base for s in self.score[meet:]]
        self.back = [(0, -1)] + [(a - meet, p) for a, p in self.back[meet + 1:]]
        return out


class Encoder:
    """Whole texts to ids and back. Encoding puts a space before the text and marks spaces as the vocabulary does; the
    mark itself, where a text holds it, is spelt in bytes. Decoding gives back exactly the text."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.mark = array("I", [self.v.byte_ids[b] for b in SPACE.encode()]).tobytes()
        self.known: dict[str, bytes] = {}

    def run(self, part: str) -> bytes:
        stream, marked = Stream(self.v), part.replace(" ", SPACE)
        if len(marked) <= 4 * self.v.longest:  # no longer than the window: nothing to commit before its end
            stream.text = marked
            return array("I", stream.end()).tobytes()
        ids = stream.feed(marked)
        return array("I", ids + stream.end()).tobytes()

    def runs(self, parts: list[str]) -> bytes:
        """Ids of word runs between which all paths meet; runs met before are remembered."""
        known = self.known
        ids = list(map(known.get, parts))
        try:
            return b"".join(ids)
        except TypeError:  # some run is new
            for i, part in enumerate(parts):
                if ids[i] is None:
                    ids[i] = known.get(part) or self.run(part)
                    if len(known) < CACHE_RUNS and len(part) < 64:
                        known[part] = ids[i]
            return b"".join(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        parts = (" " + text).split(SPACE)
        one = (lambda p: self.runs(_RUN.findall(p))) if self.v.splits else (lambda p: self.run(p) if p else b"")
        return self.mark.join(map(one, parts))

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.v.text.__getitem__, memoryview(ids).cast("I")))
        return data[1:].decode("utf-8", "surrogatepass")


def encoder(path: str) -> Encoder:
    """The worker's encoder of a model file; it outlives single tasks."""
    return worker_table(f"pieces {path}", lambda: Encoder(path))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, text, ids (binary: little-endian unsigned 32-bit numbers), n_ids, ids_crc32 of every whole text.

    A null text is empty and has no ids, like an empty one; null ids of documents stay null; repeated rows give repeated
    results; other columns are ignored. An empty table gives no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model).encode
        for batch in batches:
            ids = [encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "text", "ids", "n_ids", "ids_crc32"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, text string, ids binary, n_ids long, ids_crc32 long")


def decoded(tokens: DataFrame, model: str) -> DataFrame:
    """``tokens`` (with ids as ``encoded`` makes them) with a column ``decoded``; null ids give a null."""
    @F.pandas_udf("string")
    def decode(ids):
        back = encoder(model).decode
        return ids.map(lambda x: None if x is None else back(bytes(x)))
    return tokens.withColumn("decoded", decode("ids"))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every whole text: doc_id, n_ids, ids_crc32, decoded_sha256, exact (the text came back).

    Rows are as ``decoded`` of ``encoded`` would give them. Both ways are gone in one worker per task with one vocabulary,
    ``PART`` texts at a time, so neither texts nor ids travel back or wait for a whole batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = encoder(model)
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part, rows = batch.slice(at, PART), []
                for text in part.column(1):
                    text = text.as_py()
                    ids = table.encode(text)
                    back = table.decode(ids)
                    rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == text))
                n_ids, crc32, sha256, exact = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_ids, pa.int64()), pa.array(crc32, pa.int64()), pa.array(sha256, pa.string()),
                     pa.array(exact, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "exact"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")
