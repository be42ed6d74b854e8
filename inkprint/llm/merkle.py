"""Document fingerprints: a Merkle tree over sections, paragraphs and word runs.

Leaves are short runs of bytes, of bounded size, that end where the bytes before say so, paragraphs end at line ends,
sections end at paragraphs whose digest says so; an edit therefore changes the leaves it touches and their ancestors only. Equal
roots mean equal texts; comparing two trees from the root down locates the differing branches.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import partitions_of, whole_text

Leaf = tuple[str, int]  # digest (8 hexadecimal digits), code points


@dataclass
class Tree:
    root: str
    sections: list[tuple[str, list[tuple[str, list[Leaf]]]]]  # digest, paragraphs: digest, leaves

    def leaves(self) -> Iterator[Leaf]:
        for _, paragraphs in self.sections:
            for _, leaves in paragraphs:
                yield from leaves

    def fingerprint(self) -> str:
        """root;section=paragraph:leaf.length,leaf.length/paragraph:...;section=..."""
        return ";".join([self.root, *[
            f"{s}=" + "/".join(f"{p}:" + ",".join(f"{d}.{n}" for d, n in leaves) for p, leaves in paragraphs)
            for s, paragraphs in self.sections]])


LEAST, GREATEST = 16, 64  # bytes of a leaf; what is left before a line end or the end may be shorter


def leaf_ends(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets behind the leaves, and which of them end a paragraph. Between line ends a leaf ends at the first place
    from ``LEAST`` bytes on where a rolling hash of the eight bytes before it says so (one in 32 does), and after
    ``GREATEST`` bytes at the latest; never inside a code point. Words and spaces play no part."""
    n = len(raw)
    lines = np.flatnonzero(raw == 10) + 1
    first = (raw & 0xC0) != 0x80
    wide = raw.astype(np.uint32)
    four = wide[3:] | wide[2:-1] << np.uint32(8) | wide[1:-2] << np.uint32(16) | wide[:-3] << np.uint32(24) if n > 8 else wide[:0]
    mixed = four[4:] * np.uint32(2_654_435_761) ^ four[:-4] * np.uint32(2_246_822_519)
    mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(3_266_489_917)
    places = np.flatnonzero(mixed >> np.uint32(27) == 0) + 8
    places = places[places < n]
    places, k, start, found = [*places[first[places]].tolist(), n + GREATEST], 0, 0, []
    for stop in [*lines.tolist(), n]:
        while stop - start > LEAST:
            while places[k] < start + LEAST:
                k += 1
            end = min(places[k], start + GREATEST)
            if end >= stop:
                break
            while not first[end]:
                end -= 1
            found.append(end)
            start = end
        if stop > start:
            found.append(stop)
            start = stop
    ends = np.array(found, np.int64)
    last = np.isin(ends, lines)
    if len(last):
        last[-1] = True
    return ends, last


def tree(text: str, known: list[tuple[int, bytes]] = ()) -> tuple[Tree, list[tuple[int, bytes]]]:
    """The tree of a text, and its leaves as (end in bytes, digest). ``known``: such leaves of a text that starts alike,
    as far as the two agree; they are not hashed again."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    ends, last = leaf_ends(raw)
    chars = np.diff(np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)[ends - 1]])) if len(ends) else ends
    digests, start = [], 0
    for i, end in enumerate(ends.tolist()):
        old = known[i] if i < len(known) else (-1, b"")
        digests.append(old[1] if old[0] == end else sha256(data[start:end]).digest())
        start = end
    sections, section_digests, paragraphs, under, leaves, first = [], [], [], [], [], 0
    for i, (size, closes) in enumerate(zip(chars.tolist(), last.tolist())):
        leaves.append((digests[i].hex()[:8], size))
        if closes:
            paragraph = sha256(b"".join(digests[first:i + 1])).digest()
            paragraphs.append((paragraph.hex()[:8], leaves))
            under.append(paragraph)
            leaves, first = [], i + 1
            if paragraph[0] & 3 == 0 or first == len(digests):
                section = sha256(b"".join(under)).digest()
                sections.append((section.hex()[:8], paragraphs))
                section_digests.append(section)
                paragraphs, under = [], []
    return Tree(sha256(b"".join(section_digests)).hexdigest(), sections), list(zip(ends.tolist(), digests))


def parse(fingerprint: str) -> Tree:
    root, *sections = fingerprint.split(";")

    def leaf(x: str) -> Leaf:
        digest, size = x.split(".")
        return digest, int(size)
    made = []
    for section in sections:
        digest, _, rest = section.partition("=")
        made.append((digest, [(p.partition(":")[0], [leaf(x) for x in p.partition(":")[2].split(",")]) for p in rest.split("/")]))
    return Tree(root, made)


def likeness(a: Tree, b: Tree) -> float:
    """Share of the code points of both texts that lie in leaves they have in common: 1 for equal roots, 0 for none."""
    if a.root == b.root:
        return 1.0
    sizes: dict[str, int] = {}
    total = common = 0
    for digest, n in a.leaves():
        sizes[digest] = sizes.get(digest, 0) + n
        total += n
    for digest, n in b.leaves():
        total += n
        left = sizes.get(digest, 0)
        if left:
            common += min(n, left)
            sizes[digest] = left - min(n, left)
    return 2 * common / total if total else 0.0


def edits(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """Where two texts differ: (start, end) in the first and in the second, code points. Branches with equal digests at
    either end are skipped level by level, and the rest is compared below."""
    if a.root == b.root:
        return []
    size = lambda node: sum(n for _, n in node[1]) if node[1] and isinstance(node[1][0][1], int) else sum(map(size, node[1]))

    def narrow(x: list, y: list, at: int, bt: int, weigh, below) -> list[tuple[int, int, int, int]]:
        i = 0
        while i < min(len(x), len(y)) and x[i][0] == y[i][0]:
            at, bt, i = at + weigh(x[i]), bt + weigh(y[i]), i + 1
        j = 0
        while j < min(len(x), len(y)) - i and x[-1 - j][0] == y[-1 - j][0]:
            j += 1
        x, y = x[i:len(x) - j], y[i:len(y) - j]
        if len(x) == len(y) == 1 and below:
            return below(x[0][1], y[0][1], at, bt)
        return [(at, at + sum(map(weigh, x)), bt, bt + sum(map(weigh, y)))] if x or y else []
    leaf = lambda x, y, at, bt: narrow(x, y, at, bt, lambda n: n[1], None)
    paragraph = lambda x, y, at, bt: narrow(x, y, at, bt, size, leaf)
    return narrow(a.sections, b.sections, 0, 0, size, paragraph)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every whole text; a null text is empty. Repeated rows give repeated results."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [tree(t)[0].fingerprint() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text()).mapInArrow(
        run, "doc_id long, fingerprint string")


def in_order(docs: DataFrame) -> DataFrame:
    """The documents dealt into blocks of descending doc_id, one partition each and sorted, every block followed by the
    first document of the next one (of the first block, after the last): block, extra, doc_id, text.

    Ties in doc_id are ordered by text, null ids come last. Only block borders, a bounded number, reach the driver."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    parts = partitions_of(docs)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    block = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("block", F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(block).cast("int"))
    heads = sorted(rows.groupBy("block").agg(F.max("doc_id").alias("head")).collect(), key=lambda r: r["block"])
    # one row per block at most; the document that heads block i also goes to the block before it
    borders = [(h["head"], heads[i - 1]["block"], h["block"]) for i, h in enumerate(heads)]
    table = docs.sparkSession.createDataFrame(borders, "_head long, _to int, _block int")
    extra = rows.join(F.broadcast(table), (F.col("block") == F.col("_block")) & F.col("doc_id").eqNullSafe(F.col("_head"))).select(
        "doc_id", "text", F.col("_to").alias("block"), F.lit(1).alias("extra"))
    both = rows.select("doc_id", "text", "block", F.lit(0).alias("extra")).unionByName(extra)
    return both.repartitionById(len(cuts) + 1, "block").sortWithinPartitions(
        "block", "extra", F.col("doc_id").desc_nulls_last(), "text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has
    its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document's, in descending
    order of doc_id; after the last comes the first.

    A null text is empty; ties in doc_id are ordered by text and null ids come last; repeated rows follow one another;
    a single document is its own next. Other columns are ignored. An empty table gives no rows."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in schema.split(", ")]
        held = None  # the document whose next one is still to come, with its tree
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text, more in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "extra")]):
                made, leaves = tree(text)
                if held is not None:
                    doc0, text0, made0, leaves0 = held
                    cut = len(text0) - len(text0) // 3
                    edited = text0[:cut] + text[:len(text0) // 3]
                    stays = len(text0[:cut].encode("utf-8", "surrogatepass"))
                    changed, _ = tree(edited, [x for x in leaves0 if x[0] <= stays])
                    row = (doc0, len(text0), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), made0.fingerprint(),
                           changed.fingerprint(), likeness(made0, changed), likeness(made0, made))
                    for column, value in zip(out, row):
                        column.append(value)
                held = None if more else (doc, text, made, leaves)
                if more:
                    break
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
    return in_order(docs).mapInArrow(run, schema)
