"""Near-duplicate documents by MinHash with sequential Bayesian verification.

Texts with equal words are one class. Class signatures are banded; within a band's bucket every class meets the bucket's
first class. Of the classes of buckets that still hold several components, those with enough shingles that other components
have then meet where they share one of the rare shingles that similar sets must share. Candidate pairs compare their signatures batch by batch and are dropped as soon as the
posterior chance of reaching the threshold falls below ``MISS``; survivors are verified exactly on their full shingle
sets. Components grow over the verified links only.
"""

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkprint.llm.common import dealt, materialised, whole_text, worker_table

SHINGLE = 5
NUMERATOR, DENOMINATOR = 85, 100  # linked when DENOMINATOR * intersection >= NUMERATOR * union
BANDS, ROWS = 24, 5  # a pair at the threshold shares no band with a chance of (1 - 0.85 ** 5) ** 24 < 1e-6
HASHES = BANDS * ROWS
BATCH = 12  # signature positions compared at a time
MISS = 1e-6  # chance, at the threshold or above, that a pair may be dropped by its signature
PART = 64  # sets whose shingles are spelt at a time
SLOTS, PAGE = 1 << 21, 1 << 16  # slots in which shingles are counted to order them, whatever the corpus
CACHE_WORDS = 400_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0d]+")
_SEED = np.random.default_rng(20_240)
_MULTIPLIERS = _SEED.integers(0, 2 ** 31, (HASHES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADDENDS = _SEED.integers(0, 2 ** 32, (HASHES, 1), dtype=np.uint32)
_PLACES = _SEED.integers(1, 2 ** 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (Stafford's variant 13)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[bytes]:
    """Maximal runs of anything but the six white-space characters, A-Z in lower case."""
    return [w for w in _SPACE.split(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if w]


def _word_hashes() -> dict:
    return worker_table("word hashes", dict)


def word_codes(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash per word; the worker remembers those of frequent words."""
    from xxhash import xxh3_64_intdigest
    known = _word_hashes()
    codes = list(map(known.get, found))
    if None in codes:
        for i, c in enumerate(codes):
            if c is None:
                codes[i] = xxh3_64_intdigest(found[i])
                if len(known) < CACHE_WORDS:
                    known[found[i]] = codes[i]
    return np.array(codes, np.uint64)


def shingles(text: str) -> np.ndarray:
    return shingle_set(words(text))


def shingle_set(found: list[bytes]) -> np.ndarray:
    """The document's set: sorted distinct 64-bit hashes of its 5-word shingles; of fewer words, the whole sequence is
    one; without words, none. (Two different shingles of a document collide with a chance below 1e-10.)"""
    codes = word_codes(found)
    if not len(codes):
        return codes
    if len(codes) < SHINGLE:
        size = np.array([len(codes)], np.uint64) * _PLACES[SHINGLE]
        return _mix((codes * _PLACES[:len(codes)]).sum(dtype=np.uint64, keepdims=True) + size)
    n = len(codes) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h += _mix(codes[k:k + n] + _PLACES[SHINGLE]) * _PLACES[k]
    return np.unique(_mix(h))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash: per hash function, 16 bits of the smallest value over the set. The functions permute the upper half of the
    shingles' hashes; they are taken together over blocks of the set that stay in the processor's cache."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    upper = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), 256):
        x = upper[None, at:at + 256] * _MULTIPLIERS
        x += _ADDENDS
        x ^= x >> np.uint32(15)
        np.minimum(least, x.min(1), out=least)
    return (_mix(least.astype(np.uint64)) & np.uint64(0xFFFF)).astype("<u2")


def fewest_matches(threshold: float = NUMERATOR / DENOMINATOR, miss: float = MISS) -> np.ndarray:
    """For every number of batches compared, the fewest equal signature positions with which a pair stays: below it, the
    posterior chance of a similarity of at least ``threshold``, under a uniform prior, is less than ``miss``."""
    s = (np.arange(20_000) + 0.5) / 20_000
    fewest = []
    for n in range(BATCH, HASHES + 1, BATCH):
        for m in range(n + 1):
            logs = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(logs - logs.max())
            if p[s >= threshold].sum() / p.sum() >= miss:
                break
        fewest.append(m)
    return np.array(fewest)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test on two sorted sets."""
    if min(len(a), len(b)) * DENOMINATOR < max(len(a), len(b)) * NUMERATOR:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both) and both > 0


def class_of(own: list[bytes]) -> int:
    """A number of 64 bits for a word sequence."""
    return int.from_bytes(blake2b(b" ".join(own), digest_size=8).digest(), "little", signed=True)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, id (hash of the word sequence: one class per distinct sequence), n (set size), sig, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, n, sig = [], [], []
            for text in batch.column(1).to_pylist():
                own = words(text)
                found = shingle_set(own)
                cls.append(class_of(own))
                n.append(len(found))
                sig.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())],
                ["doc_id", "id", "n", "sig"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text()).mapInArrow(
        run, "doc_id long, id long, n long, sig binary")


def _survivors(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures leave a chance of reaching the threshold."""
    fewest = fewest_matches()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                unpack = lambda c: np.frombuffer(b"".join(df[c]), "<u2").reshape(-1, HASHES)
                a, b, left = unpack("sig_a"), unpack("sig_b"), np.arange(len(df))
                matches = np.zeros(len(df), np.int64)
                for k, least in enumerate(fewest):
                    part = slice(k * BATCH, (k + 1) * BATCH)
                    matches[left] += (a[left, part] == b[left, part]).sum(1)
                    left = left[matches[left] >= least]
                yield df[["a", "b"]].iloc[left]
    side = lambda s: reps.select(F.col("id").alias(s), F.col("sig").alias(f"sig_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInPandas(
        run, "a long, b long")


def full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id, found (the shingle set, packed) of the classes (id, doc_id of one of their documents), made again from the texts
    of those documents. An id with several texts also gives sets that were not asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [words(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(w) for w in own], pa.int64()), pa.array([shingle_set(w).tobytes() for w in own], pa.binary())],
                ["id", "found"])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).where(F.col("doc_id").isNotNull())
    return texts.join(classes.select("doc_id").distinct(), "doc_id", "left_semi").select("text").mapInArrow(
        run, "id long, found binary").where(F.length("found") > 0)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unpack = lambda c: [np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()]
            keep = pa.array([similar(a, b) for a, b in zip(unpack("set_a"), unpack("set_b"))], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)
    side = lambda s: sets.select(F.col("id").alias(s), F.col("found").alias(f"set_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _weights(sets: DataFrame) -> np.ndarray:
    """How many of ``sets`` have a shingle in each of ``SLOTS`` slots; a table of fixed size, packed page by page."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = b"".join(batch.column(0).to_pylist())
            slots, n = np.unique(np.frombuffer(packed, np.uint64) % np.uint64(SLOTS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((slots // PAGE).astype(np.int32)), pa.array((slots % PAGE).astype(np.int32)),
                                              pa.array(n.astype(np.int64))], ["page", "slot", "n"])

    def pack(page: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(PAGE, "<u4")
        full[page["slot"].to_numpy()] = np.minimum(page["n"].to_numpy(), 0xFFFFFFFF)
        return pd.DataFrame({"page": [int(page["page"].iloc[0])], "full": [full.tobytes()]})
    counts = sets.select("found").mapInArrow(count, "page int, slot int, n long").groupBy("page", "slot").agg(F.sum("n").alias("n"))
    weight = np.zeros(SLOTS, np.uint32)
    for row in counts.groupBy("page").applyInPandas(pack, "page int, full binary").collect():  # SLOTS / PAGE rows
        weight[row["page"] * PAGE:(row["page"] + 1) * PAGE] = np.frombuffer(row["full"], "<u4")
    return weight


def _centrality(sets: DataFrame, weight: np.ndarray) -> DataFrame:
    """id, o: the lower, the more frequent a set's shingles are among all. In a group of copies the one that the others were
    made from comes first: it is like most of them, which two copies need not be to each other."""
    logs = np.log2(1.0 + weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            o = [-float(logs[(x % np.uint64(SLOTS)).astype(np.int64)].mean()) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(o, pa.float64())], ["id", "o"])
    return sets.select("id", "found").mapInArrow(run, "id long, o double").groupBy("id").agg(F.min("o").alias("o"))


def _postings(members: DataFrame) -> DataFrame:
    """g (a shingle), id, comp, n (size of the set) of all shingles of ``members`` (id, comp, found)."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                packed = part.column("found").to_pylist()
                sizes = np.array([len(x) // 8 for x in packed], np.int64)
                each = lambda c: pa.array(np.repeat(part.column(c).to_numpy(zero_copy_only=False), sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(b"".join(packed), np.int64)), each("id"), each("comp"), pa.array(np.repeat(sizes, sizes))],
                    ["g", "id", "comp", "n"])
    once = members.groupBy("id").agg(F.first("comp").alias("comp"), F.first("found").alias("found"))
    return once.mapInArrow(spell, "g long, id long, comp long, n long")


def _meetings(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``members`` (id, comp, found) in different components that may be similar; all similar ones are
    among them.

    What a set has in common with one of another component are shingles that other components have, so a set with too few
    of those is like none and goes, with its shingles; that is repeated while many go. A group of copies that are unlike
    each other by edits of their own is settled so without a pair. Sets that stay are ordered from rare to frequent
    shingles, by exact counts among them; two similar ones meet in a shingle after which either has enough left for the
    overlap that the threshold asks of their sizes. Of the largest component at a shingle only the others look at it."""
    c = F.col
    rows, before = materialised(_postings(members)), None
    while True:
        foreign = rows.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("g")
        common = rows.select("g", "id", "comp", "n").join(dealt(foreign), "g")
        rows = materialised(common.withColumn("k", F.count("*").over(W.partitionBy("id"))).where(
            c("k") * DENOMINATOR >= c("n") * NUMERATOR))
        now = rows.count()
        if not now or before is not None and now > 0.9 * before:
            break
        before = now
    counts = rows.groupBy("g").agg(F.count("*").alias("size"))
    ranked = rows.join(dealt(counts), "g").withColumn("at", F.row_number().over(W.partitionBy("id").orderBy("size", "g")))
    least = F.ceil(c("n") * NUMERATOR / DENOMINATOR)  # of the overlap with any set
    first = materialised(ranked.where(c("k") - c("at") + 1 >= least).select("g", "id", "comp", "n", (c("k") - c("at") + 1).alias("left")))
    shares = first.groupBy("g", "comp").agg(F.count("*").alias("size"))
    mixed = shares.groupBy("g").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps"))
    placed = materialised(first.join(dealt(mixed.where("comps > 1").select("g", "main")), "g"))
    side = lambda s: [c(k).alias(f"{k}_{s}") for k in ("id", "comp", "n", "left")]
    met = placed.where("comp <> main").select("g", *side("x")).join(placed.select("g", *side("y")), "g")
    overlap = (c("n_x") + c("n_y")) * NUMERATOR <= F.least("left_x", "left_y") * (NUMERATOR + DENOMINATOR)
    return met.where((c("comp_x") != c("comp_y")) & overlap & (
        F.least("n_x", "n_y") * DENOMINATOR >= F.greatest("n_x", "n_y") * NUMERATOR)).select(
        F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def roots(parents: DataFrame) -> DataFrame:
    """id, comp (the root of its tree) of a forest (a, b: its parent) without circles, by pointer jumping: the distance to
    the root halves each round, and every round is written to shared storage."""
    tree = materialised(parents.select(F.col("a").alias("id"), F.col("b").alias("comp")))
    while True:
        up = tree.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        tree = materialised(tree.join(up, "comp", "left").select(
            "id", F.coalesce("next", "comp").alias("comp"), F.col("next").isNotNull().alias("moved")))
        if tree.where("moved").isEmpty():
            return tree.select("id", "comp")


def components(edges: DataFrame) -> DataFrame:
    """id, comp (smallest id reachable) of all ids in ``edges`` (a, b), by alternating large and small stars; every round is
    written to shared storage, so a lost executor repeats one round at most."""
    edges = materialised(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        # Large star: every larger neighbour of u is tied to u's smallest neighbour (or u itself).
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = dealt(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: every smaller neighbour of u, and u, are tied to the smallest of them.
        large = materialised(large)
        low = dealt(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialised(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before is not None and tuple(state) == before:
            break
        before = tuple(state)
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return ids.unionByName(ids.select(F.col("comp").alias("id"), "comp").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (set size), component_id (smallest doc_id reachable over links, itself included), kept (whether
    the row is that document), one row per row of ``docs``. Search, verification and components work on classes of equal
    word sequences, which ids only name at the end; an id repeated with other words ties its classes.

    A null text is empty; documents without words link with nothing, not even with each other. Rows with a null doc_id
    cannot be named by a link: they get a null component_id and are kept. Rows repeated with their id are one document
    and give equal rows. Other columns are ignored. An empty table gives no rows."""
    rows = materialised(signed(docs))
    named = rows.where("n > 0 AND doc_id IS NOT NULL")
    reps = materialised(named.groupBy("id").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    # A doc_id repeated with other words belongs to several classes: they are tied through it.
    several = named.groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("last")).where("b <> last").drop("last")
    tied = named.select("doc_id", F.col("id").alias("a")).join(dealt(several), "doc_id").select("a", "b").where("a <> b").distinct()

    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])
    members = reps.select("id", "n", F.explode(bands).alias("key"))
    crowded = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    crowd = materialised(members.join(dealt(crowded), "key"))
    sets = materialised(full_sets(docs, reps.select("id", "doc_id").join(crowd.select("id").distinct(), "id", "left_semi")))
    weight = _weights(sets)
    # Every bucket's most central class, in one order for all bands, so that the buckets of a group of copies agree on it.
    central = materialised(_centrality(sets, weight))
    crowd = crowd.join(central, "id")
    firsts = crowd.groupBy("key").agg(F.min(F.struct("o", "id")).alias("first"))
    crowd = materialised(crowd.join(dealt(firsts.select("key", F.col("first.id").alias("pivot"))), "key"))

    def fits(n: Column, m: Column) -> Column:
        return F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR

    sizes = reps.select(F.col("id").alias("pivot"), F.col("n").alias("m"))
    stars = dealt(crowd.where("id <> pivot").groupBy("id", "pivot").agg(F.first("n").alias("n")))
    stars = stars.join(sizes, "pivot").where(fits(F.col("n"), F.col("m"))).select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    alive = materialised(_survivors(stars, reps).join(central.select(F.col("id").alias("b"), "o"), "b"))

    # First each class with its first surviving pivot (which comes before it in the order, so the links are a forest),
    # then the other pivots, then whoever shares a bucket; each time only across components, since a link within one
    # changes nothing.
    best = alive.groupBy("a").agg(F.min(F.struct("o", "b")).alias("x")).select("a", "x.b")
    comps = roots(_verified(best, sets))

    def across(pairs: DataFrame) -> DataFrame:
        """The pairs between different components, with these as ``u`` and ``v``."""
        of = lambda s: comps.select(F.col("id").alias(s), F.col("comp").alias(f"comp_{s}"))
        joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select(
            "a", "b", F.coalesce("comp_a", "a").alias("u"), F.coalesce("comp_b", "b").alias("v"))
        return joined.where("u <> v")

    def merged(links: DataFrame) -> DataFrame:
        """The components after more links (a, b): those are drawn between components."""
        drawn = materialised(across(links).select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
        if drawn.isEmpty():
            return comps
        more = components(drawn).select(F.col("id").alias("old"), F.col("comp").alias("new"))
        known = comps.unionByName(more.select(F.col("old").alias("id"), F.col("old").alias("comp")).join(
            comps.select("id"), "id", "left_anti"))
        return materialised(known.join(more, F.col("comp") == F.col("old"), "left").select(
            "id", F.coalesce("new", "comp").alias("comp")))

    rest = materialised(across(alive.select("a", "b")).select("a", "b"))
    comps = merged(_verified(rest, sets).unionByName(tied.select("a", "b")))
    # Members of buckets that hold several components by now.
    placed = materialised(crowd.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    unsettled = placed.join(dealt(mixed), "key", "left_semi").select("id", "comp").distinct()
    met = _meetings(sets.join(unsettled, "id"))
    tried = alive.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    comps = merged(_verified(_survivors(met.join(tried, ["a", "b"], "left_anti"), reps), sets))

    # A component is named by the smallest doc_id in it.
    labelled = materialised(reps.select("id", "doc_id").join(comps, "id", "left").select(
        "id", "doc_id", F.coalesce("comp", "id").alias("label")))
    names = labelled.groupBy("label").agg(F.min("doc_id").alias("comp"))
    of_class = labelled.join(dealt(names), "label").select("id", "comp")
    out = rows.join(dealt(of_class), "id", "left")
    component = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def kept(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the rows of ``docs`` that ``near_duplicates`` keeps, with their columns.
    Of rows repeated with their id and text one stays; rows with a null id all stay."""
    ids = near_duplicates(docs).where(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull())
    stay = named.join(ids, "doc_id", "left_semi").select(*[f"`{c}`" for c in docs.columns]).dropDuplicates(["doc_id", "text"])
    return stay.unionByName(docs.where(F.col("doc_id").isNull()))


ORACLE = """WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
  s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
  e AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
      WHERE least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY 1, 2),
  l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 85 * (na + nb - k)),
  d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT d.b, r.c FROM r JOIN d ON r.doc_id = d.a)
  SELECT s.doc_id, len(s)::BIGINT AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
  FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id"""
