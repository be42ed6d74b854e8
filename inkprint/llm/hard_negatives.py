"""Hard-negative mining with segment summaries.

A vector is cut into segments; of each the mean and the deviation (the norm of what the mean leaves) are held. Over a
segment of width w the inner product of two vectors lies within w * mean * mean +- deviation * deviation, so the sum over
the segments bounds the whole score. Pairs whose bounds miss the wanted range are dropped, the others are bounded again
with shorter segments, and what is left is scored exactly. The wanted range narrows as better rows are found.

Anchors and rows meet block by block; what a block returns is bounded by its anchors, not by its pairs. A first pass
finds each anchor's positives, a second the negatives in the range that each positive allows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkprint.llm.common import materialised

SCALE = 256
SEGMENTS = (1, 4, 16)  # segments per vector, level by level
BLOCK_ROWS, BLOCK_ANCHORS, TILE = 8192, 512, 1024
LEAST_GAIN = 0.1  # a level that drops a smaller share of the pairs is the last one before exact scores
NONE = -(2 ** 62)  # stands for "no row": scores are exact above it
ROUNDING = 1e-12  # bounds are widened by this share of the product of norms: far above the rounding of their sums


def quantised(vectors: DataFrame, label: Column) -> DataFrame:
    """vec_id, label, v: floor(256 * x) of every component as longs. Rows with a null id, a null label, or a vector that is
    null, empty or holds a null or non-finite component take no part; rows repeated in all three count once."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0) & F.forall("x", finite)
    return rows.where(usable).select("vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v")).distinct()


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, padded with zeros to ``width``."""
    lists = column.combine_chunks()
    flat, sizes = np.asarray(lists.flatten()), np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Vectors:
    """A matrix of integer vectors with the summaries of their segments, level by level."""

    def __init__(self, values: np.ndarray):
        self.values, self.real = values, values.astype(np.float64)
        self.norm = np.sqrt((self.real ** 2).sum(1))
        self.levels = []
        n, width = values.shape
        for count in sorted({min(c, max(1, width)) for c in SEGMENTS}):
            wide = -(-width // count)
            parts = np.zeros((n, count * wide))
            parts[:, :width] = self.real
            parts = parts.reshape(n, count, wide)
            mean = parts.mean(2)
            self.levels.append((wide, mean, np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))))

    def bounds(self, other: "Vectors", mine: np.ndarray, theirs: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of the inner product of every chosen vector with every chosen other one."""
        wide, mean, deviation = self.levels[level]
        _, other_mean, other_deviation = other.levels[level]
        middle = wide * (mean[mine] @ other_mean[theirs].T)
        room = deviation[mine] @ other_deviation[theirs].T + ROUNDING * np.outer(self.norm[mine], other.norm[theirs])
        return middle - room, middle + room

    def exact(self, other: "Vectors", mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Exact integer inner products; in floating point where every sum stays below 2**53."""
        largest = self.norm[mine].max(initial=0) * other.norm[theirs].max(initial=0)
        if largest < 2 ** 52:
            return (self.real[mine] @ other.real[theirs].T).astype(np.int64)
        return self.values[mine] @ other.values[theirs].T


def scores_within(anchors: Vectors, rows: Vectors, wanted: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(anchor places, row places, scores): exact scores of the wanted pairs that may lie in their anchor's range, NONE for
    the others. Pairs are dropped level by level, and with them anchors and rows that have none left."""
    mine, theirs = np.arange(wanted.shape[0]), np.arange(wanted.shape[1])
    for level in range(len(rows.levels)):
        before = np.count_nonzero(wanted)
        least, most = anchors.bounds(rows, mine, theirs, level)
        wanted = wanted & (most >= low[mine, None]) & (least <= high[mine, None])
        left = np.count_nonzero(wanted)
        some, those = wanted.any(1), wanted.any(0)
        mine, theirs, wanted = mine[some], theirs[those], wanted[some][:, those]
        if not left or left > (1 - LEAST_GAIN) * before:
            break
    if not wanted.size:
        return mine, theirs, np.zeros(wanted.shape, np.int64)
    return mine, theirs, np.where(wanted, anchors.exact(rows, mine, theirs), NONE)


class Best:
    """The k highest scores of every anchor so far, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), NONE, np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def add(self, mine: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Add rows, in ascending order of ``ids``; the first of equal scores is found first. ``scores`` is used up."""
        k, line = self.scores.shape[1], np.arange(len(mine))
        found, of = np.full((len(mine), k), NONE, np.int64), np.zeros((len(mine), k), np.int64)
        for n in range(min(k, scores.shape[1])):
            at = scores.argmax(1)
            found[:, n], of[:, n] = scores[line, at], ids[at]
            scores[line, at] = NONE
        both, whose = np.hstack([self.scores[mine], found]), np.hstack([self.ids[mine], of])
        order = np.lexsort((whose, -both), axis=1)[:, :k]
        self.scores[mine], self.ids[mine] = np.take_along_axis(both, order, 1), np.take_along_axis(whose, order, 1)


def _tiles(table: pa.Table, width: int):
    """The block's rows in ascending order of id, some at a time: ids, labels, vectors."""
    table = table.sort_by("vec_id")
    for at in range(0, len(table), TILE):
        part = table.slice(at, TILE)
        yield np.asarray(part["vec_id"]), np.asarray(part["label"]), Vectors(_matrix(part["v"], width))


def _positives(width: int, k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        aid, of, vid = (np.asarray(anchors[c]) for c in ("aid", "label", "vec_id"))
        best, mine = Best(len(aid), k), Vectors(_matrix(anchors["v"], width))
        if len(aid):
            for ids, labels, vectors in _tiles(rows, width):
                wanted = (of[:, None] == labels[None, :]) & (vid[:, None] != ids[None, :])
                high = np.full(len(aid), np.inf)
                some, theirs, scores = scores_within(mine, vectors, wanted, best.scores[:, -1].astype(float), high)
                if scores.size:
                    best.add(some, scores, ids[theirs])
        a, n = np.nonzero(best.scores > NONE)
        return pa.table({"aid": aid[a], "vec_id": best.ids[a, n], "score": best.scores[a, n]})
    return run


def _negatives(width: int, k: int, floor: int, ceiling: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        aid, of = np.asarray(anchors["aid"]), np.asarray(anchors["label"])
        positives = _matrix(anchors["positives"], max(1, max(map(len, anchors["positives"].to_pylist()), default=1)))
        count = np.array([len(p) for p in anchors["positives"].to_pylist()], np.int64)
        low, high = -(-floor * positives // 100), ceiling * positives // 100
        open_ = (np.arange(positives.shape[1])[None, :] < count[:, None]) & (low <= high) if len(aid) else None
        best = [Best(len(aid), k) for _ in range(positives.shape[1])]
        mine = Vectors(_matrix(anchors["v"], width))
        if len(aid) and open_.any():
            top = np.where(open_, high, NONE).max(1).astype(float)
            for ids, labels, vectors in _tiles(rows, width):
                # the k-th best so far is as much as a further row of that range has to reach
                least = np.stack([np.where(open_[:, p], np.maximum(low[:, p], b.scores[:, -1]), -NONE)
                                  for p, b in enumerate(best)]).min(0).astype(float)
                wanted = (of[:, None] != labels[None, :]) & open_.any(1)[:, None]
                some, theirs, scores = scores_within(mine, vectors, wanted, least, top)
                for p, b in enumerate(best if scores.size else []):
                    inside = (scores >= low[some, p, None]) & (scores <= high[some, p, None]) & open_[some, p, None]
                    has = inside.any(1)
                    if has.any():
                        b.add(some[has], np.where(inside[has], scores[has], NONE), ids[theirs])
        out = [(aid[a], np.full(len(a), p), b.ids[a, n], b.scores[a, n])
               for p, b in enumerate(best) for a, n in [np.nonzero(b.scores > NONE)]]
        columns = [np.concatenate(c) for c in zip(*out)]
        return pa.table(dict(zip(("aid", "place", "vec_id", "score"), [c.astype(np.int64) for c in columns])))
    return run


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3,
         floor: int = 50, ceiling: int = 95) -> DataFrame:
    """Hard negatives of every anchor: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A row's score is its integer inner product with the anchor; higher scores come first, ties by the smaller vec_id. An
    anchor's positives are its first ``positives`` rows of the same label and another vec_id. For each of them come the
    first ``negatives`` rows of another label whose score is at least ``floor`` and at most ``ceiling`` per cent of the
    positive's. Fewer rows give fewer results; a positive of negative score has none.

    ``vectors`` has vec_id, embedding and what ``label`` and ``is_anchor`` (over vec_id and label) read; other columns are
    ignored. Which rows take no part: see ``quantised``. Shorter vectors count as padded with zeros. An id with several
    labels or vectors stands for several rows, and several anchors. Scores are exact while a hundred times a score fits
    64 bits. An empty table gives no rows."""
    rows = materialised(quantised(vectors, label).withColumn("aid", F.monotonically_increasing_id()))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"),
                    F.count(F.when(is_anchor, 1)).alias("anchors")).first()
    width = size["width"] or 1
    dealt = lambda n, block: F.pmod(F.xxhash64("aid"), F.lit(max(1, -(-n // block)))).cast("int")
    row_blocks, anchor_blocks = (max(1, -(-n // block)) for n, block in ((size["n"], BLOCK_ROWS), (size["anchors"], BLOCK_ANCHORS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    anchors = rows.where(is_anchor).withColumn("anchor_block", dealt(size["anchors"], BLOCK_ANCHORS))
    blocks = rows.select("vec_id", "label", "v", dealt(size["n"], BLOCK_ROWS).alias("row_block"),
                         every(anchor_blocks).alias("anchor_block")).groupBy("row_block", "anchor_block")

    def meet(asking: DataFrame, run, schema: str) -> DataFrame:
        asking = asking.withColumn("row_block", every(row_blocks)).groupBy("row_block", "anchor_block")
        return blocks.cogroup(asking).applyInArrow(run, schema)

    order = [F.desc("score"), "vec_id"]
    near = meet(anchors, _positives(width, positives), "aid long, vec_id long, score long").withColumn(
        "_n", F.row_number().over(Window.partitionBy("aid").orderBy(*order))).where(F.col("_n") <= positives)
    lists = F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score")))
    chosen = materialised(anchors.join(near.groupBy(F.col("aid").alias("_aid")).agg(lists.alias("near")),
                                       F.col("aid") == F.col("_aid")).drop("_aid"))
    far = meet(chosen.select("aid", "label", "v", "anchor_block", F.col("near.score").alias("positives")),
               _negatives(width, negatives, floor, ceiling), "aid long, place long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("aid", "place").orderBy(*order))
    ranked = far.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    return ranked.join(chosen.select("aid", F.col("vec_id").alias("anchor_id"), "near"), "aid").select(
        "anchor_id", F.get("near", F.col("place").cast("int"))["vec_id"].alias("positive_id"), "rank",
        F.col("vec_id").alias("negative_id"), F.get("near", F.col("place").cast("int"))["score"].alias("positive_score"),
        F.col("score").alias("negative_score"))


def search(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """The registered search: every 50th id is an anchor; every 7th id first moves to the next label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 50 == 0, label)


ORACLE = """WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
  p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same)
    WHERE n <= 5)
  SELECT * FROM (SELECT p.anchor_id, p.vec_id AS positive_id,
      row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
      s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
  WHERE rank <= 3"""
