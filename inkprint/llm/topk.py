"""Exact top-k inner products by three-phase uniform threshold.

The vectors are cut into ``LISTS`` lists of components. Phase 1 gathers, per query and list, the rows with the highest
partial scores and scores those rows fully: the k-th best is a safe cutoff. Phase 2 sends the cutoff to all blocks of
rows, and every list returns the entries of at least cutoff / LISTS: a row whose lists all stay below that cannot reach
the cutoff. Phase 3 drops rows that cannot reach it with what is known, and scores the rest exactly.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkprint.llm.common import materialised

LISTS = 2  # the share of a list is cutoff / LISTS: with few lists it is high, and few entries reach it
SCALE = 256
PROBES = 4  # times k + 1 rows of each list are scored for the cutoff: the higher it is, the fewer entries reach its share
BLOCK_ROWS = 8192  # rows of one block of vectors
BLOCK_QUERIES = 512  # queries whose products with a block of rows are held at once
GROUP_QUERIES = 8192  # queries that meet a block of rows in one task
BROADCAST_BYTES = 16_000_000  # vectors beyond that are never sent through the driver, however small their files are


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(256 * x) of every component as longs. Vectors that are null, empty or hold a null or non-finite
    component, and rows with a null id, take no part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & (F.size("x") > 0) & F.forall("x", finite)).select(
        "vec_id", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))


def _smallest(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The rows with the n smallest ids of every key. Spark cuts each map task's rows before the shuffle."""
    w = Window.partitionBy(key).orderBy("vec_id")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def _lists(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """One row per vector and list of components, with the list's part of the vector, padded with zeros."""
    part = -(-width // LISTS)
    whole = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(part * LISTS) - F.size("v")))
    parts = F.array(*[F.slice(whole, 1 + j * part, part) for j in range(LISTS)])
    return rows.select(*keys, F.posexplode(parts).alias("list", "part"))


def _matrix(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = rows.column("vid").to_numpy()
    parts = rows.column("part").combine_chunks()
    return ids, parts.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where every sum stays below 2**53."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _partials(k: int):
    """Phases 1 and 2 on one list of a block of rows and of a block of queries: the k best rows of every query, or those at
    the cutoff."""
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        if rows.num_rows and queries.num_rows:
            ids, m = _matrix(rows)
            for start in range(0, queries.num_rows, BLOCK_QUERIES):
                some = queries.slice(start, BLOCK_QUERIES)
                qids, q = _matrix(some)
                scores = _products(q, m)
                if "cutoff" in some.column_names:
                    # at least cutoff / LISTS, in integers; without a cutoff every row is sent
                    need = [np.iinfo(np.int64).min if c is None else -(-c // LISTS) for c in some.column("cutoff").to_pylist()]
                    qi, ri = np.nonzero(scores >= np.array(need)[:, None])
                else:
                    take = min(k, scores.shape[1])
                    ri = np.argpartition(-scores, take - 1, axis=1)[:, :take].ravel()
                    qi = np.repeat(np.arange(len(qids)), take)
                found.append((qids[qi], ids[ri], scores[qi, ri]))
        qid, vid, partial = (np.concatenate(x) for x in zip(*found))
        return pa.table({"qid": qid, "list": np.full(len(qid), key[-1].as_py(), np.int32), "vid": vid, "partial": partial})
    return run


_PARTIAL = "qid long, list int, vid long, partial long"


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0).cast("long"))),
                       F.lit(0).cast("long"), lambda s, x: s + x)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """For each row of ``vectors`` (vec_id, embedding) where ``is_query`` holds, the k rows other than itself with the
    highest integer inner product: query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id, and a query
    of a small table gets all other rows. Scores are exact while they fit 64 bits.

    Vectors that are null, empty, or hold a null or non-finite component, and rows with a null id, take no part. Shorter
    vectors count as padded with zeros. Equal vectors tie everywhere, so only the k + 1 smallest ids of each are
    searched, and equal queries are searched once. Rows repeated with id and vector count once. Other columns are
    ignored. An empty table gives no rows."""
    ints = materialised(quantised(vectors.where(F.col("vec_id").isNotNull())).distinct().withColumn(
        "same", F.sha2(F.array_join(F.transform("v", lambda c: c.cast("string")), ","), 256)))
    classes = ints.groupBy("same").agg(F.min("vec_id").alias("vid"), F.first("v").alias("v"))
    members = _smallest(ints.select("same", "vec_id"), "same", k + 1)
    wanted = ints.where(is_query).select(F.col("same").alias("q_same"), F.col("vec_id").alias("query_id"))
    asked = wanted.groupBy("q_same").agg(F.min("query_id").alias("_q")).join(
        classes, F.col("q_same") == F.col("same")).select(F.col("vid"), "v")
    asked = materialised(asked)
    classes = materialised(classes.select("vid", "v", "same"))

    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    n_rows, n_queries = classes.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_queries // GROUP_QUERIES))
    block = lambda n: F.pmod(F.xxhash64("vid"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = ["block", "group", "list"]
    rows = _lists(classes, ["vid", block(row_blocks).alias("block")], width).select("*", every(query_blocks).alias("group"))

    probes = PROBES * (k + 1)

    def compare(queries: DataFrame, keys: list[str]) -> DataFrame:
        """Every block of queries meets every block of rows, list by list. Both are shuffled: as blocks of rows and queries
        multiply, the queries' side outgrows any estimate from their files, and a broadcast of it the driver."""
        spread = _lists(queries, [*keys, block(query_blocks).alias("group")], width).select("*", every(row_blocks).alias("block"))
        return rows.groupBy(*met).cogroup(spread.groupBy(*met)).applyInArrow(_partials(probes), _PARTIAL)

    def bounded(vectors: DataFrame, n: int) -> DataFrame:
        """``vectors`` for a join, never broadcast if the ``n`` vectors themselves, not their files, are large."""
        return vectors.hint("merge") if n * width * 8 > BROADCAST_BYTES else vectors

    full = bounded(classes.select(F.col("vid").alias("_vid"), F.col("v").alias("_v")), n_rows)
    query_vectors = bounded(asked.select(F.col("vid").alias("_qid"), F.col("v").alias("_qv")), n_queries)

    def exact(pairs: DataFrame) -> DataFrame:
        """Scores of (qid, vid, known); a score that is known is kept."""
        return pairs.join(full, F.col("vid") == F.col("_vid")).join(query_vectors, F.col("qid") == F.col("_qid")).select(
            "qid", "vid", F.coalesce("known", _dot(F.col("_v"), F.col("_qv"))).alias("score"))

    # Phase 1. The best of each list, scored fully; a class counts once, which keeps the cutoff safe.
    best = Window.partitionBy("qid", "list").orderBy(F.desc("partial"), "vid")
    first = compare(asked, ["vid"]).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= probes)
    ranked = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    cutoffs = exact(first.select("qid", "vid", F.lit(None).cast("long").alias("known")).distinct()).withColumn("_n", F.row_number().over(ranked)).where(
        F.col("_n") == k + 1).select(F.col("qid").alias("_cut"), F.col("score").alias("cutoff"))
    cut = materialised(asked.join(cutoffs, F.col("vid") == F.col("_cut"), "left").select("vid", "v", "cutoff"))

    # Phase 2. Entries of at least the cutoff's share; what is missing in a list is below that share.
    entries = compare(cut, ["vid", "cutoff"]).groupBy("qid", "vid").agg(
        F.sum("partial").alias("known"), F.count("*").alias("lists"))
    limit = cut.select(F.col("vid").alias("_cut"), "cutoff")
    # What a list did not send lies below the integer share, so a sum with a missing list must leave room for it.
    share = F.expr(f"(cutoff + pmod(-cutoff, {LISTS})) div {LISTS}")
    whole = F.col("lists") == LISTS
    able = entries.join(limit, F.col("qid") == F.col("_cut")).where(
        F.col("cutoff").isNull() | F.when(whole, F.col("known") >= F.col("cutoff")).otherwise(
            F.col("known") + (LISTS - F.col("lists")) * (share - 1) >= F.col("cutoff")))

    # Phase 3. Exact scores of the rest; where all lists have answered, their sum is exact already. One pass over the entries.
    resolved = exact(able.select("qid", "vid", F.when(whole, F.col("known")).alias("known")))
    top = resolved.withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k + 1)
    by_class = classes.select(F.col("vid").alias("_vid"), F.col("same").alias("_of"))
    hits = top.select("qid", "vid", "score").join(by_class, F.col("vid") == F.col("_vid")).join(
        members, F.col("_of") == F.col("same")).select("qid", "vec_id", "score")
    asked_by = by_class.select(F.col("_vid").alias("_qid"), F.col("_of").alias("_qof"))
    # A query may be one of its class's smallest ids, so k + 1 rows are enough for every query of the class.
    near = hits.withColumn("_n", F.row_number().over(
        Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1)
    answers = wanted.join(asked_by, F.col("q_same") == F.col("_qof")).join(near, F.col("_qid") == F.col("qid")).where(
        F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def search(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """The registered search: every 50th id asks for its 5 best rows."""
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
  SELECT query_id, rank, vec_id, score FROM (
    SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (
      SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0))
  WHERE rank <= 5"""
