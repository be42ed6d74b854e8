"""Native column helpers shared by the operators: whole texts, match positions, span digests, shared tables."""

import sys
import types
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.session import materialised, scratch_folder  # noqa: F401  (used by the operators)

_BLOCK = 128  # running sums restart every so many matches, so their cost stays linear


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def partitions_of(df: DataFrame) -> int:
    """Enough partitions for a shuffle of ``df``: what the session asks for, and at least as many as its scan has."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def dealt(df: DataFrame) -> DataFrame:
    """A small aggregate before it is joined: dealt out anew, so that Spark can split a crowded key of the other side."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def worker_table(owner: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one thing, that of its last owner. Another owner's is dropped before
    ``make`` is called, so tables of several operators or models never stand beside each other in a reused worker."""
    slot = sys.modules.setdefault("_inkprint_worker_table", types.ModuleType("_inkprint_worker_table"))
    if getattr(slot, "owner", None) != owner:
        slot.owner = slot.kept = None
        slot.kept = make()
        slot.owner = owner
    return slot.kept


def held_out(name: str = "doc_id") -> Column:
    """True for the rows whose labels no model may learn from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 4 == 2, F.lit(False))


def _sum(part: Column) -> Column:
    return F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)


def with_running_totals(df: DataFrame, steps: str, name: str) -> DataFrame:
    """Add ``name``: the sum of all elements before each element of the array of longs ``steps``. Sums of blocks come first,
    in a column of their own, so the cost is linear."""
    blocks = F.ceil(F.size(steps) / _BLOCK).cast("int")
    numbers = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(f"_sums_{name}", F.transform(numbers, lambda b: _sum(F.slice(steps, b * _BLOCK + 1, _BLOCK))))
    parts = F.transform(f"_sums_{name}", lambda s, b: F.struct(
        _sum(F.slice(f"_sums_{name}", F.lit(1), b)).alias("before"), F.slice(steps, b * _BLOCK + 1, _BLOCK).alias("part")))
    totals = F.flatten(F.transform(parts, lambda x: F.transform(
        x["part"], lambda _, i: x["before"] + _sum(F.slice(x["part"], F.lit(1), i)))))
    return df.withColumn(name, totals).drop(f"_sums_{name}")


def with_matches(df: DataFrame, found: dict[str, tuple[str, Column]], text: str = "_text") -> DataFrame:
    """Add, for each name, the leftmost non-overlapping matches of its pattern as an array of (start, end, hit): code
    points, end exclusive. ``found`` maps a name to (pattern, condition); where the condition fails the text is not
    scanned and the array is empty. The gaps between matches give the positions, so each text is read a fixed number
    of times."""
    empty = F.array().cast("array<string>")
    for name, (pattern, wanted) in found.items():
        hit = F.coalesce(wanted & F.col(text).rlike(pattern), F.lit(False))
        df = df.withColumn(f"_on_{name}", hit)
    for name, (pattern, _) in found.items():
        on = F.col(f"_on_{name}")
        df = df.withColumn(f"_hits_{name}", F.when(on, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
        df = df.withColumn(f"_gaps_{name}", F.when(on, F.split(text, pattern, -1)).otherwise(empty))
    for name in found:
        pairs = F.zip_with(f"_hits_{name}", F.slice(f"_gaps_{name}", F.lit(1), F.size(f"_hits_{name}")), lambda h, g: F.struct(
            h.alias("hit"), F.length(g).cast("long").alias("gap"), F.length(h).cast("long").alias("size")))
        df = df.withColumn(f"_pairs_{name}", pairs)
    for name in found:
        df = df.withColumn(f"_steps_{name}", F.transform(f"_pairs_{name}", lambda p: p["gap"] + p["size"]))
        df = with_running_totals(df, f"_steps_{name}", f"_before_{name}")
    for name in found:
        spans = F.zip_with(f"_pairs_{name}", f"_before_{name}", lambda p, b: F.struct(
            (b + p["gap"]).alias("start"), (b + p["gap"] + p["size"]).alias("end"), p["hit"].alias("hit")))
        df = df.withColumn(name, spans)
    return df.drop(*[f"{p}{n}" for n in found for p in ("_on_", "_hits_", "_gaps_", "_pairs_", "_steps_", "_before_")])


def merged_spans(kinds: Sequence[str]) -> Column:
    """One array of (start, rank, end, kind) from the span columns named ``kinds``, by start, then kind as listed."""
    def labelled(rank: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.array_sort(F.flatten(F.array(*[labelled(i, k) for i, k in enumerate(kinds)])))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def rewritten(text: Column, pattern: str, replace: Callable[[Column], Column]) -> Column:
    """``text`` with every match replaced by ``replace(match)``, in one linear pass over the pieces between matches."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.zip_with(pieces, hits, lambda p, h: F.concat(p, F.when(h.isNull(), F.lit("")).otherwise(replace(h))))
    return F.when(text.rlike(pattern), F.array_join(joined, "")).otherwise(text)


def span_sql(kinds: list[tuple[str, str, str]]) -> str:
    """DuckDB CTEs ``spans(doc_id, kind, rank, start, stop, hit)`` from (kind, pattern, condition on ``hit``)."""
    parts = []
    for rank, (kind, pattern, keep) in enumerate(kinds):
        pattern = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, '{kind}' AS kind, {rank} AS rank, hit, start, start + length(hit) AS stop FROM (
          SELECT doc_id, hit, length(gap) + sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id ORDER BY i)
            - length(gap) - coalesce(length(hit), 0) AS start FROM (
              SELECT doc_id, unnest(gaps) AS gap, unnest(hits) AS hit, generate_subscripts(gaps, 1) AS i FROM (
                SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps,
                  regexp_extract_all(coalesce(text, ''), '{pattern}') AS hits FROM documents)))
          WHERE hit IS NOT NULL AND ({keep})""")
    return "spans AS (" + "\nUNION ALL\n".join(parts) + ")"


def span_digest_sql(kinds: list[tuple[str, str, str]], base: list[str]) -> str:
    """DuckDB query: counts and digest of the base kinds, and all spans, per document."""
    inside = ", ".join(f"'{k}'" for k in base)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in base)
    one = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
    zeros = ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in base)
    return f"""WITH {span_sql(kinds)}, g AS (SELECT doc_id, {counts},
        string_agg({one}, ',' ORDER BY start, rank) FILTER (kind IN ({inside})) AS base,
        string_agg({one}, ',' ORDER BY start, rank) AS spans FROM spans GROUP BY doc_id)
      SELECT d.doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
      FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""
