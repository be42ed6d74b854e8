"""Corpus profile and schema alignment."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkprint.functions.lexical import LEXICAL_FEATURES
from inkprint.functions.logprob import LOGPROB_FEATURES
from inkprint.functions.syntax import SYNTAX_FEATURES
from inkprint.operators.stats import exact_median

# Columns of a feature matrix that are not features.
METADATA = ["label", "language", "generator", "problem_id", "task_id", "source_file"]
OWN_METADATA = ["corpus", "sample_id", "parse_ok", "class", "fold"]


def code_length_stats(df: DataFrame, code: str = "code", approximate: bool = False) -> DataFrame:
    """min / median / mean / max code length (median and mean truncated) of a corpus."""
    sized = df.select(F.lit(0).alias("_all"), F.length(code).alias("n"))
    ends = [F.min("n").cast("long").alias("min_len"), F.max("n").cast("long").alias("max_len"),
            F.floor(F.avg("n")).alias("mean_len")]
    if approximate:
        return sized.agg(*ends, F.percentile_approx("n", 0.5, 10_000).cast("long").alias("median_len"))
    median = exact_median(sized, ["_all"], "n")
    return sized.groupBy("_all").agg(*ends).join(median, "_all").select(
        "min_len", F.floor("median").alias("median_len"), "mean_len", "max_len")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, pct) for each of ``columns`` the table has; one pass for all of them."""
    present = [c for c in columns if c in df.columns]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in present])
    counted = df.select(F.inline(cells)).groupBy("column", "value").agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").cast("double")).scalar()
    return counted.where(F.col("value").isNotNull()).withColumn("pct", F.col("n") * 100.0 / total)


def corpus_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Human and AI totals and shares of a stacked corpus, in one row."""
    n, human, ai = F.count("*"), F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    return df.agg(n.alias("total"), human.alias("human"), ai.alias("ai"),
                  (human * 100.0 / F.nullif(n, F.lit(0))).alias("human_pct"),
                  (ai * 100.0 / F.nullif(n, F.lit(0))).alias("ai_pct"))


def distinct_groups(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """Number of distinct values per column. Each column is deduplicated on its own before counting."""
    if approximate:
        return df.agg(*[F.approx_count_distinct(c).alias(f"n_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    unique = df.select(F.inline(cells)).distinct()
    return unique.agg(*[
        F.count_if((F.col("column") == c) & F.col("value").isNotNull()).alias(f"n_{c}") for c in columns])


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in METADATA and c not in OWN_METADATA]


def shared_features(*corpora: DataFrame) -> list[str]:
    """Feature columns every corpus has, in the order of the first. Reads schemas only."""
    first, *others = corpora
    return [c for c in feature_columns(first) if all(c in other.columns for other in others)]


def zero_fill(df: DataFrame, features: list[str]) -> DataFrame:
    """Exactly ``features`` as doubles (plus metadata): absent columns, NULL and NaN become 0.0."""
    others = [c for c in df.columns if c not in features]
    filled = [
        (F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) if f in df.columns else F.lit(0.0))
        .alias(f) for f in features]
    return df.select(*others, *filled)


def feature_names(language: str = "python", with_logprobs: bool = False) -> list[str]:
    """Ordered feature list of a language."""
    names = LEXICAL_FEATURES + (SYNTAX_FEATURES if language.lower() == "python" else [])
    return names + (LOGPROB_FEATURES if with_logprobs else [])


def compare_samples(df: DataFrame, keys: list[str], side: str, features: list[str]) -> DataFrame:
    """Feature-by-feature comparison of the two rows (side 0 and 1) sharing each key, with the direction."""
    long = df.select(*keys, side, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(
        [*keys, side], features, "feature", "value")
    of = lambda s: F.max(F.when(F.col(side) == s, F.col("value")))
    paired = long.groupBy(*keys, "feature").agg(of(0).alias("human"), of(1).alias("ai"))
    return paired.withColumn("direction", F.when(F.col("ai") > F.col("human"), "AI>H")
                             .when(F.col("ai") < F.col("human"), "H>AI").otherwise("="))
