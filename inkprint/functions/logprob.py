"""The nine token-probability features, from a long table of token log-probabilities or an array column."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.text import strip

# Feature names, in matrix order, and the two thresholds (strict comparisons).
LOGPROB_FEATURES = [
    "perp_mean_logprob", "perp_perplexity", "perp_variance", "perp_min_logprob", "perp_max_logprob", "perp_range",
    "perp_surprising_ratio", "perp_confident_ratio", "perp_token_count",
]
SURPRISING_BELOW = -3.0
CONFIDENT_ABOVE = -0.5
CONTEXT_CHARS = 800


def _finish(df: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col
    empty = c("perp_token_count") == 0
    values = {
        "perp_mean_logprob": c("_mean"),
        "perp_perplexity": F.when(c("_mean") < 0, F.exp(-c("_mean"))).otherwise(F.lit(1.0)),
        "perp_variance": c("_var"),
        "perp_min_logprob": c("_min"),
        "perp_max_logprob": c("_max"),
        "perp_range": c("_max") - c("_min"),
        "perp_surprising_ratio": c("_surprising") / F.nullif(c("perp_token_count"), F.lit(0)),
        "perp_confident_ratio": c("_confident") / F.nullif(c("perp_token_count"), F.lit(0)),
    }
    return df.select(
        *keys,
        *[F.when(empty, F.lit(0.0)).otherwise(v).alias(name) for name, v in values.items()],
        "perp_token_count",
    )


def logprob_features(tokens: DataFrame, keys: list[str], logprob: str = "logprob") -> DataFrame:
    """Per sample, from one row per token. NULL log-probabilities do not count; a sample without any gives zeros."""
    x = F.col(logprob)
    summed = tokens.groupBy(*keys).agg(
        F.avg(x).alias("_mean"), F.var_pop(x).alias("_var"), F.min(x).alias("_min"), F.max(x).alias("_max"),
        F.count_if(x < SURPRISING_BELOW).alias("_surprising"),
        F.count_if(x > CONFIDENT_ABOVE).alias("_confident"),
        F.count(x).alias("perp_token_count"),
    )
    return _finish(summed, keys)


def logprob_features_from_array(df: DataFrame, keys: list[str], logprobs: str = "logprobs") -> DataFrame:
    """Per row, from an array column; narrow."""
    xs = F.filter(F.col(logprobs), lambda x: x.isNotNull())
    n = F.size("_xs")
    zero = F.lit(0.0)
    total = lambda f: F.aggregate("_xs", zero, lambda acc, x: acc + f(x))
    listed = df.select(*keys, F.coalesce(xs, F.array().cast("array<double>")).alias("_xs"))
    meaned = listed.withColumn("_mean", F.when(n > 0, total(lambda x: x) / n))
    return _finish(
        meaned.select(
            *keys, "_mean",
            F.when(n > 0, total(lambda x: F.pow(x - F.col("_mean"), F.lit(2.0))) / n).alias("_var"),
            F.array_min("_xs").alias("_min"), F.array_max("_xs").alias("_max"),
            F.size(F.filter("_xs", lambda x: x < SURPRISING_BELOW)).cast("long").alias("_surprising"),
            F.size(F.filter("_xs", lambda x: x > CONFIDENT_ABOVE)).cast("long").alias("_confident"),
            n.cast("long").alias("perp_token_count"),
        ),
        keys,
    )


def context_prefix(code: Column, chars: int = CONTEXT_CHARS) -> Column:
    """Leading context handed to a token scorer: the first ``chars`` characters of the stripped sample."""
    return F.substring(strip(code), 1, chars)
