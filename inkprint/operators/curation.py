"""Row filters and shaping of crawled tables."""

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.functions.text import SPACE, is_not_blank, strip
from inkprint.session import join_hot_safe

# Curation limits of the reference study.
MIN_CODE_LEN, MAX_CODE_LEN = 50, 8000
CUTOFF_DATE = "2022-01-01"
HUMAN_BEFORE_EPOCH = 1669766400
MIN_RATING, MAX_RATING, MAX_CONTEST_ID, MISSING_CONTEST_ID = 800, 1400, 1500, 9999
SOLUTIONS_PER_PROBLEM = 3
SOURCE_TAG = r"<pre[^>]*id=[\"']program-source-text[\"'][^>]*>(.*?)</pre>"
BASIC_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&amp;": "&"}


def drop_blank(df: DataFrame, code: str = "code") -> DataFrame:
    return df.where(is_not_blank(F.col(code)))


def language_filter(df: DataFrame, language: str = "python", column: str = "language",
                    case_sensitive: bool = False) -> DataFrame:
    held = F.col(column)
    return df.where(held == language if case_sensitive else F.lower(held) == language.lower())


def length_bounds(df: DataFrame, code: str = "code", low: int = MIN_CODE_LEN, high: int = MAX_CODE_LEN) -> DataFrame:
    """Replace ``code`` by its stripped form and keep rows whose stripped length is within the bounds."""
    return df.withColumn(code, strip(F.col(code))).where(F.length(code).between(low, high))


def provenance_cutoff(df: DataFrame, modified: str, cutoff: str = CUTOFF_DATE) -> DataFrame:
    """Rows last modified strictly before the cutoff date; unknown dates are rejected."""
    return df.where(F.col(modified) < F.to_date(F.lit(cutoff)))


def accepted_submissions(df: DataFrame, index: str, before_epoch: int = HUMAN_BEFORE_EPOCH) -> DataFrame:
    """Accepted Python submissions to the problem ``index`` made before an instant (missing time counts as 0)."""
    return df.where(
        (F.col("problem.index") == index) & (F.col("verdict") == "OK")
        & F.startswith("programmingLanguage", F.lit("Python"))
        & (F.coalesce("creationTimeSeconds", F.lit(0)) < before_epoch))


def problem_catalogue(df: DataFrame, n: int, order: list[str], kind: str = "PROGRAMMING", low: int = MIN_RATING,
                      high: int = MAX_RATING, max_contest: int = MAX_CONTEST_ID) -> DataFrame:
    """First ``n`` problems of a type within the rating band from old contests."""
    wanted = (
        (F.col("type") == kind) & F.coalesce("rating", F.lit(0)).between(low, high)
        & (F.coalesce("contest_id", F.lit(MISSING_CONTEST_ID)) <= max_contest))
    return df.where(wanted).orderBy(*order).limit(n)


def candidate_dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key. Keys are compared by a 128-bit hash, so long texts among them are neither shuffled nor sorted for
    it; Spark keeps one row per key and task before the shuffle. NULL keys equal each other."""
    key = F.md5(F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])))
    first = W.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_seen", F.row_number().over(first)).where(F.col("_seen") == 1).drop("_seen", "_key")


def problem_key_variants(df: DataFrame, problem_id: str = "problem_id") -> DataFrame:
    """One row per file name a solution of the problem may carry (``variant`` 0..3, ``file_name``)."""
    pid = F.col(problem_id)
    digits, letters = F.regexp_replace(pid, r"[^\p{Nd}]", ""), F.regexp_replace(pid, r"\P{L}", "")
    names = F.array(
        F.concat(pid, F.lit(".py")), F.concat(F.lower(pid), F.lit(".py")),
        F.concat(digits, F.lit("_"), letters, F.lit(".py")),
        F.concat(digits, F.lit("_"), F.lower(letters), F.lit(".py")))
    return df.select("*", F.posexplode(names).alias("variant", "file_name"))


def match_problem_files(problems: DataFrame, files: DataFrame, problem_id: str = "problem_id") -> DataFrame:
    """Candidate files of each problem by file name, each file once per problem."""
    names = problem_key_variants(problems.select(problem_id), problem_id).select(problem_id, "file_name").distinct()
    return files.join(names, "file_name")


def cap_per_problem(candidates: DataFrame, problem_id: str, order: list[str], cap: int = SOLUTIONS_PER_PROBLEM,
                    have: DataFrame | None = None, usable: Column | None = None, tries: int = 3) -> DataFrame:
    """Up to ``cap`` rows per problem in order, less what ``have`` (problem, have) already holds. Only the first
    ``tries * cap`` candidates are tried; those failing ``usable`` are passed over."""
    in_order = W.partitionBy(problem_id).orderBy(*order)
    tried = candidates.withColumn("_try", F.row_number().over(in_order)).where(F.col("_try") <= tries * cap)
    if usable is not None:
        tried = tried.where(usable)
    room = F.lit(cap)
    if have is not None:
        tried = tried.join(have.select(problem_id, F.col("have").alias("_have")), problem_id, "left")
        room = F.lit(cap) - F.coalesce("_have", F.lit(0))
    taken = tried.withColumn("taken", F.row_number().over(in_order)).where(F.col("taken") <= room)
    return taken.drop("_try", "_have")


@F.pandas_udf(T.StringType())
def _unescape_any(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def unescape_entities(text: Column) -> Column:
    """HTML entities to characters. The common ones are replaced in the JVM ('&amp;' last, so nothing is unescaped
    twice); only texts with any other reference go through Python."""
    basic = text
    for entity, char in BASIC_ENTITIES.items():
        basic = F.replace(basic, F.lit(entity), F.lit(char))
    known = "|".join(e[1:] for e in BASIC_ENTITIES)
    other = F.regexp_like(text, F.lit(f"&(?!{known})[#A-Za-z]"))
    return F.coalesce(_unescape_any(F.when(other, text)), basic)


def extract_source_html(df: DataFrame, html_column: str, out: str = "source", tag: str = SOURCE_TAG) -> DataFrame:
    """Append the unescaped, stripped text of the first element matching ``tag``; NULL where there is none."""
    page = F.col(html_column)
    regex = F.lit(f"(?s){tag}")
    inner = F.when(F.regexp_like(page, regex), F.regexp_extract(page, f"(?s){tag}", 1))
    return df.withColumn(out, strip(unescape_entities(inner)))


def safe_key(column: Column) -> Column:
    """Keys usable as file names: '/' becomes '__' and ':' becomes '_'."""
    return F.replace(F.replace(column, F.lit("/"), F.lit("__")), F.lit(":"), F.lit("_"))


def compose_code(prompt: Column, body: Column) -> Column:
    return F.concat(prompt, body)


def pair_by_problem(human: DataFrame, ai: DataFrame, problem_id: str, ai_order: str) -> DataFrame:
    """Both sides of every problem, stacked: all rows of both, with ``side`` (human or ai), how many rows the problem has on
    either side (``n_human``, ``n_ai``), the first AI row by ``ai_order`` (``first_ai``), and ``paired`` (both sides have
    rows). One output row per input row, so a crowded problem never multiplies and no row is lost."""
    side = lambda df, name: df.withColumn("side", F.lit(name))
    rows = side(human, "human").unionByName(side(ai, "ai"), allowMissingColumns=True)
    is_ai = F.col("side") == "ai"
    sizes = rows.groupBy(problem_id).agg(
        F.count_if(~is_ai).alias("n_human"), F.count_if(is_ai).alias("n_ai"),
        F.min(F.when(is_ai, F.col(ai_order))).alias("first_ai"), F.count("*").alias("_rows"))
    joined = join_hot_safe(rows, sizes, problem_id, "_rows").drop("_rows")
    return joined.withColumn("paired", (F.col("n_human") > 0) & (F.col("n_ai") > 0))


def first_member(members: Column) -> Column:
    """Handle of the first author, 'unknown' when there is none."""
    return F.coalesce(F.get(members, 0)["handle"], F.lit("unknown"))


def epoch_iso(seconds: Column) -> Column:
    """Epoch seconds as ISO-8601 UTC text, whatever the session time zone."""
    whole = F.floor(seconds)
    day = F.timestamp_add("DAY", F.floor(whole / 86_400).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    instant = F.timestamp_add("SECOND", F.pmod(whole, F.lit(86_400)).cast("int"), day)
    return F.concat(F.replace(instant.cast("string"), F.lit(" "), F.lit("T")), F.lit("+00:00"))
