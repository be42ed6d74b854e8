"""DuckDB side of the checks: input views and feature definitions, written independently of the Spark expressions."""

from inkprint.functions.lexical import COMMENT_MARKERS, COMMENT_MARKERS_OTHER, LEXICAL_FEATURES, PATTERNS
from inkprint.functions.syntax import SYNTAX_FEATURES
from registry.fixtures import AI_TEMPLATES, EMBEDDING_FEATURES, LANGUAGES, TEMPLATES

BREAK = r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPACE_IN = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE, NOT_SPACE = f"[{SPACE_IN}]", f"[^{SPACE_IN}]"
DIGIT = (
    r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}"
    r"\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}"
    r"\x{2780}-\x{2788}\x{278a}-\x{2792}\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]")
UPPER = r"[\p{Lu}\x{2160}-\x{216f}\x{24b6}-\x{24cf}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r(expr: str, name: str, digits: int = 6) -> str:
    """Round half up to ``digits`` with the same floating-point steps as the Spark side."""
    scale = 10 ** digits
    return f"floor(({expr}) * {scale}.0::DOUBLE + 0.5::DOUBLE) / {scale}.0::DOUBLE AS {name}"


def with_(*ctes: str) -> str:
    seen = []
    for cte in ctes:
        if cte not in seen:
            seen.append(cte)
    return "WITH " + ",\n".join(seen) + "\n"


def _case(subject: str, options: dict, default: str) -> str:
    return f"CASE {subject} " + " ".join(f"WHEN {k} THEN {v}" for k, v in options.items()) + f" ELSE {default} END"


_PROGRAM = (
    f"replace(replace(replace({_case('doc_id % 12', {i: q(t) for i, t in enumerate(TEMPLATES)}, 'NULL')}, "
    "'~', chr(10)), '^', chr(9)), '@', cast(doc_id AS VARCHAR))")
_AI = ", ".join(map(str, AI_TEMPLATES))
CODE = f"""code_samples AS (
  SELECT 'code' AS corpus, cast(doc_id AS VARCHAR) AS sample_id,
    CASE WHEN doc_id % 12 = 10 THEN {_PROGRAM}
      ELSE {_PROGRAM} || '# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) END AS code,
    {_case('doc_id % 12', {k: q(v) for k, v in LANGUAGES.items()}, "'Python'")} AS language,
    CASE WHEN doc_id % 12 IN ({_AI}) THEN 'gen' || (doc_id % 5) END AS generator,
    CASE WHEN doc_id % 12 IN ({_AI}) THEN 1 ELSE 0 END AS label, doc_id
  FROM documents)"""
FILLED = f"filled_samples AS (SELECT * FROM code_samples WHERE regexp_matches(code, {q(NOT_SPACE)}))"
DOCS = """docs AS (SELECT cast(doc_id AS VARCHAR) AS sample_id, text AS code, lang AS language, source AS generator
  FROM documents)"""
CORPUS_A = """corpus_a AS (SELECT 'a' AS corpus, cast(d.doc_id AS VARCHAR) AS sample_id, text AS code, lang AS language,
    source AS generator, quality AS label FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
CORPUS_B = """corpus_b AS (SELECT 'b' AS corpus, cast(doc_id AS VARCHAR) AS sample_id, text AS code, lang AS language,
    source AS generator FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))"""
PAIRED = """paired AS (SELECT 'paired' AS corpus, conv_id || '/' || turn AS sample_id, text AS code,
    'text' AS language, cast(NULL AS VARCHAR) AS generator, CASE role WHEN 'assistant' THEN 1 ELSE 0 END AS label,
    conv_id AS problem_id, turn AS source_file FROM conversations WHERE role IN ('user', 'assistant'))"""
THIRD = """third AS (SELECT 'third' AS corpus, '0:' || item_id AS sample_id, text AS code, 'text' AS language, 0 AS label
    FROM benchmark UNION ALL SELECT 'third', '1:' || page_id, html, 'text', 1 FROM pages)"""
EMB = "matrix_emb AS (SELECT vec_id AS sample_id, label, " + ", ".join(
    f"embedding[{i + 1}]::DOUBLE AS {f}" for i, f in enumerate(EMBEDDING_FEATURES)) + " FROM embeddings)"
PREDICTIONS = """predictions AS (SELECT vec_id, label,
    CASE WHEN vec_id % 4 = 0 THEN (label + vec_id % 3) % 10 ELSE label END AS prediction,
    vec_id % 5 AS fold, 'c' || (vec_id % 3) AS corpus, 'gen' || (vec_id % 7) AS generator FROM embeddings)"""
TOKENS = "token_logprobs AS (SELECT user_id AS sample_id, event_id AS pos, -value / 100 AS logprob FROM events)"


def _re2(pattern: str, flags: str) -> str:
    p = pattern.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")
    return f"(?{flags}-s){p}" if flags else f"(?-s){p}"


def lexical(source: str, name: str, keep: str, exact: bool = False) -> str:
    """CTEs ending in ``name``: the kept columns of ``source`` and the 37 features, rounded unless ``exact``."""
    tokens = {
        "snake_case_count": r"[a-z][a-z0-9]*(?:_[a-z0-9]+)+",
        "camel_case_count": r"[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+",
        "long_ident_count": r"[a-zA-Z_][a-zA-Z0-9_]{15,}",
    }
    early = rf"(?s)^{SPACE}*(return|throw|raise)([^\p{{L}}\p{{N}}_(][^(]*)?$"
    inline = rf"(?s).{SPACE}(#|//)[^{SPACE_IN}\"']*({SPACE}|$)"
    counts = []
    for feature, (pattern, flags) in PATTERNS.items():
        if feature in tokens:
            counts.append(f"len(list_filter(_tokens, lambda t: regexp_full_match(t, {q(tokens[feature])}))) AS {feature}")
        elif feature == "early_return_count":
            counts.append(
                f"len(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, {q(early)}))) AS {feature}")
        else:
            text = "code" if feature == "step_comment_count" else "_folded"
            counts.append(f"len(regexp_extract_all({text}, {q(_re2(pattern, flags))})) AS {feature}")
    def comment(markers):
        return f"len(list_filter(_lines, lambda l: regexp_matches(l, {q('^' + SPACE + '*(' + '|'.join(markers) + ')')})))"
    by_language = " ".join(
        f"WHEN lower(language) = {q(lang)} THEN {comment(m)}" for lang, m in COMMENT_MARKERS.items())
    every = lambda cls: f"len(regexp_extract_all(code, {q(cls)}))"
    ratio = lambda a, b, empty="0.0": f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b}) ELSE {empty}::DOUBLE END"
    derived = {
        "avg_line_length": ratio("list_sum(_lengths)", "line_count"),
        "blank_line_ratio": ratio("line_count - non_blank_line_count", "line_count"),
        "comment_line_ratio": ratio("_comments", "line_count"),
        "inline_comment_ratio": ratio("_inline", "non_blank_line_count"),
        "whitespace_ratio": ratio("_spaces", "char_count"),
        "digit_ratio": ratio("_digits", "char_count"),
        "uppercase_ratio": ratio("_upper", "_alpha"),
        "naming_style_ratio": "snake_case_count::DOUBLE / (snake_case_count + camel_case_count + 1)",
        "error_handling_density": ratio("try_count + except_count", "line_count"),
        "defensive_density": ratio("null_check_count + guard_clause_count + isinstance_count", "line_count"),
        "error_uniformity": "uniform_except_count::DOUBLE / (except_count + 1)",
        "indent_consistency": "CASE WHEN line_count = 0 THEN 0.0::DOUBLE ELSE " + ratio(
            "greatest(_tabs, _blanks)", "_tabs + _blanks", "1.0") + " END",
        "trailing_ws_ratio": ratio("_trailing", "line_count"),
    }
    shown = (lambda e, f: f"{e} AS {f}") if exact else r
    final = [shown(derived[f], f) if f in derived else f"{f}::BIGINT AS {f}" for f in LEXICAL_FEATURES]
    return f"""{name}_split AS (
  SELECT *, regexp_extract_all(code, {q(r'[\p{L}\p{N}_]+')}) AS _tokens,
    regexp_replace(code, {q(r'[^\P{L}\x00-\x7f]|[^\P{N}\x00-\x7f]')}, '_', 'g') AS _folded,
    list_slice(_parts, 1, CASE WHEN _parts[-1] = '' THEN len(_parts) - 1 ELSE len(_parts) END) AS _lines
  FROM (SELECT *, string_split_regex(code, {q(chr(92) + 'r' + chr(92) + 'n|' + BREAK)}) AS _parts FROM {source})),
{name}_raw AS (
  SELECT *, length(code) AS char_count, len(_lines) AS line_count,
    len(list_filter(_lines, lambda l: regexp_matches(l, {q(NOT_SPACE)}))) AS non_blank_line_count,
    list_sort(list_transform(_lines, lambda l: length(l))) AS _lengths,
    CASE {by_language} ELSE {comment(COMMENT_MARKERS_OTHER)} END AS _comments,
    len(list_filter(_lines, lambda l: regexp_matches(l, {q(inline)}))) AS _inline,
    {every(SPACE)} AS _spaces, {every(DIGIT)} AS _digits, {every(chr(92) + 'p{L}')} AS _alpha, {every(UPPER)} AS _upper,
    len(list_filter(_lines, lambda l: l[1] = chr(9))) AS _tabs, len(list_filter(_lines, lambda l: l[1] = ' ')) AS _blanks,
    len(list_filter(_lines, lambda l: regexp_matches(l, {q(SPACE + '$')}))) AS _trailing,
    coalesce(_lengths[-1], 0) AS max_line_length,
    coalesce(_lengths[floor(line_count * 0.9::DOUBLE)::BIGINT + 1], 0) AS p90_line_length,
    {", ".join(counts)}
  FROM {name}_split),
{name} AS (SELECT {keep}, {", ".join(final)} FROM {name}_raw)"""


# Golden syntax features of the templates (all features not named are 0), by doc_id % 12.
GOLDEN_SYNTAX = {
    0: dict(function_count=1, return_count=2, comprehension_count=1, max_nesting_depth=2, avg_function_length=5,
            max_function_length=5, type_annotation_count=1, none_compare_count=1, early_return_count=1,
            default_arg_count=1, guarded_fn_ratio=1, defensive_line_ratio=1 / 5),
    1: dict(function_count=1, import_count=1, return_count=1, try_count=1, has_main_guard=1, max_nesting_depth=2,
            avg_function_length=9, max_function_length=9, fstring_count=1, early_return_count=1, broad_except_count=1,
            finally_count=1, except_per_try=1 / 2, defensive_line_ratio=1 / 9),
    2: {},
    10: {},
    3: dict(function_count=2, class_count=1, return_count=2, docstring_count=1, max_nesting_depth=4,
            avg_function_length=5, max_function_length=7, isinstance_count=1, early_return_count=1,
            default_arg_count=1, guarded_fn_ratio=1 / 2, defensive_line_ratio=1 / 10),
    7: dict(function_count=1, import_count=2, return_count=2, assert_count=1, comprehension_count=1, lambda_count=1,
            max_nesting_depth=2, avg_function_length=7, max_function_length=7, type_annotation_count=1,
            walrus_count=1, global_count=1, none_compare_count=2, early_return_count=1, default_arg_count=1,
            guarded_fn_ratio=1, defensive_line_ratio=2 / 7),
    8: dict(function_count=1, import_count=1, raise_count=1, try_count=1, max_nesting_depth=2, avg_function_length=7,
            max_function_length=7, broad_except_count=1, default_arg_count=1, except_per_try=1,
            defensive_line_ratio=2 / 7),
    9: dict(function_count=1, return_count=1, max_nesting_depth=1, avg_function_length=2, max_function_length=2),
    11: dict(function_count=1, return_count=4, max_nesting_depth=4, avg_function_length=9, max_function_length=9,
             early_return_count=2),
}
SYNTAX_RATIOS = ["ast_avg_function_length", "ast_guarded_fn_ratio", "ast_except_per_try", "ast_defensive_line_ratio"]


def syntax_columns(features: list[str] = SYNTAX_FEATURES) -> str:
    """``parse_ok`` and syntax features of ``code_samples`` rows, as constants per template."""
    out = ["CASE WHEN language = 'Python' THEN doc_id % 12 <> 4 END AS parse_ok"]
    for f in features:
        values = {t: float(v.get(f.removeprefix("ast_"), 0)) for t, v in GOLDEN_SYNTAX.items()}
        if f in SYNTAX_RATIOS:
            out.append(r(_case("doc_id % 12", {t: f"{v!r}::DOUBLE" for t, v in values.items()}, "NULL"), f))
        else:
            out.append(f"{_case('doc_id % 12', {t: int(v) for t, v in values.items()}, 'NULL')}::BIGINT AS {f}")
    return ", ".join(out)


def melt(source: str, name: str, features: list[str], ids: str) -> str:
    typed = ", ".join(f"{f}::DOUBLE AS {f}" for f in features)
    return f"""{name} AS (SELECT * FROM (UNPIVOT (SELECT {ids}, {typed} FROM {source}) ON {', '.join(features)}
    INTO NAME feature VALUE value))"""


def rank_counts(source: str, name: str, keys: str, side: str = "label") -> str:
    """CTEs ending in ``name``: n0, n1, u1, ties per key of a long table with ``value``."""
    return f"""{name}_hist AS (SELECT {keys}, value, count(*) FILTER ({side} = 0) AS n0, count(*) FILTER ({side} = 1) AS n1
    FROM {source} GROUP BY {keys}, value),
{name}_cum AS (SELECT *, coalesce(sum(n0) OVER (PARTITION BY {keys} ORDER BY value
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS below FROM {name}_hist),
{name} AS (SELECT {keys}, sum(n0)::BIGINT AS n0, sum(n1)::BIGINT AS n1, sum(n1 * (below + n0 / 2.0::DOUBLE)) AS u1,
    sum((n0 + n1)::DOUBLE * (n0 + n1) * (n0 + n1) - (n0 + n1)) AS ties FROM {name}_cum GROUP BY {keys})"""


def z_scores(source: str, name: str, keys: str, side: str = "label") -> str:
    counts = rank_counts(source, f"{name}_counts", keys, side)
    return f"""{counts},
{name}_spread AS (SELECT *, n0::DOUBLE * n1 AS pairs, n0 + n1 AS n,
    n0::DOUBLE * n1 / 12 * ((n0 + n1 + 1) - ties / ((n0 + n1)::DOUBLE * (n0 + n1 - 1))) AS var
    FROM {name}_counts WHERE n0 > 0 AND n1 > 0),
{name} AS (SELECT {keys}, n0, n1, pairs - u1 AS u0, u1,
    CASE WHEN var > 0 THEN (greatest(u1, pairs - u1) - pairs / 2 - 0.5) / sqrt(abs(var)) ELSE 0.0::DOUBLE END AS z
    FROM {name}_spread)"""


def wasserstein(source: str, name: str, keys: str, side: str) -> str:
    return f"""{name}_hist AS (SELECT {keys}, value, count(*) FILTER ({side} = 0) AS n0, count(*) FILTER ({side} = 1) AS n1
    FROM {source} GROUP BY {keys}, value),
{name}_gap AS (SELECT {keys}, lead(value) OVER w - value AS gap,
    abs(sum(n0) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n0) OVER (PARTITION BY {keys})
      - sum(n1) OVER (w ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n1) OVER (PARTITION BY {keys})) AS height,
    sum(n0) OVER (PARTITION BY {keys}) AS t0, sum(n1) OVER (PARTITION BY {keys}) AS t1
    FROM {name}_hist WINDOW w AS (PARTITION BY {keys} ORDER BY value)),
{name} AS (SELECT {keys}, coalesce(sum(gap * height), 0) AS distance FROM {name}_gap WHERE t0 > 0 AND t1 > 0
    GROUP BY {keys})"""


def anova(source: str, name: str, features: list[str], label: str = "label") -> str:
    """CTEs ending in ``name`` (feature, f_stat) by the textbook deviations from the means."""
    long = melt(source, f"{name}_long", features, label)
    return f"""{long},
{name}_dev AS (SELECT feature, {label}, value, avg(value) OVER (PARTITION BY feature, {label}) AS m,
    avg(value) OVER (PARTITION BY feature) AS g FROM {name}_long),
{name} AS (SELECT feature, (sum((m - g) * (m - g)) / (count(DISTINCT {label}) - 1))
    / (sum((value - m) * (value - m)) / (count(*) - count(DISTINCT {label}))) AS f_stat FROM {name}_dev GROUP BY feature)"""


def hash_of(column: str) -> str:
    return f"md5('42:' || {column})"
