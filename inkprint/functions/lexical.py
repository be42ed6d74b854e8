"""The 37 lexical style features as native column expressions: no shuffle, no Python worker, no per-line rows.

Line-level counts are taken from the whole text with patterns anchored on line starts, so only the line lengths
are ever held as an array.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.functions.text import (
    BREAK,
    DIGIT,
    INLINE_SPACE,
    SPACE,
    SPACE_NOT_LF,
    count_chars,
    count_matches,
    ends_with_break,
    java_regex,
)

# Feature names, in matrix order.
LEXICAL_FEATURES = [
    "char_count", "line_count", "non_blank_line_count",
    "avg_line_length", "max_line_length", "p90_line_length",
    "blank_line_ratio", "comment_line_ratio", "inline_comment_ratio",
    "whitespace_ratio", "digit_ratio", "uppercase_ratio",
    "todo_count", "step_comment_count",
    "snake_case_count", "camel_case_count", "long_ident_count", "naming_style_ratio",
    "type_annotation_count",
    "try_count", "except_count", "raise_count", "error_handling_density",
    "null_check_count", "none_return_count", "isinstance_count", "logging_count", "print_guard_count",
    "early_return_count", "guard_clause_count", "uniform_except_count", "bare_except_count",
    "default_param_count", "defensive_density", "error_uniformity",
    "indent_consistency", "trailing_ws_ratio",
]

# One counting pattern per feature, in Python's dialect; flags are i(gnore case), m(ultiline).
PATTERNS = {
    "todo_count": (r"#\s*(TODO|FIXME|HACK|XXX|NOTE)\b", "i"),
    "step_comment_count": (r"#\s*(Step\s+\d|[Ss]tep\s+\d|\d+\.\s+[A-Z])", "i"),
    "snake_case_count": (r"\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\b", ""),
    "camel_case_count": (r"\b[a-z][a-z0-9]*(?:[A-Z][a-z0-9]+)+\b", ""),
    "long_ident_count": (r"\b[a-zA-Z_][a-zA-Z0-9_]{15,}\b", ""),
    "type_annotation_count": (r":\s*(int|str|float|bool|list|dict|tuple|set|Optional|Union|Any|None)\b", ""),
    "try_count": (r"\btry\s*[:{]", ""),
    "except_count": (r"\b(except|catch)\b", ""),
    "raise_count": (r"\b(raise|throw)\b", ""),
    "null_check_count": (
        r"\b(is\s+None|is\s+not\s+None|!= None|== None|== null|!= null|=== null|!== null)\b", ""),
    "none_return_count": (r"\breturn\s+None\b", ""),
    "isinstance_count": (r"\bisinstance\s*\(", ""),
    "logging_count": (r"\b(logging\.|logger\.|log\.)(debug|info|warning|error|critical)\s*\(", "i"),
    "print_guard_count": (r"^\s*print\s*\(", "m"),
    "early_return_count": (r"^\s*(return|throw|raise)\b(?!.*\()", "m"),
    "guard_clause_count": (
        r"if\s+.*(is\s+(None|not\s+None)|not\s+\w+|len\s*\(|== None|!= None).*:\s*$", "m"),
    "uniform_except_count": (r"\bexcept\s+Exception\b", ""),
    "bare_except_count": (r"\bexcept\s*:", ""),
    "default_param_count": (r"=\s*(None|0|False|True|\[\]|\{\}|\"\")\s*[,)]", ""),
}

# Markers that open a full-line comment, by lower-case language, and for any other language.
COMMENT_MARKERS = {
    "python": ["#"], "javascript": ["//"], "java": ["//"], "c++": ["//"], "go": ["//"],
    "php": ["//", "#"], "c#": ["//"], "c": ["//"],
}
COMMENT_MARKERS_OTHER = ["//", "#", "--"]

# Literals at least one of which every match of a pattern contains.
_NEEDS = {
    "todo_count": ["#"],
    "step_comment_count": ["#"],
    "snake_case_count": ["_"],
    "type_annotation_count": [":"],
    "try_count": ["try"],
    "except_count": ["except", "catch"],
    "raise_count": ["raise", "throw"],
    "null_check_count": ["None", "null"],
    "none_return_count": ["None"],
    "isinstance_count": ["isinstance"],
    "logging_count": ["log"],
    "print_guard_count": ["print"],
    "early_return_count": ["return", "throw", "raise"],
    "guard_clause_count": ["None", "not", "len"],
    "uniform_except_count": ["Exception"],
    "bare_except_count": ["except"],
    "default_param_count": ["="],
}

# Patterns that cannot tell a run of lower-case letters from a single one.
SHAPE_PATTERNS = {"snake_case_count", "camel_case_count"}

_LINE_START = rf"(?:^|[{BREAK}])"
_IN_LINE = rf"[^{BREAK}]"


def _without_idle_lines(text: Column) -> Column:
    """Long texts with every line cut to "x" that no guard clause can touch. A clause ends on a line closed by a colon,
    and can only pass from one line to the next where the line ends in one of its words or is blank. Each "if" scans to the end
    of its line, so cutting the other lines keeps very long ones (minified code, prose) from costing their square."""
    filled = rf"(?=[{SPACE_NOT_LF}]*+[^\n])"
    idle = rf"(?dm)^{filled}(?![^\n]*(?::|if|is|not|len)[{SPACE_NOT_LF}]*+$)[^\n]{{2,}}$"
    return F.when(F.length(text) > 1000, F.regexp_replace(text, idle, "x")).otherwise(text)


def _pattern_count(code: Column, name: str) -> Column:
    pattern, flags = PATTERNS[name]
    if name == "guard_clause_count":
        counted = count_matches(_without_idle_lines(code), java_regex(pattern, flags), _NEEDS[name])
        closes = F.regexp_like(code, F.lit(rf"(?dm):[{SPACE_NOT_LF}]*+$"))
        return F.when(closes, counted).otherwise(F.lit(0).cast("long"))
    return count_matches(code, java_regex(pattern, flags), _NEEDS.get(name), fold="i" in flags)


def _comment_lines(code: Column, language: Column) -> Column:
    def starting_with(markers: list[str]) -> Column:
        alternatives = "|".join(markers)
        return count_matches(code, rf"{_LINE_START}[{INLINE_SPACE}]*+(?:{alternatives})", markers)

    lowered = F.coalesce(F.lower(language), F.lit(""))
    hash_only, slashes, both = ["#"], ["//"], ["//", "#"]
    of = lambda markers: [name for name, known in COMMENT_MARKERS.items() if known == markers]
    return (
        F.when(lowered.isin(of(hash_only)), starting_with(hash_only))
        .when(lowered.isin(of(slashes)), starting_with(slashes))
        .when(lowered.isin(of(both)), starting_with(both))
        .otherwise(starting_with(COMMENT_MARKERS_OTHER))
    )


def _inline_comment_lines(code: Column) -> Column:
    # One match per line: some character, a blank, then a marker whose word holds no quote; then the line's rest.
    regex = (
        rf"{_LINE_START}{_IN_LINE}{_IN_LINE}*?[{INLINE_SPACE}](?:#|//)"
        rf"(?![^{SPACE}]*[\"']){_IN_LINE}*+"
    )
    return count_matches(code, regex, ["#", "//"])


def _ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty))


def lexical_features(df: DataFrame, code: str = "code", language: str = "language") -> DataFrame:
    """Append the 37 lexical features. Empty text gives zeros throughout.

    Every regex pass costs the length of its input. ``_shape`` is the text with each run of ASCII lower-case letters
    cut to one "x", usually a third of it. Blanks, digits, capitals, line breaks, comment markers and the shapes of
    snake_case and camelCase names are the same in both, so those passes read the short form.
    """
    kept = [F.col(f"`{c}`") for c in df.columns]
    text = F.coalesce(F.col(f"`{code}`"), F.lit(""))
    shape = F.col("_shape")
    lengths = F.sort_array(F.transform(F.split(text, rf"\r\n|[{BREAK}]", -1), lambda line: F.length(line)))

    raw = df.select(
        *kept,
        lengths.alias("_lengths"),
        F.regexp_replace(text, "[a-z]{2,}", "x").alias("_shape"),
        F.when(F.length(text) == 0, 1).when(ends_with_break(text), 1).otherwise(0).alias("_unused"),
    )
    counts = {name: _pattern_count(shape if name in SHAPE_PATTERNS else text, name) for name in PATTERNS}
    raw = raw.select(
        *kept,
        (F.size("_lengths") - F.col("_unused")).cast("long").alias("line_count"),
        F.element_at("_lengths", -1).cast("long").alias("max_line_length"),
        F.element_at(
            "_lengths",
            F.least(
                F.col("_unused") + F.floor((F.size("_lengths") - F.col("_unused")) * F.lit(0.9)).cast("int") + 1,
                F.size("_lengths"),
            ),
        ).cast("long").alias("p90_line_length"),
        F.length(text).cast("long").alias("char_count"),
        (F.length(text) - count_chars(shape, BREAK)).alias("_line_chars"),
        count_matches(shape, rf"[^{SPACE}]{_IN_LINE}*+").alias("non_blank_line_count"),
        _comment_lines(shape, F.col(f"`{language}`")).alias("_comment_lines"),
        _inline_comment_lines(shape).alias("_inline_comments"),
        count_chars(shape, SPACE).alias("_spaces"),
        count_chars(shape, DIGIT).alias("_digits"),
        (F.length(text) - F.length(shape) + F.length(F.regexp_replace(shape, r"\P{L}+", ""))).cast("long").alias("_alpha"),
        count_chars(shape, r"\p{IsUppercase}").alias("_upper"),
        count_matches(shape, rf"{_LINE_START}\t", ["\t"]).alias("_tab_lines"),
        count_matches(shape, rf"{_LINE_START} ", [" "]).alias("_space_lines"),
        count_matches(shape, rf"[{INLINE_SPACE}](?!{_IN_LINE})").alias("_trailing"),
        *[expr.alias(name) for name, expr in counts.items()],
    )
    c = F.col
    lines = c("line_count")
    derived = {
        "avg_line_length": _ratio(c("_line_chars"), lines),
        "blank_line_ratio": _ratio(lines - c("non_blank_line_count"), lines),
        "comment_line_ratio": _ratio(c("_comment_lines"), lines),
        "inline_comment_ratio": _ratio(c("_inline_comments"), c("non_blank_line_count")),
        "whitespace_ratio": _ratio(c("_spaces"), c("char_count")),
        "digit_ratio": _ratio(c("_digits"), c("char_count")),
        "uppercase_ratio": _ratio(c("_upper"), c("_alpha")),
        "naming_style_ratio": c("snake_case_count").cast("double")
        / (c("snake_case_count") + c("camel_case_count") + 1),
        "error_handling_density": _ratio(c("try_count") + c("except_count"), lines),
        "defensive_density": _ratio(
            c("null_check_count") + c("guard_clause_count") + c("isinstance_count"), lines),
        "error_uniformity": c("uniform_except_count").cast("double") / (c("except_count") + 1),
        "indent_consistency": F.when(lines == 0, F.lit(0.0)).otherwise(
            _ratio(F.greatest("_tab_lines", "_space_lines"), c("_tab_lines") + c("_space_lines"), 1.0)),
        "trailing_ws_ratio": _ratio(c("_trailing"), lines),
    }
    return raw.select(*kept, *[derived.get(f, c(f)).alias(f) for f in LEXICAL_FEATURES])
