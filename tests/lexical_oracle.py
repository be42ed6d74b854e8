"""Brute-force lexical features on one string with Python's own ``str`` and ``re``, for comparison in tests."""

import re

from inkprint.functions.lexical import COMMENT_MARKERS, COMMENT_MARKERS_OTHER, PATTERNS


def python_lexical(text: str, language: str) -> dict[str, float]:
    lines = text.splitlines()
    n = len(lines)
    hits = {
        name: sum(1 for _ in re.finditer(
            pattern, text, (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0)))
        for name, (pattern, flags) in PATTERNS.items()
    }
    if n == 0:
        from inkprint.functions.lexical import LEXICAL_FEATURES
        return dict.fromkeys(LEXICAL_FEATURES, 0)
    filled = [line for line in lines if line.strip() != ""]
    lengths = sorted(map(len, lines))
    markers = tuple(COMMENT_MARKERS.get(language.lower(), COMMENT_MARKERS_OTHER))
    letters = [ch for ch in text if ch.isalpha()]
    first = [line[:1] for line in lines if line[:1] in (" ", "\t") and line]
    inline = re.compile(r".+\s+(#|//)(?!\S*[\"'])")
    return hits | {
        "char_count": len(text),
        "line_count": n,
        "non_blank_line_count": len(filled),
        "avg_line_length": sum(lengths) / n,
        "max_line_length": lengths[-1],
        "p90_line_length": lengths[int(n * 0.9)],
        "blank_line_ratio": 1 - len(filled) / n,
        "comment_line_ratio": sum(line.lstrip().startswith(markers) for line in lines) / n,
        "inline_comment_ratio": sum(bool(inline.search(x)) for x in filled) / len(filled) if filled else 0,
        "whitespace_ratio": sum(map(str.isspace, text)) / len(text),
        "digit_ratio": sum(map(str.isdigit, text)) / len(text),
        "uppercase_ratio": sum(map(str.isupper, text)) / len(letters) if letters else 0,
        "naming_style_ratio": hits["snake_case_count"]
        / (hits["snake_case_count"] + hits["camel_case_count"] + 1),
        "error_handling_density": (hits["try_count"] + hits["except_count"]) / n,
        "defensive_density": sum(
            hits[k] for k in ("null_check_count", "guard_clause_count", "isinstance_count")) / n,
        "error_uniformity": hits["uniform_except_count"] / (hits["except_count"] + 1),
        "indent_consistency": max(first.count(" "), first.count("\t")) / len(first) if first else 1.0,
        "trailing_ws_ratio": sum(line != line.rstrip() for line in lines) / n,
    }
