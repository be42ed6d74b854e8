"""Character classes and a regex dialect shared by the text features.

The feature definitions follow Python's ``str`` and ``re`` on full Unicode. Java's shorthand classes differ from
that (``\\s``, ``\\w``, ``\\b`` are ASCII by default and treat combining marks differently when Unicode-aware), so
patterns are written in Python's dialect and ``java_regex`` spells every shorthand out.
"""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode facts behind str.splitlines, str.isspace, str.isalnum and str.isdigit. Members below U+0100
# are listed one by one (Java tests those with one bit lookup) and rarer ranges sit behind one enclosing range, so
# an ordinary character costs two tests instead of one per range.
LINE_BREAKS = ["\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
BREAK = r"\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028-\u2029"
_WIDE_SPACE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a%s\u202f\u205f\u3000]]"
INLINE_SPACE = r"\t\x1f\x20\xa0" + _WIDE_SPACE % ""
SPACE = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0" + _WIDE_SPACE % r"\u2028\u2029"
SPACE_NOT_LF = r"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0" + _WIDE_SPACE % r"\u2028\u2029"
# The literal U+10400 is itself a letter; a supplementary literal makes Java's lookbehind step by code point.
WORD = "\\p{L}\\p{N}_\U00010400"
DIGIT = (
    r"0123456789\xb2\xb3\xb9[\u0660-\x{10ffff}&&["
    r"\p{Nd}\u1369-\u1371\u19da\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468\u2474-\u247c"
    r"\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}]]"
)

WORD_START = rf"(?<![{WORD}])"
WORD_END = rf"(?![{WORD}])"
BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"


def java_regex(pattern: str, flags: str = "") -> str:
    """Java form of a Python pattern, linear where the Python form would rescan.

    * A ``\\b`` that closes a word becomes a lookahead; one that opens a lower-case name becomes a lookbehind.
    * ``^\\s*`` in multi-line mode may start on any blank line above the match; anchoring it on the match's own
      line selects the same matches without rescanning runs of blank lines.
    * Whitespace runs and repeated groups become possessive: what follows them can never start inside them.
      Repeated groups also stop recursing, so very long names cannot overflow the stack.
    """
    p = re.sub(r"\\b(?=$|\(\?!)", lambda _: WORD_END, pattern)
    p = re.sub(r"^\\b(?=[a-z\[])", lambda _: WORD_START, p)
    p = p.replace(r"\b", BOUNDARY)
    p = p.replace(r"^\s*", f"^[{SPACE_NOT_LF}]*+")
    p = p.replace(r"\s*$", rf"[{SPACE}]*$")
    p = p.replace(r"\s*", rf"[{SPACE}]*+").replace(r"\s+", rf"[{SPACE}]++")
    p = p.replace(r"\S", rf"[^{SPACE}]").replace(r"\d", r"\p{Nd}").replace(r"\w", rf"[{WORD}]")
    p = p.replace(f")+{WORD_END}", f")++{WORD_END}")
    return "(?d" + flags.replace("i", "iu") + ")" + p


def count_matches(text: Column, regex: str, needs_any: list[str] | None = None, fold: bool = False) -> Column:
    """Non-overlapping matches as long. ``needs_any`` are literals without which no match is possible: the
    byte search is far cheaper than the regex scan and most samples lack most constructs."""
    counted = F.regexp_count(text, F.lit(regex)).cast("long")
    if not needs_any:
        return counted
    probe = F.lower(text) if fold else text
    possible = F.contains(probe, F.lit(needs_any[0]))
    for literal in needs_any[1:]:
        possible = possible | F.contains(probe, F.lit(literal))
    return F.when(possible, counted).otherwise(F.lit(0).cast("long"))


def count_chars(text: Column, char_class: str) -> Column:
    """Code points of ``text`` inside a character class. Removing whole runs allocates one string, where
    ``regexp_count`` would allocate one per character."""
    return (F.length(text) - F.length(F.regexp_replace(text, f"[{char_class}]+", ""))).cast("long")


def is_not_blank(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(f"[^{SPACE}]")), F.lit(False))


def strip(text: Column) -> Column:
    """``str.strip()`` on full Unicode whitespace."""
    return F.regexp_replace(text, rf"^[{SPACE}]++|(?<![{SPACE}])[{SPACE}]++\z", "")


def ends_with_break(text: Column) -> Column:
    found = F.endswith(text, F.lit(LINE_BREAKS[0]))
    for char in LINE_BREAKS[1:]:
        found = found | F.endswith(text, F.lit(char))
    return found
