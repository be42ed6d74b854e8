"""Secret scanning over a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that each of its matches must contain. An
inverted index of the trigrams those queries mention is built per block of documents; its postings are intersected and
united per rule, and only the candidate documents are verified with the expression itself. A rule whose expression has
no mandatory trigram scans every text. Everything is DataFrame expressions.
"""

from re import _constants as rc
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import merged_spans, rewritten, span_digest_sql, span_text, whole_text, with_matches

# The rules as (kind, expression, shortest length of what the expression's last group, or all of it, matches).
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]+", 16),
    ("hex", r"[0-9a-f]+", 32),
]
EXTRA = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0),
    ("stripe", r"sk_live_[A-Za-z0-9]{16,}", 0),
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0),
]
RULES = BASE + EXTRA
KINDS = [kind for kind, _, _ in RULES]
BASE_KINDS = [kind for kind, _, _ in BASE]
# The same matches for the engine: a run of the class is always taken whole, so asking for its length up front is equal
# to matching and dropping the short ones, and short runs need no list.
ENGINE = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
BLOCK_ROWS = 1024  # documents per block of the index: bounds every postings list

Dnf = frozenset  # of frozensets of trigrams: one of the sets must be present as a whole
TRUE: Dnf = frozenset({frozenset()})
_LIMIT = 64


def _absorb(terms) -> Dnf:
    terms = set(terms)
    return frozenset(t for t in terms if not any(o < t for o in terms))


def _both(a: Dnf, b: Dnf) -> Dnf:
    joined = _absorb(x | y for x in a for y in b)
    return joined if len(joined) <= _LIMIT else (a if a != TRUE else b)


def _grams(strings) -> Dnf:
    return _absorb(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _chars(items) -> set[str] | None:
    found: set[str] = set()
    for op, arg in items:
        if op is rc.LITERAL:
            found.add(chr(arg).lower())
        elif op is rc.RANGE and arg[1] - arg[0] < 8:
            found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _node(op, arg) -> tuple[set[str] | None, Dnf]:
    """The few strings a node can match (None: too many), and what every match must contain."""
    if op is rc.LITERAL:
        return {chr(arg).lower()}, TRUE
    if op is rc.AT:
        return {""}, TRUE
    if op is rc.IN:
        return _chars(arg), TRUE
    if op is rc.SUBPATTERN:
        return _sequence(arg[-1])
    if op is rc.BRANCH:
        sides = [_sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in sides):
            return set().union(*[e for e, _ in sides]), TRUE
        needs = _absorb(t for e, q in sides for t in (q if e is None else _grams(e)))
        return None, needs if len(needs) <= _LIMIT else TRUE
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, inner = arg
        exact, need = _sequence(inner)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, TRUE
        if low == 0:
            return None, TRUE
        return None, need if exact is None else _grams(exact)
    return None, TRUE


def _sequence(nodes) -> tuple[set[str] | None, Dnf]:
    exact: set[str] = {""}
    need, whole = TRUE, True
    for op, arg in nodes:
        strings, inner = _node(op, arg)
        if strings is not None and len(exact) * len(strings) <= _LIMIT:
            exact = {a + b for a in exact for b in strings}
            continue
        need, whole = _both(_both(need, _grams(exact)), inner), False
        exact = {""} if strings is None else strings
    return (exact, TRUE) if whole else (None, _both(need, _grams(exact)))


def trigram_query(pattern: str) -> Dnf:
    """The trigrams (of lower-cased text) that every match of ``pattern`` contains, as an OR of ANDs. ``TRUE`` (one empty
    set) means that nothing is mandatory. It never excludes a text that matches."""
    exact, need = _sequence(_parser.parse(pattern))
    return need if exact is None else _grams(exact)


def doc_key(text: Column) -> Column:
    """The key that joins candidates to documents: the id, or for a null id a hash of the text. Rows that share a key
    only share candidates, which are verified one by one."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text))


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index of ``docs`` (doc_id, text): block, trigram (its place in ``trigrams``), postings (keys of the
    block's documents that contain it, in lower case). A block holds consecutive rows of one input partition, at most
    ``BLOCK_ROWS``, so no postings list grows with the corpus."""
    low = docs.select(
        doc_key(whole_text()).alias("key"), F.lower(whole_text()).alias("low"),
        (F.shiftright(F.monotonically_increasing_id(), BLOCK_ROWS.bit_length() - 1)).alias("block"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    rows = low.select("block", "key", F.explode(present).alias("trigram"))
    return rows.groupBy("block", "trigram").agg(F.collect_list("key").alias("postings"))


def candidates(index: DataFrame, trigrams: list[str], queries: dict[int, Dnf]) -> DataFrame:
    """Evaluate Boolean trigram queries on the index: key, mask (bit n: the document is a candidate of query n)."""
    place = {t: i for i, t in enumerate(trigrams)}
    none = F.array().cast("array<bigint>")
    lists = lambda t: F.coalesce(F.try_element_at("lists", F.lit(place[t])), none)

    def evaluate(query: Dnf) -> Column:
        union = none
        for term in sorted(query, key=sorted):
            both, *rest = [lists(t) for t in sorted(term)]
            for other in rest:
                both = F.array_intersect(both, other)
            union = F.array_union(union, both)
        return union

    blocks = index.groupBy("block").agg(
        F.map_from_entries(F.collect_list(F.struct("trigram", "postings"))).alias("lists"))
    hits = blocks.select(F.explode(F.array(*[
        F.struct(F.lit(1 << n).cast("long").alias("bit"), evaluate(q).alias("keys")) for n, q in queries.items()])).alias("c"))
    return hits.select(F.col("c.bit").alias("bit"), F.explode("c.keys").alias("key")).groupBy("key").agg(
        F.bit_or("bit").alias("mask"))


def _long_enough(pattern: str, least: int):
    return lambda s: F.length(F.regexp_extract(s["hit"], pattern, 2)) >= least


def _scan(docs: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """The input row as a struct ``_row``, and the matches per kind."""
    queries = {n: trigram_query(pattern) for n, (_, pattern, _) in enumerate(rules)}
    indexed = {n: q for n, q in queries.items() if q != TRUE}
    trigrams = sorted({t for q in indexed.values() for term in q for t in term})
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       whole_text().alias("_text"), doc_key(whole_text()).alias("_key"))
    if indexed:
        found = candidates(trigram_index(docs, trigrams), trigrams, indexed).select(
            F.col("key").alias("_found"), F.col("mask").alias("_mask"))
        rows = rows.join(found.hint("shuffle_hash"), F.col("_key") == F.col("_found"), "left")
    wanted = lambda n: F.col("_mask").bitwiseAND(1 << n) != 0 if n in indexed else F.lit(True)
    rows = with_matches(rows, {
        kind: (ENGINE.get(kind, pattern), wanted(n)) for n, (kind, pattern, _) in enumerate(rules)})
    for kind, pattern, least in rules:
        if least and kind not in ENGINE:
            rows = rows.withColumn(kind, F.filter(kind, _long_enough(pattern, least)))
    return rows


def scan(docs: DataFrame, rules: list[tuple[str, str, int]] = RULES) -> DataFrame:
    """Find the rules' matches in every whole text: one row per input row with doc_id, text and, per kind, an array of
    (start, end, hit), code points, end exclusive.

    A null text is empty and has no match; a row with a null id is scanned like any other; repeated rows give repeated
    results; other columns are ignored, whatever their names. An empty table gives no rows."""
    kinds = [kind for kind, _, _ in rules]
    return _scan(docs.select("doc_id", "text"), rules).select("_row.doc_id", "_row.text", *kinds)


def _value_masked(pattern: str, least: int, mask: str):
    def put(hit: Column) -> Column:
        value = F.regexp_extract(hit, pattern, 2)
        kept = F.substring(hit, F.lit(1), F.length(hit) - F.length(value))
        return F.when(F.length(value) >= least, F.concat(kept, F.lit(mask))).otherwise(hit)
    return put


def masked(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask`` (of an assignment only its value), kind after kind as
    listed, and ``n_chars`` recounted where something was replaced. All other columns and all rows stay as they are; a
    null text stays null. Texts without a secret are not touched."""
    found = _scan(docs, RULES)
    text = F.col("_text")
    for kind, pattern, least in RULES:
        if kind == "assign":
            text = rewritten(text, pattern, _value_masked(pattern, least, mask))
        else:
            text = F.regexp_replace(text, ENGINE.get(kind, pattern), F.lit(mask))
    found = found.withColumn("_clean", F.when(F.size(F.concat(*[F.col(k)["start"] for k in KINDS])) > 0, text))
    new = {"text": F.coalesce("_clean", "_row.text"),
           "n_chars": F.coalesce(F.length("_clean").cast("long"), "_row.n_chars")}
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def digests(found: DataFrame) -> DataFrame:
    """The registered result: counts and digest of the base kinds, and all spans as text."""
    base, every = merged_spans(BASE_KINDS), merged_spans(KINDS)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(every).alias("spans"))


ORACLE = span_digest_sql(
    [(k, p, f"length(regexp_extract(hit, '{p.replace(chr(39), chr(39) * 2)}', 2)) >= {n}" if k == "assign"
      else f"length(hit) >= {n}") for k, p, n in RULES], BASE_KINDS)
