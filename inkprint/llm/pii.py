"""Personal data, and the words that give it away.

Patterns find protected entities (mail and network addresses, card and phone numbers). Corpus co-occurrence then tells
how strongly ordinary words reveal an entity: the pointwise mutual information of word and entity over contexts of
``CONTEXT`` words, as a share of the entity's own information. Words beyond ``DISCLOSURE`` are generalised to a stem
shared by more words if the stem reveals little enough, and removed otherwise. Everything is DataFrame expressions.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import (
    dealt, materialised, merged_spans, rewritten, span_digest_sql, span_text, whole_text, with_matches)

# The patterns of the base kinds.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# The same leftmost matches for the engine: a run is entered at its start (or where the last match ended) and taken
# without backtracking, so that long runs cost linear time and no stack.
ENGINE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
BASE_KINDS = list(PATTERNS)
KINDS = [*BASE_KINDS, "term"]
CONTEXT = 24  # words of one context
LEAST_JOINT = 3  # distinct contexts in which a word must meet an entity before it can reveal it
DISCLOSURE = 0.85  # share of the entity's information from which a word counts as revealing
STEM, STEM_FROM = 4, 6  # letters of a stem; shortest word that has one
FILTER_BITS = 1 << 20  # bits of the filter that words pass before they are counted, whatever the corpus
COPY_BITS = 1 << 23  # bits of the filter that tells contexts without copies, whatever the corpus
WORD = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
REMOVED = "[TERM]"
_TERM = r"^\p{L}{3,}$"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check-digit test."""
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + _luhn_part(
        F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return (n > 0) & (total % 10 == 0)


def _luhn_part(d: Column, doubled: Column) -> Column:
    return F.when(~doubled, d).when(d > 4, 2 * d - 9).otherwise(2 * d)


def valid(kind: str, hit: Column) -> Column:
    """The test a match of a kind's pattern must pass."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: (
            F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _entity(kind: str, hit: Column) -> Column:
    value = F.lower(hit) if kind == "email" else hit if kind == "ip" else _digits(hit)
    return F.concat(F.lit(f"{kind}:"), value)


def term_of(word: Column) -> Column:
    """A word's core: lower case, without punctuation around it; null if it is not of three letters or more."""
    core = F.lower(F.trim(word, F.lit(_PUNCTUATION)))
    return F.when(core.rlike(_TERM), core)


def stem_of(term: Column) -> Column:
    return F.when(F.length(term) >= STEM_FROM, F.concat(F.left(term, F.lit(STEM)), F.lit("*")))


def _text_key() -> list[Column]:
    """What joins rows back to their texts; rows that share it are equal."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("_id"), F.xxhash64(whole_text()).alias("_hash")]


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, _id, _hash and the base kinds as arrays of (start, end, hit)."""
    rows = docs.select("doc_id", "text", *_text_key(), whole_text().alias("_text"))
    has = {"email": F.contains("_text", F.lit("@")), "phone": F.contains("_text", F.lit("+"))}
    rows = with_matches(rows, {k: (ENGINE[k], has.get(k, F.lit(True))) for k in BASE_KINDS})

    def passing(kind: str):
        return lambda s: valid(kind, s["hit"])
    for kind in BASE_KINDS:
        rows = rows.withColumn(kind, F.filter(kind, passing(kind)))
    return rows.drop("_text")


def _contexts(texts: DataFrame) -> DataFrame:
    """words: the words of ``_text`` in runs of ``CONTEXT``, a row each."""
    split = texts.select(F.split("_text", _GAP).alias("_words"))
    n = F.ceil(F.size("_words") / CONTEXT).cast("int")
    return split.select(F.explode(F.transform(
        F.sequence(F.lit(0), n - 1), lambda k: F.slice("_words", k * CONTEXT + 1, CONTEXT))).alias("words"))


def _terms(words: Column) -> Column:
    """Distinct terms of a context."""
    cores = F.transform(words, lambda w: F.lower(F.trim(w, F.lit(_PUNCTUATION))))
    return F.filter(F.array_distinct(cores), lambda c: c.rlike(_TERM))


def _features(words: Column) -> Column:
    """Distinct terms and stems of a context."""
    terms = F.array_distinct(F.array_compact(F.transform(words, term_of)))
    return F.concat(terms, F.array_distinct(F.array_compact(F.transform(terms, stem_of))))


def _entities(text: str) -> Column:
    """Distinct protected entities that lie inside a context, given as text."""
    def one(kind: str) -> Column:
        hits = F.filter(F.regexp_extract_all(text, F.lit(ENGINE[kind]), F.lit(0)), lambda h: valid(kind, h))
        return F.transform(hits, lambda h: _entity(kind, h))
    return F.array_distinct(F.flatten(F.array(*map(one, BASE_KINDS))))


def _filter_of(terms: DataFrame, size: int = FILTER_BITS) -> Column:
    """A one-row table of ``size`` bits, those of the hashes of ``terms`` (term) set. It lets every one of them
    pass, and others by chance only; its size does not depend on the corpus."""
    place = F.pmod(F.xxhash64("term"), F.lit(size))
    filled = terms.select(F.shiftright(place, 6).alias("word"), (place % 64).cast("int").alias("bit")).groupBy("word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    empty = terms.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    whole = filled.select(F.col("word").cast("long"), "bits").unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits")).scalar()


def _passes(term: Column, bits: Column, size: int = FILTER_BITS) -> Column:
    place = F.pmod(F.xxhash64(term), F.lit(size))
    return F.bit_get(F.element_at(bits, F.shiftright(place, 6).cast("int") + 1), (place % 64).cast("int")) == 1


def _with_stems(terms: Column) -> Column:
    return F.concat(terms, F.array_distinct(F.array_compact(F.transform(terms, stem_of))))


def _counted(every: DataFrame, bits: Column, several: Column) -> DataFrame:
    """h, term, n: of contexts (h, words) that pass the filter ``several`` one row each, with all terms in ``term``; of the
    others, with a null h, the number of contexts per term or stem that passes ``bits``."""
    words = every.select("h", _terms(F.col("words")).alias("terms"))
    words = words.select(F.when(_passes(F.col("h"), several, COPY_BITS), F.col("h")).alias("h"), "terms")
    doubtful = F.col("h").isNotNull()
    words = words.select("h", F.explode(F.when(doubtful, F.array(F.array_join("terms", " "))).otherwise(
        _with_stems(F.col("terms")))).alias("term")).where(doubtful | _passes(F.col("term"), bits))
    return words.groupBy("h", "term").agg(F.count("*").alias("n"))


def disclosures(docs: DataFrame) -> DataFrame:
    """The terms and stems that reveal an entity: term, disclosure (the largest share of an entity's information).

    Entities are what the base patterns find inside single contexts. Term, entity, pair and total are all counted by
    presence in distinct contexts: a context counts once however often it is copied, and a term once in it. All counts
    cover all documents; only words that may matter, told by a filter of fixed size, are shuffled."""
    texts = docs.select(whole_text().alias("_text"))
    some = texts.where(F.col("_text").rlike("[0-9@]") & F.col("_text").rlike("|".join(f"(?:{p})" for p in ENGINE.values())))
    contexts = _contexts(some).withColumn("line", F.array_join("words", " "))
    contexts = contexts.where(F.col("line").rlike("[0-9@]")).select("words", "line", _entities("line").alias("entities"))
    contexts = contexts.where(F.size("entities") > 0).groupBy(F.md5("line").alias("h")).agg(
        F.first("entities").alias("entities"), F.first("words").alias("words"))
    contexts = materialised(contexts.select("entities", _features(F.col("words")).alias("terms")))
    entities = contexts.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
    entities = entities.where(F.col("n_entity") >= LEAST_JOINT)
    pairs = contexts.select(F.explode("entities").alias("entity"), "terms").select("entity", F.explode("terms").alias("term"))
    pairs = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= LEAST_JOINT)
    pairs = materialised(dealt(pairs).join(dealt(entities), "entity"))
    bits = _filter_of(pairs.select("term").distinct())
    # Only contexts that may have copies, told by a second filter, are shuffled by their hash, each as one row of its terms:
    # at most one row per context, however full the filter is. The others are distinct as they are and only add to counts.
    every = _contexts(texts).withColumn("h", F.unhex(F.md5(F.array_join("words", " "))))
    copied = every.groupBy("h").agg(F.count("*").alias("n")).select(F.when(F.col("n") > 1, F.col("h")).alias("term"))
    copied = materialised(copied.groupBy("term").agg(F.count("*").alias("n")))  # null: the contexts without copies
    several = _filter_of(copied.where("term IS NOT NULL").select("term"), COPY_BITS)
    counts = _counted(every, bits, several)
    each = F.when(F.col("h").isNotNull(), _with_stems(F.split("term", " "))).otherwise(F.array("term"))
    counts = counts.select(F.when(F.col("h").isNotNull(), 1).otherwise(F.col("n")).alias("n"), F.explode(each).alias("term"))
    counts = counts.where(_passes(F.col("term"), bits)).groupBy("term").agg(F.sum("n").alias("n_term"))
    total = copied.agg(F.sum("n")).scalar()
    information = F.log2(total / F.col("n_entity"))
    shared = F.log2(F.col("n_both") * total / (F.col("n_entity") * F.col("n_term")))
    return pairs.join(dealt(counts), "term").groupBy("term").agg(F.max(F.when(information > 0, shared / information)).alias(
        "disclosure"))


def revealing(docs: DataFrame) -> DataFrame:
    """term, replacement, disclosure of the words to sanitise: replaced by their stem where that stays below
    ``DISCLOSURE``, by ``REMOVED`` otherwise."""
    known = materialised(disclosures(docs))
    high = known.where((F.col("disclosure") >= DISCLOSURE) & ~F.col("term").endswith("*")).withColumn("stem", stem_of(F.col("term")))
    stems = known.select(F.col("term").alias("stem"), F.col("disclosure").alias("stem_disclosure")).where(F.col("stem").endswith("*"))
    safe = F.col("stem").isNotNull() & (F.coalesce("stem_disclosure", F.lit(0.0)) < DISCLOSURE)
    return high.join(stems, "stem", "left").select(
        "term", F.when(safe, F.col("stem")).otherwise(REMOVED).alias("replacement"), "disclosure")


def find(docs: DataFrame) -> DataFrame:
    """Base spans and revealing terms of every whole text: doc_id, text key columns, the base kinds as arrays of
    (start, end, hit), and ``term`` as an array of (start, end, hit: the replacement). Code points, end exclusive.

    A null text is empty and has no spans; rows with a null id are searched like any other; repeated rows give repeated
    results; other columns are ignored. An empty table gives no rows."""
    docs = docs.select("doc_id", "text")
    based = base_spans(docs)
    kept = materialised(based.drop("text"))
    terms = materialised(revealing(docs))
    bits = _filter_of(terms.select("term"))
    suspect = lambda w: _passes(F.lower(F.trim(w, F.lit(_PUNCTUATION))), F.col("_bits"))
    texts = docs.select(*_text_key(), whole_text().alias("_text")).withColumn("_bits", bits)
    texts = texts.where(F.exists(F.split("_text", _GAP), suspect)).drop("_bits")
    words = with_matches(texts, {"word": (WORD, F.lit(True))}).withColumn("_bits", bits)
    lead = lambda w: F.length(w) - F.length(F.ltrim(w, F.lit(_PUNCTUATION)))
    hits = words.select("_id", "_hash", F.explode(F.filter("word", lambda s: suspect(s["hit"]))).alias("s")).select(
        "_id", "_hash", term_of(F.col("s.hit")).alias("term"), (F.col("s.start") + lead(F.col("s.hit"))).alias("start"))
    hits = hits.distinct()  # rows repeated with id and text
    spans = hits.join(dealt(terms), "term").groupBy("_id", "_hash").agg(F.array_sort(F.collect_list(F.struct(
        "start", (F.col("start") + F.length("term")).alias("end"), F.col("replacement").alias("hit")))).alias("term"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    return kept.join(dealt(spans), ["_id", "_hash"], "left").withColumn("term", F.coalesce("term", none))


def digests(found: DataFrame) -> DataFrame:
    """The registered result: counts and digest of the base kinds, and all spans as text."""
    base, every = merged_spans(BASE_KINDS), merged_spans(KINDS)
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(every).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, text with every base match that passes its test replaced by its kind in brackets, kind after kind, and
    every revealing term by its replacement. A null text stays null."""
    terms = materialised(revealing(docs.select("doc_id", "text")))
    return rewritten_texts(docs, terms)


def rewritten_texts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text rewritten by the base kinds and by ``terms`` (term, replacement)."""
    rows = docs.select("doc_id", "text", *_text_key(), whole_text().alias("_text"))
    words = rows.select("_id", "_hash", F.explode(F.array_distinct(F.split("_text", _GAP))).alias("w")).withColumn(
        "term", term_of(F.col("w"))).where("term IS NOT NULL")
    named = words.join(dealt(terms.select("term", "replacement")), "term").groupBy("_id", "_hash").agg(
        F.collect_set(F.struct("term", "replacement")).alias("named"))
    clean = F.col("_text")
    for kind in BASE_KINDS:
        clean = rewritten(clean, ENGINE[kind], _bracketed(kind))
    rows = rows.withColumn("_clean", clean).join(named, ["_id", "_hash"], "left")
    swap = lambda w: F.coalesce(F.replace(w, F.trim(w, F.lit(_PUNCTUATION)), F.try_element_at("_map", term_of(w))), w)
    rows = rows.withColumn("_map", F.map_from_entries("named"))
    text = F.when(F.col("named").isNull(), F.col("_clean")).otherwise(rewritten(F.col("_clean"), WORD, swap))
    return rows.select("doc_id", F.when(F.col("text").isNotNull(), text).alias("text"))


def _bracketed(kind: str):
    return lambda h: F.when(valid(kind, h), F.lit(f"[{kind.upper()}]")).otherwise(h)


_DIGITS_SQL = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN_SQL = (f"list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda i: CASE WHEN (length({_DIGITS_SQL}) - i) % 2 = 0 "
             f"THEN substr({_DIGITS_SQL}, i, 1)::INT WHEN substr({_DIGITS_SQL}, i, 1)::INT > 4 THEN 2 * substr({_DIGITS_SQL}, i, 1)::INT - 9 "
             f"ELSE 2 * substr({_DIGITS_SQL}, i, 1)::INT END)) % 10 = 0")
BASE_ORACLE = span_digest_sql([
    ("email", PATTERNS["email"], "true"),
    ("ip", PATTERNS["ip"], "len(list_filter(string_split(hit, '.'), lambda p: p::HUGEINT > 255)) = 0"),
    ("card", PATTERNS["card"], f"length({_DIGITS_SQL}) BETWEEN 12 AND 19 AND {_LUHN_SQL}"),
    ("phone", PATTERNS["phone"], f"length({_DIGITS_SQL}) BETWEEN 9 AND 15"),
], BASE_KINDS)
