import math
import re
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import duckdb

from inkprint.llm import pii
from inkprint.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, email string, term int, _id int"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute_base(text):
    """kind -> spans, with the plain patterns."""
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text) if passes(k, m.group())] for k, p in pii.PATTERNS.items()}


def core(word):
    w = word.strip(pii._PUNCTUATION).lower()
    return w if len(w) >= 3 and all(c.isalpha() for c in w) else None


def brute_terms(texts):
    """term -> replacement; terms, entities and pairs count by presence in distinct contexts."""
    contexts, n_term = {}, Counter()
    for text in texts:
        words = re.split(r"[\x20\x09-\x0d]+", text)
        for at in range(0, len(words), pii.CONTEXT):
            part = words[at:at + pii.CONTEXT]
            terms = {core(w) for w in part} - {None}
            terms |= {t[:pii.STEM] + "*" for t in terms if len(t) >= pii.STEM_FROM}
            joined = " ".join(part)
            entities = set()
            for k, p in pii.PATTERNS.items():
                for m in re.finditer(p, joined):
                    if passes(k, m.group()):
                        v = m.group()
                        entities.add(f"{k}:" + (v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)))
            contexts[joined] = (entities, terms)
    total = len(contexts)
    for _, terms in contexts.values():
        n_term.update(terms)
    n_entity, n_both = Counter(), Counter()
    for entities, terms in contexts.values():
        n_entity.update(entities)
        n_both.update((e, t) for e in entities for t in terms)
    share = defaultdict(float)
    for (e, t), n in n_both.items():
        if n >= pii.LEAST_JOINT and n_entity[e] < total:
            value = math.log2(n * total / (n_entity[e] * n_term[t])) / math.log2(total / n_entity[e])
            share[t] = max(share[t], value) if t in share else value
    out = {}
    for t, v in share.items():
        if v >= pii.DISCLOSURE and not t.endswith("*"):
            stem = t[:pii.STEM] + "*"
            out[t] = stem if len(t) >= pii.STEM_FROM and share.get(stem, 0.0) < pii.DISCLOSURE else pii.REMOVED
    return out


def brute(rows):
    terms = brute_terms([t or "" for _, t in rows])
    out = []
    for i, text in rows:
        text = text or ""
        base = brute_base(text)
        spans = [(a, n, b, k) for n, k in enumerate(pii.BASE_KINDS) for a, b in base[k]]
        show = lambda s: ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))
        more = []
        for m in re.finditer(r"[^\x20\x09-\x0d]+", text):
            if core(m.group()) in terms:
                lead = len(m.group()) - len(m.group().lstrip(pii._PUNCTUATION))
                more.append((m.start() + lead, 4, m.start() + lead + len(core(m.group())), "term"))
        out.append((i, *[len(base[k]) for k in pii.BASE_KINDS], sha256(show(spans).encode()).hexdigest(), show(spans + more)))
    return sorted(out, key=str), terms


def run(df):
    return sorted((tuple(r) for r in pii.digests(pii.find(df)).collect()), key=str)


ROWS = [
    (1, None), (2, ""), (3, "mail a.b@c.d.e, x@y..z and p@q.r_s@t.u then 1.2.3.4.5.6.7.8 or 300.1.1.1"),
    (4, "card 4111 1111 1111 1111, 4111-1111-1111-1112 phone +49 (30) 123456 and +1 23"),
    (5, "a" * 20_000 + "@"), (6, "1" * 20_000), (7, "a@b" + ".c" * 9_000), (8, "1 " * 9_000), (9, "é@x.yz 🙂 ü.w@ß.de"),
    (10, "tie a@b.cd"), (10, "tie a@b.cd"), (None, "no id 10.0.0.1 and 010.000.0.255"),
    *[(20 + i, f"note {i} the gardener Zimbelkraut, writes from boss@corp.example about the weather again {'pad ' * i}") for i in range(6)],
    *[(40 + i, f"the weather is fine about town again today number {i} and the note says so " * 3) for i in range(40)],
    *[(90 + i, f"zimbelstern plays tune {i} in the old church by the river " * 4) for i in range(12)],
]


def test_against_brute_force(spark):
    want, terms = brute(ROWS)
    assert "zimbelkraut" in terms and "weather" not in terms
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ROWS], SCHEMA).repartition(3)
    assert run(df) == want
    assert run(df.where("doc_id = 999")) == []


def test_sanitised_text(spark):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ROWS], SCHEMA)
    got = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert got[1] is None and got[2] == ""
    assert got[4] == "card [CARD], 4111-1111-1111-1112 phone [PHONE] and +1 23"
    assert "boss@" not in got[20] and "Zimbelkraut" not in got[20] and got[20].startswith("note 0 the")
    assert got[40] == ROWS[18][1]


def test_base_spans_equal_sql(spark, sf_dir):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("documents.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    got = sorted(tuple(r) for r in QUERIES["op6_pii"](spark, sf_dir).select(*names).collect())
    assert got == sorted(db.sql(f"SELECT {', '.join(names)} FROM ({pii.BASE_ORACLE})").fetchall())


def test_copies_and_repeats_do_not_hide_a_revealing_word(spark):
    beside = [f"note {i} quillwort quillwort quillwort from boss@corp.example here" for i in range(3)]
    texts = beside * 50 + [f"plain words about the town number {i}" for i in range(2_000)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], SCHEMA)
    got = {r.term: r.disclosure for r in pii.disclosures(df).collect()}
    assert math.isclose(got["quillwort"], 1.0)
    assert math.isclose(got["quil*"], 1.0)


def test_a_copied_context_is_shuffled_as_one_row(spark):
    names = [chr(97 + i) for i in range(20)]
    lines = [" ".join(f"garden{a}{b}" for b in names) for a in names]
    every = spark.createDataFrame([(line.encode(), line.split()) for line in lines * 3 + ["some single line"]], "h binary, words array<string>")
    copied = spark.createDataFrame([(line.encode(),) for line in lines], "term binary")
    some = spark.createDataFrame([("gardenaa",), ("single",)], "term string")
    got = pii._counted(every, pii._filter_of(some), pii._filter_of(copied, pii.COPY_BITS)).collect()
    assert sorted((bytes(r.h), r.term, r.n) for r in got if r.h is not None) == sorted((x.encode(), x, 3) for x in lines)
    assert ("single", 1) in {(r.term, r.n) for r in got if r.h is None}
