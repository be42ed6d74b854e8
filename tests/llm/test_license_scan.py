"""License scanning against plain Python sets."""

import re

from inkprint.llm import license_scan as ls

SCHEMA = "doc_id long, text string, label string, word string, _row int, n_words int"


def words_of(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, templates=ls.TEMPLATES):
    out = []
    for doc, text in rows:
        words = words_of(text)
        base = [(i, label) for phrase, label in ls.PHRASES for i in range(len(words))
                if words[i:i + len(phrase.split())] == phrase.split()]
        labels, share = {x for _, x in base}, 0.0
        for at in range(0, len(words), ls.STEP):
            block = set(words[at:at + ls.WINDOW])
            for label, template in templates:
                want = set(template.split())
                if 100 * len(want & block) >= ls.THRESHOLD * len(want):
                    labels.add(label)
                    share = max(share, len(want & block) / len(want))
        places = [i for i, _ in base]
        out.append((doc, len(words), len(base), min(places, default=None), max(places, default=None),
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), 1.0 if base else share))
    return sorted(out, key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    got = ls.scan(df, **kw)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


FILLER = "the quick brown fox of this world and that one is by no means under a tree "
MIT = ls.TEMPLATES[1][1]
ROWS = [
    (1, None), (2, ""), (3, " \n\t!"), (None, "Released under the MIT License."), (4, "CC-BY-NC cc by nc, CC BY NC! xcc by nc cc by ncs"),
    (5, "under the mit license apache license version 2 under the mit license"), (5, "under the mit license apache license version 2 under the mit license"),
    (6, FILLER * 900 + MIT.replace(" ", "\n * ") + FILLER * 900),  # a very long text, the notice wrapped in comments
    (7, MIT.replace("hereby", "herewith").replace("granted", "given")), (8, "permission is hereby granted"), (9, FILLER * 3),
    (10, "This work is licensed under the GNU General Public License, version 3."), (11, "LİCENSE under the mit lıcense worK Kelvin"),
    (12, "gnu general public license " * 40), (13, "é under the MIT　license ünder 你好"),
] + [(100 + i, FILLER * (i % 3) + "x " * i + MIT + " y" * i) for i in range(0, 70, 9)]


def test_against_brute_force(spark):
    want = brute(ROWS)
    assert sum("mit" in r[6] for r in want) > 9 and any("gpl-3" in r[6] for r in want)
    assert run(spark, ROWS) == want


def test_given_documents(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == brute(rows)


def test_other_templates(spark):
    templates = [("fox", "the quick brown fox of this world"), ("one", "tree")]
    assert run(spark, ROWS, templates=templates) == brute(ROWS, templates)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_prefix_is_as_short_as_the_threshold_allows():
    order = sorted(set(MIT.split()))
    index = ls.prefixes([("mit", MIT)], order, 80)
    n = len(order)
    assert [r[-1] for r in index] == order[:n - -(-80 * n // 100) + 1]


def test_plan_is_native(spark, plan):
    text = plan(ls.scan(spark.createDataFrame(ROWS[:3], "doc_id long, text string")))
    assert "Python" not in text and "Arrow" not in text and "CartesianProduct" not in text
    assert text.count("regexp_replace") == 1
