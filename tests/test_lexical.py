import random

from inkprint.functions.lexical import LEXICAL_FEATURES, lexical_features
from registry.fixtures import code_samples, document_samples
from tests.lexical_oracle import python_lexical

PIECES = [
    "a", "x_y", "camelCase", "maxValueHolderLong", "a_b_c_d", " ", "  ", "\t", "\n", "\n\n", "\r\n", "\r", "\x0b", "\x0c",
    "\x1c", "\x1f", "\x85", "\u2028", "\u00a0", "#", "# ", "//", "// x", "--", "é", "étude_x", "naïveCase", "²", "٣", "ǅ",
    "Ⅷ", "Ⓐ", "e\u0301_x", "try:", "try {", "try :", "except:", "except  Exception:", "catch", "raise", "throw", "return",
    "return None", "return f(x)", "is None", "is not None", " == None", "!= None", "x== null", "isinstance (", "logger.info(",
    "LOG.Debug(", "lOg.ınfo(", "print(", "print (", "if ", "elif ", "not y", "len(", ":", ": ", ": int", "= None)", "=0,",
    "={} ,", '"', "'", '= "" )', "# todo", "#FIXME", "Step 1", "# step 2", "# 12. Foo", "23", "İ", "K", "ſ", "😀", "𐐀",
    "if x is None and y is\nNone:", "_lead_name_long_enough_x", "__init__",
]
ADVERSARIAL = [
    "", "\n", "   \n\t\n", "a\n\n", "no newline", "a\r\nreturn x\rreturn y", "x\x0by\x85z\u2028w", "café_x cafe_x naïve aB éaB",
    "x² ٣ Ⅷ ǅ", "try : except  Exception: except :", "a_" * 5000 + "b", "aB" * 5000, "\n" * 3000 + "return", "if " * 300 + "not x:\n",
    "\x1f#x\n a#b\n a #b\n a # \"q\"\n", "def f(): # note\n\treturn None  \n",
]
LANGUAGES = ["Python", "java", "PHP", "sql", "c++", None]


def check(spark, texts):
    rows = [(i, text, LANGUAGES[i % len(LANGUAGES)]) for i, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "sample_id long, code string, language string").repartition(8)
    for row in lexical_features(df).drop("code").collect():
        expected = python_lexical(texts[row.sample_id], row.language or "")
        wrong = {f: (expected[f], row[f]) for f in LEXICAL_FEATURES if abs(expected[f] - row[f]) > 1e-12}
        assert not wrong, (texts[row.sample_id][:200], wrong)


def test_adversarial_texts(spark):
    check(spark, ADVERSARIAL)


def test_random_texts(spark):
    rng = random.Random(11)
    check(spark, ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(3000)])


def test_guard_clauses_in_long_texts(spark):
    rng = random.Random(5)
    parts = ["if ", "if\n", "elif x", " is", " is ", "None", "not", " not ", " y", "len", "len(", ":", ": ", ":\n", "\n", " \n", "\t\n  ",
             "word ", "a.b(c) ", "== None", "\r", "\u2028", "\x0b", "if x is None:\n", "if not\ny:\n"]
    check(spark, ["".join(rng.choice(parts) for _ in range(rng.randint(300, 900))) for _ in range(400)])


def test_very_long_line_stays_linear(spark):
    text = "if x and not y then " * 20_000 + "\nif a is None:\n"
    row = lexical_features(spark.createDataFrame([(text, "python")], "code string, language string")).first()
    assert row.guard_clause_count == 1 and row.max_line_length == 400_000


def test_given_texts(spark, sf_dir):
    check(spark, [r.code for r in code_samples(spark, sf_dir).select("code").collect()])


def test_empty_is_all_zero(spark):
    row = lexical_features(spark.createDataFrame([("", "python"), (None, "java")], "code string, language string")).collect()
    assert all(r[f] == 0 for r in row for f in LEXICAL_FEATURES)


def test_types_and_ranges(spark, sf_dir):
    df = lexical_features(document_samples(spark, sf_dir))
    for name, kind in df.select(*LEXICAL_FEATURES).dtypes:
        assert kind == ("double" if name.endswith(("ratio", "density", "uniformity", "consistency")) or name == "avg_line_length" else "bigint")
    ratios = [f for f in LEXICAL_FEATURES if f.endswith("_ratio")]
    assert df.where(" or ".join(f"{f} < 0 or {f} > 1" for f in ratios)).count() == 0


def test_plan_is_narrow_and_native(spark, sf_dir, plan):
    text = plan(lexical_features(document_samples(spark, sf_dir)))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string,source:string>" in text
