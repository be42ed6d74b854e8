"""License scanning by an exact set-similarity join of text blocks with license templates.

A block is a window of ``WINDOW`` words; one begins every ``STEP`` words, so any passage of up to ``STEP`` words lies
whole in some block. A template's words and a block's words are sets in one order, that of how many documents of the
corpus hold the word, rarest first. A block contains a template if it holds at least ``THRESHOLD`` of its words. Pairs
are found by their prefixes: where a block holds the a words that a template needs, a word among the template's first
|T| - a + 1 stands among the block's first |B| - a + 1 (words outside all templates are left out of B, as they never
match). Pairs meeting in a word are dropped if the block is too short or too few words follow on either side, and the
others are verified on the full sets. Everything is DataFrame expressions; the templates are the only thing broadcast.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkprint.llm.common import whole_text

WINDOW, STEP = 64, 32  # words
THRESHOLD = 80  # per cent of a template's distinct words that a block must hold

# The phrases whose exact places are the base result.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# Notices of public licenses, each of at most STEP words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                 "http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by "
            "the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
             "published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-2", "are made available under the terms of the eclipse public license 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to "
            "this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_words(docs: DataFrame) -> DataFrame:
    """Add ``_joined`` (the words of the whole text, one blank between) and ``_words``. A-Z is lower-cased; a word is a run
    of digits, letters a-z and characters beyond ASCII. The one other character whose lower case is in a-z, the Kelvin
    sign, is set aside first."""
    low = F.lower(F.replace(whole_text(), F.lit("K"), F.lit("é")))
    joined = F.trim(F.regexp_replace(low, _GAPS, " "))
    return docs.withColumn("_joined", joined).withColumn("_words", F.when(
        F.col("_joined") != "", F.split("_joined", " ")).otherwise(F.array().cast("array<string>")))


def _places(phrase: str) -> Column:
    """Positions in ``_words`` where the phrase's words stand consecutively; only texts that hold it are walked."""
    words = phrase.split()
    walk = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: reduce(
        and_, [F.get("_words", i + n) == w for n, w in enumerate(words)]))
    return F.when(F.contains("_joined", F.lit(phrase)), walk).otherwise(F.array().cast("array<int>"))


def ordered_vocabulary(docs: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words, those that the fewest texts of ``docs`` hold first, ties by the word. Collected: as many rows
    as the templates have words."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    held = F.array_intersect(_strings(vocabulary), F.col("_words"))
    counts = with_words(docs.select("text")).select(F.explode(held).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def prefixes(templates: list[tuple[str, str]], order: list[str], threshold: int) -> list[tuple]:
    """(label, words in order, size, words needed, place, word): each template once per word of its prefix."""
    place = {w: i for i, w in enumerate(order)}
    rows = []
    for label, text in templates:
        words = sorted(set(text.split()), key=place.__getitem__)
        need = -(-threshold * len(words) // 100)
        rows += [(label, words, len(words), need, i, w) for i, w in enumerate(words[:len(words) - need + 1])]
    return rows


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base (places of the base phrases), first_word, last_word (smallest and largest start of a place,
    in words; null without one), base_labels, labels (base labels and labels of the templates contained in a block; both
    distinct, sorted, comma-joined), score (1 with a base label, else the largest share of a contained template's words
    that a block holds, 0 without one).

    A null text is empty: no words, no labels. Rows with a null id and repeated rows give rows like any other; other
    columns are ignored, whatever their names. Of a very long text every word is in a block. An empty table gives no
    rows."""
    docs = docs.select("doc_id", "text")
    order = ordered_vocabulary(docs, templates)
    index = prefixes(templates, order, threshold)
    rare, least = sorted({r[-1] for r in index}), min(r[3] for r in index)

    rows = with_words(docs.withColumn("_row", F.monotonically_increasing_id()))
    starts = F.sequence(F.lit(0), F.size("_words") - 1, F.lit(STEP))
    blocks = F.transform(starts, lambda s: F.array_intersect(_strings(order), F.slice("_words", s + 1, WINDOW)))
    found = F.when(F.arrays_overlap("_words", _strings(rare)), F.filter(blocks, lambda b: F.size(b) >= least))
    rows = rows.select(
        "_row", "doc_id", F.size("_words").cast("long").alias("n_words"),
        *[_places(phrase).alias(f"_places_{i}") for i, (phrase, _) in enumerate(PHRASES)], found.alias("_blocks"))

    # a block once per word of some template's prefix, with the word's place in the block
    meets = F.flatten(F.transform("_blocks", lambda b: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(b) - least), lambda j: F.get(b, j).isin(rare)),
        lambda j: F.struct(b.alias("block"), j.alias("place"), F.get(b, j).alias("word")))))
    places = [F.col(f"_places_{i}") for i in range(len(PHRASES))]
    every = F.concat(*places)
    base = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, (_, label) in zip(places, PHRASES)]))
    rows = rows.select(
        "_row", "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        base.alias("_base"), F.explode_outer(meets).alias("_meet"))
    held = docs.sparkSession.createDataFrame(
        index, "label string, t_words array<string>, t_size int, need int, t_place int, word string")

    # length filter, then positional filter on both sides: what can still match after this word reaches the need
    able = (F.col("_meet.word") == F.col("word")) & (F.size("_meet.block") >= F.col("need")) & (
        F.least(F.col("t_size") - F.col("t_place"), F.size("_meet.block") - F.col("_meet.place")) >= F.col("need"))
    shared = F.size(F.array_intersect("t_words", "_meet.block"))
    pairs = rows.join(F.broadcast(held), able, "left").withColumn("_shared", shared)
    hit = F.col("_shared") >= F.col("need")
    first = ["doc_id", "n_words", "n_base", "first_word", "last_word", "_base"]
    found = pairs.groupBy("_row").agg(
        *[F.first(c).alias(c) for c in first], F.collect_set(F.when(hit, F.col("label"))).alias("_labels"),
        F.max(F.when(hit, F.col("_shared") / F.col("t_size"))).alias("_share"))
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        *first[:-1], joined(F.col("_base")).alias("base_labels"), joined(F.concat("_base", "_labels")).alias("labels"),
        F.when(F.size("_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _oracle() -> str:
    phrases = ", ".join(f"({_list(p.split())}, '{label}')" for p, label in PHRASES)
    templates = ", ".join(f"({_list(sorted(set(t.split())))}, '{label}')" for label, t in TEMPLATES)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
      phrases(words, label) AS (VALUES {phrases}), templates(words, label) AS (VALUES {templates}),
      base AS (SELECT doc_id, label, start FROM (
          SELECT doc_id, words, unnest(range(0, len(words))) AS start FROM w) w JOIN phrases p
        ON w.words[start + 1:start + len(p.words)] = p.words),
      blocks AS (SELECT doc_id, words[start + 1:start + {WINDOW}] AS block FROM (
          SELECT doc_id, words, unnest(range(0, len(words), {STEP})) AS start FROM w)),
      near AS (SELECT doc_id, label, len(list_intersect(t.words, block)) AS shared, len(t.words) AS size FROM blocks, templates t
        WHERE 100 * len(list_intersect(t.words, block)) >= {THRESHOLD} * len(t.words)),
      b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
          string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
      s AS (SELECT doc_id, max(shared / size) AS share FROM near GROUP BY doc_id),
      l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (
          SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM near) GROUP BY doc_id)
      SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
        last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
      FROM w LEFT JOIN b USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN l USING (doc_id)"""


ORACLE = _oracle()
