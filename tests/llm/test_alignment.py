"""Alignment against whole-text encoding, groups and links found from byte ranges, counts in plain Python."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkprint.llm import alignment
from inkprint.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row int, regular string, n_a int"


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


def token_ranges(pair, text):
    """Byte ranges and ids of both sides from encoding the whole text at once, or None."""
    whole = (" " + text).encode()
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    out = []
    for ids, spell in ((a, pair.a_bytes), (b, pair.b_bytes)):
        at, ranges = 0, []
        for i in ids:
            ranges.append((at, at + len(spell[i]), i))
            at += len(spell[i])
        if b"".join(spell[i] for i in ids) != whole:
            return None
        out.append(ranges)
    return out


def brute(pair, rows):
    found, pairs = [], Counter()
    for doc, text in rows:
        both = token_ranges(pair, text) if text else None
        if both is None:
            found.append((doc, None, None, []))
            continue
        a, b = both
        links, j = [], 0
        for s, e, i in a:
            while j and b[j - 1][1] > s:
                j -= 1
            while j < len(b) and b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                links.append((i, b[k][2]))
                k += 1
        pairs.update(links)
        found.append((doc, a, b, links))
    top = Counter()
    for (_, b), n in pairs.items():
        top[b] = max(top[b], n)
    out = []
    for doc, a, b, links in found:
        if a is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        texts, last = [], 0
        for end in ends:
            sides = [",".join(str(i) for s, e, i in side if last <= s and e <= end) for side in (a, b)] if len(a) < 400 else None
            texts.append(sides)
            last = end
        if len(a) >= 400:  # the same in one walk
            texts, ia, ib = [], iter(a), iter(b)
            for end in ends:
                sides = []
                for it in (ia, ib):
                    ids = []
                    for _, e, i in it:
                        ids.append(str(i))
                        if e == end:
                            break
                    sides.append(",".join(ids))
                texts.append(sides)
        digest = hashlib.sha256(";".join("|".join(s) for s in texts).encode()).hexdigest()
        out.append((doc, len(a), len(b), len(ends), len(links), sum(pairs[x] == top[x[1]] for x in links),
                    sum(pairs[x] for x in links), digest))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA).repartition(3)
    got = alignment.align(df, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


ODD = [
    (1, "The quick brown fox\njumps over  the lazy dog."), (2, None), (3, ""), (None, "no id here"), (4, "naïve café ☃ 你好"),
    (5, "spells▁blanks"), (6, " "), (7, "\n\n \n"), (8, "\t tab  nbsp \r\n end "), (9, "<s> <|endoftext|> </s> <unk> <0x41>"),
    (10, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 50), (11, "internationalisation tokenizers"), (11, "internationalisation tokenizers"),
    (12, "é​ x　 y"), (13, "long " * 5000), (14, "\x1c \x1f word"), (15, "line\n next\n\n\tend\r\n\r\n"),
]


def test_against_brute_force(spark, pair):
    assert pair.cuts
    assert run(spark, ODD) == sorted(brute(pair, ODD), key=str)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_given_documents(spark, sf_dir, pair):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in alignment.align(docs, A, B).collect()), key=str)
    assert got == sorted(brute(pair, rows), key=str)


def test_small_cache_changes_nothing(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    plain = lambda x: {**x, "irregular": sorted(zip(x["irregular"], x["irregular_n"])), "irregular_n": None}
    whole = list(map(plain, alignment.Aligner(A, B)(rows).to_pylist()))
    monkeypatch.setattr(alignment, "CACHE_SIZE", 50)
    small = alignment.Aligner(A, B)
    got = [plain(x) for part in alignment._slices(rows, 10) for x in small(part).to_pylist()]
    assert got == whole


def test_quick_encoder_gives_the_same_ids(pair, sf_dir, spark):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text rlike '^[\\\\x00-\\\\x7f]+$'").select("text").collect()]
    assert pair.plain is not None and len(texts) > 20
    for text in [*texts, "I'll don't we've  it's 'sx 12ab_c\t\t x\x0b\x0c y \x1c z"]:
        assert pair.plain(text) == pair.a.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list("ab .,\n\t\r é☃1'") + ["▁", "　", "\x1c", "the", " The", "'s "]), max_size=40).map("".join))
def test_chunks_encode_like_the_whole(text):
    pair = _shared()
    both = token_ranges(pair, text) if text else None
    parts = pair.chunks(text)
    assert "".join(parts) == " " + text
    got = _PAIR[1](([(1, text)])).to_pylist()[0]
    if both is None:
        assert got["n_a"] == got["n_groups"] == 0 and got["groups_sha256"] == ""
    else:
        ids = [[i for _, _, i in side] for side in both]
        found = list(alignment.groups(*ids, pair.a_bytes, pair.b_bytes))
        whole = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b, _ in found)
        assert (got["n_a"], got["n_b"], got["n_groups"]) == (len(ids[0]), len(ids[1]), len(found))
        assert got["n_links"] == sum(len(p) for _, _, p in found)
        assert got["groups_sha256"] == hashlib.sha256(whole.encode()).hexdigest()


_PAIR = []


def _shared():
    if not _PAIR:
        _PAIR.extend([alignment.Pair(A, B), alignment.Aligner(A, B)])
    return _PAIR[0]
