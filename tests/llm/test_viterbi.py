import tempfile
import zlib
from array import array

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from inkprint.llm import viterbi
from inkprint.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "", " ", "Hello world", "  two  spaces  ", "line\nend\n\n", "a▁b ▁▁", "東京 🙂🙂 é é", "x" * 400, "tab\tand\r\n", "▁",
    "Thnt blering onthe 192.168.0.1 token = 'AKIA1234'", "\n", "aaaa " * 100, "ﬁn �",
]


@pytest.fixture(scope="module")
def encoder():
    return viterbi.Encoder(PATH)


def best_path(v, text):
    """Plain Viterbi over the whole text, all scores kept."""
    score, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        single = False
        for j in range(i + 1, min(len(text), i + v.longest) + 1):
            n = v.ids.get(text[i:j])
            if n is not None:
                single |= j == i + 1
                if score[i] + v.scores[n] > score[j]:
                    score[j], back[j] = score[i] + v.scores[n], (i, [n])
        if not single and score[i] + v.unknown > score[i + 1]:
            score[i + 1], back[i + 1] = score[i] + v.unknown, (i, [v.byte_ids[b] for b in text[i].encode()])
    ids, end = [], len(text)
    while end:
        end, part = back[end]
        ids = part + ids
    return ids, score[-1]


def test_whole_search_and_round_trip(encoder):
    for text in TEXTS:
        ids = memoryview(encoder.encode(text)).cast("I").tolist()
        assert encoder.decode(array("I", ids).tobytes()) == text
        if text and "▁" not in text:
            want, _ = best_path(encoder.v, (" " + text).replace(" ", viterbi.SPACE))
            assert ids == want, text


def test_stream_in_any_parts_with_a_bounded_window(encoder):
    text = ("The quick brown fox " * 30 + "x" * 300 + " 東京🙂").replace(" ", viterbi.SPACE)
    want, _ = best_path(encoder.v, text)
    for step in (1, 3, 50, 10_000):
        stream, ids = viterbi.Stream(encoder.v), []
        for at in range(0, len(text), step):
            ids += stream.feed(text[at:at + step])
        assert len(stream.text) <= 8 * encoder.v.longest and stream.waiting <= 12 * encoder.v.longest
        assert ids + stream.end() == want


def test_scores_equal_the_library_search(encoder):
    """The library's own unigram search over the same pieces reaches the same total score."""
    raw = open(PATH, "rb").read()
    # the trainer's model_type field (number 3 of message 2) from BPE (2) to unigram (1)
    at = raw.find(b"\x18\x02", raw.rfind(b"\x12", 0, raw.rfind(b"\x18\x02")))
    with tempfile.NamedTemporaryFile(suffix=".model") as f:
        f.write(raw[:at] + b"\x18\x01" + raw[at + 2:])
        f.flush()
        try:
            library = SentencePieceProcessor(model_file=f.name)
        except Exception:
            pytest.skip("the model file has another layout")
    text = "Hello world these are ordinary words"
    total = lambda ids: sum(encoder.v.scores[i] for i in ids)
    assert total(library.encode(text)) <= total(memoryview(encoder.encode(text)).cast("I").tolist())


def test_whole_table(spark, sf_dir):
    rows = QUERIES["op9_sentencepiece"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(r.exact for r in rows)
    v = viterbi.Vocabulary(PATH)
    for r in sorted(rows)[:40]:
        ids, _ = best_path(v, (" " + texts[r.doc_id]).replace(" ", viterbi.SPACE))
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(array("I", ids).tobytes()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "tie"), (3, "tie"), (4, "long " * 20_000)]
    df = spark.createDataFrame([(i, t, b"x", 1) for i, t in rows], "doc_id long, text string, ids binary, n_ids int")
    got = {(r.doc_id, r.n_ids) for r in viterbi.round_trip(df, PATH).where("exact").collect()}
    assert len(got) == 5 and (1, 0) in got and (2, 0) in got
    assert viterbi.round_trip(df.where("doc_id = 99"), PATH).count() == 0


def test_round_trip_needs_one_python_worker_and_equals_the_two_steps(spark):
    df = spark.createDataFrame([(i if i % 7 else None, TEXTS[i % len(TEXTS)] if i % 5 else None) for i in range(600)],
                               "doc_id long, text string").coalesce(1)
    got = viterbi.round_trip(df, PATH)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
    steps = viterbi.decoded(viterbi.encoded(df, PATH), PATH).selectExpr(
        "doc_id", "n_ids", "ids_crc32", "sha2(decoded, 256) AS decoded_sha256", "decoded = text AS exact")
    assert got.schema.simpleString() == steps.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, steps.collect()))
