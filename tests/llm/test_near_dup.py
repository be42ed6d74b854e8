import random

import numpy as np

from inkprint.llm import near_dup as nd

SCHEMA = "doc_id long, text string, n long, sig string, key int, kept boolean"


def brute_set(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(brute_set(t))  # an id with several texts is like whatever any of them is like
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x & y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    out = []
    for i, t in rows:
        comp = None if i is None else top(i)
        out.append((i, len(brute_set(t)), comp, i is None or comp == i))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(i, t, 1, "s", 2, False) for i, t in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in nd.near_duplicates(df).collect()), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_groups_chains_and_odd_rows(spark):
    rng = random.Random(3)
    base = [[f"v{rng.randrange(5000)}" for _ in range(n)] for n in (200, 60, 400, 25, 900)]
    rows, at = [], 0
    for words in base:  # copies at all distances, many about the threshold
        for k in range(24):
            rows.append((at := at + 1, edited(rng, words, rng.choice([0, 0, 1, 2, 3, 4]) * len(words) // 200)))
    chain = base[0][:]
    for k in range(20):  # each like its neighbour, the ends unlike
        chain[10 * k:10 * k + 3] = [f"c{k}a", f"c{k}b", f"c{k}c"]
        rows.append((at := at + 1, " ".join(chain)))
    shared = " ".join(f"s{i}" for i in range(120))
    for k in range(30):  # a long passage in common with much else
        rows.append((at := at + 1, shared + " " + " ".join(f"x{k}_{i}" for i in range(40 + k))))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one\x0bTWO"), (905, "one two three"), (None, "one two"),
             (None, rows[0][1]), (906, "É é a b c d"), (907, "é é a b c d"), (908, "tie tie tie tie tie tie"), (1, rows[0][1]),
             (909, rows[30][1].upper())]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_an_id_with_several_texts_loses_no_link(spark):
    rng = random.Random(8)
    base = [[f"v{rng.randrange(5000)}" for _ in range(80)] for _ in range(5)]
    rows = [(1, " ".join(base[0])), (1, " ".join(base[1])), (1, " ".join(base[2])), (2, edited(rng, base[0], 1)),
            (3, edited(rng, base[1], 1)), (4, edited(rng, base[2], 1)), (9, " ".join(base[3])), (9, " ".join(base[4])), (8, edited(rng, base[4], 1))]
    got = run(spark, rows)
    assert got == brute(rows) and {r[0]: r[2] for r in got} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(4)
    words = [f"v{rng.randrange(5000)}" for _ in range(150)]
    rows = [(i, edited(rng, words, 1)) for i in range(700)] + [(1000 + i, " ".join(words)) for i in range(300)]
    got = run(spark, rows)
    assert len(got) == 1000 and {r[2] for r in got} == {0}


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None)]) == [(None, 0, None, True)]


def test_estimates_and_bounds():
    rng = np.random.default_rng(0)
    fewest = nd.fewest_matches()
    assert len(fewest) == nd.HASHES // nd.BATCH and (np.diff(fewest) >= 0).all() and fewest[-1] > 0.5 * nd.HASHES
    lost = 0
    for _ in range(400):  # pairs at the threshold stay
        both = rng.integers(0, 2 ** 63, 850, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2 ** 63, 75, dtype=np.uint64)])) for _ in range(2))
        assert nd.similar(a, b)
        same = (nd.signature(a) == nd.signature(b)).reshape(-1, nd.BATCH).sum(1).cumsum()
        lost += bool((same < fewest).any())
    assert lost == 0
    assert (1 - 0.85 ** nd.ROWS) ** nd.BANDS < 1e-6


def test_exact_threshold():
    a = np.arange(100, dtype=np.uint64)
    assert nd.similar(a, a[:85]) and not nd.similar(a, a[:84]) and not nd.similar(a[:0], a[:0])


def test_kept_takes_a_table_with_a_column_of_ids(spark):
    rows = [(1, 5, "same words in both of these rows here"), (2, 8, "same words in both of these rows here"), (3, None, None), (9, None, "no id")]
    docs = spark.createDataFrame(rows, "_id long, doc_id long, text string")
    got = nd.kept(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2], rows[3]]


def test_a_family_of_near_misses_meets_in_no_pair(spark, monkeypatch):
    monkeypatch.setattr(nd, "SLOTS", 1 << 10)  # a table of counts that a large corpus has filled
    monkeypatch.setattr(nd, "PAGE", 1 << 10)
    rng = random.Random(6)
    words = [f"v{rng.randrange(5000)}" for _ in range(300)]
    texts = [edited(rng, words, 14) for _ in range(120)]  # about 0.65 like each other
    close = [edited(rng, t.split(), 2) for t in texts[:6]]  # like one of them
    sets = [nd.shingles(t) for t in texts + close]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if nd.similar(sets[i], sets[j])}
    assert len(want) == 6
    members = spark.createDataFrame([(i, i, bytearray(x.tobytes())) for i, x in enumerate(sets)] * 2, "id long, comp long, found binary")
    met = {(r.a, r.b) for r in nd._meetings(members).collect()}
    assert want <= met and len(met) <= 2 * len(want)
    apart = members.withColumn("comp", members.id % 2)  # pairs within a component are not looked for
    met = {(r.a, r.b) for r in nd._meetings(apart).collect()}
    assert {(i, j) for i, j in want if i % 2 != j % 2} <= met
