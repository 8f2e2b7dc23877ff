import re

import pytest

from hirelake.llm import minhash_dedup as md
from hirelake.llm.graph import connected_components
from tests.llm.conftest import make_docs, texts_of

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(texts):
    sets = {d: shingle_set(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1:]}
    for a, b in pairs:
        common = len(sets[a] & sets[b])
        if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


def run(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in md.near_duplicates(df).collect()}


def test_matches_brute_force(docs):
    assert run(docs) == brute(texts_of(docs))


def test_chains_and_groups(spark):
    base = [f"w{i}" for i in range(120)]
    rows, k = [], 0
    for group in range(6):
        words = [f"g{group}{w}" for w in base]
        for step in range(12):
            rows.append((1000 - k, " ".join(words)))
            k += 1
            words = words[:]
            words[(step * 9) % 110] = f"new{group}_{step}"
    df = make_docs(spark, rows)
    assert run(df) == brute(dict(rows))


@pytest.mark.parametrize("strays", [0, 32])
def test_many_strays_of_one_centre(spark, monkeypatch, strays):
    """Variants of one text at all distances, some of which only link one
    another: with the strays compared one by one, and by what they share."""
    import random
    monkeypatch.setattr(md, "STRAYS", strays)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows, d = [(0, " ".join(base))], 1
    for edits in range(1, 12):
        for _ in range(5):
            words = base[:]
            for i in rng.sample(range(100), edits):
                words[i] = f"e{rng.randrange(10 ** 6)}"
            rows.append((d, " ".join(words)))
            d += 1
            for i in rng.sample(range(100), rng.randint(0, 3)):  # a variant of the variant
                words[i] = f"e{rng.randrange(10 ** 6)}"
            rows.append((d, " ".join(words + base[:rng.randint(0, 9)])))
            d += 1
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert run(make_docs(spark, rows)) == brute(dict(rows))


def test_threshold_is_exact(spark):
    # 3 common shingles of 4 are a link, 3 of 5 are none.
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "p q r s t u v"), (4, "o p q r s t u v w")]
    got = run(make_docs(spark, rows))
    assert got[2] == (4, 1) and got[4][1] == 4 and got[3][1] == 3


def test_odd_tables(clashing, empty):
    got = md.near_duplicates(clashing).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [
        (0, 0, True), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert md.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
