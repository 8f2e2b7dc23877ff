import random
import re

import numpy as np
import pytest

from hirelake.llm import signature_tree as st

from .conftest import make_docs, texts_of


def sets_of(rows, k=3):
    out = {}
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        out[doc] = {tuple(words[i:i + k]) for i in range(max(len(words) - k + 1, 1))} if words else set()
    return out


def brute(rows, percent=90, k=3):
    sets = sets_of(rows, k)
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {d: (len(sets[d]), top(d)) for d in ids}


def run(docs, **options):
    rows = st.components(*st.jaccard_join(docs, **options)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def family(rng, base, n, edits):
    """Variants of a text, each with a few words changed, cut or added."""
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            at = rng.randrange(len(words))
            words[at:at + rng.randint(0, 2)] = [f"e{rng.randrange(40)}" for _ in range(rng.randint(0, 2))]
        out.append(" ".join(words))
    return out


def made(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(25)]
    texts = []
    for size, members, edits in ((60, 40, 5), (150, 60, 8), (30, 12, 2), (12, 10, 1), (400, 9, 14)):
        texts += family(rng, [rng.choice(vocabulary) for _ in range(size)], members, edits)
    for _ in range(60):  # a passage that many texts share
        own = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        texts.append(" ".join(own + passage))
    texts += texts[:20]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"hot": 3, "group": 8}), (3, {"hot": 10 ** 6, "percent": 75})])
def test_against_brute_force(spark, seed, options):
    rows = made(seed)
    want = brute(rows, options.get("percent", 90))
    assert run(make_docs(spark, rows), **options) == want
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_documents_and_odd_texts(spark, docs):
    assert run(docs) == brute(texts_of(docs).items())


def test_exact_bounds(spark):
    # 10 of 11 shingles: 100 * 9 >= 90 * 10 holds with equality.
    words = [f"a{i}" for i in range(40)]
    rows = [(i, " ".join(words[:n])) for i, n in enumerate(range(3, 41))]
    assert run(make_docs(spark, rows)) == brute(rows)


def test_nulls_repeated_rows_and_no_rows(spark, clashing, empty):
    got = st.components(*st.jaccard_join(clashing)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 4, 1), (1, 4, 1), (None, 4, None), (2, 0, 2)], key=repr)
    assert run(empty) == {}


def leaves(rng, n, spread):
    """Sets around a centre, and their leaf columns."""
    centre = set(range(200))
    sets = []
    for _ in range(n):
        gone = set(rng.sample(sorted(centre), rng.randint(0, spread)))
        sets.append((centre - gone) | {rng.randrange(1000, 1400) for _ in range(rng.randint(0, spread))})
    arr = lambda s: np.array(sorted(s), np.uint64)
    full = st._words([st._bits(arr(s), 512) for s in sets])
    adds = st._words([st._bits(arr(s - centre), 512) for s in sets])
    lacks = st._words([st._bits(arr(centre - s), 256) for s in sets])
    size = np.array([len(s) for s in sets])
    return sets, (200, size, np.array([len(s & centre) for s in sets]), np.arange(n), full, adds, lacks,
                  np.ones(n, bool))


@pytest.mark.parametrize("spread", [6, 30, 120])
def test_traversal_loses_no_link_and_prunes(spread):
    sets, columns = leaves(random.Random(spread), 300, spread)
    tree = st.Tree(*columns)
    i, j = st.traverse(tree, None, 200, 90)
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert len(found) == len(i)
    links = {(a, b) for b in range(300) for a in range(b)
             if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    assert links <= found
    assert len(found) <= 1.2 * len(links) + 100
    half = [st.Tree(200, *(v[k::2] for v in columns[1:])) for k in (0, 1)]
    i, j = st.traverse(*half, 200, 90)
    across = {tuple(sorted((2 * a, 2 * b + 1))) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    assert {(a, b) for a, b in links if (a - b) % 2} <= across


@pytest.mark.parametrize("share", [0.0, 0.5])
def test_members_that_were_not_compared(share):
    """Their own bitmaps alone bound the overlap: no link is lost, strangers are pruned."""
    rng = random.Random(4)
    sets, columns = leaves(rng, 200, 20)
    sets += [set(rng.sample(range(5000, 9000), 200)) for _ in range(200)]
    arr = lambda s: np.array(sorted(s), np.uint64)
    full = st._words([st._bits(arr(s), 512) for s in sets])
    compared = np.array([i < 200 and rng.random() < share for i in range(400)])
    wide = lambda v: np.concatenate((v, np.zeros((200, *v.shape[1:]), v.dtype)))
    _, _, common, _, _, adds, lacks, _ = columns
    tree = st.Tree(200, np.array([len(s) for s in sets]), wide(common), np.arange(400), full, wide(adds), wide(lacks), compared)
    i, j = st.traverse(tree, None, 200, 90)
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert {(a, b) for b in range(400) for a in range(b)
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])} <= found
    assert all(b < 200 for _, b in found)


def test_one_component_is_not_compared_again():
    _, columns = leaves(random.Random(5), 300, 3)
    tree = st.Tree(*columns[:3], np.zeros(300, np.int64), *columns[4:])
    assert len(st.traverse(tree, None, 200, 90)[0]) == 0


@pytest.mark.parametrize("seed,options", [(1, {}), (2, {"hot": 3, "group": 8}), (6, {"hot": 3, "percent": 40})])
def test_every_link_between_different_sets(spark, seed, options):
    rows = made(seed)
    close = family(random.Random(seed), [f"c{i}" for i in range(200)], 50, 3)
    rows += enumerate(close, len(rows))
    sets, classes, links = st.jaccard_join(make_docs(spark, rows), **options)
    own, percent = sets_of(rows), options.get("percent", 90)
    rep = {r.rep for r in classes.collect()}
    want = {(a, b) for a in rep for b in rep if a < b and
            100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])}
    got = [(r.a, r.b) for r in links.collect()]
    assert sorted(got) == sorted(want)
    assert len(want) > 200
    # Components need far fewer.
    assert links.where("joins").count() < len(want) / 2


def test_sizes_three_ranges_apart(spark):
    # 40 percent: sets of 7 and 17 shingles link, their sizes are two ranges of two apart.
    words = [f"a{i}" for i in range(60)]
    rows = [(n, " ".join(words[:n + 2])) for n in (7, 15, 16, 17, 18, 45)]
    links = st.jaccard_join(make_docs(spark, rows), percent=40)[2].collect()
    assert sorted((r.a, r.b) for r in links) == [(a, b) for a in (7, 15, 16, 17, 18) for b in (15, 16, 17, 18, 45)
                                                 if a < b and 100 * a >= 40 * b]


def test_overlap_of_members_by_their_lists():
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(60), rng.randint(0, 30))) for _ in range(40)]
    lists = st.Lists([np.array(s, np.uint64).tobytes() for s in sets])
    i, j = (v.ravel() for v in np.meshgrid(np.arange(40), np.arange(40), indexing="ij"))
    assert lists.common(i, j).tolist() == [len(set(sets[a]) & set(sets[b])) if a != b else len(
        [v for v in sets[a] if sum(v in s for s in sets) > 1]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert lists.common(i[:0], j[:0]).tolist() == []
