import hashlib
import random
import zlib

import numpy as np
import pytest

from hirelake.llm import periodic_runs as pr

from .conftest import make_docs, texts_of


def arranged(doc_id, text):
    words = text.encode().split()
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_runs(words):
    """Period by period; a stretch counts under its smallest period."""
    n, found = len(words), []
    w = np.unique(np.array(words, object), return_inverse=True)[1] if n else np.zeros(0, int)
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([0], (w[:-q] == w[q:]).astype(int), [0]))
        for s, e in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1) + q, strict=True):
            if e - s >= max(6, 4 * q) and not any(p < q and a <= s and b >= e and q % p == 0 for a, b, p in found):
                found.append((int(s), int(e), q))
    return sorted((s, e - s, q) for s, e, q in found)


def digest(doc_id, text):
    words = arranged(doc_id, text or "")
    runs = sorted(brute_runs(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def run(docs, **options):
    got = pr.judge(*pr.find_runs(docs, **options)).collect()
    return sorted((tuple(r) for r in got), key=repr)


def periodic_text(rng, n, words):
    """Random words with repetitions of random periods, some within others."""
    out = []
    while len(out) < n:
        block = [rng.choice(words) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 17, 40, 130]))]
        if rng.random() < 0.4:
            block = block * rng.randint(2, 5) + [rng.choice(words)]
        out += (block * rng.randint(1, 9))[:rng.choice([5, 30, 700])] + [rng.choice(words) for _ in range(rng.randint(0, 4))]
    return " ".join(out[:n])


@pytest.mark.parametrize("options", [{}, {"tile": 16, "long": 0}, {"tile": 16, "long": 900}])
def test_against_brute_force(spark, options):
    rng = random.Random(11)
    rows = [(i, periodic_text(rng, rng.choice([3, 9, 60, 400, 1500]), rng.choice([["a", "b"], ["a", "b", "c", "d"], list("abcdefghij")])))
            for i in range(60)]
    assert run(make_docs(spark, rows), **options) == sorted((digest(*r) for r in rows), key=repr)


def test_documents_and_odd_texts(spark, docs):
    texts = {i: t for i, t in texts_of(docs).items() if len(t) < 40_000}
    got = {r[0]: r for r in run(docs)}
    assert len(got) == docs.count()
    assert {i: got[i] for i in texts} == {i: digest(i, t) for i, t in texts.items()}
    # 30,000 equal words, behind the start of their repetition or from the first on.
    long = got[10_010]
    assert long[1:5] == (1, 0, 30_000, 1) and long[7] == hashlib.sha256(b"long").hexdigest()


def test_one_run_over_many_tiles(spark):
    rng = random.Random(3)
    block = [f"w{i}" for i in range(37)]
    for k in (1, 2):
        words = [f"u{i}" for i in range(1000)] + (block * 200)[:5000 + k] + [f"v{i}" for i in range(rng.randint(1, 50))]
        doc = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
        got = run(make_docs(spark, [(doc, " ".join(words))]), tile=64, long=0)
        assert got[0][1:5] == (1, 1000, 5000 + k, 37)


def test_nulls_repeated_rows_and_no_rows(spark, clashing, empty):
    assert run(clashing) == sorted((digest(r.doc_id, r.text) for r in clashing.collect()), key=repr)
    rows = [(None, "x " * 9), (None, "x " * 9), (None, "y z " * 5), (4, "x " * 9), (4, "other")]
    assert run(make_docs(spark, rows)) == sorted((digest(*r) for r in rows), key=repr)
    assert run(empty) == []
