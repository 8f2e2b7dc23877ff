import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from hirelake.llm import lpf_dedup as ld
from tests.llm.conftest import make_docs, texts_of


def brute(texts):
    seen, out = set(), {}
    for d in sorted(texts):
        raw = texts[d].encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            s = raw[i:i + 100]
            if s in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def run(df, **k):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in ld.remove_repeats(df, **k).collect()}


def test_matches_brute_force(docs):
    df = docs.where("length(text) < 60000 or text is null")
    assert run(df) == brute(texts_of(df))


def random_rows(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randint(15, 80))) for _ in range(8)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            parts += [p[a:b] if rng.random() < 0.5 else p, " ".join(word() for _ in range(rng.randint(0, 20)))]
        rows.append((rng.randrange(10 ** 6) * n + i, " ".join(parts)))
    rows += [(-5, rows[0][1]), (-4, "ab" * 400), (-3, "ab" * 300 + "c"), (-2, "é" * 99), (-1, "x" * 99)]
    return rows


@pytest.mark.parametrize("group", [4096, 3])
def test_shared_passages(spark, group):
    for seed in (1, 2):
        rows = random_rows(seed)
        assert run(make_docs(spark, rows).repartition(7), group=group) == brute(dict(rows))


def test_marks_over_batch_and_partition_ends():
    rng = random.Random(4)
    rows = sorted((rng.randrange(6), rng.randrange(3), rng.randrange(4), rng.randrange(3)) for _ in range(60))
    for size in (1, 2, 7, 60):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + size])],
                                              ["anchor", "around", "doc_id", "pos"]) for i in range(0, 60, size)]
        got = sorted((x["anchor"], x["doc_id"], x["pos"], x["whole"]) for b in ld._mark(iter(batches)) for x in b.to_pylist())
        want, firsts = [], {}
        for a, r, d, p in rows:
            if firsts.setdefault((a, r), (d, p)) != (d, p):
                want.append((a, d, p, True))
        for (a, r), (d, p) in firsts.items():
            if sum(k[0] == a for k in firsts) > 1 or a in (rows[0][0], rows[-1][0]):
                want.append((a, d, p, False))
        assert got == sorted(want)


def prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed,letters,rows", [(1, b"a", 9), (2, b"ab\0", 60), (3, bytes(range(256)), 40), (4, b"abc", 1)])
def test_previous_factors_are_the_longest_earlier_strings(seed, letters, rows):
    rng = random.Random(seed)
    text = lambda n: bytes(rng.choice(letters) for _ in range(n))
    around = [(text(ld.REACH), text(ld.LENGTH)) for _ in range(4)]
    made = []
    for _ in range(rows):
        left, right = bytearray(rng.choice(around)[0]), bytearray(rng.choice(around)[1])
        for part in (left, right):  # texts that part at some place, or end there
            if rng.random() < 0.6:
                part[rng.randrange(len(part))] = rng.choice(letters)
        cut = rng.choice([0, 0, rng.randrange(ld.REACH + 1)])
        made.append((rng.randrange(3), bytes(left[cut:]), bytes(right[:rng.choice([ld.LENGTH, ld.LENGTH, rng.randrange(40, 101)])])))
    group = np.array([g for g, _, _ in made])
    got = ld.previous_factors(group, np.array([len(a) for _, a, _ in made]), pa.array([a + b for _, a, b in made], pa.binary()))
    for i, (g, a, b) in enumerate(made):
        for o in range(ld.SPAN):
            whole = len(a) >= o and o + len(b) >= ld.LENGTH
            want = 0
            for h, c, d in made[:i]:
                if whole and h == g and len(c) >= o and o + len(d) >= ld.LENGTH:
                    common = prefix(a[len(a) - o:] + b, c[len(c) - o:] + d)
                    want = max(want, common if common >= o else 0)
            if 0 in letters:  # the order does not tell a NUL from the end of a document
                assert (got[i, o] >= ld.LENGTH) == (want >= ld.LENGTH) and got[i, o] <= want
            else:
                assert got[i, o] == want


def test_smaller_positions():
    rng = random.Random(6)
    for n in (0, 1, 2, 50, 300):
        group = np.array(sorted(rng.randrange(1 + n // 20) for _ in range(n)), np.int64)
        value = np.array(rng.sample(range(10 * n), n), np.int64)
        before, behind = ld._smaller(value, group)
        for i in range(n):
            near = [j for j in range(i) if group[j] == group[i] and value[j] < value[i]]
            next_ = [j for j in range(i + 1, n) if group[j] == group[i] and value[j] < value[i]]
            assert (before[i], behind[i]) == (max(near, default=-1), min(next_, default=-1))


def test_odd_tables(spark, clashing, empty):
    assert ld.remove_repeats(empty).count() == 0
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in ld.remove_repeats(clashing).collect()) == [
        (0, 11, 0), (1, 11, 0), (1, 11, 0), (2, 0, 0)]
    long = " ".join(f"w{i * i}" for i in range(40))[:150]
    df = make_docs(spark, [(None, long), (3, long), (3, long), (4, long), (None, long)])
    assert sorted((r.doc_id or 0, r.n_removed) for r in ld.remove_repeats(df).collect()) == [
        (0, 0), (0, 0), (3, 0), (3, 0), (4, 150)]
