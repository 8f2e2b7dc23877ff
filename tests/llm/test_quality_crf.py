import collections
import itertools
import re

import numpy as np

from hirelake.llm import quality_crf as qc
from tests.llm.conftest import SF, make_docs, texts_of


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated),
            n < 50 or 100 * len(repeated) > 50 * n)


def test_counts_match_brute_force(docs):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in qc.score_quality(docs, qc.default_crf()).collect()}
    assert got == {d: brute_counts(t) for d, t in texts_of(docs).items()}


def test_line_ends(spark):
    rows = [(1, "a\r\na\r\nb \nb\n\n \nb \n"), (2, "\n\n"), (3, "x\nx"), (4, "x"), (5, "x\n")]
    got = {r.doc_id: (r.n_dup_lines, r.n_lines) for r in qc.score_quality(make_docs(spark, rows), qc.default_crf()).collect()}
    assert got == {1: (2, 5), 2: (0, 0), 3: (1, 2), 4: (0, 1), 5: (0, 1)}


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(3)
    crf = qc.LineCrf(rng.normal(size=(qc.N_FEATURES, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [0, 1, 5, 3, 0, 7, 2]
    off = np.concatenate(([0], np.cumsum(sizes)))
    features = np.stack([rng.integers(qc._FIRST[j], qc._FIRST[j + 1], off[-1]) for j in range(len(qc.BINS))], axis=1)
    got = qc._viterbi(crf, features, off)
    score = crf.emit[features].sum(axis=1)
    for a, b in zip(off[:-1], off[1:]):
        def total(y):
            return (crf.start[y[0]] + sum(score[a + i, v] for i, v in enumerate(y))
                    + sum(crf.step[u, v] for u, v in zip(y, y[1:])))
        if b > a:
            assert tuple(got[a:b]) == max(itertools.product((0, 1), repeat=b - a), key=total)


def test_training_gradient_raises_the_likelihood():
    rng = np.random.default_rng(5)
    seqs, quality = [], []
    for _ in range(60):
        good = rng.random() < 0.5
        rows = np.stack([rng.integers(qc._FIRST[j], qc._FIRST[j + 1], 6) for j in range(len(qc.BINS))], axis=1)
        rows[:, 0] = qc._FIRST[0] + (0 if good else 3)
        seqs.append(rows)
        quality.append(int(good))
    crf = qc._train(seqs, np.array(quality), 40)
    off = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
    states = qc._viterbi(crf, np.concatenate(seqs), off)
    assert (states == np.repeat(quality, np.diff(off))).mean() > 0.95


def test_verdict_agrees_with_labels(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = qc.score_quality(docs, qc.fit_line_crf(docs, labels)).where("not base_failed").join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_odd_tables(spark, clashing, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    crf = qc.fit_line_crf(clashing, none)
    assert qc.score_quality(clashing, crf).count() == 4 and qc.score_quality(empty, crf).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, quality int")
    assert np.array_equal(qc.fit_line_crf(clashing, odd).emit, qc.default_crf().emit)
    assert qc.keep_quality(clashing, crf).columns == clashing.columns
