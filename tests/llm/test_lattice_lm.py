import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from hirelake.llm import lattice_lm as lm
from hirelake.llm import textbuf as tb
from tests.llm.conftest import make_docs, texts_of

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def all_segmentations(codes, pieces):
    """Log of the summed weights of all segmentations, by plain recursion."""
    total = [0.0] * len(codes) + [1.0]
    for i in range(len(codes) - 1, -1, -1):
        total[i] = sum(math.exp(pieces[tuple(codes[i:j])]) * total[j]
                       for j in range(i + 1, len(codes) + 1) if tuple(codes[i:j]) in pieces)
    return math.log(total[0])


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=lm.default_vocabulary())
    lattice = lm._lattice(None)
    names = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            codes = tuple(c for ch in model.id_to_piece(i) for c in ([256] if ch == "▁" else ch.encode()))
            names.setdefault(codes, len(names))
    for c in range(257):
        names.setdefault((c,), len(names))
    assert len(names) == lattice.n
    return names


def test_forward_recursion(pieces):
    lattice = lm._lattice(None)
    some = ["the", "ndnanded", "réeuxment", "x", "日本é", "a" * 40, "token=", "…", "\x00\x01"]
    (got,), (uses,) = lm.lattice_scores(lattice, [lattice.first], tb.Texts(pa.array(some)), np.ones((1, len(some)), bool))
    weights = {codes: float(lattice.first[i]) for codes, i in pieces.items()}
    for w, s in zip(some, got):
        assert s == pytest.approx(all_segmentations([256, *w.encode()], weights) + lattice.first[-1])
    # Expected uses: the derivative of the log probability by each log weight.
    for codes in [(256, 116, 104, 101), (110, 100), (101,)]:
        moved = lattice.first.copy()
        moved[pieces[codes]] += 1e-6
        rise = (lm.lattice_scores(lattice, [moved], tb.Texts(pa.array(some)))[0] - got).sum() / 1e-6
        assert uses[pieces[codes]] == pytest.approx(rise, rel=1e-3, abs=1e-6)


def test_training_raises_likelihood():
    lattice = lm._lattice(None)
    some = tb.Texts(pa.array(["ndnanded", "onthan", "thontion", "erthndha", "réeuxment"] * 3))
    logq = lattice.first
    last = -np.inf
    for _ in range(4):
        (scores,), (uses,) = lm.lattice_scores(lattice, [logq], some, np.ones((1, some.n), bool))
        assert scores.sum() > last
        last = scores.sum()
        uses = uses + 1e-9
        logq = np.log(uses / uses.sum())


def brute(rows):
    train = [t for d, t in rows if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    count = Counter(w for t in train for w in words(t))
    if train:
        count["\n"] = len(train)
    total, types = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        tokens = [*words(t), "\n"]
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (types + 1))) for w in tokens)
        out.append((d, d is not None and zlib.crc32(str(d).encode()) % 5 == 1, len(tokens),
                    sum(count[w] > 0 for w in tokens), total, base))
    return sorted(out, key=lambda x: str(x[:5]))


@pytest.mark.parametrize("frequent", [0, 1 << 18])
def test_base_and_counts(docs, frequent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lm.score_texts(docs, frequent=frequent).collect()
    got_rows = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got],
                      key=lambda x: str(x[:5]))
    want = brute(rows)
    assert [g[:5] for g in got_rows] == [w[:5] for w in want]
    assert [g[5] for g in got_rows] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


@pytest.mark.parametrize("frequent", [0, 1 << 18])
def test_mixture_is_the_marginal_over_classes(spark, pieces, frequent):
    rows = [(i, t, c) for i, (t, c) in enumerate([
        ("red fox", "a"), ("red dog red", "a"), ("Blue fox bl\u00e5", "b"), ("new words here", None), ("", "b"), (None, "b")] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    data = df.select("doc_id", "text", lm.held_out("doc_id").alias("held_out"), df["lang"].alias("class"))
    counted = lm.word_counts(data, ["a", "b"])
    counts = {r.word: (r.c0, r.c1, r.c2) for r in counted.collect()}
    model = lm.fit(data, counted, ["a", "b"])
    weights = [{codes: float(m.logq[i]) for codes, i in pieces.items()} for m in model.classes]
    assert sum(m.share for m in model.classes) == pytest.approx(1)

    def p(k, word):
        m = model.classes[k]
        n = counts[word][k] if word else m.ends
        lattice = m.logq[-1] + (all_segmentations([256, *word.encode()], weights[k]) if word else 0)
        return math.log(max(n - m.discount, 0) / m.tokens + m.discount * m.types / m.tokens * math.exp(lattice))

    got = {r.doc_id: r.mixture_score for r in lm.score_texts(df, class_col="lang", frequent=frequent).collect()}
    names = lm._class_names(data)
    assert sorted(names) == ["a", "b"]
    for d, t, _ in rows:
        joint = [math.log(model.classes[k].share) + sum(p(k, w) for w in words(t)) + p(k, "") for k in range(3)]
        want = (max(joint) + math.log(sum(math.exp(j - max(joint)) for j in joint))) / math.log(10)
        assert got[d] == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("frequent", [0, 1 << 18])
def test_score_is_the_lattice_marginal_without_word_counts(spark, pieces, frequent):
    rows = [(i, t, c) for i, (t, c) in enumerate([
        ("red fox", "a"), ("red dog red", "a"), ("Blue fox bl\u00e5", "b"), ("new words here", None), ("", "b"), (None, "b")] * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    data = df.select("doc_id", "text", lm.held_out("doc_id").alias("held_out"), df["lang"].alias("class"))
    model = lm.fit(data, lm.word_counts(data, ["a", "b"]), ["a", "b"])
    weights = [{codes: float(m.logq[i]) for codes, i in pieces.items()} for m in model.classes]
    got = {r.doc_id: r.score for r in lm.score_texts(df, class_col="lang", frequent=frequent).collect()}
    for d, t, _ in rows:
        joint = [math.log(m.share) + m.logq[-1] + sum(
            m.logq[-1] + all_segmentations([256, *w.encode()], weights[k]) for w in words(t)) for k, m in enumerate(model.classes)]
        want = (max(joint) + math.log(sum(math.exp(j - max(joint)) for j in joint))) / math.log(10)
        assert got[d] == pytest.approx(want, rel=1e-5)


def test_held_out_figures(spark):
    """The mixture beats the base; the lattice alone gains by its training words."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = [r for r in lm.score_texts(docs, class_col="lang").collect() if r.held_out]
    assert sum(r.mixture_score for r in got) > sum(r.base_score for r in got)
    tokens = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / tokens > -5.6


def test_counts_weigh_the_expected_uses():
    lattice = lm._lattice(None)
    some = ["red", "fox", "red", "red", "onthan", "fox"]
    one = lm.lattice_scores(lattice, [lattice.first], tb.Texts(pa.array(some)), np.ones((1, 6)))[1][0]
    seen = Counter(some)
    two = lm.lattice_scores(lattice, [lattice.first], tb.Texts(pa.array(list(seen))), np.array([list(seen.values())], float))[1][0]
    assert two == pytest.approx(one)


def test_odd_tables(clashing, empty):
    assert lm.score_texts(empty).count() == 0
    assert lm.score_texts(clashing, class_col="bucket").count() == 4
    got = sorted((r.doc_id or 0, r.n_tokens) for r in lm.score_texts(clashing).collect())
    assert got == [(0, 7), (1, 7), (1, 7), (2, 1)]
