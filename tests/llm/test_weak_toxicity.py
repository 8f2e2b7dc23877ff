import random
import zlib

import numpy as np

from hirelake.llm import weak_toxicity as wt
from tests.llm.conftest import make_docs


def made(spark, n=900, seed=1):
    """Invented texts; a tenth is toxic by words that the fixed list doesn't have."""
    rng = random.Random(seed)
    plain = [f"w{i}" for i in range(400)]
    bad = ["grumblewort", "snarkle", "vilebit", "foulmug", "drekky"]
    rows, labels = [], []
    for d in range(n):
        toxic = rng.random() < 0.12
        w = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        if toxic:
            for b in rng.sample(bad, rng.randint(2, 4)):
                w.insert(rng.randrange(len(w)), b)
        rows.append((d, " ".join(w)))
        if rng.random() < 0.8:
            labels.append((d, int(rng.random() < 0.9), int(toxic)))
    truth = {d: int(any(b in t for b in bad)) for d, t in rows}
    return make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_held_out_accuracy(spark):
    docs, labels, truth = made(spark)
    model = wt.fit(docs, labels)
    bad = ["grumblewort", "snarkle", "vilebit", "foulmug", "drekky"]
    entries = [w for w, _ in model.lexicon]
    assert all(any(b.startswith(w.rstrip("*")) for b in bad) for w in entries)
    assert all(any(b.startswith(w.rstrip("*")) for w in entries) for b in bad)
    got = wt.score_toxicity(docs, model).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_held_out_labels_are_not_learnt(spark):
    docs, labels, _ = made(spark, 400)
    from pyspark.sql import functions as F
    flipped = labels.withColumn("toxic", F.when(wt.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in wt.score_toxicity(docs, wt.fit(docs, x)).collect()) for x in (labels, flipped))
    assert a == b


def test_copies_make_no_lexicon(spark):
    docs, labels, _ = made(spark, 300)
    copies = [(1000 + i, f"oneword twoword threeword drekky snarkle fourword {'very ' * (i % 3)}fiveword") for i in range(60)]
    df = docs.unionAll(make_docs(spark, copies))
    more = labels.unionAll(spark.createDataFrame([(d, 1, 1) for d, _ in copies], "doc_id long, quality int, toxic int"))
    assert not {w[:4] for w, _ in wt.fit(df, more).lexicon} & {"onew", "twow", "thre", "four", "five"}


def test_other_languages_by_dense_stems(spark):
    """Signs that clean texts have, too, but seldom: their rate tells, not their presence."""
    rng = random.Random(5)
    plain = [f"palabra{chr(97 + i % 26)}{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(1200):
        toxic = d % 8 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(80, 200))]
        for _ in range(len(w) // 40 if toxic else int(rng.random() < 0.25)):
            w.insert(rng.randrange(len(w)), "ñandubaz" + rng.choice(["o", "a", "os"]))
        rows.append((d, " ".join(w)))
        labels.append((d, 1, int(toxic)))
    docs, labels = make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = wt.fit(docs, labels)
    assert model.lexicon and all("ñandubaz".startswith(w.rstrip("*")) or w.startswith("ñandubaz") for w, _ in model.lexicon)
    assert model.lexicon[0][1]
    held = [r for r in wt.score_toxicity(docs, model).collect() if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 8 == 0) for r in held]) > 0.97


def test_votes_features_and_score_by_hand(spark):
    lexicon = [("snarkle", False), ("drek*", True)]
    texts = ["snarkle you", "drek drekky drekkest", "drekky " + "w " * 150, "calm", "", "snarkle drekky w" + " w" * 30 + "!" * 20]
    features = wt.Features(lexicon)
    import pyarrow as pa
    from hirelake.llm import textbuf as tb
    pattern, text, feature, value = features(tb.Texts(pa.array(texts)))
    dense = np.zeros((len(texts), features.size))
    np.add.at(dense, (text, feature), value)
    for i, t in enumerate(texts):
        w = t.replace("!", "").split()
        fits = [sum(x == "snarkle" for x in w), sum(x.startswith("drek") and len(x) > 4 for x in w)]
        rate = [100 * f / max(len(w), 1) for f in fits]
        hit = [x for x in w if x == "snarkle" or (x.startswith("drek") and len(x) > 4)]
        shout = t.count("!") / max(len(w), 1)
        near = "you" in w and "snarkle" in w
        want = [*(float(f > 0) for f in fits), *(min(r, 4) for r in rate), np.log1p(len(set(hit))),
                min(100 * len(hit) / max(len(w), 1), 4), float(near), min(shout, 1)]
        assert np.allclose(dense[i], want), t
        votes = [0] * len(wt.VOTERS)
        votes[0], votes[1] = int(fits[0] > 0), int(rate[1] >= wt.DENSE)
        votes[wt.DEALT] = int(100 * len(hit) / max(len(w), 1) >= wt.DENSE)
        votes[wt.DEALT + 1] = int(near)
        votes[wt.DEALT + 2] = 1 if len(set(hit)) >= 2 else 0 if hit else 2
        votes[wt.DEALT + 3] = int(shout >= 0.2)
        assert wt._unpack(pattern[i:i + 1])[0].tolist() == votes, t
    rng = np.random.default_rng(2)
    model = wt.ToxicityModel(lexicon, None, rng.normal(size=features.size + 1))
    got = {r.doc_id: r.score for r in wt.score_toxicity(make_docs(spark, list(enumerate(texts))), model).collect()}
    for i in range(len(texts)):
        assert abs(got[i] - 1 / (1 + np.exp(-(dense[i] @ model.weights[:-1] + model.weights[-1])))) < 1e-9


def test_label_model_by_enumeration():
    """The posterior is the product of the tree's tables, normalised over both labels."""
    rng = np.random.default_rng(3)
    m = len(wt.VOTERS)
    table = rng.random((m, 2, 3, 3))
    table /= table.sum(axis=3, keepdims=True)
    model = wt.LabelModel(np.array([0.8, 0.2]), [-1, 0, 0, 1, 2, 0, 5, 6, 1][:m], table)
    patterns = rng.integers(0, 3 ** m, 50)
    for p, got in zip(patterns, model.posterior(patterns), strict=True):
        v = [int(p) // 3 ** j % 3 for j in range(m)]
        both = [model.prior[y] * np.prod([table[j][y, v[q] if q >= 0 else 0, v[j]] for j, q in enumerate(model.parent)])
                for y in (0, 1)]
        assert abs(got - both[1] / sum(both)) < 1e-9


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(7)
    n = 40_000
    y = rng.random(n) < 0.15
    votes = np.zeros((n, len(wt.VOTERS)), int)
    hit = {0: (0.9, 0.02), 1: (0.7, 0.01), 5: (0.8, 0.05)}
    for j, (p, q) in hit.items():
        votes[:, j] = rng.random(n) < np.where(y, p, q)
    votes[:, 2] = votes[:, 0]  # a copy of a voter counts once
    pattern = (votes * 3 ** np.arange(len(wt.VOTERS))).sum(axis=1)
    seen, counts = np.unique(pattern, return_counts=True)
    model = wt.fit_label_model(seen, np.full(len(seen), -1), counts.astype(float))
    assert abs(model.prior[1] - 0.15) < 0.06
    post = model.posterior(pattern)
    assert ((post > 0.5) == y).mean() > 0.92
    assert {model.parent[0], model.parent[2]} & {0, 2}  # the copies hang together


def test_odd_tables(spark, docs, clashing, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert wt.score_toxicity(empty, wt.fit(empty, none)).count() == 0
    model = wt.fit(docs, none)
    rows = make_docs(spark, [(1, "you stupid idiot, you worthless scum"), (2, "a calm day"), (3, None), (4, "")])
    s = {r.doc_id: r.score for r in wt.score_toxicity(rows, model).collect()}
    assert s[3] == s[4] and all(0 <= x <= 1 for x in s.values())
    odd = spark.createDataFrame([(1, None, None), (None, 1, 1), (77_777, 1, 1)], "doc_id long, quality int, toxic int")
    assert wt.score_toxicity(clashing, wt.fit(clashing, odd)).count() == 4
