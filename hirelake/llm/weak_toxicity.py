"""Toxicity by weak supervision (operator 9).

1. ``learn_lexicon``: words and word beginnings that mark toxic documents of a bounded
   sample of labelled rows, near copies counted once.  An entry is tested twice, by
   whether a document has it at all and by whether it stands in it at least
   ``DENSE`` times in 100 words (log-likelihood ratio tests); those that pass a false
   discovery rate over all tests are kept.  No word is given beforehand.
2. Voters: the lexicon dealt out to several, its rate in the text, and patterns (an
   entry near a form of address, several entries, shouting, nothing at all).
   Each votes toxic, clean or abstains.
3. ``LabelModel``: a generative model of the votes given the unknown label.  Voters'
   accuracies, and correlations along a maximum-information tree, are estimated by
   expectation maximisation over the vote patterns of all training documents; the
   sample's labels are held fixed.
4. ``fit_classifier``: logistic regression on the rates of the entries and on the patterns
   in the sample's documents, trained on the label model's posteriors; a known label is a
   further voter there, right ``LABELLED`` of the time.

Labels are read from training rows only (crc32 of the id by 4 is not 2).
Language, source and id are inputs of no score.

Nulls and edge cases: a null or empty text has no words and gets the score of
no evidence; a null id has no remainder and so isn't held out; labels that are null or for absent
documents are ignored; repeated rows are scored each; without labels there is no
lexicon and the patterns alone vote; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm import textbuf as tb
from hirelake.session import materialize

#: Most labelled rows that the lexicon and the classifier are fitted on.
SAMPLE = 20_000
#: Most learnt entries, and the share of false ones among them that is accepted.
WORDS, FALSE_SHARE = 256, 0.01
#: Times in 100 words that an entry stands in a text, to count as dense there.
DENSE = 1.0
#: How often a label is right, as a voter for the classifier's targets.
LABELLED = 0.95
ADDRESS = ("you", "your", "youre", "u", "du", "dich", "dein", "ihr", "tu", "te", "vous", "usted", "eres", "ton", "votre")
#: Lengths, in code points, of word beginnings; one is written with a final ``*``.
BEGINNINGS = (4, 5, 6, 7, 8)
DEALT = 5
VOTERS = (*(f"lexicon{i}" for i in range(DEALT)), "rate", "address", "several", "shouting")
N_EXTRA = 4  # features besides the words
KEYS = 4
_MARK = np.zeros(256, bool)
_MARK[33] = True


def _hashes(words) -> np.ndarray:
    """Hashes of words, and of word beginnings (``abcde*``)."""
    words = list(words)
    texts = tb.Texts(pa.array([w.removesuffix("*") for w in words], pa.string()))
    keys = tb.range_hashes(texts.data, texts.off[:-1], texts.off[1:], lower=True)
    size = np.array([len(w) - 1 if w.endswith("*") else 0 for w in words], np.int64)
    return np.where(size > 0, tb.mix(keys + tb.PLACE[size]), keys)


def _beginnings(words: tb.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of more than ``size`` code points, and the hashes of their beginnings."""
    points, starts = words.texts.points, np.flatnonzero((words.texts.data & 0xC0) != 0x80)
    at = np.flatnonzero(points[words.end] - points[words.start] > size)
    start = words.start[at]
    keys = tb.range_hashes(words.texts.data, start, starts[points[start] + size], lower=True)
    return at, tb.mix(keys + tb.PLACE[size])


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2):
    """True for rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, text, toxic)`` of the ``sample`` labelled training rows with the
    smallest crc32 of their id; the ids and labels alone are broadcast."""
    wanted = (labels.where(~held_out()).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(sample))
    return docs.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "toxic")


def learn_lexicon(picked: DataFrame, words: int = WORDS, false_share: float = FALSE_SHARE) -> list[tuple[str, bool]]:
    """Toxic words and word beginnings of a labelled sample, the strongest first, and
    whether they tell by being dense in a text (else by being there at all).

    Of documents that agree in a minimum over their three-word windows (near
    copies do) only one counts, so that the words of a copied text aren't taken
    for signs."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches):
            found = tb.Words(tb.Texts(batch.column(1)), tb.ALNUM)
            doc = found.doc
            _, first = np.unique(tb.mix(found.hash + doc.astype(np.uint64) * tb.PLACE[10]), return_index=True)
            first.sort()
            hashes, doc = found.hash[first], doc[first]
            n = found.texts.n
            off = np.searchsorted(doc, np.arange(n + 1))
            # Minima over three-word windows; shorter texts are copies if they are equal.
            grams, at = found.window_hashes(3)
            cut = np.searchsorted(found.doc[at], np.arange(n + 1))
            some = np.flatnonzero(np.diff(cut))
            keys = np.tile(tb.mix(tb.PLACE[9] + np.bincount(doc, minlength=n).astype(np.uint64)), (KEYS, 1))
            np.add.at(keys, (slice(None), doc), hashes)
            for k in range(KEYS if len(some) else 0):
                keys[k, some] = np.minimum.reduceat(tb.mix(grams * tb.PLACE[11 + k]), cut[some])
            low = tb.LOWER[found.texts.data].tobytes()
            names = [low[a:b].decode() for a, b in zip(found.start[first].tolist(), found.end[first].tolist(), strict=True)]
            _, inverse = np.unique(tb.mix(found.hash + found.doc.astype(np.uint64) * tb.PLACE[10]), return_inverse=True)
            times = np.bincount(inverse)[inverse[first]].tolist() if len(first) else []
            own, dense = [], []
            for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                count: dict[str, int] = {}
                for w, t in zip(names[a:b], times[a:b], strict=True):
                    for e in (w, *(w[:k] + "*" for k in BEGINNINGS if len(w) > k)):
                        count[e] = count.get(e, 0) + t
                own.append(list(count))
                dense.append([100 * t >= DENSE * found.n[i] for t in count.values()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int32()), *(pa.array(k.view(np.int64)) for k in keys),
                 pa.array(own, pa.list_(pa.string())), pa.array(dense, pa.list_(pa.bool_()))],
                ["doc_id", "toxic", *(f"key{k}" for k in range(KEYS)), "words", "dense"])

    keys = ", ".join(f"key{k} long" for k in range(KEYS))
    rows = materialize(picked.mapInArrow(run, f"doc_id long, toxic int, {keys}, words array<string>, dense array<boolean>"), "sample")
    for k in range(KEYS):
        ahead = rows.groupBy(f"key{k}").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        rows = rows.join(F.broadcast(ahead), "doc_id", "left_semi")  # no more rows than the sample
    totals = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return []
    entry = F.explode(F.arrays_zip("words", "dense")).alias("e")
    is_toxic, is_dense = F.col("toxic") == 1, F.col("dense")
    number = lambda test: F.sum(test.cast("double"))
    counts = (rows.select("toxic", entry).select("toxic", F.col("e.words").alias("word"), F.col("e.dense").alias("dense"))
              .groupBy("word").agg(number(is_toxic).alias("a"), number(~is_toxic).alias("b"),
                                   number(is_toxic & is_dense).alias("c"), number(~is_toxic & is_dense).alias("d")))
    # An entry of a single document proves nothing and isn't tested.
    counts = materialize(counts.where("a + b > 1"), "lexicon-counts")
    tests = 2 * counts.count()

    def ratio(a, b):
        """Log-likelihood ratio of an entry in ``a`` toxic and ``b`` clean documents; 0 where it
        isn't far more frequent in toxic ones."""
        share = (a + b) / (toxic + clean)

        def part(k, total):
            return (F.when(k > 0, k * F.log(k / (share * total))).otherwise(0.0)
                    + F.when(k < total, (total - k) * F.log((total - k) / (total * (1 - share)))).otherwise(0.0))

        useful = (a / toxic > 2 * b / clean) & (a > b) & (share < 1)
        return F.when(useful, 2 * (part(a, F.lit(float(toxic))) + part(b, F.lit(float(clean))))).otherwise(0.0)

    strong = (counts.withColumns({"there": ratio(F.col("a"), F.col("b")), "rate": ratio(F.col("c"), F.col("d"))})
              .withColumn("ratio", F.greatest("there", "rate")).where("ratio > 0")
              .orderBy(F.desc("ratio"), F.length("word"), "word").limit(8 * words).collect())
    # Benjamini and Hochberg: the longest list whose last p-value fits.
    fits = [math.erfc(math.sqrt(r["ratio"] / 2)) <= false_share * (i + 1) / tests for i, r in enumerate(strong)]
    strong = strong[:max((i + 1 for i, ok in enumerate(fits) if ok), default=0)]
    chosen: dict[str, bool] = {}
    for r in strong:
        # A beginning says as much as the words that begin with it, and less than a
        # stronger, longer one.
        word = r["word"].removesuffix("*")
        covered = any(word.startswith(w[:-1]) if w[-1] == "*" else False for w in chosen)
        wider = r["word"][-1] == "*" and any(w.startswith(word) for w in chosen)
        if len(chosen) < words and not covered and not wider:
            chosen[r["word"]] = r["rate"] > r["there"]
    return list(chosen.items())


class Features:
    """Votes and features of texts, for a lexicon."""

    def __init__(self, lexicon: list[tuple[str, bool]]):
        keys = _hashes([w for w, _ in lexicon])
        order = np.argsort(keys)
        self.keys, self.number = keys[order], np.arange(len(lexicon))[order]
        self.dense = np.array([d for _, d in lexicon], bool)
        self.address = np.sort(_hashes(ADDRESS))
        # An entry's presence and its rate, and the patterns.
        self.size = 2 * len(lexicon) + N_EXTRA

    def __call__(self, texts: tb.Texts):
        """Vote pattern of each text, and its features as ``(text, feature, value)``."""
        words = tb.Words(texts, tb.ALNUM)
        n, entries = texts.n, len(self.keys)
        hits, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for of, keys in ((np.arange(len(words)), words.hash), *(_beginnings(words, k) for k in BEGINNINGS)) if entries else ():
            at = np.minimum(np.searchsorted(self.keys, keys), entries - 1)
            same = self.keys[at] == keys
            hits.append(of[same])
            numbers.append(self.number[at[same]])
        hit, number = np.concatenate(hits), np.concatenate(numbers)
        pair, times = np.unique(words.doc[hit] * max(entries, 1) + number, return_counts=True)
        d, w = pair // max(entries, 1), pair % max(entries, 1)
        hundred = np.maximum(words.n, 1) / 100
        rate = times / hundred[d]
        hit = np.unique(hit)  # words that any entry fits
        doc = words.doc[hit]
        _, first = np.unique(tb.mix(words.hash[hit] + doc.astype(np.uint64) * tb.PLACE[10]), return_index=True)
        distinct = np.bincount(doc[first], minlength=n)
        whole = np.bincount(doc, minlength=n) / hundred
        votes = np.zeros((len(VOTERS), n), np.int64)  # 0 abstains, 1 toxic, 2 clean
        told = rate >= np.where(self.dense[w], DENSE, 0) if entries else np.zeros(0, bool)
        for i in range(DEALT):
            votes[i, d[told & (w % DEALT == i)]] = 1
        votes[DEALT] = np.where(whole >= DENSE, 1, 0)
        to = np.isin(words.hash, self.address)
        near = np.concatenate(([0], np.cumsum(to)))
        low, high = np.maximum(hit - 4, words.off[doc]), np.minimum(hit + 5, words.off[doc + 1])
        votes[DEALT + 1, doc[near[high] > near[low]]] = 1
        votes[DEALT + 2] = np.where(distinct >= 2, 1, np.where(distinct == 0, 2, 0))
        shout = texts.count(_MARK) / np.maximum(words.n, 1)
        votes[DEALT + 3] = np.where(shout >= 0.2, 1, 0)
        pattern = (votes * 3 ** np.arange(len(VOTERS))[:, None]).sum(axis=0)
        extra = np.stack([np.log1p(distinct), np.minimum(whole, 4), votes[DEALT + 1] == 1, np.minimum(shout, 1)])
        row, col = np.nonzero(extra.T)
        text = np.concatenate((d, d, row))
        feature = np.concatenate((w, entries + w, 2 * entries + col))
        value = np.concatenate((np.ones(len(d)), np.minimum(rate, 4), extra.T[row, col]))
        return pattern, text, feature, value


def _unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(VOTERS)) % 3


@dataclass(frozen=True)
class LabelModel:
    """``prior[y]``, for each voter its parent in the correlation tree (-1: none),
    and ``table[voter][y, parent's vote, vote]``."""

    prior: np.ndarray
    parent: list[int]
    table: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = _unpack(patterns)
        log = np.tile(np.log(self.prior), (len(votes), 1))
        for j, p in enumerate(self.parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            log += np.log(self.table[j][:, above, votes[:, j]]).T
        top = log - log.max(axis=1, keepdims=True)
        e = np.exp(top)
        return e[:, 1] / e.sum(axis=1)


def fit_label_model(patterns: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 40) -> LabelModel:
    """Expectation maximisation over distinct ``(pattern, label)`` with their
    numbers; ``label`` is 0, 1, or -1 where unknown."""
    votes = _unpack(patterns)
    m = votes.shape[1]
    lean = (votes == 1).sum(axis=1) - 0.5 * (votes == 2).sum(axis=1)
    belief = np.where(label >= 0, label, np.where(lean >= 1, 0.9, 0.02))
    model = None
    for step in range(rounds):
        w = np.stack([weight * (1 - belief), weight * belief])
        if step % 10 == 0:  # the tree follows the beliefs, not every round
            info = np.zeros((m, m))
            for i in range(m):
                for j in range(i):
                    joint = np.stack([np.bincount(3 * votes[:, i] + votes[:, j], w[y], 9).reshape(3, 3) for y in (0, 1)]) + 1e-3
                    total = joint.sum()
                    ratio = joint * joint.sum(axis=(1, 2), keepdims=True) / (
                        joint.sum(axis=2, keepdims=True) * joint.sum(axis=1, keepdims=True))
                    info[i, j] = info[j, i] = (joint / total * np.log(ratio)).sum()
            parent, inside = [-1] * m, [0]
            while len(inside) < m:
                gain, i, j = max((info[i, j], -i, j) for j in inside for i in range(m) if i not in inside)
                parent[-i] = j
                inside.append(-i)
        prior = w.sum(axis=1) + 1
        table = np.zeros((m, 2, 3, 3))
        for j, p in enumerate(parent):
            above = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            for y in (0, 1):
                table[j, y] = np.bincount(3 * above + votes[:, j], w[y], 9).reshape(3, 3) + 0.1
        table /= table.sum(axis=3, keepdims=True)
        model = LabelModel(prior / prior.sum(), parent, table)
        belief = np.where(label >= 0, label, model.posterior(patterns))
    return model


def fit_classifier(row, feature, value, target, size: int, rounds: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression (Newton steps) on sparse features; the last weight is
    the constant."""
    n = len(target)
    x = np.zeros((n, size + 1), np.float32)
    x[row, feature] = value
    x[:, size] = 1
    w = np.zeros(size + 1)
    w[size] = np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    penalty = np.full(size + 1, ridge)
    penalty[size] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (target - p) - penalty * w
        hessian = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(penalty)
        move = np.linalg.solve(hessian.astype(np.float64), gradient)
        w = w + np.clip(move, -3, 3)
        if np.abs(move).max() < 1e-4:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: list[tuple[str, bool]]
    label_model: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """Lexicon, label model and classifier.  Vote patterns of all training
    documents are counted (there are at most ``3 ** len(VOTERS)``); words and
    features come from at most ``sample`` labelled rows."""
    data = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    picked = labelled_sample(data, labels, sample)
    lexicon = learn_lexicon(picked)
    features = Features(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]):
        total: dict[int, int] = {}
        for batch in tb.slices(batches):
            pattern, *_ = features(tb.Texts(batch.column(1)))
            for p, n in zip(*(x.tolist() for x in np.unique(pattern, return_counts=True)), strict=True):
                total[p] = total.get(p, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
                                         ["pattern", "n"])

    def describe(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches):
            texts = tb.Texts(batch.column(1))
            pattern, text, feature, value = features(texts)
            order = np.argsort(text, kind="stable")
            off = pa.array(np.searchsorted(text[order], np.arange(texts.n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2).cast(pa.int32()), pa.array(pattern),
                 pa.ListArray.from_arrays(off, pa.array(feature[order].astype(np.int32))),
                 pa.ListArray.from_arrays(off, pa.array(value[order]))],
                ["doc_id", "toxic", "pattern", "feature", "value"])

    everything = (data.where(~held_out()).mapInArrow(vote, "pattern long, n long")
                  .groupBy("pattern").agg(F.sum("n").alias("n")).collect())
    rows = (picked.mapInArrow(describe, "doc_id long, toxic int, pattern long, feature array<int>, value array<double>")
            .orderBy("doc_id").limit(sample).collect())
    # The sample's rows are part of all rows: what is left of a pattern is unlabelled.
    known: dict[tuple[int, int], int] = {}
    for r in rows:
        key = (r.pattern, int(r.toxic == 1))
        known[key] = known.get(key, 0) + 1
    free = {r.pattern: r.n - known.get((r.pattern, 0), 0) - known.get((r.pattern, 1), 0) for r in everything}
    keys = [*known, *((p, -1) for p in sorted(free) if free[p] > 0)]
    counts = [*known.values(), *(free[p] for p in sorted(free) if free[p] > 0)]
    patterns, label = (np.array(x, np.int64) for x in (list(zip(*keys)) or [[0], [-1]]))
    model = fit_label_model(patterns, label, np.array(counts or [1], float))
    if rows:
        own = np.array([r.pattern for r in rows], np.int64)
        odds = np.log(np.clip(model.posterior(own), 1e-9, 1 - 1e-9) / np.clip(1 - model.posterior(own), 1e-9, 1 - 1e-9))
        told = np.where(np.array([r.toxic == 1 for r in rows]), 1, -1) * np.log(LABELLED / (1 - LABELLED))
        target = 1 / (1 + np.exp(-(odds + told)))
        index = np.repeat(np.arange(len(rows)), [len(r.feature) for r in rows])
        weights = fit_classifier(index, np.array([f for r in rows for f in r.feature], np.int64),
                                 np.array([v for r in rows for v in r.value]), target, features.size)
    else:  # no labelled text: the patterns stand for the texts
        seen = np.unique(patterns)
        votes = _unpack(seen)
        several = votes[:, DEALT + 2] == 1
        row, feature = np.flatnonzero(several), np.full(int(several.sum()), features.size - N_EXTRA)
        weights = fit_classifier(row, feature, np.full(len(row), np.log(3.0)), model.posterior(seen), features.size)
    return ToxicityModel(lexicon, model, weights)


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``."""
    features, weights = Features(model.lexicon), model.weights

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches):
            texts = tb.Texts(batch.column(1))
            _, text, feature, value = features(texts)
            z = np.bincount(text, weights[feature] * value, texts.n) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])

    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       held_out(id_col).alias("held_out"))
    return data.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
