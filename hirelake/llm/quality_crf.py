"""Quality rules by line sequence labelling (operator 10).

A linear-chain conditional random field labels every line of a text as content
or boilerplate; Viterbi decoding picks the best sequence, and the share of
words that stand in content lines decides whether the document stays.

* ``line_features``: one row per document with the binned features of its lines.
* ``fit_line_crf``: trains the field on a bounded sample of labelled documents.
* ``score_quality``: rule counts, content share and verdict for every document.

Nulls and edge cases: a null text has no words and fails the base rule; a
document without lines with words has content share 0; repeated rows are judged
row by row; an empty table gives an empty result; columns other than the id and
the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm import textbuf as tb

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?:;")] = True

#: Bin edges of the numeric line features; a value's feature is its bin.
BINS = {
    "symbols_per_word": (1e-9, 0.2, 0.6),
    "marks_per_word": (1e-9, 0.3, 0.8),
    "upper_share": (0.15, 0.5, 0.8),
    "digit_share": (1e-9, 0.2, 0.5),
    "words": (1, 3, 6, 12, 40),
    "mean_word": (2.5, 4, 7, 10),
    "repeat_share": (1e-9, 0.3, 0.7),
    "stops_per_word": (1e-9, 0.02, 0.3),
    "repeated_line": (0.5,),
}
_SIZES = np.array([len(e) + 1 for e in BINS.values()])
_FIRST = np.concatenate(([0], np.cumsum(_SIZES)))
#: Number of distinct feature values; each line has one value per feature.
N_FEATURES = int(_FIRST[-1])


@dataclass(frozen=True)
class LineCrf:
    """Weights of the two-state chain; state 1 is content.

    ``emit[f, y]`` for the features of ``BINS``, ``step[y, z]`` for neighbouring
    lines, ``start[y]`` for the first line."""

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray


def default_crf() -> LineCrf:
    """Prior weights, used where no labelled documents of both kinds exist:
    lines full of symbols, marks, capitals or repeats lean to boilerplate."""
    emit = np.zeros((N_FEATURES, 2))
    for j, name in enumerate(BINS):
        bad = {"symbols_per_word": (0, 0.5, 2, 3), "marks_per_word": (0, 0.5, 1.5, 3),
               "upper_share": (0, 0.5, 1.5, 2), "repeat_share": (0, 0.2, 1, 2),
               "digit_share": (0, 0, 0.3, 1)}.get(name, ())
        for b, w in enumerate(bad):
            emit[_FIRST[j] + b, 0] = w
    return LineCrf(emit, np.array([[0.5, 0.0], [0.0, 0.5]]), np.array([0.0, 1.5]))


class _Lines:
    """Counts per document and per line of one batch of texts."""

    def __init__(self, texts: tb.Texts):
        words = tb.Words(texts, tb.SPACED, lower=False)
        self.n_words = words.n
        points = texts.points
        letters = points[words.end] - points[words.start]
        self.word_chars = tb.per_doc(letters, words.off)
        self.n_symbols = texts.count(_SYMBOLS)

        grams, first = words.window_hashes(3)
        doc = words.doc
        _, times = tb.first_of_equal(tb.mix(grams + doc[first].astype(np.uint64) * tb.PLACE[20]))
        twice = first[times >= 2]
        repeated = np.zeros(len(words), bool)
        for j in range(3):
            repeated[twice + j] = True
        self.n_repeat_words = tb.per_doc(repeated, words.off)

        data, off = texts.data, texts.off
        # Lines with a word: each begins after a document start or a line feed.
        breaks = np.flatnonzero(data == 10)
        starts = np.union1d(off[:-1], breaks + 1)
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        at = np.searchsorted(words.start, starts)
        to = np.searchsorted(words.start, ends)
        some = to > at
        starts, ends, at, to = starts[some], ends[some], at[some], to[some]
        # The line feed that ends a line is not part of it.
        ends = ends - (data[ends - 1] == 10) if len(ends) else ends
        self.n = to - at
        self.doc = np.searchsorted(off, starts, side="right") - 1
        keys = tb.range_hashes(data, starts, ends, lower=False)
        same, _ = tb.first_of_equal(tb.mix(keys + self.doc.astype(np.uint64) * tb.PLACE[21]))
        self.off = np.searchsorted(self.doc, np.arange(texts.n + 1))
        self.n_dup_lines = tb.per_doc(same, self.off)

        def inside(table):
            total = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
            return total[ends] - total[starts]

        def of_words(values):
            total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
            return total[to] - total[at]

        size = np.maximum(self.n, 1)
        upper, low = inside(_UPPER), inside(_LOWER)
        chars = np.maximum(of_words(letters), 1)
        stops = _STOP[data[words.end - 1]] if len(words) else np.zeros(0, bool)
        values = {
            "symbols_per_word": inside(_SYMBOLS) / size,
            "marks_per_word": inside(_MARK) / size,
            "upper_share": upper / np.maximum(upper + low, 1),
            "digit_share": inside(_DIGIT) / chars,
            "words": self.n,
            "mean_word": chars / size,
            "repeat_share": of_words(repeated) / size,
            "stops_per_word": of_words(stops) / size,
            "repeated_line": same,
        }
        self.features = np.stack([_FIRST[j] + np.searchsorted(edges, values[k], side="right")
                                  for j, (k, edges) in enumerate(BINS.items())], axis=1)


def _viterbi(crf: LineCrf, features: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The best state of every line; documents advance side by side, the
    longest first, so that each step works on the documents still open."""
    score = crf.emit[features].sum(axis=1)
    length = np.diff(off)
    order = np.argsort(-length, kind="stable")
    begin, length = off[:-1][order], length[order]
    best = np.zeros((len(features), 2), np.int8)
    states = np.zeros(len(features), np.int8)
    most = int(length[0]) if len(length) else 0
    if not most:
        return states
    alive = int(np.searchsorted(-length, 0, side="left"))
    v = crf.start + score[begin[:alive]]
    final = np.zeros((len(length), 2))
    final[:alive] = v
    for t in range(1, most):
        alive = int(np.searchsorted(-length, -t, side="left"))  # documents with more than t lines
        reach = v[:alive, :, None] + crf.step
        at = begin[:alive] + t
        best[at] = reach.argmax(axis=1)
        v = reach.max(axis=1) + score[at]
        final[:alive] = v
    now = final.argmax(axis=1)
    for t in range(most - 1, -1, -1):
        alive = int(np.searchsorted(-length, -t, side="left"))
        at = begin[:alive] + t
        states[at] = now[:alive]
        now[:alive] = best[at, now[:alive]]
    return states


def line_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_lines, features)`` per document: for each line with a word
    its feature values of ``BINS``, concatenated."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches):
            lines = _Lines(tb.Texts(batch.column(1)))
            width = len(BINS)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(np.diff(lines.off), pa.int64()),
                pa.LargeListArray.from_arrays(pa.array(lines.off * width, pa.int64()),
                                              pa.array(lines.features.reshape(-1), pa.int32())).cast(pa.list_(pa.int32())),
            ], ["doc_id", "n_lines", "features"])

    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return data.mapInArrow(run, "doc_id long, n_lines long, features array<int>")


def fit_line_crf(docs: DataFrame, labels: DataFrame, sample_docs: int = 1000,
                 max_lines: int = 150_000, steps: int = 40) -> LineCrf:
    """Train the chain on a bounded sample of labelled documents.

    The sample is the ``sample_docs`` labelled documents with the smallest
    crc32 of their id (and of those at most ``max_lines`` lines in all); only
    their feature codes reach the driver.  Documents with label ``quality`` 1
    give content lines.  In a document with label 0 a line counts as
    boilerplate if its features are likelier under label 0 than under label 1
    (naive Bayes over the sample).  The chain is then fitted by gradient
    ascent on the conditional likelihood.  Without documents of both labels
    the default weights are returned."""
    wanted = (labels.where("quality is not null and doc_id is not null")
              .groupBy("doc_id").agg(F.max("quality").alias("quality"))
              .orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(sample_docs))
    picked = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    rows = (line_features(picked).where("n_lines > 0").join(F.broadcast(wanted), "doc_id")
            .orderBy("doc_id").limit(sample_docs).collect())
    seqs, ys, total = [], [], 0
    for r in rows:
        if total + r.n_lines > max_lines:
            continue
        total += r.n_lines
        seqs.append(np.array(r.features, np.int64).reshape(-1, len(BINS)))
        ys.append(int(r.quality))
    if len(set(ys)) < 2:
        return default_crf()
    return _train(seqs, np.array(ys), steps)


def _train(seqs: list[np.ndarray], quality: np.ndarray, steps: int) -> LineCrf:
    lines = np.concatenate(seqs)
    off = np.concatenate(([0], np.cumsum([len(s) for s in seqs])))
    of_good = np.repeat(quality == 1, np.diff(off))
    tally = np.ones((N_FEATURES, 2))
    np.add.at(tally, (lines.reshape(-1), np.repeat(of_good, lines.shape[1]).astype(int)), 1.0)
    tally /= np.array([(~of_good).sum() + 1, of_good.sum() + 1])
    odds = np.log(tally[:, 1] / tally[:, 0])[lines].sum(axis=1)
    label = (of_good | (odds > 0)).astype(int)

    order = np.argsort(-np.diff(off), kind="stable")
    length, begin = np.diff(off)[order], off[:-1][order]
    most, n = int(length[0]), len(length)
    where = np.minimum(begin[:, None] + np.arange(most), len(lines) - 1)
    live = np.arange(most) < length[:, None]
    open_at = live.sum(axis=0)  # sequences with more than t lines; the longest come first
    y = label[where]
    emit, step, start = np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)
    params, speed = [emit, step, start], 0.5
    square = [np.full_like(p, 1e-6) for p in params]

    def lse(a, axis):
        m = a.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(steps):
        score = emit[lines].sum(axis=1)[where]
        fwd = np.zeros((most, n, 2))
        back = np.zeros((most, n, 2))
        fwd[0] = start + score[:, 0]
        z = lse(fwd[0], 1)
        for t in range(1, most):
            k = open_at[t]
            fwd[t, :k] = lse(fwd[t - 1, :k, :, None] + step, 1) + score[:k, t]
            z[:k] = lse(fwd[t, :k], 1)
        for t in range(most - 2, -1, -1):
            k = open_at[t + 1]
            back[t, :k] = lse(step + (score[:k, t + 1] + back[t + 1, :k])[:, None, :], 2)
        post = np.exp(np.minimum(fwd + back - z[None, :, None], 0)).transpose(1, 0, 2) * live[:, :, None]
        truth = np.eye(2)[y] * live[:, :, None]
        diff = np.empty((len(lines), 2))
        diff[where[live]] = (truth - post)[live]
        g_emit = np.stack([np.bincount(lines.reshape(-1), np.repeat(diff[:, k], lines.shape[1]), N_FEATURES)
                           for k in (0, 1)], axis=1)
        g_start = (truth - post)[:, 0].sum(axis=0)
        g_step = np.zeros((2, 2))
        for t in range(1, most):
            k = open_at[t]
            pair = fwd[t - 1, :k, :, None] + step + (score[:k, t] + back[t, :k])[:, None, :] - z[:k, None, None]
            g_step += (np.bincount(2 * y[:k, t - 1] + y[:k, t], minlength=4).reshape(2, 2)
                       - np.exp(pair).sum(axis=0))
        for p, g, s in zip(params, (g_emit, g_step, g_start), square, strict=True):
            g = g / len(lines) - 0.001 * p
            s += g * g
            p += speed * g / np.sqrt(s)
    return LineCrf(emit, step, start)


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
          "n_repeat_words long, n_lines long, n_content_lines long, content_share double, "
          "base_failed boolean, kept boolean")


def _verdicts(texts: tb.Texts, crf: LineCrf, min_share: float):
    """Counts and verdict of each text of a batch, in the order of ``SCHEMA``."""
    x = _Lines(texts)
    content = _viterbi(crf, x.features, x.off).astype(bool)
    share = tb.per_doc(np.where(content, x.n, 0), x.off) / np.maximum(x.n_words, 1)
    failed = (x.n_words < MIN_WORDS) | (100 * x.n_repeat_words > MAX_REPEAT_PERCENT * x.n_words)
    counts = [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words,
              np.diff(x.off), tb.per_doc(content, x.off)]
    return [*(pa.array(c, pa.int64()) for c in counts), pa.array(share), pa.array(failed),
            pa.array(~failed & (share >= min_share))]


def score_quality(docs: DataFrame, crf: LineCrf, min_share: float = 0.5,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rule counts, content share and verdict, one row per row of ``docs``.

    A document fails the base rule with fewer than ``MIN_WORDS`` words or more
    than ``MAX_REPEAT_PERCENT`` percent of its words in repeated three-word
    windows.  It is kept if it passes and at least ``min_share`` of its words
    stand in lines that the chain decodes as content."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *_verdicts(tb.Texts(batch.column(1)), crf, min_share)],
                [c.split()[0] for c in SCHEMA.split(", ")])

    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return data.mapInArrow(run, SCHEMA)


def keep_quality(docs: DataFrame, crf: LineCrf, min_share: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, in one pass."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches, text_col):
            yield batch.filter(_verdicts(tb.Texts(batch.column(at)), crf, min_share)[-1])

    return docs.mapInArrow(run, docs.schema)
