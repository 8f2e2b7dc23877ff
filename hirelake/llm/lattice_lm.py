"""Language-model scores by subword lattice likelihood (operator 4).

The model writes a word as a sequence of pieces of an existing vocabulary and a
stop; the word's lattice probability sums over all of its segmentations (forward
recursion in log space).  No piece crosses white space, so a text's
probability is the product over its words and the recursion runs once for each
distinct word.  The vocabulary's own scores (ranks, read as a Zipf law) are the first
piece weights; expectation maximisation over the training words, each with its
count, then re-weights them, until the likelihood stops rising or for ``EM_ROUNDS``.
The vocabulary itself is never trained.  ``score`` is this lattice likelihood; no word has
a count in it.

Beside it, ``mixture_score`` keeps the discounted share of words seen in training, and
gives the discounted mass to the lattice (absolute discounting):

    P(word) = max(c - D, 0) / N + D * V / N * P_lattice(word)

Training documents may be told apart by a column such as their language; each
class then has counts and piece weights of its own, and the text's probability is
the marginal over classes.  Scoring never reads the class of a document.

Counts cover all training words and are never cut.  Scoring sends the at
most ``FREQUENT`` most frequent words to every task, and joins all others by word,
so neither side of it depends on the size of the vocabulary.

Nulls and edge cases: a null text is an empty one and has one token, the end; a
null id counts as training; repeated rows are counted and scored each; classes
beyond the ``CLASSES`` with most documents, and null, are one class; without
training words the lattice with its first weights is the model; an empty table
gives an empty result; columns other than id, text and class are ignored.
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

#: Most words that are sent to every task (hash, count and two scores a class: 80 bytes each).
FREQUENT = 1 << 18
EM_ROUNDS = 3
#: Gain in log probability a word below which re-weighting ends.
LEAST_GAIN = 0.005
#: Most classes of training documents, that for all the rest included.
CLASSES = 8
_SLICE = 1 << 18
_START = 256  # code of the mark before a word
_rng = np.random.Generator(np.random.PCG64(32))
_CODE = _rng.integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0xD6E8FEB86659FD93)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """All segmentations of words into pieces of a vocabulary.

    A piece is a string of codes: bytes, or ``_START`` for the mark before a
    word.  Bytes without a piece of their own are pieces, too, so every word
    has a segmentation."""

    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces: dict[tuple, float] = {}
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
                continue
            text = model.id_to_piece(i)
            codes = [c for ch in text for c in ([_START] if ch == "▁" else ch.encode())]
            pieces.setdefault(tuple(codes), model.get_score(i))
        for c in range(257):
            pieces.setdefault((c,), min(pieces.values(), default=0.0))
        self.n = len(pieces)
        ranks = np.array([-s for s in pieces.values()])
        weight = 1 / (ranks - ranks.min() + 50)
        #: First log weights of the pieces and, last, of the stop.
        self.first = np.log(np.append(weight / weight.sum() * 0.75, 0.25))
        prefix: dict[int, int] = {}
        for i, codes in enumerate(pieces):
            h = 0
            for k, c in enumerate(codes):
                h = (h * int(_FACTOR) + int(_CODE[c])) % (1 << 64)
                if k == len(codes) - 1:
                    prefix[h] = i
                else:
                    prefix.setdefault(h, -1)
        self.hash = np.array(sorted(prefix), np.uint64)
        self.piece = np.array([prefix[int(h)] for h in self.hash], np.int64)
        self.longest = max(map(len, pieces))

    def arcs(self, texts: tb.Texts):
        """``(start node, end node, piece, end offset, start offset)`` of all
        pieces in the words, and the first node of each word (and the end)."""
        n = texts.n
        off = texts.off + np.arange(n + 1)
        codes = np.empty(off[-1], np.int64)
        codes[off[:-1]] = _START
        rest = np.ones(len(codes), bool)
        rest[off[:-1]] = False
        codes[rest] = texts.data
        word = np.repeat(np.arange(n), np.diff(off))
        end, value = off[1:][word], _CODE[codes]
        alive, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        starts, sizes, pieces = [], [], []
        for k in range(1, self.longest + 1):
            fits = alive + k <= end[alive]
            alive, h = alive[fits], h[fits]
            if not len(alive):
                break
            h = h * _FACTOR + value[alive + k - 1]
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            known = self.hash[at] == h
            alive, h, at = alive[known], h[known], at[known]
            whole = self.piece[at] >= 0
            starts.append(alive[whole])
            sizes.append(np.full(int(whole.sum()), k))
            pieces.append(self.piece[at[whole]])
        start, size, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, sizes, pieces))
        offset = start - off[word[start]]
        node = start + word[start]
        return node, node + size, piece, offset + size, offset, off + np.arange(n + 1)


def _sweep(total: np.ndarray, source, target, weight, step) -> None:
    """Log-space sums along arcs into their targets, in the order of ``step``."""
    order = np.lexsort((target, step))
    source, target, weight, step = source[order], target[order], weight[order], step[order]
    cuts = np.append(np.flatnonzero(np.concatenate(([True], step[1:] != step[:-1]))), len(step)) if len(step) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        to = target[a:b]
        first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        v = total[source[a:b]] + weight[a:b]
        top = np.maximum.reduceat(v, first)
        many = np.diff(np.append(first, b - a))
        total[to[first]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), first))


def lattice_scores(lattice: Lattice, logq: list[np.ndarray], texts: tb.Texts, used: np.ndarray | None = None):
    """Log probability of each word under each set of piece weights; with
    ``used`` (set, word) also the expected uses of the pieces and the stop in words
    that occur so many times."""
    source, target, piece, end, begin, nodes = lattice.arcs(texts)
    last = nodes[1:] - 1
    word = np.searchsorted(nodes, source, side="right") - 1
    scores, uses = [], []
    for k, q in enumerate(logq):
        weight = q[piece]
        fwd = np.full(nodes[-1], -np.inf)
        fwd[nodes[:-1]] = 0.0
        if used is None:
            _sweep(fwd, source, target, weight, end)
        else:
            own = used[k][word] > 0
            _sweep(fwd, source[own], target[own], weight[own], end[own])
            back = np.full(nodes[-1], -np.inf)
            back[last] = 0.0
            _sweep(back, target[own], source[own], weight[own], -begin[own])
            share = np.exp(fwd[source[own]] + weight[own] + back[target[own]] - fwd[last][word[own]])
            times = used[k][word[own]]
            uses.append(np.append(np.bincount(piece[own], share * times, lattice.n), used[k].sum()))
        scores.append(fwd[last] + q[-1])
    return (scores, uses) if used is not None else scores


_lattices: dict[str, Lattice] = {}


def _lattice(path: str | None) -> Lattice:
    path = path or default_vocabulary()
    if path not in _lattices:
        _lattices[path] = Lattice(path)
    return _lattices[path]


def held_out(id_col: str, folds: int = 5, fold: int = 1):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def _class_names(data: DataFrame) -> list[str]:
    """Classes with counts of their own: those with most training documents."""
    rows = (data.where("not held_out").groupBy("class").count().where("class is not null")
            .orderBy(F.desc("count"), "class").limit(CLASSES - 1).collect())
    return [r["class"] for r in rows]


def word_counts(data: DataFrame, names: list[str]) -> DataFrame:
    """``(word, t, c0, c1, ...)``: the count of every word in all texts of
    ``(doc_id, text, held_out, class)``, and in training by class."""
    size = len(names) + 1
    columns = [f"c{k}" for k in range(size)]

    def run(batches: Iterator[pa.RecordBatch]):
        numbers = {name: k for k, name in enumerate(names)}
        for batch in tb.slices(batches, "text", 8 << 20):
            words = tb.Words(tb.Texts(batch.column(1)), tb.SPACED)
            train = ~np.asarray(batch.column(2).to_numpy(zero_copy_only=False), bool)
            own = np.array([numbers.get(x, size - 1) for x in batch.column(3).to_pylist()], np.int64)
            _, first, inverse, times = np.unique(words.hash, return_index=True, return_inverse=True, return_counts=True)
            doc = words.doc
            c = np.bincount(inverse * size + own[doc], train[doc], len(first) * size).astype(np.int64).reshape(-1, size)
            low = tb.LOWER[words.texts.data].tobytes()
            names_ = [low[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names_, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()),
                 *(pa.array(np.ascontiguousarray(c[:, k])) for k in range(size))], ["word", "t", *columns])

    schema = ", ".join(["word string", "t long", *(f"{c} long" for c in columns)])
    return (data.select("doc_id", "text", "held_out", "class").mapInArrow(run, schema)
            .groupBy("word").agg(*(F.sum(c).alias(c) for c in ("t", *columns))))


@dataclass(frozen=True)
class ClassModel:
    """Share of the documents, totals of the training tokens, piece weights."""

    share: float
    tokens: int
    types: int
    ends: int
    discount: float
    logq: np.ndarray

    def log(self, c, lattice) -> np.ndarray:
        """Log probability of words of count ``c`` and log lattice score."""
        if not self.tokens:
            return np.asarray(lattice)
        own = np.maximum(np.asarray(c) - self.discount, 0) / self.tokens
        spare = math.log(self.discount * self.types / self.tokens)
        return np.logaddexp(np.log(np.maximum(own, 1e-300)), spare + lattice)


@dataclass(frozen=True)
class LatticeModel:
    """Names of the classes (the last, unnamed one holds the rest), their models,
    and the training tokens, types and documents of all."""

    names: list[str]
    classes: list[ClassModel]
    tokens: int
    types: int
    ends: int

    def base(self, c) -> np.ndarray:
        return np.log10((np.asarray(c) + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def fit(data: DataFrame, counts: DataFrame, names: list[str], vocabulary: str | None = None,
        rounds: int = EM_ROUNDS) -> LatticeModel:
    """Totals, discounts (from the numbers of words seen once and twice) and piece
    weights; only these and one row per piece and class reach the driver."""
    spark = data.sparkSession
    size = len(names) + 1
    number = F.lit(size - 1)
    for k, name in enumerate(names):
        number = F.when(F.col("class") == name, F.lit(k)).otherwise(number)
    ends = {r["k"]: r["count"] for r in data.where("not held_out").groupBy(number.alias("k")).count().collect()}
    total = sum((F.col(f"c{k}") for k in range(1, size)), F.col("c0"))
    parts = [F.sum((total > 0).cast("long")).alias("types")]
    for k in range(size):
        c = F.col(f"c{k}")
        parts += [F.sum(c).alias(f"n{k}"), *(F.sum(x.cast("long")).alias(f"{name}{k}") for name, x in
                                             (("v", c > 0), ("one", c == 1), ("two", c == 2)))]
    r = counts.agg(*parts).first().asDict()
    r = {k: v or 0 for k, v in r.items()}
    lattice = _lattice(vocabulary)
    logq, last = [lattice.first] * size, -math.inf
    for _ in range(rounds if r["types"] else 0):
        sent = spark.sparkContext.broadcast(logq)

        def run(batches: Iterator[pa.RecordBatch], sent=sent):
            own = _lattice(vocabulary)
            uses = np.zeros((size, own.n + 2))  # the last: log probability of all
            for batch in tb.slices(batches, "word", _SLICE):
                used = np.stack([np.asarray(batch.column(1 + k), float) for k in range(size)])
                scores, own_uses = lattice_scores(own, sent.value, tb.Texts(batch.column(0)), used)
                uses[:, :-1] += np.stack(own_uses)
                uses[:, -1] += [float(s[u > 0] @ u[u > 0]) for s, u in zip(scores, used, strict=True)]
            k, piece = np.nonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(piece, pa.int32()), pa.array(uses[k, piece])],
                                             ["k", "piece", "uses"])

        rows = (counts.where(total > 0).select("word", *(f"c{k}" for k in range(size)))
                .mapInArrow(run, "k int, piece int, uses double").groupBy("k", "piece").agg(F.sum("uses").alias("uses")).toArrow())
        uses = np.tile(np.append(np.exp(lattice.first), 0), (size, 1))  # the vocabulary's weights count as one use in all
        k, piece = (np.asarray(rows.column(c), np.int64) for c in ("k", "piece"))
        uses[k, piece] += np.asarray(rows.column("uses"))
        found, uses = uses[:, -1].sum(), uses[:, :-1]
        if found - last < LEAST_GAIN * sum(r[f"n{k}"] for k in range(size)):
            break
        last = found
        logq = list(np.log(uses / uses.sum(axis=1, keepdims=True)))
    classes, docs = [], max(sum(ends.values()), 1)
    for k in range(size):
        own, one, two = ends.get(k, 0), r[f"one{k}"], r[f"two{k}"]
        discount = min(max(one / (one + 2 * two), 0.1), 0.95) if one and two else 0.5
        classes.append(ClassModel(own / docs if ends else 1 / size, r[f"n{k}"] + own, r[f"v{k}"] + (own > 0), own, discount, logq[k]))
    return LatticeModel(names, classes, sum(c.tokens for c in classes), r["types"] + (sum(ends.values()) > 0), sum(ends.values()))


def score_texts(docs: DataFrame, vocabulary: str | None = None, frequent: int = FREQUENT,
                id_col: str = "doc_id", text_col: str = "text", class_col: str | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    mixture_score)``, one row per row of ``docs``.

    Learns from the documents whose crc32 of the id leaves another remainder than
    1 by 5, scores all; the scores are log10 probabilities: ``score`` of the lattice,
    ``mixture_score`` of words mixed from their counts and the lattice."""
    spark = docs.sparkSession
    kind = F.col(class_col).cast("string") if class_col else F.lit(None).cast("string")
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       held_out(id_col).alias("held_out"), kind.alias("class"))
    names = _class_names(data) if class_col else []
    size = len(names) + 1
    columns = [f"c{k}" for k in range(size)]
    counts = materialize(word_counts(data, names), "words")
    model = fit(data, counts, names, vocabulary)
    sent = spark.sparkContext.broadcast(model)
    # By class: the mixture's score, then the lattice's own.
    ranks = [f"{x}{k}" for x in "sl" for k in range(size)]
    sums = [f"sum_{x}" for x in ranks]

    def rate(batches: Iterator[pa.RecordBatch]):
        """Total training count and log probabilities by class of each word."""
        own, lattice = sent.value, _lattice(vocabulary)
        for batch in tb.slices(batches, "word", _SLICE):
            c = [np.asarray(batch.column(2 + k)) for k in range(size)]
            lattices = lattice_scores(lattice, [m.logq for m in own.classes], tb.Texts(batch.column(0)))
            scores = [*(m.log(n, x) for m, n, x in zip(own.classes, c, lattices, strict=True)), *lattices]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sum(c)), *(pa.array(x.astype(np.float32)) for x in scores)],
                ["word", "t", "c", *ranks])

    rated = materialize(counts.select("word", "t", *columns).mapInArrow(
        rate, ", ".join(["word string", "t long", "c long", *(f"{x} float" for x in ranks)])), "rated")
    # The words of the highest bins of counts that together hold no more than ``frequent``.
    binned = rated.withColumn("bin", F.floor(F.log2("t") * 16))
    least, total = 1 << 40, 0
    for r in binned.groupBy("bin").count().orderBy(F.desc("bin")).collect():
        total += r["count"]
        if total > frequent:
            break
        least = r["bin"]
    often = binned["bin"] >= least
    table = binned.where(often).select("word", "c", *ranks).toArrow()
    texts = tb.Texts(pa.array(table.column("word").to_pylist(), pa.string()))
    keys = tb.range_hashes(texts.data, texts.off[:-1], texts.off[1:], lower=False)
    order = np.argsort(keys)
    known = spark.sparkContext.broadcast(
        (keys[order], np.asarray(table.column("c"), np.int64)[order],
         np.stack([np.asarray(table.column(x), np.float32)[order] for x in ranks])))
    fields = ["row", "doc_id", "held_out", "word", "n", "n_tokens", "n_known", "base", *sums]

    def look_up(batches: Iterator[pa.RecordBatch]):
        keys, counts_, scores = known.value
        own = sent.value
        # The end is a word of no bytes: its lattice is the stop alone.
        ends = [float(m.log(np.array([m.ends]), np.array([m.logq[-1]]))[0]) for m in own.classes]
        ends += [float(m.logq[-1]) for m in own.classes]
        for batch in tb.slices(batches):
            words = tb.Words(tb.Texts(batch.column(2)), tb.SPACED)
            n = words.texts.n
            at = np.minimum(np.searchsorted(keys, words.hash), max(len(keys) - 1, 0))
            found = keys[at] == words.hash if len(keys) else np.zeros(len(words), bool)
            at = at[found]

            def total(values, found=found, words=words):
                spread = np.zeros(len(words), values.dtype)
                spread[found] = values
                run = np.concatenate(([0], np.cumsum(spread, dtype=np.float64 if values.dtype.kind == "f" else None)))
                return run[words.off[1:]] - run[words.off[:-1]]

            ids = [batch.column(0), batch.column(1), batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.nulls(n, pa.string()), pa.array(np.zeros(n, np.int64)), pa.array(words.n + 1, pa.int64()),
                 pa.array(total((counts_[at] > 0).astype(np.int64)) + int(own.ends > 0)),
                 pa.array(total(own.base(counts_[at])) + float(own.base(own.ends))),
                 *(pa.array(total(scores[k][at]) + ends[k]) for k in range(len(ranks)))], fields)
            # All other words: one row for each document and word.
            rest = np.flatnonzero(~found)
            doc = words.doc[rest]
            _, first, times = np.unique(tb.mix(words.hash[rest] + doc.astype(np.uint64) * tb.PLACE[60]),
                                        return_index=True, return_counts=True)
            pick, doc = rest[first], pa.array(doc[first])
            low = tb.LOWER[words.texts.data].tobytes()
            spelled = [low[a:b] for a, b in zip(words.start[pick].tolist(), words.end[pick].tolist(), strict=True)]
            zero, none = pa.array(np.zeros(len(pick), np.int64)), pa.array(np.zeros(len(pick)))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(doc) for c in ids), pa.array(spelled, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()),
                 zero, zero, none, *[none] * len(ranks)], fields)

    schema = ("row long, doc_id long, held_out boolean, word string, n long, n_tokens long, n_known long, base double, "
              + ", ".join(f"{x} double" for x in sums))
    rows = (data.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "held_out")
            .mapInArrow(look_up, schema))
    # Rows of documents have no word of the table: the left join leaves them as they are.
    rows = rows.withColumn("word", F.coalesce("word", F.concat(F.lit(" "), F.col("row").cast("string"))))
    rare = binned.where(~often).select("word", "c", *ranks)
    base = F.log10((F.col("c").cast("double") + 0.5) / F.lit(model.tokens + 0.5 * (model.types + 1)))
    summed = (rows.join(rare, "word", "left").groupBy("row", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(F.col("n") * base, F.lit(0.0))).alias("base_score"),
        *(F.sum(F.col(y) + F.coalesce(F.col("n") * F.col(x).cast("double"), F.lit(0.0))).alias(y)
          for x, y in zip(ranks, sums, strict=True))))

    def marginal(own):
        joint = [F.col(x) + math.log(m.share) for x, m in zip(own, model.classes, strict=True) if m.share > 0]
        top = F.greatest(*joint) if len(joint) > 1 else joint[0]
        return (top + F.log(sum((F.exp(x - top) for x in joint[1:]), F.exp(joint[0] - top)))) / math.log(10)

    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
                         "base_score", marginal(sums[size:]).alias("score"), marginal(sums[:size]).alias("mixture_score"))
