"""Benchmark decontamination with one Aho-Corasick automaton (operator 3).

The windows of all test items (13 consecutive normalised words; a shorter item
is one window) are the patterns of one automaton over word codes: each distinct
benchmark word is one code point, so a text becomes a short string that the
automaton scans once.  Words that no item has reset it, and stretches of known
words shorter than the shortest window are left out before the scan.  Hits are
mapped back to word numbers and to code-point offsets of the original text.

The automaton is built on the executors from the items, which are sent to them
in shards of at most ``SHARD_BYTES`` of text.  A benchmark of several shards is
scanned one shard after the other, the hits so far travelling in a table in the
checkpoint folder; results are the same for any number of shards.

Nulls and edge cases: a null or empty text has no words and no hits; items with
a null id or no words are ignored; equal windows of several items count for each;
repeated rows are judged row by row; empty tables give no hits or no rows; columns
other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hirelake.llm import textbuf as tb
from hirelake.session import materialize

WINDOW = 13
SHARD_BYTES = 8 << 20
#: Code points of benchmark words begin here; this one separates stretches.
_FIRST_CODE, _BREAK = 0x10000, 1

_FINDINGS = "_n_words long, _n_hit long, _spans array<struct<start:long,end:long>>, _items array<string>"
_CARRIED = "_first array<long>, _stop array<long>, _items array<string>"

_built: dict[str, tuple] = {}


def _automaton(key: str, items: list[tuple[str, str]], window: int):
    """The automaton of one shard, built once per worker process."""
    if key in _built:
        return _built[key]
    import ahocorasick
    texts = tb.Texts(pa.array([t for _, t in items], pa.string()))
    words = tb.Words(texts, tb.ALNUM)
    vocabulary = np.unique(words.hash)
    code = np.searchsorted(vocabulary, words.hash) + _FIRST_CODE
    owners: dict[str, set[str]] = {}
    for i, (name, _) in enumerate(items):
        own = code[words.off[i]:words.off[i + 1]].astype("<u4").tobytes().decode("utf-32-le")
        for j in range(max(1, len(own) - window + 1) if own else 0):
            owners.setdefault(own[j:j + window], set()).add(name)
    machine = ahocorasick.Automaton()
    for pattern, names in owners.items():
        machine.add_word(pattern, (len(pattern), tuple(sorted(names))))
    if owners:
        machine.make_automaton()
    _built.clear()
    _built[key] = vocabulary, machine, min(map(len, owners), default=0)
    return _built[key]


def _scan(words: tb.Words, vocabulary, machine, shortest) -> list[tuple[int, int, tuple]]:
    """``(first word, word after the last, item ids)`` of every window found."""
    if not shortest or not len(words):
        return []
    code = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
    known = vocabulary[code] == words.hash
    # Stretches of known words inside one document.
    new_doc = np.zeros(len(words), bool)
    new_doc[words.off[:-1][words.n > 0]] = True
    begins = np.flatnonzero(known & (new_doc | ~np.concatenate(([False], known[:-1]))))
    closes = np.flatnonzero(known & np.concatenate((new_doc[1:] | ~known[1:], [True]))) + 1
    long = closes - begins >= shortest
    begins, closes = begins[long], closes[long]
    if not len(begins):
        return []
    size = closes - begins + 1  # one more for the break
    first = np.concatenate(([0], np.cumsum(size)))
    index = np.arange(first[-1]) - np.repeat(first[:-1] - begins, size)
    points = np.append(code, 0)[np.minimum(index, len(words))] + _FIRST_CODE
    points[first[1:] - 1] = _BREAK
    string = points.astype("<u4").tobytes().decode("utf-32-le")
    return [(int(index[at]) - n + 1, int(index[at]) + 1, names) for at, (n, names) in machine.iter(string)]


def _result(words: tb.Words, hits, before):
    """Hit words, the maximal runs of them (first and last word), and the
    sorted item ids of each document; ``before`` has those of earlier shards."""
    mark = np.zeros(len(words) + 1, np.int64)
    for a, b, _ in hits:
        mark[a] += 1
        mark[b] -= 1
    names = [set() for _ in range(words.texts.n)]
    if hits:
        doc = np.searchsorted(words.off, [a for a, _, _ in hits], side="right") - 1
        for d, (_, _, ids) in zip(doc, hits, strict=True):
            names[d].update(ids)
    if before is not None:
        first, stop, items = before
        for d in range(words.texts.n):
            for a, b in zip(first[d], stop[d], strict=True):
                mark[words.off[d] + a] += 1
                mark[words.off[d] + b] -= 1
            names[d].update(items[d])
    hit = np.cumsum(mark[:-1]) > 0
    new_doc = np.zeros(len(words), bool)
    new_doc[words.off[:-1][words.n > 0]] = True
    begins = np.flatnonzero(hit & (new_doc | ~np.concatenate(([False], hit[:-1]))))
    closes = np.flatnonzero(hit & np.concatenate((new_doc[1:] | ~hit[1:], [True]))) if len(hit) else begins
    return hit, begins, closes, [sorted(x) for x in names]


def _scanned(data: DataFrame, benchmark: DataFrame, window: int, shard_bytes: int, item_col: str,
             item_text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` of ``data`` (which has ``text``), with the findings in ``_n_words``,
    ``_n_hit``, ``_spans`` and ``_items``."""
    spark = data.sparkSession
    items = (benchmark.select(F.col(item_col).cast("string").alias("item"),
                              F.col(item_text_col).alias("text")).where("item is not null and text is not null"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(total / shard_bytes))
    names, at = data.columns, data.columns.index("text")
    schema = data.schema
    for k in range(shards):
        part = items if shards == 1 else items.where(F.pmod(F.crc32(F.col("item")), F.lit(shards)) == k)
        rows = sorted((r.item, r.text) for r in part.collect())
        sent = spark.sparkContext.broadcast(rows)
        key = hashlib.sha256(repr((window, rows)).encode()).hexdigest()
        last = k == shards - 1

        def run(batches: Iterator[pa.RecordBatch], sent=sent, key=key, last=last, carried=k > 0):
            vocabulary, machine, shortest = _automaton(key, sent.value, window)
            for batch in tb.slices(batches):
                texts = tb.Texts(batch.column(at))
                words = tb.Words(texts, tb.ALNUM)
                before = [c.to_pylist() for c in batch.columns[len(names):]] if carried else None
                hit, begins, closes, found = _result(words, _scan(words, vocabulary, machine, shortest), before)
                cut = np.searchsorted(begins, words.off)
                offs, ids = pa.array(cut, pa.int32()), pa.array(found, pa.list_(pa.string()))
                if last:
                    span = pa.StructArray.from_arrays(
                        [pa.array(v, pa.int64()) for v in _points(texts, words, begins, closes)], ["start", "end"])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(names.index(c)) for c in keep), pa.array(words.n, pa.int64()),
                         pa.array(tb.per_doc(hit, words.off), pa.int64()), pa.ListArray.from_arrays(offs, span), ids],
                        [*keep, "_n_words", "_n_hit", "_spans", "_items"])
                else:
                    base = np.repeat(words.off[:-1], np.diff(cut))
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:len(names)],
                         pa.ListArray.from_arrays(offs, pa.array(begins - base, pa.int64())),
                         pa.ListArray.from_arrays(offs, pa.array(closes + 1 - base, pa.int64())), ids],
                        [*names, "_first", "_stop", "_items"])

        more = _FINDINGS if last else _CARRIED
        out = T.StructType([*(schema[c] for c in (keep if last else names)), *T.StructType.fromDDL(more).fields])
        data = data.mapInArrow(run, out)
        if not last:
            data = materialize(data, "decontaminate")
    return data


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                   shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items)``, one row per row of ``docs``.

    ``spans`` are the maximal runs of hit words as code-point offsets into the
    original text (end exclusive); ``items`` the sorted ids, as text, of the
    items with a window in the document."""
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = _scanned(data, benchmark, window, shard_bytes, item_col, item_text_col, ["doc_id"])
    return found.toDF("doc_id", "n_words", "n_hit", "spans", "items")


def contaminated(n_hit, n_words):
    """The contamination rule: a twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows and columns of ``docs`` (with a column ``text``) that aren't
    contaminated, in one pass."""
    found = _scanned(docs, benchmark, window, shard_bytes, "item_id", "text", docs.columns)
    return found.where(~contaminated(F.col("_n_hit"), F.col("_n_words"))).select(*docs.columns)


def _points(texts: tb.Texts, words: tb.Words, begins, closes):
    """Code-point offsets, from the start of the document, of word runs."""
    if not len(begins):
        return begins, begins
    doc = np.searchsorted(words.off, begins, side="right") - 1
    base = texts.points[texts.off[doc]]
    return texts.points[words.start[begins]] - base, texts.points[words.end[closes]] - base


def judge(found: DataFrame) -> DataFrame:
    """Counts, a digest of the items and the verdict from ``find_benchmark``."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))
