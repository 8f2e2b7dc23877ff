"""Suffix-array dedup by longest previous factors (operator 7).

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts earlier
(smaller document id, or earlier in the same document): where the longest previous
factor, the longest string from there that also starts earlier, has ``LENGTH`` bytes or
more.  In suffix order, the earlier start with the longest common prefix is the
nearest smaller position before or behind.

One suffix array of all texts would order every byte of the corpus.  Instead:

1. Every string of ``LENGTH`` bytes elects an anchor, its ``GRAM``-byte substring
   of smallest hash (the last of equals).  Equal strings elect the same anchor at
   the same place, so suffixes meet under their anchor, and about one position in
   35 is an anchor.
2. Anchors are range-partitioned and sorted by anchor, hash of the surroundings
   (all strings through the anchor), document and position.  An anchor behind an
   equal one with equal surroundings has all of its strings from earlier.  Range
   partitions cut even a group of millions of equal anchors into equal parts.
3. First anchors of each surroundings go on if their anchor has several.  Under each
   anchor, the suffixes that start 0, 1, 2, ... bytes before it are put in suffix order,
   each order made from the last by one byte in front (``previous_factors``).
   Previous and next smaller positions give the earlier suffixes with the longest
   common prefixes, and so the longest previous factors.

Anchors with more than ``GROUP`` surroundings have their strings grouped by hash over all
executors instead: equal strings are neighbours in suffix order, and the first has the
smallest position.

Results are exact up to collisions of 64-bit hashes.

Nulls and edge cases: a null text is empty; a row with a null id is left whole
and gives no matches; rows that repeat an id are one document and agree;
texts shorter than ``LENGTH`` stay; an empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm import textbuf as tb
from hirelake.session import materialize

LENGTH = 100
GRAM = 32
#: Starts of grams in one string; bytes before an anchor that its strings reach.
SPAN = LENGTH - GRAM + 1
REACH = SPAN - 1
#: Largest number of different surroundings that one task compares at a time.
GROUP = 4096
#: Most anchors with more surroundings that are sent to all tasks.
SEND_MAX = 1_000_000
_SEGMENT = 1 << 19
_GRAMS = (-REACH, -REACH + GRAM, -REACH + 2 * GRAM, -REACH + 3 * GRAM, -REACH + 4 * GRAM, LENGTH - GRAM)
_POSITION = np.uint64((1 << 21) - 1)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position, by doubling."""
    h = tb.byte_values(data)
    size = 1
    while size < GRAM:
        h = h[:-size] + tb.power(size) * h[size:] if len(h) > size else h[:0]
        size *= 2
    return tb.mix(h)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    rest = width - size
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def _anchors(texts: tb.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions in the buffer, hashes of anchors and of surroundings."""
    data, off = texts.data, texts.off
    places, grams, around = [], [], []
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for a in range(0, len(data) - LENGTH + 1, _SEGMENT):
        b = min(a + _SEGMENT, len(data) - LENGTH + 1)  # strings begin in [a, b)
        low = max(0, a - REACH)
        h = _gram_hashes(data[low:min(len(data), b + REACH + LENGTH)])
        own = h[a - low:b + REACH - low]
        key = own & ~_POSITION | (_POSITION - np.arange(len(own), dtype=np.uint64))
        elected = (_POSITION - (_sliding_min(key, SPAN) & _POSITION)).astype(np.int64)
        begin = np.arange(a, b)
        doc_end = off[np.searchsorted(off, [a], side="right")[0]:]
        # Strings must not run over the end of their document.
        ends = doc_end[np.searchsorted(doc_end, begin, side="right")] if len(doc_end) else begin
        at = np.unique(a + elected[begin + LENGTH <= ends])
        if not len(at):
            continue
        doc = np.searchsorted(off, at, side="right") - 1
        start, end = off[doc], off[doc + 1]
        before, after = np.minimum(at - start, REACH), np.minimum(end - at, LENGTH)
        total = before.astype(np.uint64) * tb.PLACE[30] + after.astype(np.uint64) * tb.PLACE[31]
        for j, g in enumerate(_GRAMS):
            total += h[np.clip(at + g, start, end - GRAM) - low] * tb.PLACE[j]
        places.append(at)
        grams.append(h[at - low])
        around.append(tb.mix(total))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(grams)[first], np.concatenate(around)[first]


def anchors(data: DataFrame) -> DataFrame:
    """``(anchor, around, doc_id, pos)`` of every anchor of ``(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches):
            texts = tb.Texts(batch.column(1))
            at, gram, around = _anchors(texts)
            doc = np.searchsorted(texts.off, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)),
                 batch.column(0).take(pa.array(doc)), pa.array(at - texts.off[doc])],
                ["anchor", "around", "doc_id", "pos"])

    return data.where("doc_id is not null").mapInArrow(run, "anchor long, around long, doc_id long, pos long")


def _mark(batches: Iterator[pa.RecordBatch]):
    """Over sorted anchors: ``whole`` marks those behind an equal anchor with
    equal surroundings; the first of each surroundings goes on, unless it is the
    only one of its anchor.  The first and last anchor of a partition may go on in
    its neighbours and so always go on here."""
    group = None  # (anchor, around, doc, pos) of the first row of the open surroundings
    opening = None  # the partition's first anchor
    held = None  # the only first row so far of the open anchor
    several = False  # whether the open anchor's first rows went on already

    def out(anchor, doc, pos, whole):
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(pos, pa.int64()),
             pa.array(np.full(len(anchor), whole))], ["anchor", "doc_id", "pos", "whole"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, r, d, p = (np.asarray(batch.column(i)) for i in range(4))
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
        if group is not None:
            new[0] = (a[0], r[0]) != group[:2]
        first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        inside = first >= 0
        fd = np.where(inside, d[first], group[2] if group else 0)
        fp = np.where(inside, p[first], group[3] if group else 0)
        again = ~new & ((d != fd) | (p != fp))
        yield out(a[again], d[again], p[again], True)

        at = np.flatnonzero(new)
        if opening is None:
            opening = a[0]
        if len(at):
            fa, fdoc, fpos = a[at], d[at], p[at]
            if held is not None:
                fa = np.concatenate(([held[0]], fa))
                fdoc = np.concatenate(([held[1]], fdoc))
                fpos = np.concatenate(([held[2]], fpos))
            change = np.flatnonzero(np.concatenate(([True], fa[1:] != fa[:-1])))
            count = np.diff(np.append(change, len(fa)))
            goes = np.repeat(count >= 2, count) | (fa == opening)
            if several and group is not None:
                goes |= fa == group[0]
            # An earlier anchor that stayed alone is done with; the last may go on.
            several = bool(goes[-1])
            held = None if several else (fa[-1], fdoc[-1], fpos[-1])
            yield out(fa[goes], fdoc[goes], fpos[goes], False)
        last = first[-1]
        if last >= 0:
            group = (a[last], r[last], d[last], p[last])
    if held is not None:
        yield out(np.array([held[0]]), np.array([held[1]]), np.array([held[2]]), False)


def _union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges (touching ranges join)."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def _judge(batches: Iterator[pa.RecordBatch]):
    """Join the documents with their marks: size, checksum, and for documents with
    marks the text, the removed ranges so far and the anchors to compare."""
    for batch in tb.slices(batches):
        texts = tb.Texts(batch.column(1))
        rows = {k: [] for k in ("sha", "text", "start", "end", "anchor", "pos")}
        n_bytes = np.diff(texts.off)
        for i, (whole, anchor, pos) in enumerate(zip(*(batch.column(j) for j in (2, 3, 4)), strict=True)):
            raw = texts.bytes(i)
            whole = np.asarray(whole.values, np.int64) if whole.is_valid else np.zeros(0, np.int64)
            more = anchor.is_valid and len(anchor.values) > 0
            start, end = _union(np.maximum(whole - REACH, 0), np.minimum(whole + LENGTH, len(raw)))
            rows["sha"].append(hashlib.sha256(raw).hexdigest())
            rows["text"].append(raw if len(start) or more else None)
            rows["start"].append(start)
            rows["end"].append(end)
            rows["anchor"].append(anchor.values if more else [])
            rows["pos"].append(pos.values if more else [])
        lists = [pa.array([np.asarray(v, np.int64) for v in rows[k]], pa.list_(pa.int64()))
                 for k in ("start", "end", "anchor", "pos")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(rows["sha"]), pa.array(rows["text"], pa.binary()),
             *lists], ["doc_id", "n_bytes", "sha", "text", "start", "end", "anchor", "pos"])


def _surroundings(batches: Iterator[pa.RecordBatch]):
    """The bytes that the strings through each anchor to be compared reach."""
    for batch in tb.slices(batches):
        docs, anchors_, places = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
        raw = batch.column(1).to_pylist()
        out = [[], [], [], [], []]
        for doc, text, anchor, pos in zip(docs, raw, anchors_, places, strict=True):
            for a, p in zip(anchor.values.to_pylist(), pos.values.to_pylist(), strict=True):
                begin = max(0, p - REACH)
                for c, v in zip(out, (a, doc, p, p - begin, text[begin:p + LENGTH]), strict=True):
                    c.append(v)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())],
            ["anchor", "doc_id", "pos", "left", "bytes"])


def _string_hashes(left: np.ndarray, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per row and distance ``o`` of the anchor from the string's start: the hash of
    the string, and whether it lies in the document."""
    texts = tb.Texts(column)
    n, width = texts.n, REACH + LENGTH
    size = np.diff(texts.off)
    grid = np.zeros((n, width), np.uint8)
    row = np.repeat(np.arange(n), size)
    grid[row, np.arange(len(row)) - np.repeat(texts.off[:-1] - (REACH - left), size)] = texts.data
    # 100 = 64 + 32 + 4 bytes, by doubling.
    level, total = tb.byte_values(grid), np.zeros((n, SPAN), np.uint64)
    for k in (1, 2, 4, 8, 16, 32, 64):
        if k in (4, 32, 64):
            at = {64: 0, 32: 64, 4: 96}[k]
            total += level[:, at:at + SPAN] * tb.PLACE[50 + k % 7]
        level = level[:, :-k] + tb.power(k) * level[:, k:]
    begin = np.arange(SPAN)  # in the grid; the anchor is at REACH
    fits = (begin >= (REACH - left)[:, None]) & (begin + LENGTH <= (REACH - left + size)[:, None])
    return tb.mix(total), fits


def _runs(found: np.ndarray, doc, pos) -> pa.RecordBatch:
    """Ranges of bytes under the marked strings, by their begin from ``REACH`` bytes before
    the anchor on; consecutive ones as one."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    start = pos[row] - REACH + a
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[row], pa.int64()), pa.array(start, pa.int64()), pa.array(pos[row] - REACH + b - 1 + LENGTH, pa.int64())],
        ["doc_id", "start", "end"])


def _smaller_before(value: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each, in its group (-1: none)."""
    near = np.arange(len(value)) - 1
    near[1:][group[1:] != group[:-1]] = -1
    while True:
        # What lies between a place and its ``near`` is greater, so chains may be skipped.
        on = np.flatnonzero(near >= 0)
        on = on[value[near[on]] > value[on]]
        if not len(on):
            return near
        near[on] = near[near[on]]


def _smaller(value: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the previous and of the next smaller value of each, in its group (-1: none)."""
    behind = _smaller_before(value[::-1], group[::-1])[::-1]
    return _smaller_before(value, group), np.where(behind >= 0, len(value) - 1 - behind, -1)


class _Common:
    """Bytes that pairs of rows share on both sides of their anchors; pairs seldom change
    from one suffix order to the next, so only new ones are compared."""

    def __init__(self, grid: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.grid, self.left, self.right = grid, left, right
        self.other = np.full(len(grid), -1)
        self.before, self.after = np.zeros(len(grid), np.int64), np.zeros(len(grid), np.int64)

    def factor(self, row: np.ndarray, other: np.ndarray, o: int) -> np.ndarray:
        """Common prefix of the suffixes ``o`` bytes before the anchors of ``row`` and ``other``
        (none: -1), as far as the surroundings go; 0 if it ends before the anchor."""
        new = (self.other[row] != other) & (other >= 0)
        i, j = row[new], other[new]
        for a in range(0, len(i), GROUP):
            p, q = i[a:a + GROUP], j[a:a + GROUP]
            same = np.concatenate((self.grid[p] == self.grid[q], np.zeros((len(p), 1), bool)), axis=1)
            self.after[p] = np.minimum(np.argmin(same[:, REACH:], axis=1), np.minimum(self.right[p], self.right[q]))
            back = np.concatenate((same[:, REACH - 1::-1] if REACH else same[:, :0], np.zeros((len(p), 1), bool)), axis=1)
            self.before[p] = np.minimum(np.argmin(back, axis=1), np.minimum(self.left[p], self.left[q]))
        self.other[i] = j
        return np.where((other >= 0) & (self.before[row] >= o), o + self.after[row], 0)


def previous_factors(group: np.ndarray, left: np.ndarray, column: pa.Array) -> np.ndarray:
    """Per row and distance ``o`` of the anchor: the length of the longest string that starts
    ``o`` bytes before it and also starts at an earlier row of the group, ``o`` bytes before the
    anchor there; 0 if that ends before the anchor or the string is cut short by its document.

    Rows come by document and position, without repeats; ``column`` holds ``left`` bytes
    before each anchor, and ``LENGTH`` from it on or as many as the document has."""
    texts = tb.Texts(column)
    n, size = texts.n, np.diff(texts.off)
    right = size - left
    grid = np.zeros((n, REACH + LENGTH), np.uint8)
    row = np.repeat(np.arange(n), size)
    grid[row, np.arange(len(row)) - np.repeat(texts.off[:-1] - (REACH - left), size)] = texts.data
    # The suffixes from the anchors on; bytes behind a document's end don't matter, as
    # only suffixes of LENGTH bytes or more are looked at.
    words = np.ascontiguousarray(np.pad(grid[:, REACH:], ((0, 0), (0, -LENGTH % 8)))).view(">u8")
    order = np.lexsort((*words.T[::-1], group))
    lengths = np.zeros((n, SPAN), np.int64)
    sides = _Common(grid, left, right), _Common(grid, left, right)
    for o in range(SPAN):
        if o:
            # A byte in front: the last order, sorted by it.
            order = order[np.argsort(group[order].astype(np.int64) * 256 + grid[order, REACH - o], kind="stable")]
        suffixes = order[(left[order] >= o) & (right[order] >= LENGTH - o)]
        for common, near in zip(sides, _smaller(suffixes, group[suffixes]), strict=True):
            other = np.where(near >= 0, suffixes[np.maximum(near, 0)], -1)
            lengths[suffixes, o] = np.maximum(lengths[suffixes, o], common.factor(suffixes, other, o))
    return lengths


def _compare(batches: Iterator[pa.RecordBatch]):
    """Rows sorted by anchor, at most ``GROUP`` an anchor: whole anchors of a few
    thousand rows at a time are put in suffix order."""
    held: list[pa.RecordBatch] = []

    def flush(table: pa.Table):
        doc, pos = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "pos"))
        order = np.lexsort((pos, doc))
        doc, pos = doc[order], pos[order]
        once = np.ones(len(order), bool)
        once[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1])
        table = table.take(pa.array(order[once]))
        doc, pos, left = (np.asarray(table.column(c).combine_chunks()) for c in ("doc_id", "pos", "left"))
        _, group = np.unique(np.asarray(table.column("anchor").combine_chunks()), return_inverse=True)
        factors = previous_factors(group, left, table.column("bytes").combine_chunks())
        return _runs((factors >= LENGTH)[:, ::-1], doc, pos)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < 2 * GROUP:
            continue
        table = pa.Table.from_batches(held)
        anchor = np.asarray(table.column("anchor").combine_chunks())
        cut = int(np.searchsorted(anchor, anchor[-1], side="left"))  # the last anchor may go on
        for at in _cuts(anchor[:cut]):
            yield flush(table.slice(*at))
        held = table.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        table = pa.Table.from_batches(held)
        for at in _cuts(np.asarray(table.column("anchor").combine_chunks())):
            yield flush(table.slice(*at))


def _cuts(anchor: np.ndarray) -> list[tuple[int, int]]:
    """Offset and length of slices of about ``2 * GROUP`` rows of whole anchors."""
    out, at = [], 0
    ends = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor)) if len(anchor) else []
    while at < len(anchor):
        to = int(ends[max(np.searchsorted(ends, at + 2 * GROUP, side="right") - 1, np.searchsorted(ends, at, side="right"))])
        out.append((at, to - at))
        at = to
    return out


def _strings(batches: Iterator[pa.RecordBatch]):
    """Of anchors with very many surroundings: each distinct string once a batch, at
    its earliest start; later ones of the batch are decided here."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2 * GROUP):
            part = batch.slice(at, 2 * GROUP)
            doc, pos, left = (np.asarray(part.column(i)) for i in (1, 2, 3))
            hashes, fits = _string_hashes(left, part.column(4))
            row, o = np.nonzero(fits)
            key, d, s = hashes[row, o], doc[row], pos[row] - REACH + o
            order = np.lexsort((s, d, key))
            key, d, s = key[order], d[order], s[order]
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(key) else np.zeros(0, np.int64)
            later = ~new & ((d != d[first]) | (s != s[first]))
            pick = new | later
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)[pick]), pa.array(d[pick], pa.int64()), pa.array(s[pick], pa.int64()),
                 pa.array(later[pick])], ["string", "doc_id", "start", "later"])


def _finish(batches: Iterator[pa.RecordBatch]):
    """Remove the ranges and hash what is left."""
    for batch in tb.slices(batches):
        text = batch.column(3)
        out = [[], [], []]
        for i in range(batch.num_rows):
            ranges = [[], []]
            for j in (4, 6):
                for k in (0, 1):
                    v = batch.column(j + k)[i]
                    if v.is_valid:
                        ranges[k] += v.values.to_pylist()
            start, end = _union(np.array(ranges[0], np.int64), np.array(ranges[1], np.int64))
            sha = batch.column(2)[i].as_py()
            if len(start):
                raw, left, last = text[i].as_py(), hashlib.sha256(), 0
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    left.update(raw[last:a])
                    last = b
                left.update(raw[last:])
                sha = left.hexdigest()
            out[0].append(int((end - start).sum()))
            out[1].append(len(start))
            out[2].append(sha)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
             pa.array(out[2], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP):
    """``(judged, ranges)``: every document with size, checksum, and (where it
    has repeats) text and removed ranges from whole surroundings; and the further
    ranges ``(doc_id, start, end)`` that come from comparing strings."""
    spark = docs.sparkSession
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["anchor", "around", "doc_id", "pos"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = materialize(anchors(data).repartitionByRange(parts, *order).sortWithinPartitions(*order)
                        .mapInArrow(_mark, "anchor long, doc_id long, pos long, whole boolean"), "lpf-marks")
    # Anchors with too many surroundings for one task, at most one in ``group`` marks.
    hot = materialize(marks.where("not whole").groupBy("anchor").count().where(F.col("count") > group).select("anchor"), "lpf-hot")
    n_hot = hot.count()
    lists = marks.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("whole"), F.col("pos"))).alias("whole"),
        F.collect_list(F.when(~F.col("whole"), F.struct("anchor", "pos"))).alias("more")) \
        .select("doc_id", "whole", F.col("more.anchor").alias("m_anchor"), F.col("more.pos").alias("m_pos"))
    judged = materialize(data.join(lists, "doc_id", "left").select("doc_id", "text", "whole", "m_anchor", "m_pos").mapInArrow(
        _judge, "doc_id long, n_bytes long, sha string, text binary, start array<long>, end array<long>, "
                "anchor array<long>, pos array<long>"), "judged")
    rows = (judged.where(F.size("anchor") > 0).select("doc_id", "text", "anchor", "pos")
            .mapInArrow(_surroundings, "anchor long, doc_id long, pos long, left long, bytes binary"))
    spans = "doc_id long, start long, end long"
    known = F.broadcast(hot) if n_hot <= SEND_MAX else hot
    few = ((rows.join(known, "anchor", "left_anti") if n_hot else rows).repartition(parts, "anchor")
           .sortWithinPartitions("anchor").mapInArrow(_compare, spans))
    if not n_hot:
        return judged, few
    strings = materialize(rows.join(known, "anchor", "left_semi").select(*rows.columns)
                          .mapInArrow(_strings, "string long, doc_id long, start long, later boolean"), "strings")
    least = (strings.where("not later").groupBy("string")
             .agg(F.min(F.struct("doc_id", "start")).alias("least"), F.count("*").alias("n")).where("n > 1"))
    many = (strings.where("not later").join(least, "string").where(F.struct("doc_id", "start") > F.col("least"))
            .select("doc_id", "start").unionAll(strings.where("later").select("doc_id", "start")))
    return judged, few.unionAll(many.select("doc_id", "start", (F.col("start") + LENGTH).alias("end")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` per row of ``docs``."""
    judged, ranges = repeated_ranges(docs, id_col, text_col, group)
    more = ranges.groupBy("doc_id").agg(F.collect_list("start").alias("start2"), F.collect_list("end").alias("end2"))
    columns = ["doc_id", "n_bytes", "sha", "text", "start", "end", "start2", "end2"]
    # Only documents with anchors that were compared may have further ranges.
    none = F.lit(None).cast("array<long>")
    settled = judged.where(F.size("anchor") == 0).withColumns({"start2": none, "end2": none})
    open_ = judged.where(F.size("anchor") > 0).join(more, "doc_id", "left")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (settled.select(*columns).mapInArrow(_finish, out)
            .unionAll(open_.select(*columns).mapInArrow(_finish, out)))
