"""Periodic runs of words, solved in tiles and stitched (operator 11).

A run is a stretch of words with smallest period ``q`` (words ``q`` apart are equal), at
least ``max(6, 4 q)`` words long, that cannot be extended.  Periods are taken by
octaves, ``P <= q < 2 P``:

1. A document is cut into tiles of ``max(TILE, 16 P)`` words for the octave.  A tile
   answers for the centres in it, the multiples of ``2 P``, and overlaps its
   neighbours by ``2 P`` words before and ``4 P`` words behind.  A run has ``3 q`` or more words
   equal to those ``q`` further on, so some centre ``c`` has its next ``P`` words
   among them: comparing the hash of these ``P`` words with the hashes at ``c + q`` finds it.
2. The boundary Z-functions at a centre tell how far the words from ``c`` and from
   ``c + q`` agree, forwards and backwards; hashes of blocks of 1, 2, 4, ...
   words give them for all centres and periods of a batch at once.  Periods that a
   divisor explains are dropped.  What remains is an interval, cut at the tile's edges.
3. Intervals are shuffled by document and period, and those that overlap by a
   period or more are one run (two different runs of period ``q`` overlap by less).

A document's tiles are solved where it is read, unless it is longer than ``LONG``
characters: then its tiles are rows of their own, dealt over all executors.  Only
documents with an interval keep their words for the last step, which drops the
repeated words.  Results are exact up to collisions of 64-bit hashes.

Nulls and edge cases: a null text is empty, and has no run; a null id is never
rearranged; rows that repeat an id are judged each by its own text; an empty table
gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm import textbuf as tb
from hirelake.session import materialize

#: Fewest words of a run, and fewest periods in it.
LEAST, PERIODS = 6, 4
#: Words in a tile: this, or 16 times the octave's least period.
TILE = 4096
#: Characters above which the tiles of a document are dealt over the executors.
LONG = 1 << 16
_SLICE = 1 << 20
_LEFT, _RIGHT = tb.PLACE[20], tb.PLACE[21]


def rearranged(doc_id: int | None, words: list) -> list:
    """The words of the document as judged: a tenth of the ids has its words from some
    place on replaced by a repetition."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def _blocks(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the blocks of 1, 2, 4, ... words from every place."""
    out = [ids]
    while 2 << (len(out) - 1) <= min(longest, len(ids)):
        size = 1 << (len(out) - 1)
        h = out[-1][:-size] * _LEFT + out[-1][size:] * _RIGHT
        out.append(h ^ (h >> np.uint64(29)))
    return out


def _agree(blocks: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from ``i`` and from ``j > i`` on agree (before them, if ``back``)."""
    length = np.zeros(len(i), np.int64)
    n = len(blocks[0])
    for k in range(len(blocks) - 1, -1, -1):
        size, h = 1 << k, blocks[k]
        if back:
            at, to = i - length - size, j - length - size
            fits = at >= 0
        else:
            at, to = i + length, j + length
            fits = to + size <= n
        rows = np.flatnonzero(fits)
        same = rows[h[at[rows]] == h[to[rows]]]
        length[same] += size
    return length


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def intervals(ids: np.ndarray, off: np.ndarray, first: np.ndarray, total: np.ndarray, own: tuple[np.ndarray, np.ndarray],
              octaves: tuple[int, int] | None = None, tile: int = TILE) -> list[np.ndarray]:
    """``(segment, period, start, end)`` of the intervals found in segments of documents.

    ``ids[off[i]:off[i + 1]]`` are words of a document of ``total[i]`` words from its
    place ``first[i]`` on; the segment answers for the centres in ``own``."""
    out = [[], [], [], []]
    size = np.diff(off)
    longest = int(size.max()) if len(size) else 0
    blocks = _blocks(ids, longest)
    low, high = octaves or (0, 62)
    for octave in range(low, high + 1):
        least = 1 << octave
        if max(LEAST, PERIODS * least) > longest:
            break
        # Centres, in places of the document; 2 P words from a centre lie in the document.
        step = 2 * least
        start = -(-own[0] // step) * step
        stop = np.minimum(own[1], total - 2 * least + 1)
        count = np.where(total >= max(LEAST, PERIODS * least), np.maximum(-(-(stop - start) // step), 0), 0)
        seg = np.repeat(np.arange(len(count)), count)
        if not len(seg):
            continue
        c = start[seg] + step * (np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count))
        at = c - first[seg] + off[seg]
        # Equal blocks of P words at a distance of a period, some rows at a time.
        h = blocks[octave]
        periods = np.arange(least, 2 * least)
        rows, cols = [], []
        room = np.minimum(total - first, size)[seg] + off[seg] - least  # last place of a block
        chunk = max(1, (1 << 20) // least)
        for a in range(0, len(at), chunk):
            to = at[a:a + chunk, None] + periods
            inside = to <= room[a:a + chunk, None]
            r, k = np.nonzero(inside & (h[at[a:a + chunk], None] == h[np.minimum(to, len(h) - 1)]))
            rows.append(r + a)
            cols.append(k)
        r, q = np.concatenate(rows), periods[np.concatenate(cols)]
        # Only smallest periods: a proper period of the stretch divides q.
        smallest = np.ones(len(r), bool)
        divisors = {int(v): [int(v) // p for p in _primes(int(v))] for v in np.unique(q)}
        for turn in range(max((len(d) for d in divisors.values()), default=0)):
            d = np.array([divisors[v][turn] if turn < len(divisors[v]) else 0 for v in q.tolist()], np.int64)
            test = np.flatnonzero(smallest & (d > 0))
            smallest[test] = _agree(blocks, at[r[test]], at[r[test]] + d[test]) < q[test]
        r, q = r[smallest], q[smallest]
        if not len(r):
            continue
        centre, place, s = c[r], at[r], seg[r]
        width = max(tile, 16 * least)
        edge = centre // width * width
        left, right = np.maximum(edge - 2 * least, 0), np.minimum(edge + width + 4 * least, total[s])
        ahead = np.minimum(_agree(blocks, place, place + q), right - centre - q)
        behind = np.minimum(_agree(blocks, place, place + q, back=True), centre - left)
        begin, end = centre - behind, centre + q + ahead
        cut = ((begin == left) & (left > 0)) | ((end == right) & (right < total[s]))
        keep = cut | (end - begin >= np.maximum(LEAST, PERIODS * q))
        found = np.unique(np.stack([s[keep], q[keep], begin[keep], end[keep]]), axis=1)
        for column, values in zip(out, found, strict=True):
            column.append(values)
    return [np.concatenate(v) if v else np.zeros(0, np.int64) for v in out]


def _read(tile: int, long: int):
    """Documents to words: checksum, the words where they are needed again, and the
    intervals of all but long documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches, max_bytes=_SLICE):
            texts = tb.Texts(batch.column(1))
            words = [rearranged(d, texts.bytes(i).split()) for i, d in enumerate(batch.column(0).to_pylist())]
            joined = [b" ".join(w) for w in words]
            n = np.array([len(w) for w in words], np.int64)
            large = np.diff(texts.off) > long
            short = [b"" if big else j for j, big in zip(joined, large, strict=True)]
            buf = tb.Words(tb.Texts(pa.array(short, pa.large_binary())), tb.SPACED, lower=False)
            seg, q, begin, end = intervals(buf.hash, buf.off, np.zeros(len(n), np.int64), buf.n,
                                           (np.zeros(len(n), np.int64), buf.n), tile=tile)
            order = np.argsort(seg, kind="stable")
            at = np.searchsorted(seg[order], np.arange(len(n) + 1)).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(v[order], pa.int64()) for v in (q, begin, end)], ["q", "s", "e"])
            wanted = large | (np.diff(at) > 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array([hashlib.sha256(j).hexdigest() for j in joined]),
                 pa.array([j if w else None for j, w in zip(joined, wanted, strict=True)], pa.binary()),
                 pa.array(large), pa.ListArray.from_arrays(pa.array(at), items)],
                ["doc_id", "n", "plain", "words", "large", "found"])

    return run


def _explode(tile: int):
    """Words of long documents to tiles: octaves whose tiles have the same size share them."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches, "words"):
            for doc, plain, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                _, ids = np.unique(np.array(raw.split(), object), return_inverse=True)
                n, ids = len(ids), ids.astype(np.uint32)
                shared = max(tile.bit_length() - 1 - 4, 0)  # largest octave with 16 P <= tile
                tops = [shared] + [k for k in range(shared + 1, 62) if PERIODS << k <= n]
                for top in tops:
                    width, least = max(tile, 16 << top), 1 << top
                    for edge in range(0, n, width):
                        left, right = max(edge - 2 * least, 0), min(edge + width + 4 * least, n)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v], t) for v, t in (
                                (doc, pa.int64()), (plain, pa.string()), (n, pa.int64()), (left, pa.int64()), (edge, pa.int64()),
                                (edge + width, pa.int64()), (0 if top == shared else top, pa.int32()), (top, pa.int32()),
                                (ids[left:right].tobytes(), pa.binary()))],
                            ["doc_id", "plain", "n", "first", "low", "high", "octave", "top", "ids"])

    return run


def _solve(tile: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                ids = tb.mix(np.frombuffer(row["ids"], np.uint32).astype(np.uint64) + tb.PLACE[22])
                one = lambda v: np.array([v], np.int64)
                _, q, s, e = intervals(ids, np.array([0, len(ids)]), one(row["first"]), one(row["n"]),
                                       (one(row["low"]), one(row["high"])), (row["octave"], row["top"]), tile)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["doc_id"]] * len(q), pa.int64()), pa.array([row["plain"]] * len(q), pa.string()),
                     *(pa.array(v, pa.int64()) for v in (q, s, e))], ["doc_id", "plain", "q", "s", "e"])

    return run


def _collapse(batches: Iterator[pa.RecordBatch]):
    """Checksum of the words that no run repeats."""
    for batch in tb.slices(batches, "words"):
        docs, plain, words, runs = (batch.column(i).to_pylist() for i in range(4))
        out = []
        for raw, found in zip(words, runs, strict=True):
            split = raw.split()
            edge = np.zeros(len(split) + 1, np.int64)
            for r in found:
                edge[r["start"] + r["period"]] += 1
                edge[r["start"] + r["length"]] -= 1
            kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
            out.append(hashlib.sha256(b" ".join([split[i] for i in kept])).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())],
                                         ["doc_id", "plain", "collapsed"])


def stitch(found: DataFrame) -> DataFrame:
    """``(doc_id, plain, period, start, length)`` of the runs that intervals ``(doc_id, plain, q,
    s, e)`` make: those of one document and period that overlap by a period are one."""
    lane = Window.partitionBy("doc_id", "plain", "q").orderBy("s", "e")
    reach = F.max("e").over(lane.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum(F.when(reach - F.col("s") >= F.col("q"), 0).otherwise(1)).over(lane)
    return (found.withColumn("number", number).groupBy("doc_id", "plain", "q", "number")
            .agg(F.min("s").alias("start"), (F.max("e") - F.min("s")).alias("length"))
            .where(F.col("length") >= F.greatest(F.lit(LEAST), PERIODS * F.col("q")))
            .select("doc_id", "plain", F.col("q").alias("period"), "start", "length"))


def find_runs(docs: DataFrame, tile: int = TILE, long: int = LONG, id_col: str = "doc_id",
              text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(read, runs)``: every document with its number of words and checksum (``plain``),
    and its runs ``(doc_id, plain, period, start, length)``, joined by id and checksum."""
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    read = materialize(data.mapInArrow(
        _read(tile, long), "doc_id long, n long, plain string, words binary, large boolean, "
                           "found array<struct<q:long,s:long,e:long>>"), "runs-read")
    near = read.where(F.size("found") > 0).select("doc_id", "plain", F.explode("found").alias("f")).select(
        "doc_id", "plain", "f.*")
    tiles = (read.where("large").select("doc_id", "plain", "words").mapInArrow(
        _explode(tile), "doc_id long, plain string, n long, first long, low long, high long, octave int, top int, ids binary")
             .repartition("doc_id", "plain", "low", "top"))
    far = tiles.mapInArrow(_solve(tile), "doc_id long, plain string, q long, s long, e long")
    return read, materialize(stitch(near.unionAll(far)), "runs")


def judge(read: DataFrame, runs: DataFrame) -> DataFrame:
    """The digest of ``find_runs``, one row per document."""
    same = [F.col("r.doc_id").eqNullSafe(F.col("d.doc_id")), F.col("r.plain") == F.col("d.plain")]
    by_doc = runs.groupBy("doc_id", "plain").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    texts = (read.where("words is not null").select("doc_id", "plain", "words").dropDuplicates(["doc_id", "plain"]).alias("d")
             .join(by_doc.alias("r"), same).select("d.doc_id", "d.plain", "words", "runs"))
    collapsed = texts.mapInArrow(_collapse, "doc_id long, plain string, collapsed string")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    digest = by_doc.select(
        "doc_id", "plain", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"))
    facts = (digest.alias("r").join(collapsed.alias("d"), same)
             .select("r.doc_id", "r.plain", "n_runs", "best", "runs_sha256", "collapsed"))
    nothing = hashlib.sha256(b"").hexdigest()
    length, period = F.col("best.length"), -F.col("best.p")
    return (read.select("doc_id", "plain").alias("d").join(facts.alias("r"), same, "left")
            .select("d.doc_id", F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"), (-F.col("best.s")).alias("start"),
                    length.alias("length"), period.alias("period"),
                    F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
                    F.coalesce("runs_sha256", F.lit(nothing)).alias("runs_sha256"),
                    F.coalesce("collapsed", F.col("d.plain")).alias("collapsed_sha256")))
