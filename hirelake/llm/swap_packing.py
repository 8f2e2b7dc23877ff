"""Best-fit packing with swap-based local search (operator 8).

1. ``token_pieces`` tokenises whole texts and cuts only longer ones.
2. ``plan_packing`` needs the pieces' lengths only, of which there are at most
   ``capacity``: best-fit decreasing over the histogram gives kinds of bins (which
   lengths, how many bins alike), then local search exchanges one item for one, two
   for one, or moves one or two between kinds of underfull bins, until no exchange
   between any two of them raises the sum of squared fills.
3. ``assign`` numbers the pieces of each length and hands every number its
   place in the plan.

Only the histogram and the plan, both bounded by the capacity, pass through the
driver; pieces never do.

Nulls and edge cases: a null or empty text is one piece that holds only the
end id; repeated rows are packed each; an empty table gives an empty
result; columns other than id and text are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm import textbuf as tb
from hirelake.session import materialize

CAPACITY = 2048
END_ID = 0
#: Token sequences a worker remembers before it forgets them all.
CACHED = 1 << 20

_KIND = np.zeros(256, np.int8)
_LETTER, _DIGIT, _OTHER, _LEAD, _TRAIL, _ODD = 1, 2, 3, 4, 5, 6
_KIND[:] = _OTHER
_KIND[65:91] = _LETTER
_KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _ODD  # apostrophes begin contractions
_KIND[60] = _ODD  # special tokens of the vocabulary
_KIND[:32] = _ODD
_KIND[127:] = _ODD
_KIND[0xC3] = _LEAD
_KIND[0x80:0xC0] = _TRAIL


class WordTokenizer:
    """Ids of word-wise vocabularies, remembered by word.

    Texts fall apart at ASCII white space, which the vocabulary drops, into
    chunks.  A chunk of ASCII characters and Latin-1 letters, without
    apostrophes or ``<``, falls apart further into letter runs, digits and runs of
    the rest, just as the vocabulary's own splitting does; any other chunk goes
    to the tokenizer whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, keys, words: list[bytes], single: np.ndarray) -> None:
        """Remember the ids of ``words``; ``single`` marks those that are one
        pre-token and so end with the one id that closes a word."""
        ids, sizes = [], np.zeros(len(words), np.int64)
        one = np.flatnonzero(single)
        for at in range(0, len(one), 4096):
            part = one[at:at + 4096]
            got = np.array(self.tokenizer.encode(b" ".join([words[i] for i in part]).decode(), add_special_tokens=False).ids,
                           np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            if len(stops) != len(part) or (len(got) and stops[-1] != len(got)):
                raise ValueError("the vocabulary does not close every word with an end-of-word id")
            sizes[part] = np.diff(np.concatenate(([0], stops)))
            ids.append(got)
        rest = np.flatnonzero(~single)
        for i in rest:
            got = np.array(self.tokenizer.encode(words[i].decode(), add_special_tokens=False).ids, np.uint32)
            sizes[i] = len(got)
            ids.append(got)
        order = np.concatenate((one, rest))
        starts = np.empty(len(words), np.int64)
        starts[order] = len(self.pool) + np.concatenate(([0], np.cumsum(sizes[order])))[:-1]
        self.pool = np.concatenate((self.pool, *ids))
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.start = np.insert(self.start, where, starts)
        self.size = np.insert(self.size, where, sizes)

    def encode(self, texts: tb.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets that tell the texts apart."""
        data = texts.data
        start, end, doc_off, single = self._split(texts)
        keys = tb.range_hashes(data, start, end, lower=False, inside=~tb.SPACE[data])
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(unique) > CACHED:
            self._forget()
        at = np.minimum(np.searchsorted(self.keys, unique), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != unique) if len(self.keys) else np.arange(len(unique))
        if len(new):
            raw = data.tobytes()
            who = first[new]
            self._learn(unique[new], [raw[a:b] for a, b in zip(start[who].tolist(), end[who].tolist(), strict=True)],
                        single[who])
            at = np.searchsorted(self.keys, unique)
        at = at[inverse]
        size, begin = self.size[at], self.start[at]
        to = np.concatenate(([0], np.cumsum(size)))
        index = np.arange(to[-1]) - np.repeat(to[:-1] - begin, size)
        return self.pool[index], to[doc_off]

    def _split(self, texts: tb.Texts):
        """Byte ranges of the words, their offsets per document, and which are
        single pre-tokens."""
        data, off = texts.data, texts.off
        if not len(data):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(texts.n + 1, np.int64), none.astype(bool)
        kind = _KIND[data]
        kind[tb.SPACE[data]] = 0
        lead = np.flatnonzero(kind == _LEAD)
        after = np.minimum(lead + 1, len(data) - 1)
        good = (lead + 1 < len(data)) & (data[after] >= 0x80) & (data[after] < 0xC0) & (data[after] != 0x97) & (data[after] != 0xB7)
        kind[lead] = np.where(good, _LETTER, _ODD)
        kind[lead[good] + 1] = _LETTER
        kind[kind == _TRAIL] = _ODD
        inside = kind != 0
        opens = np.zeros(len(data) + 1, bool)
        opens[0] = True
        opens[1:-1] = inside[1:] != inside[:-1]
        opens[off] = True
        # Chunks with anything odd stay whole.
        chunk = np.cumsum(opens[:-1]) - 1
        odd = np.zeros(int(chunk[-1]) + 1, bool)
        odd[chunk[kind == _ODD]] = True
        whole = odd[chunk]
        cuts = opens.copy()
        cuts[1:-1] |= ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & ~whole[1:]
        begin = np.flatnonzero(cuts[:-1])
        stop = np.append(begin[1:], len(data))
        word = inside[begin]
        begin, stop = begin[word], stop[word]
        return begin, stop, np.searchsorted(begin, off), ~whole[begin]


_tokenizers: dict[str, WordTokenizer] = {}


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the pieces of all texts,
    of at most ``capacity`` ids with the end id.

    ``vocabulary`` is the path of the tokenizer file on the executors; without it,
    each executor takes the installed public one."""

    def run(batches: Iterator[pa.RecordBatch]):
        path = vocabulary or default_vocabulary()
        if path not in _tokenizers:
            _tokenizers[path] = WordTokenizer(path)
        encoder = _tokenizers[path]
        for batch in tb.slices(batches):
            ids, off = encoder.encode(tb.Texts(batch.column(1)))
            ids = np.insert(ids, off[1:], END_ID).astype("<u4")
            off = off + np.arange(len(off))
            size = np.diff(off)
            n = -(-size // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            raw, begin = memoryview(ids.tobytes()), (off[row] + start) * 4
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return data.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> Counter:
    """Best-fit decreasing over a histogram of lengths: kinds of bins and their
    numbers.  Equal items go to equal bins in one step."""
    free: dict[int, list] = {}
    rooms: list[int] = []

    def put(room, kind, n):
        if not n:
            return
        if room not in free:
            bisect.insort(rooms, room)
            free[room] = []
        free[room].append([kind, n])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                per = capacity // length
                whole, rest = divmod(left, per)
                put(capacity - per * length, (length,) * per, whole)
                put(capacity - rest * length, (length,) * rest, 1 if rest else 0)
                break
            room = rooms[i]
            kind, n = free[room][-1]
            per = room // length
            bins = min(n, left // per)
            if bins:
                take = per
            else:
                bins, take = 1, left
            if bins == n:
                free[room].pop()
                if not free[room]:
                    del free[room], rooms[i]
            else:
                free[room][-1][1] -= bins
            put(room - take * length, kind + (length,) * take, bins)
            left -= bins * take
    out: Counter = Counter()
    for kinds in free.values():
        for kind, n in kinds:
            out[tuple(sorted(kind, reverse=True))] += n
    return out


class _Takers:
    """Underfull kinds, found by a length that they hold and by their room.

    ``least[s, y]`` is the smallest room that takes ``s`` for the ``lengths[y]`` given
    back (0: nothing is given back), so a giver reads one row for each sum that it
    may give and looks at no kind.  The table has a number for each pair of a sum and
    a length in the histogram, both at most the capacity."""

    def __init__(self, lengths, capacity: int):
        self.lengths = np.array([0, *sorted(lengths)], np.int64)
        self.row = {int(x): i for i, x in enumerate(self.lengths)}
        self.capacity, self.none = capacity, capacity + 1
        self.least = np.full((capacity + 1, len(self.lengths)), self.none, np.int32)
        self.kinds: dict[tuple[int, int], dict] = {}

    def add(self, kind: tuple) -> None:
        room = self.capacity - sum(kind)
        for y in {0, *kind}:
            held = self.kinds.setdefault((y, room), {})
            if not held:
                cells = self.least[y + 1:y + room + 1, self.row[y]]
                np.minimum(cells, room, out=cells)
            held[kind] = None

    def remove(self, kind: tuple) -> None:
        room = self.capacity - sum(kind)
        for y in {0, *kind}:
            held = self.kinds[y, room]
            del held[kind]
            if not held:
                del self.kinds[y, room]
                column = self.least[:, self.row[y]]
                cells = column[y + 1:y + room + 1]
                cells[cells == room] = column[y + room + 1] if y + room < self.capacity else self.none

    def best_change(self, giver: tuple, bins: Counter):
        """``(taker, given, back)`` that raises the squared fills most, of all
        exchanges out of ``giver``, or None."""
        fill, items = sum(giver), sorted(set(giver))
        offers = {x + y: (x, y) for i, x in enumerate(items) for y in items[i:] if x != y or giver.count(x) > 1}
        offers |= {x: (x,) for x in items}
        sums = np.fromiter(offers, np.int64, len(offers))
        room = self.least[sums]
        d = sums[:, None] - self.lengths
        gain = np.where(room < self.none, d * (self.capacity - room - fill + d), 0)
        at = int(gain.argmax())
        s, y = divmod(at, gain.shape[1])
        if gain[s, y] <= 0:
            return None
        back = int(self.lengths[y])
        return max(self.kinds[back, int(room[s, y])], key=lambda k: (bins[k], k)), offers[int(sums[s])], back


def local_search(bins: Counter, capacity: int = CAPACITY) -> Counter:
    """Exchange items between kinds of underfull bins while the sum of squared
    fills grows: move one or two, swap one for one, or two for one.

    Each exchange changes as many bins as both kinds have.  Givers are taken by the
    magnitude of their number of bins, so that small remainders meet as one kind
    before their turn, and the emptiest first among these.  The search ends when no exchange between any two underfull bins
    raises the sum, or when there are no more bins than the lengths need at least."""
    bins = Counter(bins)
    count = sum(bins.values())
    least = math.ceil(sum(sum(k) * n for k, n in bins.items()) / capacity)
    takers = _Takers({x for k in bins for x in k}, capacity)
    for kind in sorted(bins):
        if sum(kind) < capacity:
            takers.add(kind)

    def turn(kind):
        return -bins[kind].bit_length(), sum(kind), kind

    def change_count(kind, n):
        known = kind in bins
        bins[kind] += n
        if not bins[kind]:
            del bins[kind]
        if sum(kind) < capacity and (kind in bins) != known:
            if known:
                takers.remove(kind)
            else:
                takers.add(kind)
                heapq.heappush(queue, turn(kind))

    changed = True
    while changed and count > least:
        changed = False
        queue = sorted(turn(k) for k in bins if sum(k) < capacity)
        while queue and count > least:
            size, _, giver = heapq.heappop(queue)
            if giver not in bins:
                continue
            if turn(giver)[0] > size:  # fewer bins than when it was queued
                heapq.heappush(queue, turn(giver))
                continue
            alone = bins[giver] == 1
            if alone:
                takers.remove(giver)
            change = takers.best_change(giver, bins)
            if alone:
                takers.add(giver)
            if not change:
                continue
            changed = True
            taker, given, back = change
            times = bins[giver] // 2 if taker == giver else min(bins[giver], bins[taker])
            rest, grown = list(giver), list(taker)
            for x in given:
                rest.remove(x)
            if back:
                grown.remove(back)
                rest.append(back)
            change_count(giver, -times)
            change_count(taker, -times)
            change_count(tuple(sorted([*grown, *given], reverse=True)), times)
            if rest:
                change_count(tuple(sorted(rest, reverse=True)), times)
            else:
                count -= times
            if giver in bins:
                heapq.heappush(queue, turn(giver))
    return bins


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """``(length, first number, count, first sequence, offset)``: the pieces of a
    length with these numbers go to consecutive sequences at ``offset``."""
    bins = local_search(best_fit(histogram, capacity), capacity)
    used: Counter = Counter()
    rows, sequence = [], 0
    for kind in sorted(bins, reverse=True):
        n, at = bins[kind], 0
        for length in kind:
            rows.append((length, used[length], n, sequence, at))
            used[length] += n
            at += length
        sequence += n
    if used != Counter({k: n for k, n in histogram.items() if n}):
        raise AssertionError("the plan must hold every piece once")
    return rows


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)``, one
    row per piece."""
    spark = docs.sparkSession
    made = token_pieces(docs, vocabulary, capacity, id_col, text_col)
    pieces = materialize(made.withColumn("part", F.spark_partition_id()), "pieces")
    counts = materialize(pieces.groupBy("length", "part").count(), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = plan_packing(histogram, capacity)
    # Pieces are numbered by task first, so no length is gathered in one place.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece")) - 1
    numbered = (pieces.withColumn("within", within).join(base, ["part", "length"])
                .select("doc_id", "piece", "start", "length", "ids_crc32",
                        (F.col("base") + F.col("within")).alias("number")))
    table = np.array(plan, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    sent = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]):
        own = sent.value
        keys = own[:, 0] << 44 | own[:, 1]
        for batch in batches:
            length, number = (np.asarray(batch.column(i)) for i in (3, 5))
            at = np.searchsorted(keys, length << 44 | number, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(own[at, 3] + number - own[at, 1]), pa.array(own[at, 4])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
