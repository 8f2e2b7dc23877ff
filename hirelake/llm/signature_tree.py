"""N-gram Jaccard join by signature trees (operator 12).

Documents are sets of distinct shingles; two link when their Jaccard similarity is at
least ``percent``.  No link between different sets is lost:

1. Top of the tree: shingles have one global order (common ones last, then by hash).
   Linked sets overlap in ``percent`` of the larger one at least, so they share one of
   the first ``n - ceil(percent n) + 1`` shingles of both, and their sizes differ by
   ``100 / percent`` at most.  A node is such a shingle with a range of sizes; a
   document stands under the ranges from its own size to the largest size it may
   be linked with, so that linked documents meet.
2. A node of two documents tells of one pair.  Linked sets share not one but
   ``overlap + 1 - ceil(percent max n)`` of their first shingles, so a pair that shares fewer
   nodes of two is dropped, unless it shares a larger node.
   Every document has a bitmap of its shingles.  Each larger node names a centre, the member
   with most company in its nodes; bitmaps bound the overlap of members with it.
   Those that may share ``RELATED`` percent with the centre are compared with it in
   full: the shingles that a member adds to the centre and lacks of it are kept.
3. A centre's members may be linked with each other.  They become leaves
   of a signature tree: a leaf has its bitmap and its size and, if it was compared,
   bitmaps of the shingles that it adds to the centre and of those that it lacks; an
   inner node has the OR of its children's bitmaps, and ranges of their sizes.  The tree
   is traversed against itself from the top; a pair of nodes is pruned when its maximum
   possible overlap is below what its smallest sizes ask for, or when the sizes do not
   fit.  Of the pairs of leaves that remain, two compared members are decided on the spot,
   by what both add and lack; the others are compared in full.

Every link between different sets is returned, also those within one component.

Two sets overlap in no more shingles than their bitmaps share bits, plus the shingles
that fall on a taken bit (``extra``).  Of two members that were compared, the same is
told more sharply: by what they share of the centre, at most the centre without the
union of what they lack, plus what they share outside it.

Groups of more than ``GROUP`` members or ``GROUP_BYTES`` are cut into blocks, and pairs of
blocks are traversed by different tasks.  Documents with equal sets are one class throughout.

Nulls and edge cases: documents without words have an empty set and link with
nothing; fewer than ``k`` words make one shingle; a null id links with nothing and is
its own (null) component; rows that repeat an id are one document and agree; an empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm import textbuf as tb
from hirelake.llm.graph import connected_components
from hirelake.session import materialize

SHINGLE = 3
PERCENT = 90
#: A shingle under which more documents stand is put last in the order; of these,
#: the most frequent ``COMMON`` (a list of this length is sent to the tasks).
#: Any list gives the same links.
HOT, COMMON = 10, 100_000
#: Percent of the larger set that a member and its centre may share, to be compared.
RELATED = 70
#: Sizes of a range: a factor of this.
RANGE = 2.0
#: Most ids that are sent to all tasks to pick their texts.
SEND_MAX = 1_000_000
#: Most members of a centre that one task holds at a time; members a salt of a centre.
GROUP, SALT = 4096, 512
#: Most bytes of members that one task holds at a time, of each of two blocks.
GROUP_BYTES = 16 << 20
_FANOUT = 8
#: Words of bitmaps that are compared at a time.
_PAIRS = 1 << 20
#: What is known of a pair.
OPEN, APART, LINKED = range(3)


def shingle_sets(texts: tb.Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted, and their offsets."""
    words = tb.Words(texts, tb.SPACED)
    hashes, first = words.window_hashes(k)
    doc = np.searchsorted(words.off, first, side="right") - 1
    short = np.flatnonzero((words.n > 0) & (words.n < k))
    whole = words.n[short].astype(np.uint64) * tb.PLACE[40]
    for j in range(k - 1):
        has = words.n[short] > j
        whole[has] += words.hash[words.off[short[has]] + j] * tb.PLACE[j]
    hashes, doc = np.concatenate((hashes, tb.mix(whole))), np.concatenate((doc, short))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(texts.n + 1))


def prefixes(sets: np.ndarray, off: np.ndarray, percent: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set, by which linked sets meet, and their document."""
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    if len(common) and len(sets):
        hot = common[np.minimum(np.searchsorted(common, sets), len(common) - 1)] == sets
        order = np.lexsort((hot, doc))  # stable: by hash within
        sets = sets[order]
    length = n - -(-percent * n // 100) + 1
    first = np.arange(len(sets)) - np.repeat(off[:-1], n) < np.repeat(length, n)
    return sets[first], doc[first]


def _data(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def common_shingles(data: DataFrame, k: int, percent: int, hot: int, most: int) -> np.ndarray:
    """Shingles under which more than ``hot`` documents stand, the most frequent
    ``most`` of them: counted over all documents."""

    def run(batches: Iterator[pa.RecordBatch]):
        none = np.zeros(0, np.uint64)
        for batch in tb.slices(batches):
            first, _ = prefixes(*shingle_sets(tb.Texts(batch.column(1)), k), percent, none)
            shingle, count = np.unique(first, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle.view(np.int64)), pa.array(count, pa.int64())], ["s", "n"])

    counts = data.mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    rows = counts.orderBy(F.desc("n"), "s").limit(most).collect()
    return np.sort(np.array([r["s"] for r in rows], np.int64).view(np.uint64))


def signatures(data: DataFrame, k: int, percent: int, common: np.ndarray) -> DataFrame:
    """``(doc_id, n, x, y, nodes, bits)``: set size, 128-bit set checksum, keys of the
    nodes, bitmap of the set."""

    def ranges(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of sizes of each set, and that of the largest set it may be linked with."""
        n = np.maximum(n, 1)
        return tuple(np.floor(np.log(v) / np.log(RANGE)).astype(np.uint64) for v in (n, 100 * n // percent))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches):
            sets, off = shingle_sets(tb.Texts(batch.column(1)), k)
            n = np.diff(off)
            some = np.flatnonzero(n)
            x, y = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(some):
                x[some] = np.add.reduceat(sets, off[:-1][some])
                y[some] = np.add.reduceat(tb.mix(sets ^ tb.PLACE[41]), off[:-1][some])
            first, doc = prefixes(sets, off, percent, common)
            low, high = ranges(n)
            # The ranges from low to high: two, or more where percent is below 50.
            steps = np.arange(int((high - low).max(initial=0)) + 1, dtype=np.uint64)
            keys = tb.mix(first[:, None] ^ (low[doc][:, None] + steps + np.uint64(1)) * tb.PLACE[42])
            use = steps <= (high - low)[doc][:, None]
            ends = np.concatenate(([0], np.cumsum(use.sum(axis=1))))[np.searchsorted(doc, np.arange(len(n) + 1))]
            bits = [_bits(sets[off[i]:off[i + 1]], _width(int(n[i]))) for i in range(len(n))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys[use].view(np.int64))),
                 pa.array(bits, pa.binary())], ["doc_id", "n", "x", "y", "nodes", "bits"])

    return data.mapInArrow(run, "doc_id long, n long, x long, y long, nodes array<long>, bits binary")


def _attach(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` with the columns of ``table(doc_id, ...)`` for both (``_a``, ``_b``).  Pairs
    of one ``a`` are dealt over as many salts as they need, and its row is sent once a salt."""
    own, columns = [c for c in pairs.columns if c not in ("a", "b")], [c for c in table.columns if c != "doc_id"]
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    left = (table.withColumnRenamed("doc_id", "a").join(salts, "a")
            .select("a", *(F.col(c).alias(f"{c}_a") for c in columns),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")))
    pairs = pairs.join(salts, "a").select("a", "b", *own, F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    right = table.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    return pairs.join(right, "b").join(left, ["a", "salt"]).drop("salt")


def _texts(data: DataFrame, pairs: DataFrame) -> DataFrame:
    """The texts of the documents in ``pairs``, written out.  Where their ids are few, they
    are sent to the tasks that read the texts; otherwise Spark joins both by id."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "tree-ids")
    few = ids.count() <= SEND_MAX
    return materialize(data.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "tree-texts")


def _bits(values: np.ndarray, width: int) -> bytes:
    """The bitmap of ``width`` bits (a power of two) of hashed values."""
    marks = np.zeros(width, bool)
    marks[(tb.mix(values) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


def _width(n: int) -> int:
    """Bits for sets of about ``n``: two to four times as many, 256 at least."""
    return max(256, 1 << int(2 * n - 1).bit_length())


def bound(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """``(a, b, n_a, n_b, common, full, star)``: sizes, what ``a`` and ``b`` may have in common at most, and
    the bitmap of ``b``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            n_a, n_b, bits_a, bits_b = (batch.column(c).to_pylist() for c in ("n_a", "n_b", "bits_a", "bits_b"))
            most = []
            for n, m, one, two in zip(n_a, n_b, bits_a, bits_b, strict=True):
                width = min(len(one), len(two))
                p, q = _folded(one, width), _folded(two, width)
                most.append(min(n, m, (p & q).bit_count() + min(n - p.bit_count(), m - q.bit_count())))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("a", "b", "n_a", "n_b")), pa.array(most, pa.int64()), batch.column("bits_b"),
                 batch.column("star")], ["a", "b", "n_a", "n_b", "common", "full", "star"])

    return _attach(pairs, signed.select("doc_id", "n", "bits")).mapInArrow(
        run, "a long, b long, n_a long, n_b long, common long, full binary, star boolean")


def _folded(bits: bytes, width: int) -> int:
    """A bitmap at a smaller width: the OR of its parts."""
    out = 0
    for at in range(0, len(bits), width):
        out |= int.from_bytes(bits[at:at + width], "little")
    return out


def compare(pairs: DataFrame, data: DataFrame, k: int, bitmaps: bool) -> DataFrame:
    """``(a, b, n_a, n_b, common, full, adds, lacks)``: sizes and overlap of full sets; with
    ``bitmaps``, that of ``b``, and the shingles that it adds to ``a`` and that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(tb.slices(batches, "text_a"), "text_b"):
            one, at = shingle_sets(tb.Texts(batch.column(2)), k)
            two, to = shingle_sets(tb.Texts(batch.column(3)), k)
            rows = []
            for i in range(batch.num_rows):
                s, t = one[at[i]:at[i + 1]], two[to[i]:to[i + 1]]
                found = np.searchsorted(s, t)
                shared = np.zeros(len(t), bool)
                inside = found < len(s)
                shared[inside] = s[found[inside]] == t[inside]
                full = adds = lacks = None
                if bitmaps:
                    kept = np.zeros(len(s), bool)
                    kept[found[shared]] = True
                    full, adds, lacks = _bits(t, _width(len(t))), t[~shared].tobytes(), s[~kept].tobytes()
                rows.append((len(s), len(t), int(shared.sum()), full, adds, lacks))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]),
                 *(pa.array(c, pa.binary()) for c in cols[3:])], ["a", "b", "n_a", "n_b", "common", "full", "adds", "lacks"])

    both = _attach(pairs, _texts(data, pairs)).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long, n_a long, n_b long, common long, full binary, adds binary, lacks binary")


class Tree:
    """A signature tree over members of one centre: ``levels[0]`` are the leaves, each
    level above has one node for ``_FANOUT`` below it."""

    def __init__(self, centre, n, common, root, full, adds, lacks, compared):
        """Size of the centre; of the members: sizes, overlaps with the centre, components,
        bitmaps (rows of 64-bit words) of their sets, of what they add to the centre and lack of
        it, and whether they were compared with it."""
        # Neighbours are compared alike, members of one component, then of like size.
        order = np.lexsort((n, root, compared))
        n, common, root, full, adds, lacks, compared = (v[order] for v in (n, common, root, full, adds, lacks, compared))
        self.order, self.size = order, len(n)
        # Shingles that fall on a taken bit.
        extra = lambda size, bits: size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [{"n_min": n, "n_max": n, "common": common, "added": n - common, "root_min": root, "root_max": root,
                        "full": full, "adds": adds, "lacks": lacks, "full_extra": extra(n, full),
                        "adds_extra": extra(n - common, adds), "lacks_extra": extra(centre - common, lacks),
                        "compared": compared.astype(np.int64)}]
        while len(self.levels[-1]["n_min"]) > _FANOUT:
            below = self.levels[-1]
            at = np.arange(0, len(below["n_min"]), _FANOUT)
            least = {c: np.minimum.reduceat(below[c], at) for c in ("n_min", "root_min", "compared")}
            most = {c: np.maximum.reduceat(below[c], at) for c in (
                "n_max", "common", "added", "root_max", "full_extra", "adds_extra", "lacks_extra")}
            self.levels.append(least | most | {c: np.bitwise_or.reduceat(below[c], at, axis=0) for c in ("full", "adds", "lacks")})

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of nodes: (index into ``node``, child)."""
        first = node * _FANOUT
        count = np.minimum(first + _FANOUT, len(self.levels[level - 1]["n_min"])) - first
        of = np.repeat(np.arange(len(node)), count)
        return of, first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)


def _possible(x: dict, i: np.ndarray, y: dict, j: np.ndarray, centre: int, percent: int, within: bool) -> np.ndarray:
    """Which pairs of nodes may hold a linked pair; without ``within``, one of different components."""
    fits = (100 * x["n_max"][i] >= percent * y["n_min"][j]) & (100 * y["n_max"][j] >= percent * x["n_min"][i])
    if not within:
        fits &= ~((x["root_min"][i] == x["root_max"][i]) & (y["root_min"][j] == y["root_max"][j]) & (x["root_min"][i] == y["root_min"][j]))
    at = np.flatnonzero(fits)
    i, j = i[at], j[at]
    least = lambda c: np.minimum(x[c][i], y[c][j])
    shared = lambda c: np.bitwise_count(x[c][i] & y[c][j]).sum(axis=1, dtype=np.int64) + least(f"{c}_extra")
    overlap = np.minimum(shared("full"), least("n_max"))
    both = (x["compared"][i] > 0) & (y["compared"][j] > 0)
    rows = np.flatnonzero(both & ((100 + percent) * overlap >= percent * (x["n_min"][i] + y["n_min"][j])))
    if len(rows):
        i, j, n_min = i[rows], j[rows], x["n_min"][i] + y["n_min"][j]
        # Of the centre: its shingles less the union of what the two lack.
        inside = np.minimum(least("common"), x["common"][i] + y["common"][j] - centre + shared("lacks"))
        outside = np.minimum(least("added"), shared("adds"))
        overlap[rows] = np.minimum(overlap[rows], inside + outside)
    else:
        n_min = x["n_min"][i] + y["n_min"][j]
    fits[at] = (100 + percent) * overlap >= percent * n_min
    return fits


def traverse(one: Tree, two: Tree | None, centre: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves of different components that may be linked, of ``one`` and ``two`` (of
    ``one`` with itself if that is None)."""
    none = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    i, j = zip(*none, *traversed(one, two, centre, percent, False), strict=True)
    return np.concatenate(i), np.concatenate(j)


def traversed(one: Tree, two: Tree | None, centre: int, percent: int, within: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same from the top down, in parts; with ``within``, pairs of one component as well."""
    other = two or one
    tops = [np.arange(len(t.levels[-1]["n_min"])) for t in (one, other)]
    i, j = (v.ravel() for v in np.meshgrid(*tops, indexing="ij"))
    # Depth first over parts of the frontier, which bounds memory.
    most = max(64, _PAIRS // one.levels[0]["full"].shape[1])
    stack = [(len(one.levels) - 1, len(other.levels) - 1, i, j)]
    while stack:
        p, q, i, j = stack.pop()
        if two is None:
            i, j = i[i <= j], j[i <= j]
            if p == 0:
                i, j = i[i < j], j[i < j]
        if len(i) > most:
            half = len(i) // 2
            stack += [(p, q, i[:half], j[:half]), (p, q, i[half:], j[half:])]
            continue
        go = _possible(one.levels[p], i, other.levels[q], j, centre, percent, within)
        i, j = i[go], j[go]
        if not len(i):
            continue
        if p == 0 and q == 0:
            yield one.order[i], other.order[j]
            continue
        if two is None or p >= q:
            if p > 0:
                of, i = one.children(p, i)
                j = j[of]
                p -= 1
        if two is None or q > p:
            if q > 0:
                of, j = other.children(q, j)
                i = i[of]
                q -= 1
        stack.append((p, q, i, j))


def _words(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1) if column else np.zeros((0, 4), np.uint64)


class Lists:
    """Lists of shingles by member, to count what two members have in common."""

    def __init__(self, lists: list[bytes]):
        n = np.array([len(v) // 8 for v in lists], np.int64)
        values, found, count = np.unique(np.frombuffer(b"".join(lists), np.uint64), return_inverse=True, return_counts=True)
        # What one member alone has counts for no pair.
        kept = count[found] > 1
        self.values, self.size = found[kept], len(values)
        self.off = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], np.cumsum(n)))]

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Shingles that members ``i`` and ``j`` share, for pairs in order of ``i``."""
        out = np.zeros(len(i), np.int64)
        if not len(i):
            return out
        marks = np.zeros(self.size, bool)
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(i)], strict=True):
            mine = self.values[self.off[i[a]]:self.off[i[a] + 1]]
            if not len(mine):
                continue
            marks[mine] = True
            first, n = self.off[j[a:b]], self.off[j[a:b] + 1] - self.off[j[a:b]]
            ends = np.cumsum(n)
            at = np.arange(ends[-1]) + np.repeat(first - ends + n, n)
            out[a:b] = np.diff(np.concatenate(([0], np.cumsum(marks[self.values[at]])))[np.concatenate(([0], ends))])
            marks[mine] = False
        return out


def _join(table: pa.Table, percent: int):
    """Pairs (positions in ``table``) of members of one centre, or across two blocks of them: those
    that are linked (``True``), and those of which one was not compared that may be."""
    cols = {c: np.asarray(table.column(c).combine_chunks()) for c in ("n", "common", "root", "side")}
    centre = int(table.column("n_a")[0].as_py())
    full, adds, lacks = (table.column(c).to_pylist() for c in ("full", "adds", "lacks"))
    compared = np.array([v is not None for v in lacks])
    adds, lacks = ([v or b"" for v in c] for c in (adds, lacks))
    added, lacked = Lists(adds), Lists(lacks)
    adds = [_bits(np.frombuffer(v, np.uint64), 8 * len(f)) for v, f in zip(adds, full, strict=True)]
    narrow = max(256, _width(centre) // 4)
    lacks = _words([_bits(np.frombuffer(v, np.uint64), narrow) for v in lacks])
    width = np.array([len(v) for v in full], np.int64)
    split = len(np.unique(cols["side"])) > 1
    # Linked sizes differ by 100 / percent at most, and so do widths, rounded up: fold the wider ones.
    factors = [1 << f for f in range((-(-100 // percent) - 1).bit_length() + 1)]
    for w in np.unique(width):
        trees = {}
        for factor in factors:
            for side in (0, 1) if split else (0,):
                rows = np.flatnonzero((width == factor * w) & ((cols["side"] == side) | (not split)))
                if not len(rows):
                    continue
                bits = [_words([v[r] for r in rows]).reshape(len(rows), factor, -1) for v in (full, adds)]
                bits = [np.bitwise_or.reduce(v, axis=1) for v in bits]
                trees[factor, side] = rows, Tree(centre, *(cols[c][rows] for c in ("n", "common", "root")), *bits, lacks[rows],
                                                 compared[rows])
        wider = factors[1:]
        meet = ([((1, 0), (1, 1))] + [((1, s), (f, 1 - s)) for f in wider for s in (0, 1)] if split
                else [((1, 0), None)] + [((1, 0), (f, 0)) for f in wider])
        for first, second in meet:
            if first not in trees or (second and second not in trees):
                continue
            rows, one = trees[first]
            others, two = trees[second] if second else (rows, None)
            for i, j in traversed(one, two, centre, percent, True):
                i, j = rows[i], others[j]
                both = compared[i] & compared[j]
                if not both.all():
                    yield i[~both], j[~both], False
                i, j = i[both], j[both]
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                # Of the centre: its shingles less the union of what the two lack.
                overlap = cols["common"][i] + cols["common"][j] - centre + lacked.common(i, j) + added.common(i, j)
                linked = 100 * overlap >= percent * (cols["n"][i] + cols["n"][j] - overlap)
                yield i[linked], j[linked], True


def _groups(percent: int):
    """Over rows sorted by centre and pair of blocks: each group in turn."""

    def out(tables):
        table = pa.Table.from_batches(tables)
        member, root = (np.asarray(table.column(c).combine_chunks()) for c in ("b", "root"))
        for i, j, sure in _join(table, percent):
            a, b = member[i], member[j]
            state = np.full(len(i), LINKED if sure else OPEN, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(state), pa.array(root[i] != root[j])],
                ["a", "b", "state", "joins"])

    def run(batches: Iterator[pa.RecordBatch]):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)) for c in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                now = tuple(keys[:, a].tolist())
                if held and now != key:
                    yield from out(held)
                    held = []
                key = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from out(held)

    return run


def open_pairs(leaves: DataFrame, parts: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """Pairs ``(a, b, state, joins)`` of members of one centre: linked ones, and those that may
    be but have to be compared; ``joins`` if their components differ.  A pair comes once for
    each centre that it shares."""
    root = parts.select(F.col("node").alias("id"), "root")
    rows = (leaves.join(root.withColumnRenamed("id", "b"), "b", "left")
            .select("a", "b", "n_a", F.col("n_b").alias("n"), "common", F.coalesce("root", "b").alias("root"), "full", "adds",
                    "lacks"))
    held = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("full", "adds", "lacks")), F.lit(0).cast("long"))
    several = (rows.groupBy("a").agg(F.count("*").alias("m"), F.sum(held).alias("bytes"))
               .where("m > 1").select("a", F.ceil(F.greatest(F.col("m") / group, F.col("bytes") / GROUP_BYTES)).alias("blocks")))
    rows = (rows.join(several, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("a", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                    (F.col("block") > F.col("other")).cast("int").alias("side"), "b", "n_a", "n", "common", "root", "full", "adds", "lacks"))
    return (rows.repartition("a", "lo", "hi").sortWithinPartitions("a", "lo", "hi")
            .mapInArrow(_groups(percent), "a long, b long, state int, joins boolean"))


def jaccard_join(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
                 hot: int = HOT, group: int = GROUP) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sets, classes, links)``: every document with size and checksum of its set, the
    representative of each set ``(x, y, n, rep)``, and all links ``(a, b, joins)``, ``a < b``, between
    representatives.  Links with ``joins`` alone give the components of all links: in a group
    of near copies they are no more than its members, where all links are its pairs."""
    data = _data(docs, id_col, text_col)
    sig = materialize(signatures(data, k, percent, common_shingles(data, k, percent, hot, COMMON)), "tree-signatures")
    own = sig.where("n > 0 and doc_id is not null")
    classes = materialize(own.groupBy("x", "y", "n").agg(F.min("doc_id").alias("rep")), "tree-classes")
    signed = materialize(own.join(classes.select(F.col("rep").alias("doc_id"), "x", "y"), ["doc_id", "x", "y"], "left_semi")
                         .dropDuplicates(["doc_id"]).select("doc_id", "n", "nodes", "bits"), "tree-signed")
    nodes = signed.select("doc_id", "n", F.size("nodes").alias("own"), F.explode("nodes").alias("node"))
    members = materialize(nodes.withColumn("size", F.count("*").over(Window.partitionBy("node"))).where("size > 1"), "tree-members")
    pairs = (members.where("size = 2").groupBy("node").agg(F.min(F.struct("doc_id", "n")).alias("p"), F.max(F.struct("doc_id", "n")).alias("q"))
             .groupBy(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b"))
             .agg(F.count("*").alias("shared"), F.max("p.n").alias("m"), F.max("q.n").alias("n")))
    pairs = pairs.where(F.col("shared") >= F.ceil(percent * (F.col("m") + F.col("n")) / (100 + percent)) + 1
                        - F.ceil(percent * F.greatest("m", "n") / 100)).select("a", "b")
    several = members.where("size > 2").select("doc_id", "own", "node", "size")
    # Company over all nodes of a document: high for one of many copies, low for a long
    # text that shares a little with many.
    degree = several.groupBy("doc_id").agg((F.sum("size") / F.first("own")).alias("degree"))
    centres = (several.join(degree, "doc_id").groupBy("node")
               .agg((-F.max(F.struct("degree", (-F.col("doc_id")).alias("minus")))["minus"]).alias("a")))
    stars = several.join(centres, "node").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct()
    stars = materialize(stars.withColumn("star", F.lit(True)).unionAll(pairs.withColumn("star", F.lit(False)))
                        .groupBy("a", "b").agg(F.max("star").alias("star")), "tree-stars")
    bounded = materialize(bound(stars, signed), "tree-bounds")
    size = F.col("n_a") + F.col("n_b")
    related = 100 * F.col("common") >= min(RELATED, percent) * F.greatest("n_a", "n_b")
    compared = materialize(compare(bounded.where(F.when(F.col("star"), related).otherwise(
        (100 + percent) * F.col("common") >= percent * size)).select("a", "b"), data, k, True), "tree-compared")
    linked = 100 * F.col("common") >= percent * (size - F.col("common"))
    links = compared.where(linked).select("a", "b")
    leaves = compared.unionByName(bounded.where(F.col("star") & ~related).drop("star").withColumns(
        {c: F.lit(None).cast("binary") for c in ("adds", "lacks")}))
    known = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                            F.when(linked, F.lit(LINKED)).otherwise(F.lit(APART)).alias("state"), F.lit(True).alias("joins"))
    pairs = materialize(known.unionAll(open_pairs(leaves, connected_components(links), percent, group))
                        .groupBy("a", "b").agg(F.max("state").alias("state"), F.max("joins").alias("joins")), "tree-pairs")
    unsure = pairs.where(F.col("state") == OPEN).drop("state")
    more = materialize(compare(unsure.select("a", "b"), data, k, False).where(linked).select("a", "b"), "tree-links")
    links = pairs.where(F.col("state") == LINKED).drop("state").unionAll(unsure.join(more, ["a", "b"], "left_semi"))
    return sig.select("doc_id", "n", "x", "y"), classes, links


def components(sets: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per document."""
    parts = connected_components(links.where("joins"))
    found = (sets.join(classes, ["x", "y", "n"], "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
