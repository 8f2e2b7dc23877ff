"""MinHash near-dedup with min-max signatures (operator 1).

Each permutation of the shingle space keeps both its minimum and its maximum,
so ``PERMUTATIONS`` hash passes give twice as many signature values.  Values are
banded (``ROWS`` of one kind, from different permutations, a band); documents that
share a band are candidates, and a link needs the exact overlap of full shingle
sets.  At a similarity of 0.75 a link is missed with a probability of 2e-5.

Groups are never expanded into all pairs:

* documents with equal sets are one class, and only its smallest id goes on;
* the members of a band bucket are compared with its centre, the member that
  shares buckets with most others, and linked documents are put together;
* then a centre's members may still lie in several components.  Up to ``STRAYS``
  members outside the centre's component are compared with all members of
  other components.  With more strays, what the centre's comparisons
  tell is used: two members that overlap enough either do so within the centre's
  shingles alone, which their overlaps with the centre bound, or share shingles
  that the centre lacks, and are found by joining on these (rarest first, as
  many as the needed overlap asks for).

Two members of a bucket that are never compared are connected already or cannot
be linked, so components are those of all candidate pairs.

Nulls and edge cases: documents without words have an empty set and are linked
with nothing; fewer than five words make one shingle; a null id is linked
with nothing and kept; rows that repeat an id are one document and agree;
an empty table gives an empty result; columns other than id and text are
ignored.
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

SHINGLE = 5
#: Signature shape: bands of ``ROWS`` minima or maxima.
ROWS, BANDS = 5, 40
#: Most members outside a centre's component that are compared one by one.
STRAYS = 32
PERMUTATIONS = ROWS * BANDS // 2
_rng = np.random.Generator(np.random.PCG64(75))
_FACTORS = _rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64)


def shingles(texts: tb.Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all documents, repeats included, and the
    offsets that tell the documents apart."""
    words = tb.Words(texts, tb.SPACED)
    hashes, first = words.window_hashes(k)
    n = np.maximum(words.n - k + 1, 0)
    short = np.flatnonzero((words.n > 0) & (words.n < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = words.n[short] > j
            whole[has] += words.hash[words.off[short[has]] + j] * tb.PLACE[j]
        whole = tb.mix(whole + words.n[short].astype(np.uint64) * tb.PLACE[40])
        n[short] = 1
        place = np.searchsorted(first, words.off[short])
        hashes = np.insert(hashes, place, whole)
    return hashes, np.concatenate(([0], np.cumsum(n)))


def _sets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, sorted, and their offsets."""
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(off)))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, x, y, bands)``: set size, 128-bit set checksum, band keys."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(batches):
            hashes, off = shingles(tb.Texts(batch.column(1)))
            sets, at = _sets(hashes, off)
            n = np.diff(at)
            some = np.flatnonzero(n)
            x, y = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            keys = np.zeros((len(some), BANDS), np.uint64)
            if len(some):
                starts = at[:-1][some]
                x[some] = np.add.reduceat(sets, starts)
                y[some] = np.add.reduceat(tb.mix(sets ^ tb.PLACE[41]), starts)
                for p, factor in enumerate(_FACTORS):
                    image = sets * factor
                    place = tb.PLACE[p % ROWS]
                    keys[:, p // ROWS] += tb.mix(np.minimum.reduceat(image, starts)) * place
                    keys[:, BANDS // 2 + p // ROWS] += tb.mix(np.maximum.reduceat(image, starts)) * place
                keys = tb.mix(keys + _BAND)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)),
                 pa.ListArray.from_arrays(
                     pa.array(np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)),
                     pa.array(keys.reshape(-1).view(np.int64)))],
                ["doc_id", "n", "x", "y", "bands"])

    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return data.mapInArrow(run, "doc_id long, n long, x long, y long, bands array<long>")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")


def _pairs_of_sets(batch: pa.RecordBatch):
    one, at = _sets(*shingles(tb.Texts(batch.column(2))))
    two, to = _sets(*shingles(tb.Texts(batch.column(3))))
    for i in range(batch.num_rows):
        yield one[at[i]:at[i + 1]], two[to[i]:to[i + 1]]


def _compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b, n_a, n_b, common)``: sizes and overlap of full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(tb.slices(batches, "text_a"), "text_b"):
            rows = []
            for s, t in _pairs_of_sets(batch):
                both = np.concatenate((s, t))
                both.sort(kind="stable")
                rows.append((len(s), len(t), int((both[1:] == both[:-1]).sum())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(np.array(c, np.int64)) for c in zip(*rows, strict=True))],
                ["a", "b", "n_a", "n_b", "common"])

    return _with_texts(pairs, texts).mapInArrow(run, "a long, b long, n_a long, n_b long, common long")


def _differences(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b, shingle)``: the shingles of ``b`` that ``a`` lacks."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in tb.slices(tb.slices(batches, "text_a"), "text_b"):
            own = [np.setdiff1d(t, s, assume_unique=True) for s, t in _pairs_of_sets(batch)]
            row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(own).view(np.int64))],
                ["a", "b", "shingle"])

    return _with_texts(pairs, texts).mapInArrow(run, "a long, b long, shingle long")


def _open_pairs(compared: DataFrame, parts: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of one centre, of different components, that may be linked
    and have not been compared."""
    root = parts.select(F.col("node").alias("id"), "root")
    rows = (compared.join(root.select(F.col("id").alias("a"), F.col("root").alias("a_root")), "a", "left")
            .join(root.select(F.col("id").alias("b"), F.col("root").alias("b_root")), "b", "left")
            .select("a", "b", F.col("n_b").alias("n"), "common", F.coalesce("a_root", "a").alias("main"),
                    F.coalesce("b_root", "b").alias("root")))
    counts = rows.where("root != main").groupBy("a").agg(F.count("*").alias("strays"))
    rows = materialize(rows.join(counts, "a"), "open")
    strays = rows.where("root != main").select("a", *(F.col(c).alias(f"s_{c}") for c in ("b", "n", "common", "root")), "strays")
    members = rows.select("a", "b", "n", "common", "root")
    size = F.col("n") + F.col("s_n")
    # Overlap of a linked pair, times the percentages: common >= percent / (100 + percent) * size.
    near = (100 * F.least("n", "s_n") >= percent * F.greatest("n", "s_n")) & (F.col("root") != F.col("s_root"))
    few = strays.where(F.col("strays") <= STRAYS).join(members, "a").where(near)
    many = strays.where(F.col("strays") > STRAYS)
    inside = many.join(members, "a").where(
        near & ((100 + percent) * F.least("common", "s_common") >= percent * size))
    pairs = few.select("s_b", "b").unionAll(inside.select("s_b", "b"))
    crowded = many.select("a").distinct()
    if not crowded.isEmpty():
        own = materialize(_differences(rows.join(crowded, "a", "left_semi").select("a", "b"), texts), "differences")
        often = own.groupBy("a", "shingle").agg(F.count("*").alias("df")).where("df > 1")
        # A linked pair overlaps in percent of the larger set at least; what the
        # centre's shingles cannot give must come from these.
        place = Window.partitionBy("a", "b").orderBy("df", "shingle")
        whole = Window.partitionBy("a", "b")
        need = F.greatest(F.lit(1), F.ceil(percent * F.col("n") / 100) - F.col("common"))
        kept = (own.join(often, ["a", "shingle"]).join(rows.select("a", "b", "n", "common", "root", "main"), ["a", "b"])
                .withColumn("place", F.row_number().over(place)).withColumn("all", F.count("*").over(whole))
                .where(F.col("place") <= F.col("all") - need + 1))
        left = kept.where("root != main").select("a", "shingle", F.col("b").alias("s_b"), F.col("n").alias("s_n"),
                                                 F.col("root").alias("s_root"))
        sharing = left.join(kept.select("a", "shingle", "b", "n", "root"), ["a", "shingle"]).where(near)
        pairs = pairs.unionAll(sharing.select("s_b", "b"))
    known = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return (pairs.select(F.least("s_b", "b").alias("a"), F.greatest("s_b", "b").alias("b")).distinct()
            .join(known, ["a", "b"], "left_anti"))


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``."""
    data = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sig = materialize(signatures(data), "signatures")
    own = sig.where("n > 0 and doc_id is not null")
    classes = materialize(own.groupBy("x", "y", "n").agg(F.min("doc_id").alias("rep")), "classes")
    bands = (own.join(classes.select(F.col("rep").alias("doc_id"), "x", "y"), ["doc_id", "x", "y"], "left_semi")
             .select("doc_id", F.explode("bands").alias("bucket")))
    shared = (bands.groupBy("bucket").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("size"))
              .where("lo < hi").select("bucket", "size"))
    members = materialize(bands.join(shared, "bucket").distinct(), "members")
    degree = members.groupBy("doc_id").agg(F.sum("size").alias("degree"))
    centres = (members.join(degree, "doc_id").groupBy("bucket")
               .agg((-F.max(F.struct("degree", (-F.col("doc_id")).alias("minus")))["minus"]).alias("a")))
    stars = (members.join(centres, "bucket").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct())
    texts = materialize(data.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    compared = materialize(_compare(stars, texts), "compared")
    linked = 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
    links = compared.where(linked).select("a", "b")
    parts = connected_components(links)

    more = materialize(_compare(_open_pairs(compared, parts, texts, percent), texts).where(linked).select("a", "b"), "links")
    if more.take(1):
        parts = connected_components(links.unionAll(more))

    found = (sig.select("doc_id", "n", "x", "y")
             .join(classes.select("x", "y", "n", "rep"), ["x", "y", "n"], "left")
             .join(parts.withColumnRenamed("node", "rep"), "rep", "left"))
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep")), "doc_id")
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
