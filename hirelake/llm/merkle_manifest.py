"""Merkle manifest of a dataset, with a proof for every row (operator 13).

A row's leaf is the sha256 of its fields, each written as ``<bytes>:<value>`` (or
``-`` for null).  Per language, leaves stand by document id; every ``arity``
consecutive nodes of a level become the sha256 of their hex digests one after
the other (a last run has fewer, even one), until one is left, the subroot.
Subroots, ordered by language, are climbed in the same way to the root.

Levels are strings.  An aligned block of ``arity ** height`` nodes keeps each of its
levels as one string of hex digests, 64 bytes a node.  A parent is the hash of a
substring of fixed width, and the siblings of a node on a level are the substrings
that flank it in its run, so a proof is made of substrings alone.  Block roots
are the nodes of the next tier, which is cut into blocks again, until one block
a language is left; proofs are put together on the way back.  A language of any
size is spread over its blocks, and no task holds more than a block of rows at a time.

Places in a language come from a range-partitioned sort: place in the partition,
plus the rows of the language in earlier partitions.  Texts are hashed where they are
read and never shuffled.

Nulls and edge cases: a null field is ``-``, a null language stands first; rows with
a null id stand first in their language, and are never tampered with; rows that
repeat an id stand by their leaves (equal leaves are interchangeable), each with
its own proof; a lone leaf is its subroot and a lone subroot the root (the proof is
the hash of nothing); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Hex digits of a digest.
WIDTH = 64
#: Levels of a block: ``2 ** HEIGHT`` leaves.
HEIGHT = 9
#: A row is tampered with where this divides the crc32 of its id.
TAMPER = 7


def field(value) -> Column:
    """A field as hashed: byte count, ``:``, value; ``-`` for null."""
    text = F.col(value) if isinstance(value, str) else value
    text = text.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars="n_chars") -> Column:
    return F.sha2(F.concat(*(field(n_chars if c == "n_chars" else c) for c in FIELDS)), 256)


def tampered() -> Column:
    """Whether the row is one that tampering changes (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0, F.lit(False))


def _ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``n`` in their group: range-partitioned,
    sorted and written; no group is one task's work."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    # The id holds the partition in its upper bits and the place in it below.
    placed = materialize(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                         .withColumn("_at", F.monotonically_increasing_id())
                         .withColumn("_part", F.shiftright("_at", 33)), label)
    counts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(group, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                          F.sum("_rows").over(Window.partitionBy(group)).alias("n"))
    return (placed.join(shift, [group, "_part"])
            .withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift"))


def _part(level: Column, start: Column, count: Column) -> Column:
    """``count`` digests of a level from number ``start``: a substring of fixed width."""
    return F.substring(level, (start * WIDTH + 1).cast("int"), (count * WIDTH).cast("int"))


def _levels(arity: int, height: int) -> Column:
    """All levels of a block, lowest first, from ``items`` (sorted by place).

    A whole group climbs until one node is left; a block of a larger group climbs
    ``height`` levels, so that its root is a node of the next tier."""
    own = F.size("items").cast("long")
    needed = sum((own > arity ** h).cast("int") for h in range(height))
    climbs = F.when(F.col("n") > arity ** height, F.lit(height)).otherwise(needed)
    first = F.array_join(F.transform("items", lambda x: x["node"]), "").cast("binary")

    def above(level):
        count = F.ceil(F.octet_length(level) / (WIDTH * arity))
        node = lambda i: F.sha2(_part(level, i * arity, F.lit(arity)), 256)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), node), "").cast("binary")

    steps = F.when(climbs > 0, F.sequence(F.lit(1), climbs)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(first), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _flanks(arity: int, place: Column) -> Column:
    """Per level below the block's root, what stands in a node's run before and after it."""

    def at(level, k):
        number = F.floor(place / F.pow(F.lit(float(arity)), k)).cast("long")
        run = number - number % arity
        return F.struct(_part(level, run, number - run).cast("string").alias("before"),
                        _part(level, number + 1, run + arity - number - 1).cast("string").alias("after"))

    return F.transform(F.slice("levels", 1, F.greatest(F.size("levels") - 1, F.lit(0))), at)


def climb(nodes: DataFrame, arity: int = 2, height: int = HEIGHT) -> tuple[DataFrame, DataFrame]:
    """``(group, root)`` and ``(group, payload, root, path)`` for ``nodes(group, place, n, node,
    payload)``: the root of each group, and for every node the flanks on its way to it,
    lowest first."""
    size = arity ** height
    tiers = []
    while True:
        items = F.sort_array(F.collect_list(F.struct("place", "node", "payload"))).alias("items")
        blocks = nodes.groupBy("group", F.floor(F.col("place") / size).alias("block"), "n").agg(items)
        blocks = materialize(blocks.withColumn("levels", _levels(arity, height)), "merkle-blocks")
        tiers.append(blocks)
        largest = blocks.agg(F.max("n")).first()[0]
        if largest is None or largest <= size:
            break
        nodes = blocks.select("group", F.col("block").alias("place"), F.ceil(F.col("n") / size).alias("n"),
                              F.element_at("levels", -1).cast("string").alias("node"), F.lit(None).cast("string").alias("payload"))
    top = tiers[-1].withColumn("root", F.element_at("levels", -1).cast("string"))
    above = None
    for blocks in reversed(tiers):
        if above is None:
            blocks = top.withColumn("above", F.array().cast("array<struct<before:string,after:string>>"))
        else:
            blocks = blocks.join(above.select("group", F.col("place").alias("block"), "root", F.col("path").alias("above")),
                                 ["group", "block"])
        inner = lambda x: F.struct(x["place"], x["payload"], F.concat(
            _flanks(arity, x["place"] % size), F.col("above")).alias("path"))
        above = (blocks.select("group", "root", F.explode(F.transform("items", inner)).alias("i"))
                 .select("group", "i.place", "i.payload", "root", "i.path"))
    return top.select("group", "root"), above.select("group", "payload", "root", "path")


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its flanks lead to."""
    return F.aggregate(path, node, lambda h, p: F.sha2(F.concat(p["before"], h, p["after"]), 256))


def proof(path: Column) -> Column:
    """All siblings of a path, level by level, as one string."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def manifest(docs: DataFrame, arity: int = 2, height: int = HEIGHT) -> DataFrame:
    """``(doc_id, lang, leaf, forged, subroot, root, path)`` per row of ``docs``: its leaf as
    it is and after tampering, the roots above it and the flanks of its way up."""
    forged = F.when(tampered() & F.col("n_chars").isNotNull(), leaf(F.col("n_chars").cast("decimal(38,0)") + 1))
    rows = docs.select("doc_id", "lang", leaf().alias("node"), forged.alias("forged"),
                       # Null first, then by the bytes of the language.
                       F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("group"))
    placed = _ranked(rows, "group", ["doc_id", "node"], "merkle-leaves")
    payload = F.struct("doc_id", "lang", F.col("node").alias("leaf"), F.coalesce("forged", "node").alias("forged"))
    groups, lower = climb(placed.select("group", "place", "n", "node", payload.alias("payload")), arity, height)

    tops = _ranked(groups.select(F.lit(0).alias("whole"), "group", F.col("root").alias("node")),
                   "whole", ["group"], "merkle-groups")
    _, upper = climb(tops.select(F.col("whole").alias("group"), "place", "n", "node", F.col("group").alias("payload")),
                  arity, height)
    upper = upper.select(F.col("payload").alias("group"), F.col("root").alias("top"), F.col("path").alias("rest"))
    return (lower.join(upper, "group")
            .select("payload.doc_id", "payload.lang", "payload.leaf", "payload.forged", F.col("root").alias("subroot"),
                    F.col("top").alias("root"), F.concat("path", "rest").alias("path")))


def verify(rows: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of a manifest:
    the root that each row, as tampered with, leads to by its original siblings."""
    return (rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
                        fold(F.col("forged"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
