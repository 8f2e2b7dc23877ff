import hashlib
import zlib

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from hirelake.llm import merkle_manifest as mm

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                     StructField("source", StringType()), StructField("n_chars", LongType()),
                     StructField("place", StringType()), StructField("node", StringType()), StructField("n", LongType())])


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, add=0):
    n = row["n_chars"]
    values = [row["doc_id"], row["source"], row["lang"], None if n is None else n + add, row["text"]]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, arity):
    flanks, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for way, a in zip(flanks, at, strict=True):
            run = a - a % arity
            way.append(("".join(level[run:a]), "".join(level[a + 1:run + arity])))
        level = [digest("".join(level[i:i + arity])) for i in range(0, len(level), arity)]
        at = [a // arity for a in at]
    return level[0], flanks


def brute(rows, arity=2):
    langs = sorted({r["lang"] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {v: sorted((r for r in rows if r["lang"] == v),
                        key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))) for v in langs}
    lower = {v: climb([leaf(r) for r in groups[v]], arity) for v in langs}
    root, upper = climb([lower[v][0] for v in langs], arity)
    out = []
    for lang, rest in zip(langs, upper, strict=True):
        subroot, flanks = lower[lang]
        for row, way in zip(groups[lang], flanks, strict=True):
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf(row, int(hit))
            for before, after in way + rest:
                node = digest(before + node + after)
            siblings = "".join(b + a for b, a in way + rest)
            out.append((row["doc_id"], leaf(row), subroot, root, digest(siblings), node, node == root))
    return out


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def made(n):
    """Rows of five languages, one of them null, one with a single row, one holding most."""
    rows = []
    for i in range(n):
        lang = "big" if i % 3 else ["é", "z", None][i // 3 % 3]
        rows.append({"doc_id": i, "text": f"text {i % 50}" * (i % 4), "lang": lang, "source": None if i % 11 == 0 else "s",
                     "n_chars": None if i % 5 == 0 else i, "place": "x", "node": "y", "n": 0})
    rows.append(dict(rows[0], doc_id=n, lang="alone", n_chars=2**63 - 1))
    rows += [dict(rows[1]), dict(rows[1], text="other"), dict(rows[2], doc_id=None), dict(rows[2], doc_id=None)]
    return rows


@pytest.mark.parametrize("arity,height,n", [(2, 2, 60), (2, 9, 33), (3, 1, 40)])
def test_against_brute_force(spark, arity, height, n):
    rows = made(n)
    got = mm.verify(mm.manifest(spark.createDataFrame(rows, SCHEMA), arity, height)).collect()
    assert key(got) == key(brute(rows, arity))


def test_tampered_rows_alone_fail(spark):
    rows = made(200)
    for r in mm.verify(mm.manifest(spark.createDataFrame(rows, SCHEMA))).collect():
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
        known = [x["n_chars"] for x in rows if x["doc_id"] == r.doc_id]
        assert r.verified == (not hit or known[0] is None)


def test_one_row_and_none(spark):
    one = made(5)[:1]
    got = mm.verify(mm.manifest(spark.createDataFrame(one, SCHEMA))).collect()
    assert key(got) == key(brute(one))
    assert got[0].leaf == got[0].root and got[0].proof_sha256 == digest("")
    assert mm.verify(mm.manifest(spark.createDataFrame([], SCHEMA))).collect() == []


def test_very_long_and_empty_texts(spark):
    rows = [dict(made(5)[0], doc_id=i, text=t) for i, t in enumerate([None, "", "é" * 300_000, "a"])]
    assert key(mm.verify(mm.manifest(spark.createDataFrame(rows, SCHEMA), 2, 1)).collect()) == key(brute(rows))


def test_any_changed_field_changes_the_root(spark):
    rows = made(20)
    roots = set()
    for change in ({}, {"text": "t"}, {"lang": "q"}):
        changed = [dict(rows[0], **change)] + rows[1:]
        roots.add(mm.manifest(spark.createDataFrame(changed, SCHEMA)).first()["root"])
    assert len(roots) == 3
