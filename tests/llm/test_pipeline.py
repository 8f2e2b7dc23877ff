import re

import corpus_pipeline as cp
from hirelake.llm import quality_crf as qc
from tests.llm.conftest import SF, make_docs, texts_of
from tests.llm.test_minhash_dedup import brute as brute_copies
from tests.llm.test_scans import brute_contamination, brute_secrets
from tests.llm.test_swap_packing import direct_ids


def test_run_matches_brute_force(spark):
    """Every stage against its brute force, on what the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    crf = qc.fit_line_crf(docs, labels)
    kept = {r.doc_id for r in qc.score_quality(docs, crf).where("kept").collect()}
    texts = {d: t for d, t in texts_of(docs).items() if d in kept}
    texts = {d: texts[d] for d, (_, root) in brute_copies(texts).items() if d == root}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {d: texts[d] for d, row in brute_contamination(texts, items).items() if not row[-1]}
    masked = {}
    for d, t in texts.items():
        spans, last, out = [], 0, ""
        for s in brute_secrets(t):
            _, a, b = s.split(":")
            if spans and int(a) < spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], int(b))
            else:
                spans.append([int(a), int(b)])
        for a, b in spans:
            out, last = out + t[last:a] + "[SECRET]", b
        masked[d] = out + t[last:]
    got = {}
    for r in cp.run(spark, SF).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {d: len(direct_ids(t)) for d, t in masked.items()}
    assert any(re.search(r"\[SECRET\]", t) for t in masked.values()) or all(t == texts[d] for d, t in masked.items())


def test_stages_on_odd_tables(spark, clashing, empty):
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, empty, SF).count() == 0, name
        out = stage(spark, clashing, SF)
        assert out.columns == clashing.columns, name
        out.collect()
    assert cp.packing(spark, empty, SF).count() == 0
    assert cp.packing(spark, clashing, SF).count() == 4


def test_dedup_keeps_one_of_each_group_and_all_else(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = make_docs(spark, [(5, long), (3, long), (9, long + " more"), (4, "else"), (None, long), (7, None)])
    assert sorted((r.doc_id or -1) for r in cp.near_dedup(spark, df, SF).collect()) == [-1, 3, 4, 7]


def test_masking_follows_the_text(spark):
    df = spark.createDataFrame([(1, "token = abcdef123456 end", 24), (2, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in cp.secret_masking(spark, df, SF).collect()}
    assert got == {1: ("[SECRET] end", 12), 2: (None, None)}
