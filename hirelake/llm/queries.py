"""Registered queries of the training-data operators.

``QUERIES`` and ``ORACLE`` have the shape of ``hirelake.plans.registry``;
``__spark_entry__`` adds them when this subpackage is present.  Every query
applies its operator with production parameters to the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from hirelake.llm import (
    decontaminate,
    lattice_lm,
    license_templates,
    lpf_dedup,
    merkle_manifest,
    minhash_dedup,
    periodic_runs,
    quality_crf,
    secret_grammar,
    signature_tree,
    swap_packing,
    url_rules,
    weak_toxicity,
)
from hirelake.plans.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _words_sql(pattern: str) -> str:
    lowered = f"translate(coalesce(text, ''), '{url_rules.UPPER}', '{url_rules.LOWER}')"
    return f"regexp_extract_all({lowered}, '{pattern}')"


_SPACED = _words_sql(r"[^\x20\x09-\x0D]+")
_ALNUM = _words_sql(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Unsigned crc32 of the decimal document id: bytes one by one, bits within.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(
  [ord(c)::BIGINT for c in string_split(CAST(doc_id AS VARCHAR), '')],
  lambda crc, byte: list_reduce([0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, _:
    CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END, xor(crc, byte)),
  4294967295::BIGINT))"""


def _components_sql(k: int, percent: int, columns: str) -> str:
    """Components of documents whose sets of ``k``-word shingles are similar."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPACED} AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + {k - 1}], ' ') AS g
  FROM w, unnest(range(1, greatest(len(ws) - {k - 1}, 1) + 1)) t(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= {percent} * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, {columns}
FROM w LEFT JOIN sizes USING (doc_id) JOIN reach ON reach.a = doc_id GROUP BY doc_id
"""


ORACLE["op1_minhash_dedup"] = _components_sql(5, 75, "min(b) AS component_id, min(b) = doc_id AS kept")
ORACLE["op12_signature_tree_join"] = _components_sql(3, 90, "min(b) AS component_id")

ORACLE["op3_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_ALNUM} AS ws FROM documents),
items AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(ws), 13) AS k, array_to_string(ws[i:i + 12], ' ') AS g
  FROM items, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) t(i) WHERE len(ws) > 0),
places AS (
  SELECT doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM windows) s, unnest(range(1, len(ws) - k + 2)) t(i)),
hits AS (SELECT doc_id, i, places.k, item FROM places JOIN windows ON places.k = windows.k AND places.g = windows.g),
hit_words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + k)) t(j) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

ORACLE["op11_periodic_runs"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws, {_CRC32} AS h FROM documents),
sized AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
placed AS (SELECT *, g % n AS a FROM sized WHERE n > 0),
shaped AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM placed),
words AS (
  SELECT doc_id, n, i, ws[1 + CASE WHEN h % 10 = 0 AND i >= a THEN a + (i - a) % p ELSE i END] AS w
  FROM shaped, unnest(range(n)) t(i)),
equal AS (
  SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.w = y.w
  WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (
  SELECT doc_id, q, min(i) AS s, max(i) + q + 1 AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal)
  GROUP BY doc_id, q, island HAVING max(i) + q + 1 - min(i) >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches r WHERE NOT EXISTS (
    SELECT 1 FROM stretches z WHERE z.doc_id = r.doc_id AND z.q < r.q AND r.q % z.q = 0 AND z.s <= r.s AND z.e >= r.e)),
digest AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || (e - s) || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY doc_id),
best AS (
  SELECT doc_id, s AS start, e - s AS length, q AS period FROM runs
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY e - s DESC, s, q) = 1),
gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(s + q, e)) t(i)),
kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS line FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, (1000 * length) // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(line, '')) AS collapsed_sha256
FROM d LEFT JOIN digest USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _field_sql(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field_sql(n_chars if c == "n_chars" else c) for c in merkle_manifest.FIELDS) + ")"


ORACLE["op13_merkle_manifest"] = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN {_CRC32} % {merkle_manifest.TAMPER} = 0 THEN {_leaf_sql('(n_chars::HUGEINT + 1)')}
              ELSE {_leaf_sql('n_chars')} END AS forged
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY g) AS n
  FROM leaves),
levels AS (
  SELECT g, 0 AS lev, place, leaf AS node, n FROM placed
  UNION ALL
  SELECT g, lev + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2
  FROM levels WHERE n > 1 GROUP BY g, lev, place // 2, n),
subroots AS (
  SELECT g, node AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS n, lev AS tall
  FROM levels WHERE n = 1),
tops AS (
  SELECT 0 AS lev, place, subroot AS node, n FROM subroots
  UNION ALL
  SELECT lev + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2
  FROM tops WHERE n > 1 GROUP BY lev, place // 2, n),
ways AS (
  SELECT p.g, p.place, l.lev, p.place >> l.lev AS at, coalesce(x.node, '') AS sibling
  FROM placed p JOIN (SELECT DISTINCT g, lev FROM levels WHERE n > 1) l ON l.g = p.g
  LEFT JOIN levels x ON x.g = p.g AND x.lev = l.lev AND x.place = xor(p.place >> l.lev, 1)
  UNION ALL
  SELECT p.g, p.place, s.tall + t.lev, s.place >> t.lev, coalesce(x.node, '')
  FROM placed p JOIN subroots s ON s.g = p.g CROSS JOIN (SELECT DISTINCT lev FROM tops WHERE n > 1) t
  LEFT JOIN tops x ON x.lev = t.lev AND x.place = xor(s.place >> t.lev, 1)),
proofs AS (SELECT g, place, string_agg(sibling, '' ORDER BY lev) AS proof FROM ways GROUP BY g, place),
folded AS (
  SELECT g, place, 0 AS lev, forged AS node FROM placed
  UNION ALL
  SELECT f.g, f.place, f.lev + 1, sha256(CASE WHEN w.at % 2 = 1 THEN w.sibling || f.node ELSE f.node || w.sibling END)
  FROM folded f JOIN ways w ON w.g = f.g AND w.place = f.place AND w.lev = f.lev)
SELECT doc_id, leaf, subroot, r.node AS root, sha256(coalesce(proof, '')) AS proof_sha256, f.node AS folded_root,
       f.node = r.node AS verified
FROM placed p JOIN subroots s ON s.g = p.g CROSS JOIN (SELECT node FROM tops WHERE n = 1) r
LEFT JOIN proofs q ON q.g = p.g AND q.place = p.place
JOIN (SELECT g, place, arg_max(node, lev) AS node FROM folded GROUP BY g, place) f ON f.g = p.g AND f.place = p.place
"""


@query
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.filter_urls(table(spark, sf_dir, "pages"), rules)


ORACLE["op2_url_filter"] = url_rules.ORACLE_SQL


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(decontaminate.find_benchmark(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query
def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_texts(table(spark, sf_dir, "documents"), class_col="lang")


@query
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.summarise(license_templates.scan_licenses(table(spark, sf_dir, "documents")))


@query
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_grammar.digest(secret_grammar.find_secrets(docs, secret_grammar.learn_formats(docs)))


@query
def op7_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weak_toxicity.score_toxicity(docs, weak_toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crf = quality_crf.fit_line_crf(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score_quality(docs, crf)


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.judge(*periodic_runs.find_runs(table(spark, sf_dir, "documents")))


@query
def op12_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.components(*signature_tree.jaccard_join(table(spark, sf_dir, "documents")))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verify(merkle_manifest.manifest(table(spark, sf_dir, "documents")))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
