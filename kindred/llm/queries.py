"""The corpus operators' queries, each over its whole table with production parameters."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses
from .common import fold5
from .decontamination import find_leaks
from .html_text import extract_main_text
from .language import identify_language
from .lexical import search
from .negatives import mine_hard_negatives
from .ngram_join import ngram_jaccard_join
from .packing import byte_bpe, pack
from .quality import quality_rules
from .sharding import kd_shards
from .suffix_dedup import suffix_dedup
from .toxicity import score_toxicity
from .url_filter import Rule, filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs, kept=None).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    got = identify_language(docs, learn=fold5("doc_id") != 0)
    return got.select("doc_id", (fold5("doc_id") == 0).alias("held_out"), "lang_pred", "score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score_toxicity(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return got.select("doc_id", (fold5("doc_id") == 0).alias("held_out"), "score", "predicted")


def tokenizer():
    """The byte-level tokenizer of the packing query, by the paths its package gives."""
    import public_tokenizers as files

    return byte_bpe(str(files.path("byte_bpe_50k.json")), str(files.path("byte_bpe_50k.tiktoken")), files.PATTERN)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer=tokenizer())


#: The host rules of the url query, and the globs that decide where none of them fits.
URL_RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
URL_GLOBS = ["*casino*", "*adult-*", "*free-bets*", "*cheap-pills*", "*spam-*", "*?xxx?*", "*/ads/*"]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, URL_GLOBS).select("page_id", "host", "path", "rule", "verdict")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.KNOWN).select("doc_id", "digest", "license", "is_license")


def _op6_sql() -> str:
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.KNOWN.items())
    return f"""
WITH known AS (
  SELECT sha256(c) AS digest, min(license) AS license
  FROM (SELECT license, {licenses.canonical_sql("body")} AS c FROM (VALUES {known}) AS t(license, body))
  WHERE c <> '' GROUP BY 1),
own AS (SELECT doc_id, sha256({licenses.canonical_sql("text")}) AS digest FROM documents)
SELECT doc_id, own.digest AS digest, license, license IS NOT NULL AS is_license FROM own LEFT JOIN known USING (digest)"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op11_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return kd_shards(docs, shards=8, dims=["source", "lang", "doc_id"], columns=["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(moved, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_url_filter": op5_url_filter,
    "op6_license_scan": op6_license_scan,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_quality_rules": op8_quality_rules,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_html_extraction": op10_html_extraction,
    "op11_kd_sharding": op11_kd_sharding,
    "op12_ranked_search": op12_ranked_search,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": pipeline,
}


def _op5_sql() -> str:
    """A ``?`` of a glob is a character here and a byte in the automaton: the same for these globs, which only ask for one at least."""
    fits = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in URL_RULES]
    rules = ", ".join(f"CASE WHEN {f} THEN {{'size': {len(r.name)}, 'rule': '{r.name}', 'verdict': '{r.verdict}'}} END" for f, r in zip(fits, URL_RULES, strict=True))
    globs = " OR ".join("regexp_full_match(host || path, '(?s)" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g) + "')" for g in URL_GLOBS)
    return f"""
WITH t AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS tail FROM pages),
u AS (SELECT page_id, translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(tail, '^[^/?#]*([^?#]*)', 1) AS path FROM t),
m AS (SELECT *, list_max(list_filter([{rules}], lambda x: x IS NOT NULL)) AS best FROM u)
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM m"""


_OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM words),
size AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM shared JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(y) AS component_id, coalesce(any_value(l), 0) AS n_links
FROM (SELECT DISTINCT doc_id FROM documents) d JOIN reach ON reach.x = d.doc_id LEFT JOIN size ON size.doc_id = d.doc_id
  LEFT JOIN (SELECT x, count(*) AS l FROM edge GROUP BY x) own ON own.x = d.doc_id GROUP BY d.doc_id"""

_OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
own AS (SELECT r, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM own),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY ALL),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
scored AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN own USING (r), total GROUP BY item_id, doc_id, r)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 50"""

_OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10"""

#: DuckDB SQL for those of the queries that SQL can express.
ORACLES: dict[str, str] = {"op5_url_filter": _op5_sql(), "op6_license_scan": _op6_sql(), "op9_ngram_jaccard_join": _OP9_SQL, "op12_ranked_search": _OP12_SQL, "op13_hard_negatives": _OP13_SQL}
