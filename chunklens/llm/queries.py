"""The queries opN_<name> and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunklens.llm.decontaminate import contamination
from chunklens.llm.near_dedup import near_duplicates
from chunklens.llm.paragraphs import repeated_paragraphs, shared_passages
from chunklens.llm.pieces import encoded, read_vocabulary
from chunklens.llm.pii import personal_data
from chunklens.llm.quality_classifier import classify
from chunklens.llm.quality_rules import quality_rules
from chunklens.llm.secret_scan import secrets
from chunklens.llm.shards import sharded
from chunklens.llm.shared import Scratch
from chunklens.llm.toxicity import fit, toxicity

#: The vocabulary that the query and the pipeline encode with; a parameter of the operators.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard, and a hash of the whole row, of each document, that arrived in eight batches, read back from the
    compacted store."""
    docs = _table(spark, sf_dir, "documents")
    store = sharded(docs, f"{Scratch(spark, 'store').path}/documents", target_bytes=64 << 20, fanout=4, batches=8)
    return store.read(shard_column="shard").select("doc_id", "shard", F.xxhash64(*docs.columns).alias("row_hash"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that repeat (word is null), then whole passages that do, wherever they lie in lines (line is null)."""
    docs = _table(spark, sf_dir, "documents")
    lines = repeated_paragraphs(docs).withColumn("word", F.lit(None).cast("int"))
    return lines.unionByName(shared_passages(docs), allowMissingColumns=True)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), read_vocabulary(PIECES))
    return found.select("doc_id", F.size("ids").alias("n_pieces"), "ids", "exact")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(_table(spark, sf_dir, "documents")).select("doc_id", "quality_score", "keep")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shards": op1_shards,
    "op2_decontaminate": op2_decontaminate,
    "op3_toxicity": op3_toxicity,
    "op4_personal_data": op4_personal_data,
    "op5_secrets": op5_secrets,
    "op6_near_dedup": op6_near_dedup,
    "op7_paragraphs": op7_paragraphs,
    "op8_quality_rules": op8_quality_rules,
    "op9_pieces": op9_pieces,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE_SQL: dict[str, str] = {
    "op2_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT item_id, least(13, len(ws)) AS n, unnest(list_transform(range(1, len(ws) - least(13, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(13, len(ws)) - 1], ' '))) AS g FROM b WHERE len(ws) > 0),
p AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, (SELECT DISTINCT n FROM v) WHERE len(ws) >= n),
h AS (SELECT p.doc_id, i, p.n, item_id FROM p JOIN v ON v.n = p.n AND v.g = array_to_string(ws[i:i + p.n - 1], ' ')),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op6_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS ss FROM w),
e AS (SELECT doc_id, unnest(ss) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * common >= 85 * (len(a.ss) + len(b.ss) - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(ss) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.doc_id = s.doc_id""",
}
