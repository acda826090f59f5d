"""Queries of the training-data operators over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.functions.ids import step_ids, step_key
from braidlake.llm.leaks import leaked, leaked_items
from braidlake.llm.packing import MOST_LOSS, SHARD, audited, packed, token_counts
from braidlake.llm.reading import reading_levels
from braidlake.llm.setjoin import similar_records
from braidlake.llm.spans import shared_amounts, shared_spans
from braidlake.plans.data_queries import id_sql
from braidlake.session import table

#: Steps in a row from which a stretch counts as shared.
LEAST_STEPS = 12


def _recorded(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "paths").select("rec_id", "segments").unionByName(table(spark, folder, "walks").select("rec_id", "segments"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of path and walk records by their segments, and of path records by the parts of their names."""
    by_segments = similar_records(_recorded(spark, folder).select("rec_id", step_ids(F.col("segments")).alias("items")), 0.8)
    parts = F.regexp_extract_all(F.lower("name"), F.lit("[a-z0-9]+"), F.lit(0))
    by_name = similar_records(table(spark, folder, "paths").select("rec_id", parts.alias("items")), 0.7)
    return by_segments.select(F.lit("segments").alias("field"), "rec_a", "rec_b").unionByName(by_name.select(F.lit("name").alias("field"), "rec_a", "rec_b"))


def _sequences(spark: SparkSession, folder: str) -> DataFrame:
    return _recorded(spark, folder).select(F.col("rec_id").alias("record"), F.transform("segments", step_key).alias("steps"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Maximal runs of steps of path and walk records that other records share."""
    runs = shared_spans(_sequences(spark, folder), LEAST_STEPS)
    return runs.select(F.col("record").alias("rec_id"), F.col("start_pos").cast("bigint").alias("start_pos"), F.col("end_pos").cast("bigint").alias("end_pos"))


def p3_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Per path and walk record its steps and how many of them are shared."""
    return shared_amounts(_sequences(spark, folder), LEAST_STEPS).withColumnRenamed("record", "rec_id")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container and place of every text, under all three limits."""
    return packed(token_counts(table(spark, folder, "documents")), loss_capacity=MOST_LOSS).withColumnRenamed("item_id", "doc_id")


def p6_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What the containers of all texts break, which must be nothing, and whether they are at most 1 % (or one a shard) more than the least possible."""
    row = audited(packed(token_counts(table(spark, folder, "documents")), loss_capacity=MOST_LOSS))
    close = F.col("n_containers") <= 1.01 * F.col("least_containers") + F.ceil(F.col("n_items") / SHARD)
    return row.select("n_items", "over_tokens", "over_segments", "over_loss", "broken_places", "broken_pieces", close.alias("is_close"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that show at least 12 consecutive words of a held-out item."""
    return leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """Held-out items that leaked, with the number of documents that show them, and of those that show the answer too."""
    return leaked_items(leaked(table(spark, folder, "documents"), table(spark, folder, "eval_items")))


def p8_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Reading level of every document, for running the operator over the whole table."""
    return reading_levels(table(spark, folder, "documents"), table(spark, folder, "level_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p3_found, p3_amounts, p6_containers, p6_audit, p7_found, p7_items, p8_levels)}

# --- SQL ----------------------------------------------------------------------------------------------------------

_RECORDED = "SELECT rec_id, segments FROM paths UNION ALL SELECT rec_id, segments FROM walks"


def _pairs(field: str, sets: str, threshold: float) -> str:
    """Pairs by shared items counted one by one; `sets` is (rec_id, item), distinct."""
    return f"""
SELECT '{field}' AS field, a.rec_id AS rec_a, b.rec_id AS rec_b
FROM ({sets}) AS a JOIN ({sets}) AS b ON a.item = b.item AND a.rec_id < b.rec_id
JOIN (SELECT rec_id, count(*) AS n FROM ({sets}) GROUP BY rec_id) AS na ON na.rec_id = a.rec_id
JOIN (SELECT rec_id, count(*) AS n FROM ({sets}) GROUP BY rec_id) AS nb ON nb.rec_id = b.rec_id
GROUP BY a.rec_id, b.rec_id, na.n, nb.n HAVING count(*) / (na.n + nb.n - count(*)) >= {threshold}"""


_STEP_SETS = f"SELECT DISTINCT rec_id, {id_sql('u.seg')} AS item FROM (SELECT rec_id, unnest(segments) AS u FROM ({_RECORDED})) WHERE u.seg IS NOT NULL"
_NAME_SETS = "SELECT DISTINCT rec_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS item FROM paths"
_SPANS = f"""
WITH steps AS (
  SELECT rec_id, unnest(range(len(segments))) AS pos, unnest(segments) AS u FROM (SELECT rec_id, any_value(segments) AS segments FROM ({_RECORDED}) GROUP BY rec_id)),
keys AS (
  SELECT rec_id, pos, coalesce({id_sql('u.seg')}, '') || chr(9) || coalesce(u.orient, CASE WHEN u.seg ~ '.*-\\s*' THEN '-' ELSE '+' END) AS step FROM steps),
stretches AS (
  SELECT rec_id, pos, list(step) OVER (PARTITION BY rec_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LEAST_STEPS - 1} FOLLOWING) AS g FROM keys),
shared AS (SELECT g FROM stretches WHERE len(g) = {LEAST_STEPS} GROUP BY g HAVING count(DISTINCT rec_id) > 1),
covered AS (SELECT DISTINCT rec_id, unnest(range(pos, pos + {LEAST_STEPS})) AS pos FROM stretches SEMI JOIN shared USING (g)),
runs AS (SELECT rec_id, pos, pos - row_number() OVER (PARTITION BY rec_id ORDER BY pos) AS run FROM covered)"""

ORACLE = {
    "p1_found": _pairs("segments", _STEP_SETS, 0.8) + "\nUNION ALL\n" + _pairs("name", _NAME_SETS, 0.7),
    "p6_audit": "SELECT count(*) AS n_items, 0 AS over_tokens, 0 AS over_segments, 0 AS over_loss, 0 AS broken_places, 0 AS broken_pieces, true AS is_close FROM documents",
    "p3_found": _SPANS + "\nSELECT rec_id, min(pos) AS start_pos, max(pos) AS end_pos FROM runs GROUP BY rec_id, run",
    "p3_amounts": _SPANS + f"""
SELECT r.rec_id, coalesce(len(r.segments), 0) AS n_steps, coalesce(c.n, 0) AS n_shared
FROM (SELECT rec_id, any_value(segments) AS segments FROM ({_RECORDED}) GROUP BY rec_id) AS r
LEFT JOIN (SELECT rec_id, count(*) AS n FROM covered GROUP BY rec_id) AS c ON c.rec_id = r.rec_id""",
}
