"""Queries on skewed keys, failing rows and orphan references, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlake.functions.ids import WHITESPACE, segment_id, step_ids
from braidlake.operators.orphans import first_delivery_only, orphan_counts, orphan_references, presence
from braidlake.operators.skew import frequent_candidates, heavy_keys, per_key, skewed_join, union_all
from braidlake.session import checkpointed, table
from braidlake.sources.rejects import failing, load_lines

#: A segment is heavy from this share of the rows.
HEAVY_SHARE = 0.02


def _real(key: Column) -> Column:
    return key.isNotNull() & (key != "")


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "links").select(segment_id(F.col("from_segment")).alias("seg_id"), segment_id(F.col("to_segment")).alias("neighbour"))


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "paths").select("rec_id", F.explode(step_ids(F.col("segments"))).alias("seg_id"))


# --- few keys with most rows --------------------------------------------------------------------------------------


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Segment ids with at least 2 % of the rows of links (by from_segment) or of the steps of paths."""
    both = {"from_segment": _links(spark, folder).select("seg_id"), "segments": _steps(spark, folder).select("seg_id")}
    return union_all([heavy_keys(df, "seg_id", HEAVY_SHARE).where(_real(F.col("seg_id"))).select(F.lit(field).alias("field"), "seg_id") for field, df in both.items()])


def _lengths(spark: SparkSession, folder: str) -> DataFrame:
    """(seg_id, length): the longest loaded length of each segment."""
    return _loaded(spark, folder).where(_real(F.col("seg_id"))).groupBy("seg_id").agg(F.max("length").alias("length"))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a segment and a segment it links to, with the number of links and the segment's longest loaded length.

    Heavy segments are told on the links themselves. Pairs are counted before anything is joined, so each reaches the join once.
    """
    links = _links(spark, folder).where(_real(F.col("seg_id")) & _real(F.col("neighbour")))
    heavy = frequent_candidates(links, "seg_id")
    pairs = links.groupBy("seg_id", "neighbour").agg(F.count("*").alias("n_links"))
    return skewed_join(pairs, _lengths(spark, folder), ["seg_id"], "left", heavy=heavy).select("seg_id", "neighbour", "n_links", "length")


def p2_link_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per from_segment the number of links and of distinct neighbours, with the segment's longest loaded length."""
    return per_key(_links(spark, folder).where(_real(F.col("seg_id"))), _lengths(spark, folder), "seg_id", "neighbour", "n_links", "n_neighbours")


def p2_path_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per segment the number of steps and of distinct path records with such a step, with the segment's longest loaded length."""
    return per_key(_steps(spark, folder).where(_real(F.col("seg_id"))), _lengths(spark, folder), "seg_id", "rec_id", "n_steps", "n_paths")


def p2_containing_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a segment and a path record that contains it, with the number of such steps and the segment's longest loaded length."""
    steps = _steps(spark, folder).where(_real(F.col("seg_id")))
    heavy = frequent_candidates(steps, "seg_id")
    pairs = steps.groupBy("seg_id", "rec_id").agg(F.count("*").alias("n_steps"))
    return skewed_join(pairs, _lengths(spark, folder), ["seg_id"], "left", heavy=heavy).select("seg_id", "rec_id", "n_steps", "length")


# --- failing rows -------------------------------------------------------------------------------------------------

CHECKED = {"segments": ("tags", "tags"), "links": ("overlap", "cigar"), "edges": ("cigar", "cigar"), "raw_lines": ("value", "line")}


def rejected(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, rec_id, reason) of all failing records."""
    return union_all([failing(table(spark, folder, name), name, column, kind) for name, (column, kind) in CHECKED.items()])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejected(spark, folder).select("table_name", "rec_id")


def p4_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Failing records with the reason."""
    return rejected(spark, folder)


def p4_loaded(spark: SparkSession, folder: str) -> DataFrame:
    """The valid lines of the delivered files as typed records, each delivery once per line."""
    lines = table(spark, folder, "raw_lines").select("value", F.struct("loaded_at", "rec_id", "file_name", "line_no").alias("ord"))
    records, _ = load_lines(lines)
    first = F.coalesce("id", "name", "src")
    return records.select("ord.rec_id", "rec_type", first.alias("subject"), "dst", "length", "from_start", "to_end", F.size("steps").cast("bigint").alias("n_steps"))


# --- orphan references --------------------------------------------------------------------------------------------


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    columns = [segment_id(F.col("id")).alias("seg_id"), "length", "loaded_at"]
    segments = table(spark, folder, "segments").select(*columns, "deleted_at")
    anchors = table(spark, folder, "anchor_segments").select(*columns, F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return segments.unionByName(anchors)


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """(table_name, rec_id, seg_id, t): one row per orphan reference of a record, at its earliest delivery."""
    periods = presence(_loaded(spark, folder))
    links, paths = table(spark, folder, "links"), table(spark, folder, "paths")
    ends = F.array_distinct(F.array(segment_id(F.col("from_segment")), segment_id(F.col("to_segment"))))
    refs = {
        "links": links.select("rec_id", F.explode(ends).alias("seg_id"), F.col("loaded_at").alias("t")),
        "paths": paths.select("rec_id", F.explode(F.array_distinct(step_ids(F.col("segments")))).alias("seg_id"), F.col("loaded_at").alias("t")),
    }
    # written once: it is compared with all deliveries and then counted
    found = checkpointed(orphan_references(union_all([df.withColumn("table_name", F.lit(name)) for name, df in refs.items()]), periods))
    # Records are numbered uniquely over all tables, so deliveries of both can be told apart by rec_id alone.
    deliveries = union_all([df.select("rec_id", F.col("loaded_at").alias("t")) for df in (links, paths)])
    return first_delivery_only(found, deliveries).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(spark, folder).select("table_name", "rec_id", "seg_id")


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_counts(orphans(spark, folder))


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p2_link_counts, p2_path_counts, p2_containing_paths, p4_found, p4_reasons, p4_loaded, p5_found, p5_counts)}

# --- SQL ----------------------------------------------------------------------------------------------------------

_SPACE = "".join(f"\\x{{{ord(c):04X}}}" for c in WHITESPACE)


def id_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SPACE}]+|[{_SPACE}+-]+$', '', 'g')"


_LINKS = f"SELECT {id_sql('from_segment')} AS seg_id, {id_sql('to_segment')} AS neighbour FROM links"
_STEPS = f"SELECT rec_id, {id_sql('u.seg')} AS seg_id FROM (SELECT rec_id, unnest(segments) AS u FROM paths)"
_LOADED = (
    f"SELECT {id_sql('id')} AS seg_id, length, loaded_at, deleted_at FROM segments UNION ALL "
    f"SELECT {id_sql('id')}, length, loaded_at, NULL FROM anchor_segments"
)
_LENGTHS = f"SELECT seg_id, max(length) AS length FROM ({_LOADED}) WHERE seg_id <> '' GROUP BY seg_id"
_ORPHANS = f"""
WITH loaded AS (SELECT seg_id, loaded_at, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS gone FROM ({_LOADED})),
refs AS (
  SELECT 'links' AS table_name, rec_id, seg_id, min(loaded_at) AS t FROM (
    SELECT rec_id, {id_sql('from_segment')} AS seg_id, loaded_at FROM links UNION ALL SELECT rec_id, {id_sql('to_segment')}, loaded_at FROM links)
  GROUP BY ALL
  UNION ALL
  SELECT 'paths', rec_id, {id_sql('u.seg')} AS seg_id, min(loaded_at) FROM (SELECT rec_id, loaded_at, unnest(segments) AS u FROM paths) GROUP BY ALL)
SELECT table_name, rec_id, seg_id, t FROM refs
WHERE seg_id <> '' AND NOT EXISTS (SELECT 1 FROM loaded AS l WHERE l.seg_id = refs.seg_id AND l.loaded_at <= t AND l.gone > t)
"""

# The record format in SQL: patterns of TESTDATA's rules, and the fields of a line.
_CIGAR = r"(\*|([0-9]+[MIDNSHPX=])+)"
_FLOAT = r"[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_TAG = rf"[A-Za-z][A-Za-z0-9]:(A:[!-~]|i:[+-]?[0-9]+|f:{_FLOAT}|Z:[ -~]+|H:([0-9A-F][0-9A-F])+|B:[cCsSiIf](,{_FLOAT})+|J:(?s:.*))"


def _tags_ok(tags: str) -> str:
    """Whether all of a list of tags are valid."""
    # what json_valid takes beyond strict JSON, outside of strings: commas at the end of a list, and numbers that aren't
    bare = """regexp_replace(substr(x, 6), '"(\\\\.|[^"\\\\])*"', '""', 'g')"""
    json = f"json_valid(substr(x, 6)) AND NOT regexp_matches({bare}, ',[ \\t\\r\\n]*[\\]}}]|(?i:nan|inf)')"
    return f"len(list_filter({tags}, lambda x: NOT regexp_full_match(x, '{_TAG}') OR (x LIKE '__:J:%' AND NOT ({json})))) = 0"


_FIELD = '("(?:[^"]|"")*"|[^"\\t][^\\t]*|)'
_LINES = f"""
WITH lines AS (
  SELECT rec_id, regexp_replace(value, '\r$', '') AS v, left(value, 1) AS letter FROM raw_lines WHERE value IS NOT NULL AND left(value, 1) IN ('S', 'L', 'E', 'P', 'O')),
cut AS (
  SELECT *, regexp_full_match(v || chr(9), '({_FIELD}\t)+') AS quoted,
    list_transform(regexp_extract_all(v || chr(9), '{_FIELD}\t', 1), lambda x: CASE WHEN x LIKE '"%' THEN replace(substr(x, 2, len(x) - 2), '""', '"') ELSE x END) AS f0,
    CASE f0[1] WHEN 'S' THEN 3 WHEN 'L' THEN 6 WHEN 'E' THEN 9 WHEN 'P' THEN 4 WHEN 'O' THEN 3 END AS least FROM lines),
parts AS (
  SELECT *, f0[1:greatest(least, coalesce(list_max(list_filter(range(1, len(f0) + 1), lambda i: f0[i] <> '')), 0))] AS f FROM cut),
typed AS (
  SELECT *, CASE WHEN f[1] = 'S' AND regexp_full_match(f[3], '[0-9]+') AND len(f) > 3 THEN 5 ELSE least + 1 END AS tags_at FROM parts),
steps AS (SELECT *, string_split(f[3], ',') AS steps FROM typed),
checked AS (
  SELECT *, coalesce(quoted AND least IS NOT NULL AND len(f) >= least AND f[2] <> '' AND {_tags_ok('f[tags_at:]')} AND CASE f[1]
    WHEN 'S' THEN CASE WHEN regexp_full_match(f[3], '[0-9]+') THEN len(f) = 3 OR regexp_full_match(f[4], '[*]|[a-zA-Z]+') ELSE regexp_full_match(f[3], '[*]|[a-zA-Z]+') END
    WHEN 'L' THEN f[4] <> '' AND f[3] IN ('+', '-') AND f[5] IN ('+', '-') AND regexp_full_match(f[6], '{_CIGAR}')
    WHEN 'E' THEN regexp_full_match(f[3], '(?s:.+)[+-]') AND regexp_full_match(f[6], '(?s:.+)[+-]') AND len(list_filter([f[4], f[5], f[7], f[8]], lambda x: NOT regexp_full_match(x, '[0-9]+[$]?'))) = 0
      AND try_cast(rtrim(f[4], '$') AS HUGEINT) <= try_cast(rtrim(f[5], '$') AS HUGEINT) AND try_cast(rtrim(f[7], '$') AS HUGEINT) <= try_cast(rtrim(f[8], '$') AS HUGEINT) AND regexp_full_match(f[9], '{_CIGAR}')
    WHEN 'P' THEN len(list_filter(steps, lambda x: NOT regexp_full_match(x, '[^\\s;]+[+-]'))) = 0 AND len(list_filter(string_split(f[4], ','), lambda x: NOT regexp_full_match(x, '{_CIGAR}'))) = 0
    WHEN 'O' THEN len(list_filter(steps, lambda x: NOT regexp_full_match(x, '[^\\s;]+[+-]'))) = 0 END, false) AS ok FROM steps)"""

ORACLE = {
    "p4_found": f"""{_LINES}
SELECT DISTINCT 'raw_lines' AS table_name, rec_id FROM checked WHERE NOT ok
UNION SELECT 'segments', rec_id FROM segments WHERE tags IS NOT NULL AND NOT ({_tags_ok('string_split(tags, chr(9))')})
UNION SELECT 'links', rec_id FROM links WHERE NOT regexp_full_match(overlap, '{_CIGAR}')
UNION SELECT 'edges', rec_id FROM edges WHERE NOT regexp_full_match(cigar, '{_CIGAR}')""",
    "p4_loaded": f"""{_LINES}
SELECT rec_id, f[1] AS rec_type, CASE f[1] WHEN 'E' THEN rtrim(f[3], '+-') ELSE f[2] END AS subject, CASE f[1] WHEN 'L' THEN f[4] WHEN 'E' THEN rtrim(f[6], '+-') END AS dst,
  CASE WHEN f[1] = 'S' THEN try_cast(regexp_extract(f[3], '^[0-9]+$') AS BIGINT) END AS length, CASE WHEN f[1] = 'E' THEN CAST(rtrim(f[4], '$') AS BIGINT) END AS from_start,
  CASE WHEN f[1] = 'E' THEN CAST(rtrim(f[8], '$') AS BIGINT) END AS to_end, CASE WHEN f[1] IN ('P', 'O') THEN len(steps) END AS n_steps
FROM checked WHERE ok""",
    "p2_found": f"""
SELECT 'from_segment' AS field, seg_id FROM ({_LINKS}) WHERE seg_id <> '' GROUP BY seg_id HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM links)
UNION ALL
SELECT 'segments', seg_id FROM ({_STEPS}) WHERE seg_id <> '' GROUP BY seg_id HAVING count(*) >= {HEAVY_SHARE} * (SELECT count(*) FROM ({_STEPS}))""",
    "p2_neighbours": f"""
SELECT p.*, l.length FROM (SELECT seg_id, neighbour, count(*) AS n_links FROM ({_LINKS}) WHERE seg_id <> '' AND neighbour <> '' GROUP BY ALL) AS p LEFT JOIN ({_LENGTHS}) AS l USING (seg_id)""",
    "p2_link_counts": f"""
SELECT p.*, l.length FROM (SELECT seg_id, count(*) AS n_links, count(DISTINCT neighbour) AS n_neighbours FROM ({_LINKS}) WHERE seg_id <> '' GROUP BY seg_id) AS p LEFT JOIN ({_LENGTHS}) AS l USING (seg_id)""",
    "p2_path_counts": f"""
SELECT p.*, l.length FROM (SELECT seg_id, count(*) AS n_steps, count(DISTINCT rec_id) AS n_paths FROM ({_STEPS}) WHERE seg_id <> '' GROUP BY seg_id) AS p LEFT JOIN ({_LENGTHS}) AS l USING (seg_id)""",
    "p2_containing_paths": f"""
SELECT p.*, l.length FROM (SELECT seg_id, rec_id, count(*) AS n_steps FROM ({_STEPS}) WHERE seg_id <> '' GROUP BY ALL) AS p LEFT JOIN ({_LENGTHS}) AS l USING (seg_id)""",
    "p5_found": f"SELECT table_name, rec_id, seg_id FROM ({_ORPHANS})",
    "p5_counts": f"""
SELECT table_name, CAST(date_trunc('month', t) AS TIMESTAMP) AS month, count(*) AS n_orphans, count(DISTINCT rec_id) AS n_records, count(DISTINCT seg_id) AS n_keys
FROM ({_ORPHANS}) GROUP BY ALL""",
}
