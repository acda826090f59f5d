"""Tables as lines of text, so that queries go through the parser like any file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from braidlake.functions.ids import segment_id, step_orient
from braidlake.functions.records import parse_lines
from braidlake.session import table


def _line(*fields: Column | str) -> Column:
    """Fields with TABs between; null fields are left out."""
    return F.concat_ws("\t", *[F.lit(f) if isinstance(f, str) else f for f in fields])


def _orient(name: str) -> Column:
    return F.when(F.col(name) == "-", F.lit("-")).otherwise(F.lit("+"))


def _ordered(df: DataFrame, line: Column) -> DataFrame:
    return df.select(line.alias("value"), F.struct("loaded_at", "rec_id").alias("ord"))


def segment_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = _line("S", segment_id(F.col("id")), F.col("length").cast("string"), F.coalesce("sequence", F.lit("*")), F.col("tags"))
    rows = [table(spark, folder, t).where(F.col("id").isNotNull()) for t in ("segments", "anchor_segments")]
    return _ordered(rows[0].select("id", "length", "sequence", "tags", "loaded_at", "rec_id").unionByName(rows[1].select("id", "length", "sequence", "tags", "loaded_at", "rec_id")), line)


def _ended(df: DataFrame) -> DataFrame:
    return df.where((segment_id(F.col("from_segment")) != "") & (segment_id(F.col("to_segment")) != ""))


def link_lines(spark: SparkSession, folder: str) -> DataFrame:
    line = _line("L", segment_id(F.col("from_segment")), _orient("orientation_from"), segment_id(F.col("to_segment")), _orient("orientation_to"), F.coalesce("overlap", F.lit("*")), F.col("tags"))
    return _ordered(_ended(table(spark, folder, "links")), line)


def edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    ends = [(segment_id(F.col(f"{x}_segment")), _orient(f"orientation_{x}"), [F.col(f"{x}_{p}").cast("string") for p in ("start", "end")]) for x in ("from", "to")]
    (u, a, at_u), (v, b, at_v) = ends
    placed = reduce(lambda x, y: x & y, [c.isNotNull() for c in (*at_u, *at_v)])
    eid = F.coalesce("eid", F.lit("*"))
    line = F.when(placed, _line("E", eid, F.concat(u, a), *at_u, F.concat(v, b), *at_v, F.coalesce("cigar", F.lit("*")), F.col("tags"))).otherwise(_line("E", eid, u, a, v, b, F.col("tags")))
    return _ordered(_ended(table(spark, folder, "edges")), line)


def path_lines(spark: SparkSession, folder: str) -> DataFrame:
    steps = F.array_join(F.transform("segments", lambda s: F.concat(segment_id(s["seg"]), step_orient(s["seg"], s["orient"]))), ",")
    kinds = []
    for name, letter in (("paths", "P"), ("walks", "O")):
        rows = table(spark, folder, name).where("name is not null and size(segments) > 0")
        kinds.append(_ordered(rows, _line(letter, F.col("name"), steps, *["*"] * (letter == "P"), F.col("tags"))))
    return kinds[0].unionByName(kinds[1])


def graph_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of segments, links and edges."""
    return parse_lines(segment_lines(spark, folder).unionByName(link_lines(spark, folder)).unionByName(edge_lines(spark, folder)))


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as segments, consecutive parts of an order as links, the parts of each brand as a path."""
    part, item = table(spark, folder, "part"), table(spark, folder, "lineitem")
    node = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    keys = F.struct(F.lit(1).alias("kind"), F.col("l_orderkey").alias("a"), F.row_number().over(order).cast("bigint").alias("b"))
    links = item.select(node("l_partkey").alias("u"), F.lead("l_partkey").over(order).alias("next"), F.col("l_quantity").cast("bigint").alias("q"), keys.alias("ord")).where("next is not null")
    links = links.select(_line("L", F.col("u"), "+", node("next"), "+", "0M", F.concat(F.lit("RC:i:"), F.col("q").cast("string"))).alias("value"), "ord")
    none = F.lit(0).cast("bigint")
    segments = part.select(_line("S", node("p_partkey"), F.col("p_size").cast("string"), "*").alias("value"), F.struct(F.lit(0).alias("kind"), F.col("p_partkey").alias("a"), none.alias("b")).alias("ord"))
    brands = part.groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"), F.min("p_partkey").alias("least"))
    steps = F.array_join(F.transform("keys", lambda k: F.concat(F.lit("p"), k.cast("string"), F.lit("+"))), ",")
    paths = brands.select(_line("P", F.col("p_brand"), steps, "*").alias("value"), F.struct(F.lit(2).alias("kind"), F.col("least").alias("a"), none.alias("b")).alias("ord"))
    return segments.unionByName(links).unionByName(paths)
