"""Segments cut at the coordinates of their alignments.

Intervals come from sorting each segment's breakpoints; edges find their intervals by equality of (segment, begin, end),
so an edge over several intervals finds none and is left out; links have no coordinates and join whole segments.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.operators.numbering import densely_numbered
from braidlake.operators.skew import frequent_candidates, skewed_join, split_by_weight
from braidlake.schema import STEPS, TAG_VALUE
from braidlake.session import checkpointed

ALIGNED = ("E", "C")


def segments_of(records: DataFrame) -> DataFrame:
    """(seg, length, seg_ord): each segment's last record, at its first place."""
    own = records.where(F.col("rec_type") == "S")
    return own.groupBy(F.col("id").alias("seg")).agg(F.max_by("length", "ord").alias("length"), F.min("ord").alias("seg_ord"))


def _followed(points: DataFrame) -> DataFrame:
    """(seg, at, before, next, after): each breakpoint with the one before it and the next two of its segment.

    Breakpoints of segments with very many of them are numbered over all tasks and meet their neighbours by number.
    """
    heavy = frequent_candidates(points, "seg")
    light, hot = split_by_weight(points, "seg", heavy)
    order = Window.partitionBy("seg").orderBy("at")
    out = light.select("seg", "at", F.lag("at").over(order).alias("before"), F.lead("at").over(order).alias("next"), F.lead("at", 2).over(order).alias("after"))
    if not heavy:
        return out
    n = densely_numbered(hot, ["seg", "at"], "n").select("seg", "at", "n")
    numbered = n
    for name, by in (("before", 1), ("next", -1), ("after", -2)):
        numbered = numbered.join(n.select("seg", F.col("at").alias(name), (F.col("n") + by).alias("n")), ["seg", "n"], "left")
    return out.unionByName(numbered.drop("n"))


def intervals(records: DataFrame) -> DataFrame:
    """(seg, length, seg_ord, a, b, is_first, node, following): consecutive intervals of each segment with a record.

    Breakpoints are 0 and the length, if known, and all coordinates of edges at the segment, whether within it or not.
    A segment with one breakpoint is one interval, from it to the length, or to itself. `following` is the next interval's node.
    """
    segments = checkpointed(segments_of(records))
    pairs = [F.struct(F.col(seg).alias("seg"), F.col(at).alias("at")) for seg, at in (("src", "from_start"), ("src", "from_end"), ("dst", "to_start"), ("dst", "to_end"))]
    ends = records.where(F.col("rec_type").isin(*ALIGNED)).select(F.explode(F.array(*pairs)).alias("e")).select("e.seg", "e.at")
    known = segments.where("length is not null").select("seg", F.explode(F.array(F.lit(0).cast("bigint"), F.col("length"))).alias("at"))
    points = checkpointed(known.unionByName(ends).where("at is not null").distinct())
    # a segment's points may be very many; its record is one, and its rows are spread by both
    joined = skewed_join(_followed(points), segments, ["seg"], "inner").unionByName(segments.join(points.select("seg").distinct(), "seg", "left_anti"), allowMissingColumns=True)
    # the last breakpoint begins no interval, unless it is the only one
    only = F.col("next").isNull() & F.col("before").isNull()
    a = F.coalesce("at", F.lit(0).cast("bigint"))
    b = F.when(only, F.coalesce("length", a)).otherwise(F.col("next"))
    named = lambda x, y: F.concat("seg", F.lit(":"), x.cast("string"), F.lit("-"), y.cast("string"))
    kept = joined.where(only | F.col("next").isNotNull())
    following = F.when(F.col("after").isNotNull(), named(F.col("next"), F.col("after")))
    return kept.select("seg", "length", "seg_ord", a.alias("a"), b.alias("b"), F.col("before").isNull().alias("is_first"), named(a, b).alias("node"), following.alias("following"))


def aliases(cut: DataFrame) -> DataFrame:
    """(seg, a, b, node): what an edge's end may say. Each interval by its coordinates, and the one that stands for the whole segment, by none (-1) or by 0 and the length.

    The whole segment is stood for by the interval from 0 to the length, if there is one, else by the first.
    """
    none = F.lit(-1).cast("bigint")
    is_whole = F.coalesce((F.col("a") == 0) & (F.col("b") == F.col("length")), F.lit(False))
    spans = cut.select("seg", "length", "is_first", "a", "b", "node", is_whole.alias("whole"))
    # breakpoints are ordered, so a whole interval that isn't first comes only after negative ones
    whole = spans.where("whole or is_first").groupBy("seg", "length").agg(F.max_by("node", "whole").alias("node"), F.bool_or("whole").alias("whole"))
    by_length = whole.where("length is not null and not whole").select("seg", F.lit(0).cast("bigint").alias("a"), F.col("length").alias("b"), "node")
    return spans.select("seg", "a", "b", "node", F.lit(False).alias("unplaced")).unionByName(by_length.withColumn("unplaced", F.lit(False))).unionByName(
        whole.select("seg", none.alias("a"), none.alias("b"), "node", F.lit(True).alias("unplaced"))
    )


def _located(edges: DataFrame, known: DataFrame, side: str, heavy: list) -> DataFrame:
    """The interval of one end, as `<side>_node`; null if there is none. A segment that very many edges name meets its intervals by broadcast."""
    seg, a, b = ("src", "from_start", "from_end") if side == "from" else ("dst", "to_start", "to_end")
    unplaced, none = F.col(a).isNull() & F.col(b).isNull(), F.lit(-1).cast("bigint")
    # with only one of the two coordinates it is no interval, and null matches nothing
    placed = edges.withColumns({"unplaced": unplaced, "_a": F.when(unplaced, none).otherwise(F.col(a)), "_b": F.when(unplaced, none).otherwise(F.col(b))})
    names = known.select(F.col("seg").alias(seg), F.col("a").alias("_a"), F.col("b").alias("_b"), "unplaced", F.col("node").alias(f"{side}_node"))
    return skewed_join(placed, names, [seg, "_a", "_b", "unplaced"], "left", heavy=heavy).drop("_a", "_b", "unplaced")


def rewired(records: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """Link-like records with `from_node` and `to_node`, the intervals of their ends; null where there is none. `cut` are the intervals, if made already."""
    if cut is None:
        # written once, so that the text is parsed once
        records = checkpointed(records)
        cut = intervals(records)
    known = checkpointed(aliases(cut))
    edges = records.where(F.col("rec_type").isin("L", *ALIGNED))
    src, dst = (frequent_candidates(edges, c) for c in ("src", "dst"))
    return _located(_located(edges, known, "from", src), known, "to", dst)


def skipped_edges(records: DataFrame) -> DataFrame:
    """Link-like records that splitting leaves out, because an end is no interval."""
    return rewired(records).where(F.col("from_node").isNull() | F.col("to_node").isNull()).drop("from_node", "to_node")


def warn_skipped(records: DataFrame, limit: int = 20) -> None:
    """A RuntimeWarning for each skipped edge, the first `limit` of them by their ends, and one that says how many more there are. Runs a job."""
    skipped = checkpointed(skipped_edges(records).select("src", "dst"))
    for row in skipped.orderBy("src", "dst").limit(limit).collect():
        warnings.warn(f"Skipping edge without matching interval: {row[0]} -> {row[1]}", RuntimeWarning, stacklevel=2)
    more = skipped.count() - limit
    if more > 0:
        warnings.warn(f"Skipping {more} more edges without matching interval", RuntimeWarning, stacklevel=2)


def warn_growth(records: DataFrame) -> None:
    """RuntimeWarning if splitting makes over ten times as many names of intervals as there are segments; see aliases. Runs a job."""
    before, after = segments_of(records).count(), aliases(intervals(records)).count()
    if after > 10 * before:
        warnings.warn(f"splitting made {after} names of intervals of {before} segments", RuntimeWarning, stacklevel=2)


def chain_links(cut: DataFrame) -> DataFrame:
    """(src, dst, seg_ord, a): links between consecutive intervals of a segment."""
    return cut.where("following is not null").select(F.col("node").alias("src"), F.col("following").alias("dst"), "seg_ord", "a")


def _record(df: DataFrame, kind: str | Column, ord_: Column, **columns: Column) -> DataFrame:
    none = {
        **dict.fromkeys(("id", "sequence", "src", "dst", "orientation_from", "orientation_to", "overlap", "cigar", "name"), "string"),
        **dict.fromkeys(("length", "from_start", "from_end", "to_start", "to_end"), "bigint"), "steps": STEPS, "tags": f"map<string,{TAG_VALUE}>",
    }
    return df.select((F.lit(kind) if isinstance(kind, str) else kind).alias("rec_type"), ord_.alias("ord"), *[columns.get(c, F.lit(None).cast(t)).alias(c) for c, t in none.items()])


def split_on_alignment(records: DataFrame) -> DataFrame:
    """Records of the split graph: intervals as segments without sequence and tags, links between neighbours, and the rewired edges.

    Their order is all segments with their chains, then alignments, then links, which decides where later edges win.
    """
    records = checkpointed(records)
    cut = checkpointed(intervals(records))
    plus = F.lit("+")
    # ord is compared within a phase only, so each phase keeps its own key
    key = lambda phase, of, part, at: F.struct(F.lit(phase).alias("phase"), of.alias("of"), F.lit(part).alias("part"), at.alias("at"))
    segments = _record(cut, "S", key(0, F.col("seg_ord"), 0, F.col("a")), id=F.col("node"), length=F.col("b") - F.col("a"))
    chains = _record(chain_links(cut), "L", key(0, F.col("seg_ord"), 1, F.col("a")), src=F.col("src"), dst=F.col("dst"), orientation_from=plus, orientation_to=plus)
    met = rewired(records, cut).where(F.col("from_node").isNotNull() & F.col("to_node").isNotNull())
    edges = _record(
        met, F.col("rec_type"), F.struct(F.when(F.col("rec_type") == "L", 2).otherwise(1).alias("phase"), F.col("ord").alias("of"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("at")),
        src=F.col("from_node"), dst=F.col("to_node"), orientation_from=F.col("orientation_from"), orientation_to=F.col("orientation_to"), overlap=F.col("overlap"), cigar=F.col("cigar"), tags=F.col("tags"),
    )
    # nodes and edges are made of it several times
    return checkpointed(segments.unionByName(chains).unionByName(edges))
