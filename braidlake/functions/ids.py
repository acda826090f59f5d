"""Segment ids and steps as they are compared everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters of Unicode's White_Space property.
WHITESPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def segment_id(col: Column) -> Column:
    """The id without surrounding whitespace and without signs at its end; null stays null, case counts."""
    return F.rtrim(F.btrim(col, F.lit(WHITESPACE)), F.lit(WHITESPACE + "+-"))


def step_orient(seg: Column, orient: Column) -> Column:
    """`orient`, else the sign at the end of `seg`, else `+`."""
    sign = F.right(F.rtrim(seg, F.lit(WHITESPACE)), F.lit(1))
    return F.coalesce(orient, F.when(sign == "-", F.lit("-")).otherwise(F.lit("+")))


def step_key(step: Column) -> Column:
    """One string per step, id then orientation; a null id counts as the empty id."""
    seg = step["seg"]
    return F.concat(F.coalesce(segment_id(seg), F.lit("")), F.lit("\t"), step_orient(seg, step["orient"]))


def step_ids(steps: Column) -> Column:
    """Segment ids of an array of steps, in order."""
    return F.transform(steps, lambda s: segment_id(s["seg"]))
