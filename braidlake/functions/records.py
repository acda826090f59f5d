"""Lines of text to typed records, in Column expressions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braidlake.schema import STEPS, TAG_VALUE

# What is read as a number.
INTEGER = r"^\s*[+-]?[0-9]+\s*$"
REAL = r"^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$"
RECORD_TYPES = ("S", "L", "P", "E", "C", "O")
SILENT_TYPES = ("H", "F")
LEAST_FIELDS = {"S": 2, "L": 5, "P": 3, "O": 3, "E": 6, "C": 5}


def integer(text: Column) -> Column:
    """The whole number a text spells, else null. Beyond 64 bits and digit groups with `_` count as no number."""
    return F.when(text.rlike(INTEGER), F.trim(text).try_cast("bigint"))


def real(text: Column) -> Column:
    return F.when(text.rlike(REAL), F.trim(text).try_cast("double"))


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _value(kind: Column, text: Column) -> Column:
    items = F.split(text, ",")
    filled = F.filter(items, lambda x: x != "")
    numbers = F.transform(filled, integer)
    whole = F.forall(numbers, lambda x: x.isNotNull())
    is_list = kind == "B"
    return F.struct(
        kind.alias("typ"),
        F.when(kind == "i", integer(text)).alias("i"),
        F.when(kind == "f", real(text)).alias("f"),
        F.when(is_list & whole, numbers).alias("b"),
        F.when(is_list & ~whole, items).alias("bs"),
        F.when(~kind.isin("i", "f", "B"), text).alias("s"),
    )


def parse_tags(fields: Column) -> Column:
    """Tag map of an array of `NAME:TYPE:VALUE` fields; null if none is readable.

    Fields of other shapes and numbers that can't be read are skipped; of equal names the later one stays.
    A list of type B is of whole numbers if all its items are, else of strings, its subtype letter among them.
    """
    parts = F.filter(F.transform(fields, lambda x: F.split(x, ":", 3)), lambda p: F.size(p) == 3)
    entries = F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("key"), _value(F.get(p, F.lit(1)), F.get(p, F.lit(2))).alias("value")))
    usable = F.filter(entries, lambda e: ~((e["value"]["typ"] == "i") & e["value"]["i"].isNull()) & ~((e["value"]["typ"] == "f") & e["value"]["f"].isNull()))
    last = F.filter(usable, lambda e, i: ~F.exists(F.slice(usable, i + 2, F.greatest(F.size(usable), F.lit(1))), lambda other: other["key"] == e["key"]))
    # what `last` does for each entry is worked out anew, so it is left to records that repeat a name
    names = F.transform(parts, lambda p: F.get(p, F.lit(0)))
    tags = F.map_from_entries(F.when(F.size(F.array_distinct(names)) == F.size(names), usable).otherwise(last))
    return F.when(F.size(tags) > 0, tags).cast(f"map<string,{TAG_VALUE}>")


def tag_number(tags: Column, tag: str) -> Column:
    """The number of a tag of type i or f as a double; null for other types."""
    value = F.try_element_at(tags, F.lit(tag))
    return F.coalesce(value["f"], value["i"].cast("double"))


def _sign(text: Column, default: str = "+") -> Column:
    last = F.right(text, F.lit(1))
    return F.when(last.isin("+", "-"), last).otherwise(F.lit(default))


def _bare(text: Column) -> Column:
    return F.rtrim(text, F.lit("+-"))


def _steps(text: Column) -> Column:
    """Steps between commas: one sign is taken off the end."""
    return F.transform(
        F.split(text, ","),
        lambda x: F.struct(F.when(F.right(x, F.lit(1)).isin("+", "-"), F.left(x, F.length(x) - 1)).otherwise(x).alias("seg"), _sign(x).alias("orient")),
    )


def parse_lines(lines: DataFrame, mode: str = "FAILFAST", strict_gfa2: bool = False) -> DataFrame:
    """Records of lines (value, ord).

    Lines of other kinds are left out (see unsupported_lines). A record with too few fields raises an error (FAILFAST), is
    left out (DROPMALFORMED), or comes with its reason in a further column `malformed` (PERMISSIVE). Null lines are no
    records. strict_gfa2 reads positions ending in `$`; without it such an edge is read by its orientation fields.
    """
    if mode not in ("FAILFAST", "DROPMALFORMED", "PERMISSIVE"):
        raise ValueError(f"unknown mode: {mode}")
    # Conditions are on the line itself, so that a filter by record type comes before any line is split.
    kind = F.substring_index("value", "\t", 1)
    n = F.length("value") - F.length(F.replace("value", F.lit("\t"))) + 1
    kept = lines.where(kind.isin(*RECORD_TYPES))
    short = F.lit(False)
    for k, least in LEAST_FIELDS.items():
        short = short | ((kind == k) & (n < least))
    reason = F.concat(F.lit("Malformed "), kind, F.lit(" record"))
    if mode == "FAILFAST":
        # A column that is not deterministic isn't merged with the caller's own filters: merged with one that gives null, it
        # would be evaluated on lines which that filter leaves out.
        checked = F.when(short & (F.spark_partition_id() >= 0), F.raise_error(reason).cast("boolean")).otherwise(F.lit(True))
        kept = kept.select("value", "ord", checked.alias("_ok")).where("_ok")
    elif mode == "DROPMALFORMED":
        kept = kept.where(~short)
    extra = [F.when(short, reason).alias("malformed")] if mode == "PERMISSIVE" else []
    return parse_fields(kept.select("value", "ord", F.split("value", "\t", -1).alias("f")), kind, n, strict_gfa2, extra)


def parse_fields(rows: DataFrame, kind: Column, n: Column, strict_gfa2: bool, extra: Iterable[Column] = ()) -> DataFrame:
    """Records of rows (ord, f array of fields) of the given kind with n fields each, and the extra columns."""
    f = lambda i: F.get(F.col("f"), F.lit(i))
    is_s, is_l, is_e, is_c = (kind == k for k in "SLEC")
    is_path = kind.isin("P", "O")
    length = integer(f(2))
    like_tag = F.coalesce(f(3).rlike(r"(?s)^[^:]{2}:[^:]:"), F.lit(False))
    has_sequence = length.isNotNull() & (n > 3) & ~like_tag
    position = lambda i: integer(F.rtrim(f(i), F.lit("$")) if strict_gfa2 else f(i))
    placed = (n >= 9) & position(3).isNotNull() & position(4).isNotNull() & position(6).isNotNull() & position(7).isNotNull()
    split_form = f(2).isin("+", "-")
    at = lambda i: F.when((is_e | is_c) & placed, position(i))

    def by_form(link_a: Column, link_b: Column, placed_value: Column, edge: Column, contained: Column) -> Column:
        return (
            F.when(is_l & split_form, link_a).when(is_l, link_b)
            .when((is_e | is_c) & placed, placed_value).when(is_e, edge).when(is_c, contained)
        )

    minus = lambda c: F.when(F.right(c, F.lit(1)) == "-", F.lit("-")).otherwise(F.lit("+"))
    tags_from = (
        F.when(is_s, F.when(has_sequence, 4).otherwise(3)).when(is_l, F.when(split_form, 6).otherwise(4))
        .when((is_e | is_c) & placed, 9).when(is_e, 6).when(is_c, 5).otherwise(3)
    )
    columns = [
        kind.alias("rec_type"), F.col("ord"),
        F.when(is_s, f(1)).alias("id"),
        F.when(is_s, length).alias("length"),
        F.when(is_s, F.when(length.isNull(), f(2)).when(has_sequence, f(3))).alias("sequence"),
        by_form(f(1), _bare(f(1)), _bare(f(2)), f(2), f(1)).alias("src"),
        by_form(f(3), _bare(f(2)), _bare(f(5)), f(4), f(3)).alias("dst"),
        by_form(f(2), _sign(f(1)), minus(f(2)), f(3), f(2)).alias("orientation_from"),
        by_form(f(4), _sign(f(2)), minus(f(5)), f(5), f(4)).alias("orientation_to"),
        F.when(is_l, F.when(split_form, f(5)).otherwise(f(3))).alias("overlap"),
        at(3).alias("from_start"), at(4).alias("from_end"), at(6).alias("to_start"), at(7).alias("to_end"),
        F.when((is_e | is_c) & placed, f(8)).alias("cigar"),
        F.when(is_path, f(1)).alias("name"),
        F.when(is_path, _steps(f(2))).cast(STEPS).alias("steps"),
        parse_tags(F.slice(F.col("f"), tags_from + 1, F.greatest(n, F.lit(1)))).alias("tags"),
    ]
    return rows.select(*columns, *extra)


def unsupported_lines(lines: DataFrame) -> DataFrame:
    """Lines of kinds that are skipped with a warning: all but records, headers and fragments; blank ones and comments included."""
    return lines.where(F.col("value").isNotNull() & ~F.left("value", F.lit(1)).isin(*RECORD_TYPES, *SILENT_TYPES))
