"""Loading rows some of which break the record format.

Blocks of records (Arrow batches) are parsed in bulk: one compiled pattern over a whole block, without a step of Python
per record. A block that fails is halved again and again until the failing records stand alone; only those are
diagnosed strictly, field by field, and get a reason. Valid rows come out unchanged, ready for the typed parser.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from braidlake.functions.records import parse_fields
from braidlake.session import unused

# The record format.
CIGAR = r"(?:\*|(?:[0-9]++[MIDNSHPX=])++)"
FLOAT = r"[+-]?+(?:[0-9]++(?:\.[0-9]++)?+|\.[0-9]++)(?:[eE][+-]?+[0-9]++)?+"
TAG_NAME = r"[A-Za-z][A-Za-z0-9]"
TAG_VALUES = {
    "A": r"[!-~]",
    "i": r"[+-]?+[0-9]++",
    "f": FLOAT,
    "Z": r"[ -~]++",
    "H": r"(?:[0-9A-F]{2})++",
    "B": rf"[cCsSiIf](?:,{FLOAT})++",
}
# In bulk, JSON is taken only in a plain form that is surely valid; anything else is left to the strict parser.
PLAIN_JSON = r"(?:null|true|false|-?(?:0|[1-9][0-9]*+)|\"[ !#-\[\]-~]*+\"|\[(?:\"[ !#-\[\]-~]*+\"(?:,(?=\"))?+)*+\]|\{\"[ !#-\[\]-~]*+\":(?:(?:0|[1-9][0-9]*+)|\"(?:[ !#-\[\]-~]|\\[\"\\/bfnrt])*+\")\})"
TAG = rf"{TAG_NAME}:(?:" + "|".join(f"{k}:{v}" for k, v in TAG_VALUES.items()) + rf"|J:{PLAIN_JSON})"
TAGS = rf"{TAG}(?:\t{TAG})*+"
LINE_TAGS = rf"(?:\t{TAG})*+"
PLAIN_ID = r"[^\t\"\r\n][^\t\r\n]*+"
STEP = r"[^\s\",;][^\s,;]++(?<=[+-])"
STEPS = rf"{STEP}(?:,{STEP})*+"
CIGARS = rf"{CIGAR}(?:,{CIGAR})*+"
REFERENCE = r"[^\t\"\r\n][^\t\r\n]++(?<=[+-])"
INTERVAL = r"[0-9]++\$?+\t[0-9]++\$?+"
SEQUENCE = r"(?:[A-Za-z]++|\*)"
#: Lines without quoting, in their common spellings; what doesn't match is diagnosed, not rejected.
LINE = (
    r"(?:(?![SLEPO])[^\n]*+|(?:"
    rf"S\t{PLAIN_ID}\t(?:{SEQUENCE}|[0-9]++(?:\t{SEQUENCE})?+)"
    rf"|L\t{PLAIN_ID}\t[+-]\t{PLAIN_ID}\t[+-]\t{CIGAR}"
    rf"|E\t{PLAIN_ID}\t{REFERENCE}\t{INTERVAL}\t{REFERENCE}\t{INTERVAL}\t{CIGAR}"
    rf"|P\t{PLAIN_ID}\t{STEPS}\t{CIGARS}"
    rf"|O\t{PLAIN_ID}\t{STEPS}"
    rf"){LINE_TAGS}\t*+\r?+)"
)
INTERVALS = r"(?m)^E\t[^\t]*\t[^\t]*\t([0-9]+)\$?\t([0-9]+)\$?\t[^\t]*\t([0-9]+)\$?\t([0-9]+)"


# --- strict diagnosis -------------------------------------------------------------------------------------------

_full = {k: re.compile(v) for k, v in TAG_VALUES.items()}
_name, _cigar, _digits = re.compile(TAG_NAME), re.compile(CIGAR), re.compile(r"[0-9]+")
_sequence, _position = re.compile(r"\*|[A-Za-z]+"), re.compile(r"([0-9]+)\$?")
_space = re.compile(r"[\s;]")


def _no_constant(text: str) -> None:
    raise ValueError(f"{text} is not JSON")


def cigar_error(text: str | None) -> str | None:
    """Why `text` is not a CIGAR; None if it is, or is null."""
    if text is None or _cigar.fullmatch(text):
        return None
    return "empty cigar" if not text else "cigar not of number-operation pairs"


def tag_error(text: str) -> str | None:
    parts = text.split(":", 2)
    if len(parts) < 3:
        return "tag without name, type and value"
    name, kind, value = parts
    if not _name.fullmatch(name):
        return "tag name"
    if kind == "J":
        try:
            json.loads(value, parse_constant=_no_constant, parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            return "tag value of type J"
        # the library takes any whitespace that JSON allows around a value, and nothing else
        return None
    if kind not in _full:
        return "tag type"
    return None if _full[kind].fullmatch(value) else f"tag value of type {kind}"


def tags_error(text: str | None) -> str | None:
    """Why TAB-separated `text` is not a list of tags; None if it is, or is null. An empty text is one broken tag."""
    if text is None:
        return None
    return next((e for e in map(tag_error, text.split("\t")) if e), None)


def fields_of(line: str) -> list[str] | None:
    """The fields of a line, quotes removed; None if a quoted field is not closed or goes on after its closing quote."""
    out, at, n = [], 0, len(line)
    while True:
        if line.startswith('"', at):
            got, i = [], at + 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return None
                got.append(line[i:j])
                if line.startswith('"', j + 1):
                    got.append('"')
                    i = j + 2
                    continue
                break
            out.append("".join(got))
            at = j + 1
            if at < n and line[at] != "\t":
                return None
        else:
            j = line.find("\t", at)
            j = n if j < 0 else j
            out.append(line[at:j])
            at = j
        if at >= n:
            return out
        at += 1


def _signed(text: str) -> bool:
    return len(text) > 1 and text[-1] in "+-"


def _step_ok(text: str) -> bool:
    return _signed(text) and not _space.search(text)


def _at_most(a: str, b: str) -> bool:
    """a <= b for digits of any length."""
    a, b = a.lstrip("0"), b.lstrip("0")
    return (len(a), a) <= (len(b), b)


def _segment(f: list[str]) -> tuple[int, str | None]:
    if _digits.fullmatch(f[2]):
        if len(f) == 3:
            return 3, None
        return 4, None if _sequence.fullmatch(f[3]) else "sequence"
    return 3, None if _sequence.fullmatch(f[2]) else "sequence or length"


def _link(f: list[str]) -> tuple[int, str | None]:
    if not f[3]:
        return 6, "empty id"
    if f[2] not in ("+", "-") or f[4] not in ("+", "-"):
        return 6, "orientation"
    return 6, cigar_error(f[5])


def _edge(f: list[str]) -> tuple[int, str | None]:
    if not (_signed(f[2]) and _signed(f[5])):
        return 9, "reference without orientation"
    for a, b in ((f[3], f[4]), (f[6], f[7])):
        m, n = _position.fullmatch(a), _position.fullmatch(b)
        if not (m and n):
            return 9, "position"
        if not _at_most(m[1], n[1]):
            return 9, "begin after end"
    return 9, cigar_error(f[8])


def _path(f: list[str]) -> tuple[int, str | None]:
    if not all(map(_step_ok, f[2].split(","))):
        return 4, "step"
    return 4, next((e for e in map(cigar_error, f[3].split(",")) if e), None)


def _walk(f: list[str]) -> tuple[int, str | None]:
    return 3, None if all(map(_step_ok, f[2].split(","))) else "step"


#: By record letter: the least number of fields, and the check of the fields besides the id or name, which gives where the tags begin.
_RECORDS = {"S": (3, _segment), "L": (6, _link), "E": (9, _edge), "P": (4, _path), "O": (3, _walk)}


def line_error(line: str | None) -> str | None:
    """Why a line breaks the format; None if it doesn't, is null, or is of a kind that is not checked."""
    return read_line(line)[0]


def read_line(line: str | None) -> tuple[str | None, list[str] | None]:
    """Why a line breaks the format, or None and its fields: quotes removed, empty ones at the end dropped. No fields if it is not checked."""
    if not line or line[0] not in _RECORDS:
        return None, None
    fields = fields_of(line[:-1] if line.endswith("\r") else line)
    if fields is None:
        return "quoting", None
    if fields[0] not in _RECORDS:
        return "record type", None
    least, check = _RECORDS[fields[0]]
    while len(fields) > least and not fields[-1]:
        fields.pop()
    if len(fields) < least:
        return "too few fields", None
    if not fields[1]:
        return "empty id", None
    tags_at, error = check(fields)
    error = error or next((e for e in map(tag_error, fields[tags_at:]) if e), None)
    return (error, None) if error else (None, fields)


# --- bulk parsing with bisection --------------------------------------------------------------------------------

_intervals = re.compile(INTERVALS)


def _in_order(block: str) -> bool:
    return all(_at_most(a, b) and _at_most(c, d) for a, b, c, d in _intervals.findall(block))


#: By kind: the pattern of one record, what else holds for a block that matches, and the strict check of one record.
_KINDS: dict[str, tuple[str, Callable[[str], bool], Callable[[str | None], str | None]]] = {
    "cigar": (CIGAR, lambda block: True, cigar_error),
    "tags": (TAGS, lambda block: True, tags_error),
    "line": (LINE, _in_order, line_error),
}
#: Records in a block. The size follows how often blocks fail; it decides only the speed.
LEAST_BLOCK, MOST_BLOCK = 8, 4096


def reasons(values: list[str | None], kind: str) -> list[str | None]:
    """For each value the reason why it fails, or None."""
    pattern, also, strict = _KINDS[kind]
    bulk = re.compile(rf"(?:{pattern}\n)++").fullmatch
    out: list[str | None] = [None] * len(values)
    present = [i for i, v in enumerate(values) if v is not None]

    def parses(block: list[int]) -> bool:
        text = "\n".join([values[i] for i in block]) + "\n"
        # a value with a line feed of its own would be read as two records
        return text.count("\n") == len(block) and bulk(text) is not None and also(text)

    at, size = 0, 256
    while at < len(present):
        block, at = present[at : at + size], at + size
        if parses(block):
            size = min(2 * size, MOST_BLOCK)
            continue
        size = max(size // 2, LEAST_BLOCK)
        failed = [block]
        while failed:
            block = failed.pop()
            if len(block) == 1:
                out[block[0]] = strict(values[block[0]])
                continue
            half = len(block) // 2
            failed += [part for part in (block[:half], block[half:]) if len(part) == 1 or not parses(part)]
    return out


def with_reasons(df: DataFrame, column: str, kind: str) -> DataFrame:
    """`df` with a last column `reason`: why `column` breaks the format (`kind`: cigar, tags or line), null where it is valid.

    All other columns pass through unread; a null value is valid; an empty table gives an empty one. If `df` has a column of
    that name, the new one is called `_reason`, and so on.
    """
    schema = StructType([*df.schema.fields, StructField(unused("reason", df.columns), StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = reasons(batch.column(column).to_pylist(), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], schema.names)

    return df.mapInArrow(run, schema)


def load_checked(df: DataFrame, column: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows as they are, failing rows with their reason in the last column; see with_reasons)."""
    checked = with_reasons(df, column, kind)
    reason = F.col(checked.columns[-1])
    return checked.where(reason.isNull()).drop(checked.columns[-1]), checked.where(reason.isNotNull())


def load_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, failing lines with `reason`) of lines (value, ord, ...).

    Valid lines come as typed records, positions with `$` and quoted fields read as the format means them. Lines of kinds that
    are not checked, and null lines, are in neither result; containments among them are read by parse_lines.
    """
    kept = lines.where(F.left("value", F.lit(1)).isin(*_RECORDS))
    reason, split = unused("reason", lines.columns), unused("fields", lines.columns)
    schema = StructType([*kept.schema.fields, StructField(reason, StringType()), StructField(split, ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("value").to_pylist()
            found = reasons(values, "line")
            # Only lines that need more than splitting at TABs carry their fields.
            fields = [None if why or not ('"' in v or v.endswith(("\t", "\r"))) else read_line(v)[1] for v, why in zip(values, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(fields, pa.list_(pa.string()))], schema.names)

    checked = kept.mapInArrow(run, schema)
    valid = checked.where(F.col(reason).isNull()).select("ord", F.coalesce(split, F.split("value", "\t", -1)).alias("f"))
    return parse_fields(valid, F.get("f", F.lit(0)), F.size("f"), True), checked.where(F.col(reason).isNotNull()).drop(split)


def failing(df: DataFrame, table: str, column: str, kind: str) -> DataFrame:
    """(table_name, rec_id, reason) of the failing records, once per record however often it was delivered.

    Only the checked column travels to Python. Rows that share a rec_id share the value, so they share the reason.
    """
    checked = with_reasons(df.select("rec_id", F.col(column).alias("checked")).where(F.col(column).isNotNull()), "checked", kind)
    bad = checked.where("reason is not null").groupBy("rec_id").agg(F.min("reason").alias("reason"))
    return bad.select(F.lit(table).alias("table_name"), "rec_id", "reason")
