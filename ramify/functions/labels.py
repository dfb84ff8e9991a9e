"""Labels of problems, and the string forms of messages and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST = r"\[(\d+),(\d+)\]$"
LAST_TWO = r"^(.*)\[(\d+),(\d+)\]\[(\d+),(\d+)\]$"


def fanout(parent: Column, index: Column, n: Column) -> Column:
    """The label of a child: parent[index,n]."""
    return F.concat(parent, F.lit("["), index.cast("string"), F.lit(","), n.cast("string"), F.lit("]"))


def fanin(label: Column) -> Column:
    """Where a child's siblings meet: L[x,y][u,v] to L[x+y,y]; the root's [x,y] to [x+y,y]."""
    two = label.rlike(LAST_TWO)
    x = F.when(two, F.regexp_extract(label, LAST_TWO, 2)).otherwise(F.regexp_extract(label, LAST, 1)).cast("long")
    y = F.when(two, F.regexp_extract(label, LAST_TWO, 3)).otherwise(F.regexp_extract(label, LAST, 2)).cast("long")
    return F.concat(F.when(two, F.regexp_extract(label, LAST_TWO, 1)).otherwise(F.lit("")), F.lit("["), (x + y).cast("string"), F.lit(","), y.cast("string"), F.lit("]"))


def parent(label: Column) -> Column:
    """Without its last pair of brackets."""
    return F.regexp_replace(label, r"\[[^\[]*$", "")


def memo_label(label: Column) -> Column:
    """The text after the last hyphen."""
    return F.substring_index(label, "-", -1)


def is_try(method: Column) -> Column:
    return F.startswith(method, F.lit("try_"))


def without_try(method: Column) -> Column:
    return F.when(is_try(method), F.substring(method, 5, 1 << 30)).otherwise(method)


def list_literal(text: Column) -> Column:
    """A one-line list like [1, 2] as an array of longs."""
    return F.from_json(text, "array<bigint>")


def threshold_in(path: Column) -> Column:
    """The number after seq= in a file's name."""
    return F.nullif(F.regexp_extract(path, r"seq=(\d+)", 1), F.lit("")).cast("long")


def message_field(text: Column, name: str) -> Column:
    """A field of a JSON message as text."""
    return F.get_json_object(text, f"$.{name}")


def envelope(*fields: Column) -> Column:
    """A JSON message of these fields in base64."""
    return F.base64(F.to_json(F.struct(*fields)).cast("binary"))


def opened(text: Column) -> Column:
    """The message in an envelope, padded or not."""
    pad = F.concat(text, F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    return F.unbase64(pad).cast("string")


#: What a result's type is.
NULL, STOP, NORMAL = -1, 0, 1


def result(kind: Column, problem_id: Column, value: Column) -> Column:
    """A result as a struct; a null result and one that stops have no value."""
    return F.struct(kind.cast("tinyint").alias("type"), problem_id.alias("problem_id"), F.when(kind == NORMAL, value).alias("value"))


def same_result(a: Column, b: Column) -> Column:
    """Results are the same by type and id, whatever their values; a null is the same as a null."""
    return a["type"].eqNullSafe(b["type"]) & a["problem_id"].eqNullSafe(b["problem_id"])
