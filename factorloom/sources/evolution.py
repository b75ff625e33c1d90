"""Typed schemas that change over time: what has changed, and how rows of an older schema are read in a newer one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType, StructField, StructType

#: types that hold all values of the type before the colon
_WIDER = {
    "tinyint": ("smallint", "int", "bigint"),
    "smallint": ("int", "bigint"),
    "int": ("bigint", "double"),
    "float": ("double",),
    "date": ("timestamp_ntz", "timestamp"),
}
ADDED, WIDENED, MISSING, NARROWED, INCOMPATIBLE = "ADDED", "WIDENED", "MISSING", "NARROWED", "INCOMPATIBLE"


def widens(old: DataType, new: DataType) -> bool:
    if isinstance(old, DecimalType) and isinstance(new, DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return new.simpleString() in _WIDER.get(old.simpleString(), ())


def changes(old: StructType, new: StructType) -> list[tuple[str, str, str]]:
    """(column, kind, what) for each column that is not the same in both.

    ADDED: in the new schema alone. MISSING: in the old one alone. WIDENED: the new type
    holds all old values. NARROWED: the old type holds all new values. INCOMPATIBLE: neither.
    """
    out = []
    was, now = {f.name: f.dataType for f in old}, {f.name: f.dataType for f in new}
    for name in sorted(was.keys() | now.keys()):
        a, b = was.get(name), now.get(name)
        if a is None:
            out.append((name, ADDED, b.simpleString()))
        elif b is None:
            out.append((name, MISSING, a.simpleString()))
        elif a != b:
            kind = WIDENED if widens(a, b) else NARROWED if widens(b, a) else INCOMPATIBLE
            out.append((name, kind, f"{a.simpleString()} -> {b.simpleString()}"))
    return out


def evolved(old: StructType, new: StructType) -> StructType:
    """A schema for rows of both: the old columns with the wider type of each, then the new ones. Columns that a schema lacks may be NULL; types that do not go together fail."""
    wrong = [f"{c} ({what})" for c, kind, what in changes(old, new) if kind == INCOMPATIBLE]
    if wrong:
        raise ValueError(f"these columns change their type: {', '.join(wrong)}")
    later = {f.name: f.dataType for f in new}
    kept = [StructField(f.name, later[f.name] if f.name in later and widens(f.dataType, later[f.name]) else f.dataType, True) for f in old]
    return StructType(kept + [StructField(f.name, f.dataType, True) for f in new if f.name not in old.fieldNames()])


def read_as(rows: DataFrame, schema: StructType) -> DataFrame:
    """Rows in the columns of ``schema``: wider types by a cast, absent columns as NULL."""
    have = {f.name: f.dataType for f in rows.schema}
    return rows.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
