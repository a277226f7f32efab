"""Type names: groups that matter for tagging, and the short names used in manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Types a manifest cannot hold.
UNSUPPORTED_TYPES = [
    "INTERVAL",
    "VOID",
    "ARRAY",
    "MAP",
    "STRUCT",
    "VARIANT",
    "OBJECT",
    "GEOGRAPHY",
    "GEOMETRY",
]

# Types that never carry a semantic.
NUMERIC_TYPES = [
    "LONG",
    "BIGINT",
    "INT",
    "INTEGER",
    "SMALLINT",
    "TINYINT",
    "DOUBLE",
    "FLOAT",
    "DECIMAL",
    "NUMERIC",
    "NUMBER",
]

# Texts looked for in a type name, tried in this order, and the short name they give.
TYPE_TEXTS = [
    (["varchar", "char", "text", "string"], "string"),
    (["int", "integer", "smallint", "bigint"], "long"),
    (["decimal", "numeric"], "decimal"),
    (["float", "double", "real"], "double"),
    (["bool"], "boolean"),
    (["date"], "date"),
    (["timestamp"], "timestamp"),
]

# The Redshift list has "character" where the one above has "string".
REDSHIFT_STRING_TEXTS = ["varchar", "char", "text", "character"]

# Base type names and the short name each stands for.
BASE_TYPES = {
    "string": "string varchar char character text bpchar nvarchar nchar uuid",
    "long": "long bigint int integer smallint tinyint byte short int2 int4 int8",
    "decimal": "decimal numeric number",
    "double": "double float real float4 float8",
    "boolean": "boolean bool",
    "date": "date",
    "timestamp": "timestamp timestamptz timestamp_ntz timestamp_ltz timestamp_tz datetime",
}


def base_type(type_name: Column) -> Column:
    """The upper-case type name without precision or element types: ``DECIMAL(10,2)`` is ``DECIMAL``."""
    return F.upper(F.trim(F.regexp_extract(type_name, r"^[^(<]*", 0)))


def is_numeric(type_name: Column) -> Column:
    """True for types that never carry a semantic."""
    return F.coalesce(base_type(type_name).isin(NUMERIC_TYPES), F.lit(False))


def is_unsupported(type_name: Column) -> Column:
    """True for types a manifest cannot hold (``INTERVAL DAY`` counts as ``INTERVAL``)."""
    return F.coalesce(F.split_part(base_type(type_name), F.lit(" "), F.lit(1)).isin(UNSUPPORTED_TYPES), F.lit(False))


def _by_text(lower: Column, texts: list[tuple[list[str], str]]) -> list[Column]:
    return [
        F.when(reduce(lambda a, b: a | b, [lower.contains(t) for t in words]), F.lit(short))
        for words, short in texts
    ]


def normalise_type(type_name: Column, mode: str = "reference", upper: bool = False) -> Column:
    """Short type name of a warehouse type; unknown types are ``string``.

    ``reference`` and ``redshift`` look for texts inside the name, in a fixed order: ``interval`` and ``point``
    become ``long`` because they contain "int", ``datetime`` becomes ``date``, ``NUMBER(38,0)`` becomes ``string``.
    ``strict`` goes by the base type.
    """
    lower = F.lower(type_name)
    if mode == "reference":
        branches = _by_text(lower, TYPE_TEXTS)
    elif mode == "redshift":
        branches = _by_text(lower, [(REDSHIFT_STRING_TEXTS, "string"), *TYPE_TEXTS[1:]])
    elif mode == "strict":
        base = F.lower(base_type(type_name))
        branches = [F.when(base.isin(names.split()), F.lit(short)) for short, names in BASE_TYPES.items()]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    short = F.coalesce(*branches, F.lit("string"))
    return F.upper(short) if upper else short
