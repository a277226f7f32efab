"""Changes a person asks for after a scan. Names are compared without regard to case.

``edits`` holds ``table_name`` (null = every table), ``column_name``, and for changes ``new_semantic``. It may also have
``catalog_name`` and ``schema_name``; where they are given, the edit is for that catalogue or schema alone. Edits that
name a table and edits that do not are joined separately, each on its whole key, so that a frequent column name
meets at most one edit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.skew import join_by_key
from kinweave.sources.catalog import COLUMN_KEYS


def _keyed(scan: DataFrame) -> DataFrame:
    return scan.withColumns({"_table": F.lower("table_name"), "_column": F.lower("column_name")})


def _edit_keys(edits: DataFrame) -> DataFrame:
    return edits.withColumns({"_table": F.lower("table_name"), "_column": F.lower("column_name")})


_PLACES = "array<struct<catalog:string,schema:string>>"


def _place(edits: DataFrame) -> Column:
    """Where an edit holds; null parts mean everywhere. A person writes few edits for one name."""
    given = [F.lower(c) if c in edits.columns else F.lit(None).cast("string") for c in ("catalog_name", "schema_name")]
    return F.struct(given[0].alias("catalog"), given[1].alias("schema"))


def _here(place: Column) -> Column:
    """Whether an edit for this place is for the column of the scan."""
    same = [F.coalesce(place[p] == F.lower(F.col(f"{p}_name")), place[p].isNull()) for p in ("catalog", "schema")]
    return same[0] & same[1]


def _mark_columns(scan: DataFrame, edits: DataFrame, value: Column) -> DataFrame:
    """``scan`` with ``_edit``: the value of the edit for this column; one naming the table goes first, and of two
    for the same key the greater value."""
    keyed = _edit_keys(edits).filter("_column IS NOT NULL").withColumn("_value", value)
    entry = F.collect_set(F.struct(F.col("_value").alias("value"), _place(edits).alias("place")))
    exact = keyed.filter("_table IS NOT NULL").groupBy("_table", "_column").agg(entry.alias("_exact"))
    general = keyed.filter("_table IS NULL").groupBy("_column").agg(entry.alias("_general"))
    marked = join_by_key(_keyed(scan), exact, ["_table", "_column"], "left")
    marked = join_by_key(marked, general, ["_column"], "left")

    def best(entries: str) -> Column:
        return F.array_max(F.transform(F.filter(entries, lambda e: _here(e["place"])), lambda e: e["value"]))

    return marked.withColumn("_edit", F.coalesce(best("_exact"), best("_general")))


def exclude_tables(scan: DataFrame, edits: DataFrame) -> DataFrame:
    """``scan`` with ``excluded``; columns of excluded tables lose their semantic, so the table has no PII."""
    named = edits.withColumn("_table", F.lower("table_name")).filter("_table IS NOT NULL")
    places = named.groupBy("_table").agg(F.collect_set(_place(edits)).alias("_places"))
    marked = join_by_key(scan.withColumn("_table", F.lower("table_name")), places, ["_table"], "left")
    hit = F.exists(F.coalesce("_places", F.array().cast(_PLACES)), _here)
    return _apply_exclusion(scan, marked.withColumn("excluded", hit))


def exclude_tables_containing(scan: DataFrame, texts: Sequence[str]) -> DataFrame:
    """``exclude_tables`` for tables whose name contains one of a few texts a person typed."""
    hits = [F.lower("table_name").contains(F.lit(t.lower())) for t in texts]
    excluded = reduce(lambda a, b: a | b, hits, F.lit(False))
    return _apply_exclusion(scan, scan.withColumn("excluded", F.coalesce(excluded, F.lit(False))))


def _apply_exclusion(scan: DataFrame, marked: DataFrame) -> DataFrame:
    kept = F.when(~F.col("excluded"), F.col("semantic"))
    return marked.withColumn("semantic", kept).select(*scan.columns, "excluded")


def exclude_columns(scan: DataFrame, edits: DataFrame) -> DataFrame:
    """``scan`` without the semantic of the named columns; a table with none left has no PII."""
    marked = _mark_columns(scan, edits, F.lit(True))
    return marked.withColumn("semantic", F.when(F.col("_edit").isNull(), F.col("semantic"))).select(*scan.columns)


def change_semantics(scan: DataFrame, edits: DataFrame) -> DataFrame:
    """``scan`` with new semantics for the named columns. Only columns that have a semantic are changed."""
    marked = _mark_columns(scan, edits, F.col("new_semantic"))
    changed = F.when(F.col("semantic").isNotNull(), F.coalesce("_edit", "semantic"))
    return marked.withColumn("semantic", changed).select(*scan.columns)


def editable(scan: DataFrame) -> DataFrame:
    """The PII columns there are: table names, column and semantic."""
    return scan.filter("semantic IS NOT NULL").select(*COLUMN_KEYS, "column_name", "semantic")


def unmatched_edits(scan: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (with ``action``) that change nothing, and ``reason``: table or PII column not found, or not named."""
    asked = _edit_keys(edits)
    tables = scan.select(F.lower("table_name").alias("_table")).distinct().withColumn("_t", F.lit(True))
    found = _keyed(editable(scan)).select("_table", "_column").distinct()
    exact = found.withColumn("_e", F.lit(True))
    general = found.select("_column").distinct().withColumn("_g", F.lit(True))
    for_table = F.col("action") == "exclude_table"
    reason = (
        F.when(for_table & F.col("_table").isNull(), F.lit("No table specified"))
        .when(for_table & F.col("_t").isNull(), F.format_string("Table '%s' not found", F.col("table_name")))
        .when(~for_table & F.col("_column").isNull(), F.lit("No column specified"))
        .when(
            ~for_table & F.when(F.col("_table").isNull(), F.col("_g").isNull()).otherwise(F.col("_e").isNull()),
            F.format_string("Column '%s' not found in PII results", F.col("column_name")),
        )
    )
    checked = join_by_key(asked, tables, ["_table"], "left")
    checked = join_by_key(checked, exact, ["_table", "_column"], "left")
    checked = join_by_key(checked, general, ["_column"], "left")
    return checked.withColumn("reason", reason).filter("reason IS NOT NULL").select(*edits.columns, "reason")
