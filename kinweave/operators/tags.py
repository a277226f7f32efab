"""Semantic tags: planning, storing, applying, and reporting on them.

The tag table has ``database_name, schema_name, table_name, column_name, semantic_type, updated_at``; the first four
are its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.skew import join_by_key

TABLE_KEYS = ["database_name", "schema_name", "table_name"]
TAG_KEYS = [*TABLE_KEYS, "column_name"]
TAG_SCHEMA = (
    "database_name string, schema_name string, table_name string, column_name string, semantic_type string, "
    "updated_at timestamp"
)


def _given(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def _complete() -> Column:
    return reduce(lambda a, b: a & b, [_given(c) for c in [*TAG_KEYS, "semantic_type"]])


def retagged_tables(batch: DataFrame) -> DataFrame:
    """The tables a batch names in full."""
    return batch.filter(reduce(lambda a, b: a & b, [_given(c) for c in TABLE_KEYS])).select(*TABLE_KEYS).distinct()


def tag_plan(scan: DataFrame) -> DataFrame:
    """Tags to store for a scan: ``database_name, schema_name, table_name, column_name, semantic_type`` of every
    column with a semantic, in tables without error, where no name is blank."""
    clean = scan.filter(F.col("error").isNull()) if "error" in scan.columns else scan
    return clean.select(
        F.col("catalog_name").alias("database_name"),
        "schema_name",
        "table_name",
        "column_name",
        F.col("semantic").alias("semantic_type"),
    ).filter(_given("table_name") & _given("column_name") & _given("semantic_type"))


def tag_errors(batch: DataFrame) -> DataFrame:
    """Tags of a batch that cannot be stored, with ``error``: a field is missing, or the column appears with another
    semantic too (the first in sort order is stored)."""
    missing = ~_complete()
    inner = _given("table_name") & _given("column_name") & _given("semantic_type")
    reason = F.when(inner, F.lit("Missing database or schema")).otherwise(F.lit("Missing table, column, or semantic_type"))
    lacking = batch.filter(missing).select(*TAG_KEYS, "semantic_type", reason.alias("error"))
    stored = storable_tags(batch).select(*TAG_KEYS, F.col("semantic_type").alias("stored_type"))
    clashes = (
        batch.filter(~missing)
        .join(stored, TAG_KEYS)
        .filter("semantic_type <> stored_type")
        .select(*TAG_KEYS, "semantic_type", F.lit("Column tagged twice in one batch").alias("error"))
    )
    return lacking.unionByName(clashes)


def storable_tags(batch: DataFrame) -> DataFrame:
    """The tags of a batch that can be stored, one per column: those that lack no field, the first semantic in sort order."""
    return (
        batch.filter(_complete())
        .groupBy(*TAG_KEYS)
        .agg(F.min("semantic_type").alias("semantic_type"))
    )


def upsert_tags(existing: DataFrame, batch: DataFrame, at: Column) -> DataFrame:
    """The tag table after storing ``batch``: tables named in the batch lose their old tags and get the new ones,
    stamped ``at``; all other tags stay. An empty batch changes nothing. See ``tag_errors`` for what is left out."""
    retagged = retagged_tables(batch)
    kept = join_by_key(existing, retagged, TABLE_KEYS, "left_anti")
    fresh = storable_tags(batch).withColumn("updated_at", at)
    return kept.unionByName(fresh.select(*existing.columns))


def verify_upsert(tags: DataFrame, batch: DataFrame) -> DataFrame:
    """``expected, actual, success``: tags to be stored against tags found for the tables of the batch."""
    retagged = retagged_tables(batch)
    expected = storable_tags(batch).agg(F.count("*").alias("n")).select(F.lit("expected").alias("side"), "n")
    actual = (
        join_by_key(tags, retagged, TABLE_KEYS, "left_semi")
        .agg(F.count("*").alias("n"))
        .select(F.lit("actual").alias("side"), "n")
    )
    both = expected.unionByName(actual).agg(
        F.max(F.when(F.col("side") == "expected", F.col("n"))).alias("expected"),
        F.max(F.when(F.col("side") == "actual", F.col("n"))).alias("actual"),
    )
    return both.withColumn("success", F.col("expected") == F.col("actual"))


def with_semantics(df: DataFrame, tags: DataFrame) -> DataFrame:
    """``df`` with each tagged column's semantic in its field metadata (key ``semantic``), kept by parquet and tables.

    ``tags`` are those of this one table, as ``read_tags`` gives them; there cannot be more than it has columns.
    """
    wanted = tags.filter(F.col("column").isin(df.columns)).select("column", "semantic")
    for row in wanted.collect():
        df = df.withMetadata(row["column"], {**df.schema[row["column"]].metadata, "semantic": row["semantic"]})
    return df


def resolve_table_ref(df: DataFrame, column: str, default_database: str, default_schema: str) -> DataFrame:
    """``df`` with ``database_name, schema_name, table_name`` of a reference of one to three parts. A reference of
    more parts is taken as a bare name."""
    parts = F.split(F.col(column), r"\.")
    n = F.size(parts)
    return df.withColumns(
        {
            "database_name": F.when(n == 3, F.get(parts, F.lit(0))).otherwise(F.lit(default_database)),
            "schema_name": F.when(n == 3, F.get(parts, F.lit(1)))
            .when(n == 2, F.get(parts, F.lit(0)))
            .otherwise(F.lit(default_schema)),
            "table_name": F.when(n == 3, F.get(parts, F.lit(2)))
            .when(n == 2, F.get(parts, F.lit(1)))
            .otherwise(F.col(column)),
        }
    )


def tag_outcomes(results: DataFrame) -> DataFrame:
    """``table_name, tagged, failed`` from one line per attempted tag (``table_name, column_name, success, error``)."""
    return (
        results.groupBy("table_name")
        .agg(F.count_if("success").alias("tagged"), F.count_if(~F.col("success")).alias("failed"))
        .orderBy("table_name")
    )


def failure_summary(results: DataFrame) -> DataFrame:
    """``error, columns`` and a readable ``message`` for each reason tags failed, most frequent first."""
    return (
        results.filter(~F.coalesce("success", F.lit(False)))
        .groupBy(F.coalesce("error", F.lit("Unknown error")).alias("error"))
        .agg(F.count("*").alias("columns"))
        .withColumn("message", F.format_string("%d column(s) failed due to: %s", F.col("columns"), F.col("error")))
        .orderBy(F.desc("columns"), "error")
    )
