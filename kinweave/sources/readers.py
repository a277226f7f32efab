"""Reading tables, files, warehouses and query results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Warehouse connectors by short name: the data source each one's package registers. The packages are not part of
# Spark and must be on the cluster's class path; jdbc needs the driver of the database.
CONNECTORS = {
    "redshift": "io.github.spark_redshift_community.spark.redshift",
    "snowflake": "net.snowflake.spark.snowflake",
    "databricks": "jdbc",
}


def read_source(spark: SparkSession, kind: str, path: str | None = None, **options: Any) -> DataFrame:
    """A table from any source: ``table`` (by name), a file format, ``jdbc``, or a warehouse connector.

    ``jdbc`` kinds need ``partitionColumn, lowerBound, upperBound, numPartitions``, as one task would otherwise read the
    whole table.
    """
    if kind == "table":
        if not path:
            raise ValueError("a table name is needed")
        return spark.table(path)
    name = CONNECTORS.get(kind, kind)
    if name == "jdbc" and not {"partitioncolumn", "lowerbound", "upperbound", "numpartitions"} <= {o.lower() for o in options}:
        raise ValueError("jdbc reads need partitionColumn, lowerBound, upperBound and numPartitions")
    reader = spark.read.format(name).options(**options)
    return reader.load(path) if path else reader.load()


def name_columns(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """``df`` with the given column names, or ``column_1, column_2, ...``."""
    return df.toDF(*(names or [f"column_{i + 1}" for i in range(len(df.columns))]))


def csv_chunks(spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str] | int) -> DataFrame:
    """Result chunks in CSV files without header, every value a string, quotes doubled inside quotes.

    ``columns`` are the names, or how many there are. A missing file fails the job; no chunk is passed over.
    """
    names = [f"column_{i + 1}" for i in range(columns)] if isinstance(columns, int) else list(columns)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("header", False).option("multiLine", True).option("escape", '"')
    return reader.option("mode", "FAILFAST").csv(paths)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``df`` with some columns cast; a value that does not fit becomes null."""
    return df.withColumns({name: df[name].try_cast(kind) for name, kind in types.items()})


def run_sql(
    spark: SparkSession,
    query: str,
    args: Mapping[str, Any] | None = None,
    catalog: str | None = None,
    database: str | None = None,
) -> DataFrame:
    """The result of one SQL query with named parameters, in the given catalogue and database if any. Names are looked
    up at once, and the session is left as it was."""
    before = spark.catalog.currentCatalog(), spark.catalog.currentDatabase()
    try:
        if catalog:
            spark.catalog.setCurrentCatalog(catalog)
        if database:
            spark.catalog.setCurrentDatabase(database)
        return spark.sql(query, args=dict(args)) if args else spark.sql(query)
    finally:
        spark.catalog.setCurrentCatalog(before[0])
        spark.catalog.setCurrentDatabase(before[1])
