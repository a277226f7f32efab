"""What the catalogue holds: tables, columns, tags, sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions.skew import join_by_key

COLUMN_KEYS = ["catalog_name", "schema_name", "table_name"]
COLUMN_SCHEMA = (
    "catalog_name string, schema_name string, table_name string, column_name string, data_type string, "
    "nullable boolean, position bigint"
)
TABLE_SCHEMA = "catalog_name string, schema_name string, table_name string, table_type string, comment string"


def list_tables(spark: SparkSession, database: str | None = None, pattern: str | None = None) -> DataFrame:
    """One line per table or view of a database, optionally those whose name fits ``pattern``."""
    found = spark.catalog.listTables(database, pattern)
    rows = [
        (t.catalog, t.namespace[-1] if t.namespace else None, t.name, t.tableType, t.description) for t in found
    ]
    return spark.createDataFrame(rows, TABLE_SCHEMA)


def table_details(spark: SparkSession, database: str | None = None, pattern: str = "*") -> DataFrame:
    """What the catalogue knows about each table and view of a database whose name fits ``pattern``: ``schema_name,
    table_name, is_temporary, table_type, owner, created, format, location, size_bytes, comment, properties``, null where
    it says nothing. One call of the catalogue, whatever the number of tables."""
    where = f" IN `{database.replace('`', '``')}`" if database else ""
    text = pattern.replace("\\", "\\\\").replace("'", "\\'")
    shown = spark.sql(f"SHOW TABLE EXTENDED{where} LIKE '{text}'")

    def told(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("information", rf"(?m)^{name}:(.*)$", 1)), F.lit(""))

    return shown.select(
        F.nullif("namespace", F.lit("")).alias("schema_name"),
        F.col("tableName").alias("table_name"),
        F.col("isTemporary").alias("is_temporary"),
        told("Type").alias("table_type"),
        told("Owner").alias("owner"),
        told("Created Time").alias("created"),
        told("Provider").alias("format"),
        told("Location").alias("location"),
        F.regexp_extract(F.coalesce(told("Statistics"), F.lit("")), r"^(\d+) bytes", 1).try_cast("bigint").alias("size_bytes"),
        told("Comment").alias("comment"),
        told("Table Properties").alias("properties"),
    )


def list_schemas(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """``catalog_name, schema_name`` of the current catalogue."""
    rows = [(d.catalog, d.name) for d in spark.catalog.listDatabases(pattern)]
    return spark.createDataFrame(rows, "catalog_name string, schema_name string")


def list_catalogs(spark: SparkSession, pattern: str | None = None) -> DataFrame:
    """``catalog_name`` of every catalogue of the session."""
    rows = [(c.name,) for c in spark.catalog.listCatalogs(pattern)]
    return spark.createDataFrame(rows, "catalog_name string")


def column_catalog(spark: SparkSession, tables: Iterable[str]) -> DataFrame:
    """One line per column of the named tables (one to three name parts), in table order.

    Missing parts are the current catalogue and database. Only table metadata is read. The lines come from the driver,
    as table schemas do anywhere in Spark.
    """
    current = [spark.catalog.currentCatalog(), spark.catalog.currentDatabase()]
    rows = []
    for name in tables:
        given = name.split(".")
        parts = [*current[: 3 - len(given)], *given]
        for position, field in enumerate(spark.table(name).schema.fields):
            rows.append((*parts, field.name, field.dataType.simpleString(), field.nullable, position))
    return spark.createDataFrame(rows, COLUMN_SCHEMA)


def read_columns(
    columns: DataFrame, catalog: str, schemas: Iterable[str], tagged: DataFrame | None = None
) -> DataFrame:
    """Columns of the tables of some schemas; with ``tagged`` only those of the tables that appear in it.

    Sorted by schema, table and position. Tables are matched by schema and name.
    """
    found = columns.filter((F.col("catalog_name") == catalog) & F.col("schema_name").isin(list(schemas)))
    if tagged is not None:
        of_tables = tagged.select("schema_name", "table_name").distinct()
        found = join_by_key(found, of_tables, ["schema_name", "table_name"], "left_semi")
    return found.orderBy("schema_name", "table_name", "position")


def read_tags(tags: DataFrame, database: str, schema: str) -> DataFrame:
    """``table, column, semantic`` stored for one schema, sorted by table and column."""
    return (
        tags.filter((F.col("database_name") == database) & (F.col("schema_name") == schema))
        .select(
            F.col("table_name").alias("table"),
            F.col("column_name").alias("column"),
            F.col("semantic_type").alias("semantic"),
        )
        .orderBy("table", "column")
    )


def distinct_sources(df: DataFrame, default: str = "default_source") -> DataFrame:
    """The distinct non-null ``datasource`` names, or ``default`` when there are none."""
    found = df.select("datasource").filter(F.col("datasource").isNotNull()).distinct()
    none_found = found.agg(F.count("*")).scalar() == 0
    fallback = df.sparkSession.range(1).select(F.lit(default).alias("datasource")).filter(none_found)
    return found.unionByName(fallback)
