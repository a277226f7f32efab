"""Manifests as JSON files on any file system Hadoop can reach."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.manifest import refuse_secrets

TABLES_SCHEMA = "path string, fields array<struct<`field-name`: string, type: string, semantics: array<string>>>"


def write_manifest(tables: DataFrame, settings: Mapping[str, Any], path: str) -> None:
    """Write ``manifest.nest_fields`` output and the settings below ``path``.

    ``path/tables`` has one JSON document per table, so a lake of any size is written by all tasks;
    ``path/settings`` has one line per setting, nested ones as JSON text. Settings that look like secrets are refused.
    """
    refuse_secrets(settings)
    spark = tables.sparkSession
    tables.select("path", "fields").write.mode("overwrite").json(f"{path}/tables")
    rows = [(k, v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in settings.items()]
    spark.createDataFrame(rows, "name string, value string").write.mode("overwrite").json(f"{path}/settings")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One line per table: ``path, fields``."""
    return spark.read.schema(TABLES_SCHEMA).json(f"{path}/tables")


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """``name, value`` of each setting."""
    return spark.read.schema("name string, value string").json(f"{path}/settings")


def manifest_fields(tables: DataFrame) -> DataFrame:
    """A manifest read back, one line per field: ``path, position, field_name, type, semantics``."""
    return tables.select("path", F.posexplode("fields").alias("position", "field")).select(
        "path",
        "position",
        F.col("field.field-name").alias("field_name"),
        F.col("field.type").alias("type"),
        F.col("field.semantics").alias("semantics"),
    )
