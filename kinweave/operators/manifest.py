"""Manifests: which tables and fields go into a resolution run.

Manifests are built as one line per field (``path, position, field_name, type, semantics``). ``nest_fields`` turns
them into one line per table for the JSON sink.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.binding import bind
from kinweave.functions.skew import join_by_key
from kinweave.functions.types import is_numeric, is_unsupported, normalise_type
from kinweave.sources.catalog import COLUMN_KEYS


# Endings of setting names that would hold a secret.
SECRET_WORDS = ("password", "private_key", "token", "secret")


def _has(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def _full_name() -> Column:
    return F.concat_ws(".", *COLUMN_KEYS)


def _semantics(semantic: Column, marker: bool = False) -> Column:
    """The semantic as a list, empty if there is none; ``marker`` adds the general "pii" entry."""
    held = F.array_distinct(F.array(semantic, F.lit("pii"))) if marker else F.array(semantic)
    return F.when(semantic.isNotNull() & (semantic != ""), held).otherwise(F.array().cast("array<string>"))


def tables_with_pii(scan: DataFrame) -> DataFrame:
    """Columns of the tables that were scanned without error and have at least one semantic."""
    clean = scan.filter(F.col("error").isNull()) if "error" in scan.columns else scan
    found = clean.filter(_has("semantic")).select(*COLUMN_KEYS).distinct()
    return join_by_key(clean, found, COLUMN_KEYS, "left_semi")


def resolution_config(scan: DataFrame) -> DataFrame:
    """Fields of a resolution run: supported types only, no semantic on numeric types, tables by full name."""
    kept = tables_with_pii(scan).filter(~is_unsupported(F.col("data_type")))
    semantic = F.when(~is_numeric(F.col("data_type")), F.col("semantic"))
    return kept.select(
        _full_name().alias("path"),
        "position",
        F.col("column_name").alias("field_name"),
        F.col("data_type").alias("type"),
        _semantics(semantic).alias("semantics"),
    )


def unsupported_fields(scan: DataFrame) -> DataFrame:
    """The fields ``resolution_config`` leaves out, with the semantic they would have had."""
    return (
        tables_with_pii(scan)
        .filter(is_unsupported(F.col("data_type")))
        .select(_full_name().alias("path"), "column_name", F.col("data_type").alias("type"), "semantic")
    )


def manifest_from_scan(scan: DataFrame, mode: str = "reference") -> DataFrame:
    """Fields of all tables with PII, ``path`` being the bare table name, semantics ``[semantic, "pii"]``. Catalogue
    and schema tell tables of one name apart."""
    return (
        tables_with_pii(scan)
        .filter(_has("table_name") & _has("column_name"))
        .select(
            F.col("table_name").alias("path"),
            "catalog_name",
            "schema_name",
            "position",
            F.col("column_name").alias("field_name"),
            normalise_type(F.col("data_type"), mode).alias("type"),
            _semantics(F.col("semantic"), marker=True).alias("semantics"),
        )
    )


def _tagged(columns: DataFrame, tags: DataFrame) -> DataFrame:
    """Columns of tables that have tags, with the semantic of each. Everything is matched by full name, so tables of
    the same name in two schemas stay apart."""
    named = tags.filter(_has("semantic_type")).select(
        F.col("database_name").alias("catalog_name"), "schema_name", "table_name", "column_name", "semantic_type"
    )
    of_tables = join_by_key(columns, named.select(*COLUMN_KEYS).distinct(), COLUMN_KEYS, "left_semi")
    return of_tables.join(named, [*COLUMN_KEYS, "column_name"], "left")


def manifest_from_tags(columns: DataFrame, tags: DataFrame, database: str, schema: str) -> DataFrame:
    """Fields of the tagged tables of one schema, types in upper case, semantics without the "pii" entry."""
    one = columns.filter((F.col("catalog_name") == database) & (F.col("schema_name") == schema))
    return _tagged(one, tags).select(
        F.col("table_name").alias("path"),
        "position",
        F.col("column_name").alias("field_name"),
        normalise_type(F.col("data_type"), "redshift", upper=True).alias("type"),
        _semantics(F.col("semantic_type")).alias("semantics"),
    )


def manifest_multi_schema(columns: DataFrame, tags: DataFrame, mode: str = "reference") -> DataFrame:
    """Fields of the tagged tables of any number of schemas, ``path`` being ``schema.table``. The catalogue tells those
    of one path apart."""
    return _tagged(columns, tags).select(
        F.concat_ws(".", "schema_name", "table_name").alias("path"),
        "catalog_name",
        "position",
        F.col("column_name").alias("field_name"),
        normalise_type(F.col("data_type"), mode).alias("type"),
        _semantics(F.col("semantic_type"), marker=True).alias("semantics"),
    )


def nest_fields(fields: DataFrame) -> DataFrame:
    """One line per table: ``path, fields`` in column order, named as in the manifest JSON.

    Fields that carry ``catalog_name`` or ``schema_name`` are nested by those too, and keep them, so tables of one path
    do not mix. A line holds one table's columns, which Spark holds as one schema anyway.
    """
    entry = F.struct("position", F.col("field_name").alias("field-name"), "type", "semantics")
    shaped = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda f: F.struct(
            f["field-name"].alias("field-name"), f["type"].alias("type"), f["semantics"].alias("semantics")
        ),
    )
    keys = [c for c in ("catalog_name", "schema_name") if c in fields.columns]
    return fields.groupBy(*keys, "path").agg(shaped.alias("fields"))


def documents(nested: DataFrame, settings: Mapping[str, Any], name: str | None = None) -> DataFrame:
    """``path, body``: a complete manifest in JSON for each table of ``nest_fields``, with the settings of the run.
    Settings that look like secrets are refused.

    One document per table keeps a manifest of any number of tables out of a single row.
    """
    refuse_secrets(settings)
    whole = F.struct(
        *([F.lit(name).alias("name")] if name else []),
        F.array(F.struct("path", "fields")).alias("tables"),
    )
    head = F.regexp_replace(F.to_json(whole), r"\}$", "")
    keys = [c for c in ("catalog_name", "schema_name") if c in nested.columns]
    return nested.select(
        *keys, "path", F.concat(head, F.lit(',"settings":'), F.lit(json.dumps(dict(settings))), F.lit("}")).alias("body")
    )


def refuse_secrets(settings: Mapping[str, Any]) -> None:
    """Fail if the name of a setting, at any depth, looks like that of a secret."""

    def names(value: Any) -> list[str]:
        if isinstance(value, Mapping):
            return [str(k) for k in value] + [n for v in value.values() for n in names(v)]
        if isinstance(value, (list, tuple)):
            return [n for v in value for n in names(v)]
        return []

    secrets = [n for n in names(settings) if n.lower().endswith(SECRET_WORDS)]
    if secrets:
        raise ValueError(f"manifests must not hold secrets: {', '.join(secrets)}")


def _present(**values: Any) -> dict[str, Any]:
    return {k: v for k, v in values.items() if v}


def config_settings(
    output_catalog: str,
    output_schema: str = "resolution_outputs",
    data_provider: str = "databricks",
    compute_provider: str = "databricks",
) -> dict[str, Any]:
    """Settings of a run on catalogue tables."""
    return {
        "output_catalog_name": output_catalog,
        "output_schema_name": output_schema,
        "data_provider": data_provider,
        "compute_provider": compute_provider,
    }


def redshift_settings(
    database: str,
    schema: str,
    temp_dir: str,
    iam_role: str,
    host: str | None = None,
    port: int = 5439,
    user: str | None = None,
    output_schema: str = "resolution_outputs",
    data_provider: str = "redshift",
    compute_provider: str = "databricks",
    **connection: str,
) -> dict[str, Any]:
    """Settings of a run on Redshift tables. ``connection`` holds what else names the cluster (identifier, workgroup,
    region). Host, port and user are left out for serverless access by role."""
    server = _present(host=host, port=port, user=user) if host else {}
    return {
        "redshift_config": {"database": database, "schema": schema, **server, **connection},
        "s3_temp_dir": temp_dir,
        "redshift_iam_role": iam_role,
        "output_database_name": database,
        "output_schema_name": output_schema,
        "data_provider": data_provider,
        "compute_provider": compute_provider,
    }


def snowflake_settings(
    account: str,
    user: str,
    database: str,
    schema: str,
    warehouse: str,
    role: str | None = None,
    output_database: str | None = None,
    output_schema: str = "resolution_outputs",
    compute_provider: str = "databricks",
) -> dict[str, Any]:
    """Settings of a run on Snowflake tables; results go to the same database unless another is named."""
    return {
        "data_provider": "snowflake",
        "compute_provider": compute_provider,
        "snowflake_config": {
            "account": account,
            "user": user,
            "database": database,
            "schema": schema,
            "warehouse": warehouse,
            **_present(role=role),
        },
        "output_database_name": output_database or database,
        "output_schema_name": output_schema,
    }


@dataclass(frozen=True)
class ManifestRules:
    """What a manifest must have: keys of the document, keys of its settings (dotted for inner ones, the parent
    first), whether settings and table entries must not be empty, and whether each field is looked at."""

    top: Sequence[str] = ("tables", "settings")
    settings: Sequence[str] = ()
    filled: bool = False
    fields: bool = True


# The three rule sets. None asks for credentials, as manifests here never hold secrets.
CONFIG_RULES = ManifestRules(("name", "tables", "settings"), ("output_catalog_name", "output_schema_name"))
REDSHIFT_RULES = ManifestRules(
    settings=(
        "redshift_config",
        "s3_temp_dir",
        "redshift_iam_role",
        "redshift_config.database",
        "redshift_config.schema",
    )
)
SNOWFLAKE_RULES = ManifestRules(
    settings=(
        "snowflake_config",
        "output_database_name",
        "output_schema_name",
        "snowflake_config.account",
        "snowflake_config.user",
        "snowflake_config.database",
        "snowflake_config.schema",
        "snowflake_config.warehouse",
    ),
    filled=True,
    fields=False,
)


def _kind(document: Column, path: str) -> Column:
    """Type of the value at a JSON path, null where there is none."""
    return F.schema_of_variant(F.try_variant_get(document, path, "variant"))


def _is_list(document: Column, path: str) -> Column:
    return F.coalesce(_kind(document, path).startswith("ARRAY"), F.lit(False))


def _absent(document: Column, path: str, filled: bool) -> Column:
    absent = _kind(document, path).isNull()
    if not filled:
        return absent
    value = F.try_variant_get(document, path, "string")
    return absent | F.coalesce(value == "", _kind(document, path) == "VOID")


def _items(document: Column, path: str) -> Column:
    found = F.try_variant_get(document, path, "array<variant>")
    return F.when(_is_list(document, path), found).otherwise(F.array().cast("array<variant>"))


def _error(condition: Column, *text: Column | str) -> Column:
    parts = [F.lit(t) if isinstance(t, str) else t for t in text]
    return F.when(condition, F.concat(*parts))


def validate_manifest(df: DataFrame, rules: ManifestRules = CONFIG_RULES, body: str = "body") -> DataFrame:
    """``df`` with ``valid, first_error, error_count, errors`` for a manifest in JSON text.

    All errors are listed, in the order keys, tables, fields, settings. Each document is checked where it lies,
    without a shuffle.
    """

    def field_errors(field: Column, i: Column, j: Column) -> Column:
        where = F.concat(F.lit("Table "), i.cast("string"), F.lit(" field "), j.cast("string"))
        checks = [
            _error(_kind(field, f"$['{key}']").isNull(), where, f" missing '{key}'")
            for key in ("field-name", "type", "semantics")
        ]
        wrong = _kind(field, "$.semantics").isNotNull() & ~_is_list(field, "$.semantics")
        return F.array(*checks, _error(wrong, where, " 'semantics' must be a list"))

    def table_errors(table: Column, i: Column) -> Column:
        where = F.concat(F.lit("Table "), i.cast("string"))
        here = [
            _error(_absent(table, "$.path", rules.filled), where, " missing 'path'"),
            _error(_absent(table, "$.fields", rules.filled), where, " missing 'fields'"),
            _error(
                _kind(table, "$.fields").isNotNull() & ~_is_list(table, "$.fields"), where, " 'fields' must be a list"
            ),
        ]
        if rules.filled:
            empty = _is_list(table, "$.fields") & (F.size(_items(table, "$.fields")) == 0)
            here.append(_error(empty, where, " has no fields"))
        if not rules.fields:
            return F.array(*here)
        inner = F.transform(_items(table, "$.fields"), lambda field, j: field_errors(field, i, j))
        return F.concat(F.array(*here), F.flatten(inner))

    def document_errors(doc: Column) -> Column:
        top = [_error(_kind(doc, f"$.{key}").isNull(), f"Missing '{key}'") for key in rules.top]
        has_tables = _kind(doc, "$.tables").isNotNull()
        listed = [_error(has_tables & ~_is_list(doc, "$.tables"), "'tables' must be a list")]
        if rules.filled:
            empty = _is_list(doc, "$.tables") & (F.size(_items(doc, "$.tables")) == 0)
            listed.append(_error(empty, "No tables in manifest"))
        tables = F.flatten(F.transform(_items(doc, "$.tables"), table_errors))
        has_settings = _kind(doc, "$.settings").isNotNull()
        settings = [
            _error(has_settings & _absent(doc, f"$.settings.{key}", rules.filled), f"Missing '{key}' in settings")
            for key in rules.settings
        ]
        unreadable = _error(doc.isNull(), "Not a JSON document")
        readable = F.concat(F.array(*top, *listed), tables, F.array(*settings).cast("array<string>"))
        return F.when(doc.isNull(), F.array(unreadable)).otherwise(readable)

    errors = F.array_compact(bind(F.try_parse_json(F.col(body)), document_errors))
    return df.withColumn("errors", errors).select(
        *df.columns,
        (F.size("errors") == 0).alias("valid"),
        F.get("errors", F.lit(0)).alias("first_error"),
        F.size("errors").cast("bigint").alias("error_count"),
        "errors",
    )
