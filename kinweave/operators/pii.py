"""Which columns hold personal data.

A *scan* is one line per column: the column catalogue plus ``semantic``, and ``error`` where a table could not be
classified. Tables are told apart by ``catalog_name, schema_name, table_name`` throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.patterns import NAME_RULES, SEMANTICS, UUID_PATTERN, NameRule, name_semantic, snake_case
from kinweave.functions.skew import join_by_key
from kinweave.functions.types import is_numeric
from kinweave.sources.catalog import COLUMN_KEYS
from kinweave.sources.shared import materialise


def skip_tables(df: DataFrame, prefix: str) -> DataFrame:
    """Without tables whose name starts with ``prefix`` (case counts): the outputs of earlier resolution runs."""
    return df.filter(~F.coalesce(F.col("table_name").startswith(prefix), F.lit(False)))


def classify_columns(columns: DataFrame, rules: list[NameRule] = NAME_RULES) -> DataFrame:
    """The catalogue with ``semantic`` by name rules; null where no rule fits or the type is numeric."""
    semantic = F.when(~is_numeric(F.col("data_type")), name_semantic(F.col("column_name"), rules))
    return columns.withColumn("semantic", semantic)


# What a value pattern says about the column that holds it.
EVIDENCE = {"email": "email", "phone": "phone"}


def with_evidence(scan: DataFrame, evidence: DataFrame, least: float = 0.5) -> DataFrame:
    """``scan`` with a semantic also for columns whose names say nothing, if a share of ``least`` of their values looks
    like one kind of personal data (``content.content_evidence``: ``table_name, column_name, pattern, share``). Of two
    kinds the more frequent one is taken. Columns are matched by table and column name."""
    kinds = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])
    told = evidence.withColumn("kind", kinds[F.col("pattern")]).filter(F.col("kind").isNotNull() & (F.col("share") >= least))
    best = told.groupBy("table_name", "column_name").agg(F.max(F.struct("share", "kind")).getField("kind").alias("kind"))
    joined = join_by_key(scan, best, ["table_name", "column_name"], "left")
    return joined.withColumn("semantic", F.coalesce("semantic", "kind")).select(*scan.columns)


def numeric_guard(scan: DataFrame) -> DataFrame:
    """``scan`` with no semantic on numeric types. Goes by the base type, so ``DECIMAL(10,2)`` is caught."""
    return scan.withColumn("semantic", F.when(~is_numeric(F.col("data_type")), F.col("semantic")))


def single_pk(scan: DataFrame) -> DataFrame:
    """``scan`` with at most one ``pk`` per table: a uuid column if there is one, then the first by position.

    Only the columns tagged ``pk`` are grouped, by a minimum that is combined on the map side.
    """
    is_uuid = snake_case(F.col("column_name")).rlike(UUID_PATTERN) | (F.lower("data_type") == "uuid")
    order = F.struct((~F.coalesce(is_uuid, F.lit(False))).alias("plain"), "position", "column_name")
    chosen = (
        scan.filter(F.col("semantic") == "pk")
        .groupBy(*COLUMN_KEYS)
        .agg(F.min(order).alias("first"))
        .select(*COLUMN_KEYS, F.col("first.column_name").alias("column_name"), F.lit(True).alias("is_key"))
    )
    keep = (F.col("semantic") != "pk") | F.col("is_key")
    return (
        scan.join(chosen, [*COLUMN_KEYS, "column_name"], "left")
        .withColumn("semantic", F.when(keep, F.col("semantic")))
        .select(*scan.columns)
    )


def _answer_text(response: Column) -> Column:
    """The answer without surrounding blanks and code fences."""
    blanks = F.lit(" \t\r\n")
    text = F.btrim(response, blanks)
    opening = F.when(text.startswith("```json"), F.lit(7)).when(text.startswith("```"), F.lit(3))
    inside = F.substr(text, opening + 1, F.length(text) - opening - 3)
    return F.btrim(F.coalesce(inside, text), blanks)


def ingest_answers(columns: DataFrame, answers: DataFrame) -> DataFrame:
    """The catalogue with the semantics a model gave, as a scan with ``error``.

    ``answers`` has the three table names and ``response``: a JSON list with one ``{"name", "semantic"}`` for each
    column, perhaps inside a code fence. Names are matched exactly, the last entry of a name counts, an empty
    semantic is none, unknown names are ignored. A response that is no list or has another length makes every
    column of the table an error; so do a missing response, more than one answer for the table, and a semantic that
    is not one of ``SEMANTICS``.
    """
    text = _answer_text(F.col("response"))
    one = answers.groupBy(*COLUMN_KEYS).agg(F.max("response").alias("response"), F.count("*").alias("answers"))
    parsed = one.select(
        *COLUMN_KEYS, "answers", F.when(text.startswith("["), F.from_json(text, "array<string>")).alias("items")
    )
    given = F.transform("items", lambda i: F.get_json_object(i, "$.semantic"))
    unknown = F.get(F.filter(given, lambda s: (s != "") & ~s.isin(*SEMANTICS)), F.lit(0))
    expected = columns.groupBy(*COLUMN_KEYS).agg(F.count("*").alias("n"))
    problem = (
        F.when(F.col("answers") > 1, F.format_string("%d answers for one table", F.col("answers")))
        .when(F.col("items").isNull(), F.lit("Failed to parse the answer"))
        .when(F.size("items") != F.col("n"), F.format_string("Expected %d items, got %d", F.col("n"), F.size("items")))
        .when(unknown.isNotNull(), F.format_string("Unknown semantic '%s'", unknown))
    )
    # Used twice below, and parsing is the costly part.
    checked = materialise(expected.join(parsed, COLUMN_KEYS, "left").withColumn("error", problem), "answers").df
    entries = (
        checked.filter("error IS NULL")
        .select(*COLUMN_KEYS, F.posexplode("items").alias("at", "item"))
        .withColumn("item", F.from_json("item", "name string, semantic string"))
        .select(
            *COLUMN_KEYS,
            F.col("item.name").alias("column_name"),
            F.struct("at", F.nullif("item.semantic", F.lit("")).alias("semantic")).alias("entry"),
        )
        .filter("column_name IS NOT NULL")
        .groupBy(*COLUMN_KEYS, "column_name")
        .agg(F.max("entry").getField("semantic").alias("semantic"))
    )
    with_error = columns.join(checked.select(*COLUMN_KEYS, "error"), COLUMN_KEYS)
    return with_error.join(entries, [*COLUMN_KEYS, "column_name"], "left").select(
        *columns.columns, "semantic", "error"
    )


def table_summary(scan: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """One line per table: ``column_count, pii_column_count, has_pii, error``.

    With ``listing`` tables without columns are there too, with zeros. A table with an error counts no columns.
    """
    error = F.max("error") if "error" in scan.columns else F.lit(None).cast("string")
    found = scan.groupBy(*COLUMN_KEYS).agg(
        F.count("*").alias("n"), F.count("semantic").alias("n_pii"), error.alias("error")
    )
    if listing is not None:
        found = listing.select(*COLUMN_KEYS).join(found, COLUMN_KEYS, "left")
    clean = F.col("error").isNull()
    return found.select(
        *COLUMN_KEYS,
        F.when(clean, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("column_count"),
        F.when(clean, F.coalesce("n_pii", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("pii_column_count"),
        (clean & (F.coalesce("n_pii", F.lit(0)) > 0)).alias("has_pii"),
        "error",
    )


def schema_rollup(summary: DataFrame) -> DataFrame:
    """One line per schema: tables attempted, processed without error, with PII, and PII columns in all."""
    return (
        summary.groupBy("catalog_name", "schema_name")
        .agg(
            F.count("*").alias("tables_scanned_attempted"),
            F.count_if(F.col("error").isNull()).alias("tables_successfully_processed"),
            F.count_if("has_pii").alias("tables_with_pii"),
            F.sum("pii_column_count").alias("total_pii_columns"),
        )
        .orderBy("catalog_name", "schema_name")
    )


def location_rollup(summary: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """One line per location ``catalog.schema``: status, tables with PII, all their columns, their PII columns.

    ``locations`` (``catalog_name, schema_name``) adds those nothing was scanned for, with status ``error``.
    """
    with_pii = F.col("has_pii")
    keys = ["catalog_name", "schema_name"]
    found = summary.groupBy(*keys).agg(
        F.count_if(with_pii).alias("tables"),
        F.sum(F.when(with_pii, F.col("column_count")).otherwise(0)).alias("columns"),
        F.sum(F.when(with_pii, F.col("pii_column_count")).otherwise(0)).alias("pii_columns"),
        F.lit("success").alias("status"),
    )
    if locations is not None:
        found = locations.select(*keys).distinct().join(found, keys, "left")
    return found.select(
        F.concat_ws(".", *keys).alias("location"),
        F.coalesce("status", F.lit("error")).alias("status"),
        "tables",
        "columns",
        "pii_columns",
    ).orderBy("location")


def table_profile(scan: DataFrame, at: str) -> DataFrame:
    """One JSON ``profile`` per table: its names, columns in order, PII tags, and the time ``at`` (ISO text)."""
    column = F.struct("position", F.col("column_name").alias("name"), F.col("data_type").alias("type"), "semantic")
    columns = F.sort_array(F.collect_list(column))
    schema = F.transform("columns", lambda c: F.struct(c["name"].alias("name"), c["type"].alias("type")))
    tagged = F.transform(
        F.filter("columns", lambda c: c["semantic"].isNotNull()),
        lambda c: F.struct(c["name"].alias("name"), c["semantic"].alias("semantic")),
    )
    record = F.struct(
        F.struct(*COLUMN_KEYS).alias("table"),
        schema.alias("schema"),
        tagged.alias("pii_tags"),
        F.lit(at).alias("profiling_timestamp"),
    )
    nested = scan.groupBy(*COLUMN_KEYS).agg(columns.alias("columns"))
    return nested.select(*COLUMN_KEYS, F.to_json(record).alias("profile"))
