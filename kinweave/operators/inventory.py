"""What tables there are, how large they are, and finding them by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from kinweave.functions.names import likeness
from kinweave.functions.skew import join_by_key
from kinweave.functions.unions import union_all
from kinweave.sources.catalog import COLUMN_KEYS
from kinweave.sources.shared import materialise


def table_column_counts(columns: DataFrame, keys: Sequence[str] = COLUMN_KEYS) -> DataFrame:
    """Distinct column names of each table."""
    return (
        columns.select(*keys, "column_name")
        .distinct()
        .groupBy(*keys)
        .agg(F.count("column_name").alias("column_count"))
    )


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, row_count`` of many tables in one job (parquet counts come from file footers)."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return union_all(counts)


def table_inventory(
    listing: DataFrame, column_counts: DataFrame, row_counts: DataFrame, keys: Sequence[str] = ("table_name",)
) -> DataFrame:
    """The listing with ``column_count`` (0 if unknown), ``row_count`` and its text ("-" if unknown)."""
    keys = list(keys)
    return (
        listing.join(column_counts, keys, "left")
        .join(row_counts, keys, "left")
        .withColumn("column_count", F.coalesce("column_count", F.lit(0)).cast("bigint"))
        .withColumn("row_count_text", F.coalesce(F.col("row_count").cast("string"), F.lit("-")))
    )


def sample_rows(df: DataFrame, key: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows by ``key``. Spark keeps n rows per task, so nothing else is moved."""
    return df.orderBy(*key).limit(n)


def result_page(df: DataFrame, key: Sequence[str], start: int, n: int = 50) -> DataFrame:
    """Rows ``start`` to ``start + n`` in the order of ``key``, which must be unique for pages to fit together.

    For pages near the front: ``start + n`` rows meet in one task. ``paging.store_pages`` serves any page.
    """
    return df.orderBy(*key).offset(start).limit(n)


def page_after(df: DataFrame, key: str, last: object = None, n: int = 50) -> DataFrame:
    """The next ``n`` rows after the key value ``last``: a filter that reaches the scan, so deep pages cost no more
    than the first."""
    rest = df if last is None else df.filter(F.col(key) > F.lit(last))
    return rest.orderBy(key).limit(n)


def fuzzy_name_match(
    names: DataFrame, targets: Sequence[str], min_score: float | None = 0.4, column: str = "name"
) -> DataFrame:
    """``target, name, match, score``: the best name for each wanted name.

    An equal name (ignoring case and outer blanks) beats a name containing the target, which beats the most
    similar name of at least ``min_score`` (none if that is None); ties go to the first in sort order. (A first-come
    search over a list lets an earlier substring hit beat a later equal name; here the order of the names has no
    influence.)
    ``targets`` are typed by a person, ``names`` may be large: only one candidate per target and task is shuffled. The
    sure hits are looked for first; names are scored only for targets without one, and only where the lengths and the
    letters two names share leave the score within reach (both are upper bounds of it, worked out without Python).
    """

    def crossed(wanted: Sequence[str]) -> DataFrame:
        target = F.explode(F.array(*[F.lit(t) for t in wanted]).cast("array<string>")).alias("target")
        rows = names.select(F.col(column).alias("name")).filter("name <> ''").select("name", target)
        return rows.withColumns({"t": F.lower(F.trim("target")), "c": F.lower(F.trim("name"))})

    def best_of(rows: DataFrame) -> DataFrame:
        order = F.struct((-F.col("rank")).alias("rank"), (-F.col("score")).alias("score"), "name")
        return rows.groupBy("target").agg(F.min(order).alias("best"))

    rank = F.when(F.col("t") == F.col("c"), F.lit(2)).when(F.col("c").contains(F.col("t")), F.lit(1))
    sure = crossed(list(targets)).withColumn("rank", rank).filter("rank IS NOT NULL").withColumn("score", F.lit(1.0))
    best = materialise(best_of(sure), "sure_names").df
    if min_score is not None:
        # No more lines than targets.
        settled = {r["target"] for r in best.select("target").collect()}
        a, b = F.char_length("t"), F.char_length("c")
        bound = F.try_divide(2 * F.least(a, b), a + b)
        near = crossed([t for t in targets if t not in settled]).filter(bound >= F.lit(float(min_score)))
        letters = F.array_intersect(F.split("t", ""), F.split("c", ""))
        shared = F.aggregate(
            letters, F.lit(0), lambda n, x: n + F.least(a - F.char_length(F.replace(F.col("t"), x)), b - F.char_length(F.replace(F.col("c"), x)))
        )
        near = near.filter(F.try_divide(2 * shared, a + b) >= F.lit(float(min_score)))
        guessed = near.withColumn("rank", F.lit(0)).withColumn("score", likeness("t", "c"))
        best = best.unionByName(best_of(guessed.filter(F.col("score") >= F.lit(float(min_score)))))
    labels = F.element_at(F.array(F.lit("similar"), F.lit("contains"), F.lit("equal")), (1 - F.col("best.rank")))
    score = (-F.col("best.score")).alias("score")
    return best.select("target", F.col("best.name").alias("name"), labels.alias("match"), score)


def parse_targets(df: DataFrame, column: str = "target") -> DataFrame:
    """``target`` split into ``catalog`` and ``schema``, with ``error`` where it is not ``catalog.schema``."""
    parts = F.split(F.col(column), r"\.")
    good = (F.size(parts) == 2) & (parts[0] != "") & F.coalesce(F.get(parts, F.lit(1)) != "", F.lit(False))
    good = F.coalesce(good, F.lit(False))
    given = F.coalesce(F.col(column), F.lit(""))
    problem = F.concat(F.lit("Invalid target format: '"), given, F.lit("'. Expected 'catalog.schema'"))
    return df.select(
        "*",
        F.when(good, parts[0]).alias("catalog"),
        F.when(good, F.get(parts, F.lit(1))).alias("schema"),
        F.when(~good, problem).alias("error"),
    )


def check_locations(spark: SparkSession, locations: Sequence[tuple[str, str]]) -> DataFrame:
    """``catalog, schema, accessible, error`` for locations a person wrote down."""
    rows = []
    for catalog, schema in locations:
        if not catalog or not schema:
            rows.append((catalog, schema, False, "Missing catalog or schema"))
            continue
        try:
            found = spark.catalog.databaseExists(f"{catalog}.{schema}")
            rows.append((catalog, schema, found, None if found else f"Schema {catalog}.{schema} not found"))
        except AnalysisException as problem:
            rows.append((catalog, schema, False, str(problem)))
    return spark.createDataFrame(rows, "catalog string, schema string, accessible boolean, error string")


def location_report(locations: DataFrame, schemas: DataFrame) -> DataFrame:
    """``catalog, schema, accessible, error`` of any number of locations (columns ``catalog, schema``), against a listing of
    schemas (``catalog_name, schema_name``, as ``catalog.list_schemas`` gives it) that is asked for once.

    Names are compared without case, as Spark does. A missing part is an error; repeated lines are each reported.
    """
    folded = {"_catalog": F.lower("catalog"), "_schema": F.lower("schema")}
    known = schemas.select(F.lower("catalog_name").alias("_catalog"), F.lower("schema_name").alias("_schema")).distinct()
    asked = locations.select("catalog", "schema").withColumns(folded)
    found = join_by_key(asked, known.withColumn("_found", F.lit(True)), ["_catalog", "_schema"], "left")
    complete = F.coalesce((F.col("catalog") != "") & (F.col("schema") != ""), F.lit(False))
    accessible = complete & F.coalesce("_found", F.lit(False))
    missing = F.concat(F.lit("Schema "), "catalog", F.lit("."), "schema", F.lit(" not found"))
    error = F.when(~complete, F.lit("Missing catalog or schema")).when(~accessible, missing)
    return found.select("catalog", "schema", accessible.alias("accessible"), error.alias("error"))
