"""From resolved records to scores and levels (report input).

Input records have ``entity_id, datasource`` and the identity columns named by the weights. The report counts
records, so everything but the row-level outputs works on ``profile``: one line per entity, source and set of
present columns. It is small per entity (sources x column sets) however many records an entity has, which keeps
a huge entity, or the null entity, from landing in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.scoring import LEVELS, WEIGHTS, bit_names, bits_score, classify, completeness, presence_bits
from kinweave.functions.skew import join_by_key

SCORES = ["record_pii_score", "source_pii_score", "entity_pii_score", "max_record_pii_score"]


def _mapping_table(spark: SparkSession, mapping: Mapping[str, str]) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return spark.range(1).select(F.explode(pairs).alias("datasource", "friendly"))


def unified_view(df: DataFrame, mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Records with ``source``: the friendly name of ``datasource`` if one is given, else itself.

    Two sources mapped to one name merge. Columns: those of ``df`` without ``datasource``, plus ``source``. The
    mapping was written by a person and is held by the driver, so it may be broadcast.
    """
    if not mapping:
        return df.withColumn("source", F.col("datasource")).drop("datasource")
    names = _mapping_table(df.sparkSession, mapping)
    return (
        df.join(F.broadcast(names), "datasource", "left")
        .withColumn("source", F.coalesce("friendly", "datasource"))
        .drop("friendly", "datasource")
    )


def record_scores(view: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``view`` with ``record_pii_score``."""
    return view.withColumn("record_pii_score", completeness(weights))


def record_levels(
    view: DataFrame, weights: Mapping[str, float] = WEIGHTS, levels: Mapping[str, float] = LEVELS
) -> DataFrame:
    """``view`` with ``record_pii_score`` and ``row_known_unknown``."""
    return record_scores(view, weights).withColumn(
        "row_known_unknown", classify(F.col("record_pii_score"), levels)
    )


def profile(view: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``entity_id, source, bits, records``: how many records show which columns (null keys kept)."""
    return (
        view.select("entity_id", "source", *presence_bits(weights))
        .groupBy("entity_id", "source", *bit_names(weights))
        .agg(F.count("*").alias("records"))
    )


def sizes(view: DataFrame) -> DataFrame:
    """``entity_id, source, records``: the profile without the columns. Enough for reports that only count."""
    return view.groupBy("entity_id", "source").agg(F.count("*").alias("records"))


def _merged(weights: Mapping[str, float]) -> list[Column]:
    return [F.bit_or(n).alias(n) for n in bit_names(weights)]


def source_scores(prof: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``entity_id, source, source_pii_score``: score of all records of an entity in a source taken together."""
    return (
        prof.groupBy("entity_id", "source")
        .agg(*_merged(weights))
        .select("entity_id", "source", bits_score(weights).alias("source_pii_score"))
    )


def entity_scores(prof: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``entity_id, max_record_pii_score, entity_pii_score`` over all records of an entity."""
    return (
        prof.groupBy("entity_id")
        .agg(F.max(bits_score(weights)).alias("max_record_pii_score"), *_merged(weights))
        .select("entity_id", "max_record_pii_score", bits_score(weights).alias("entity_pii_score"))
    )


def profile_scores(prof: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """``prof`` with the four scores. Lines without entity or source are left out, but a line without source
    still counts for its entity. The window holds at most sources x column sets lines of one entity."""
    score, names = bits_score(weights), bit_names(weights)
    entity = Window.partitionBy("entity_id")
    source = Window.partitionBy("entity_id", "source")
    return (
        prof.filter(F.col("entity_id").isNotNull())
        .withColumns({f"entity_{n}": F.bit_or(n).over(entity) for n in names})
        .withColumn("max_record_pii_score", F.max(score).over(entity))
        .withColumns({f"source_{n}": F.bit_or(n).over(source) for n in names})
        .filter(F.col("source").isNotNull())
        .select(
            "entity_id",
            "source",
            *names,
            "records",
            score.alias("record_pii_score"),
            bits_score(weights, "source_bits").alias("source_pii_score"),
            bits_score(weights, "entity_bits").alias("entity_pii_score"),
            "max_record_pii_score",
        )
    )


def scored(view: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Every record with its own score and those of its source group and entity.

    Records without entity or source drop out, as in an inner join on both keys. Scores of the two groups are
    put together first, on the small side, so the records are joined once.
    """
    groups = (
        profile_scores(profile(view, weights), weights)
        .groupBy("entity_id", "source")
        .agg(
            F.max("source_pii_score").alias("source_pii_score"),
            F.max("entity_pii_score").alias("entity_pii_score"),
            F.max("max_record_pii_score").alias("max_record_pii_score"),
        )
    )
    return join_by_key(record_scores(view, weights), groups, ["entity_id", "source"], "inner")


def with_levels(df: DataFrame, levels: Mapping[str, float] = LEVELS) -> DataFrame:
    """``df`` with the level of each of the four scores."""
    return df.withColumns(
        {
            "row_known_unknown": classify(F.col("record_pii_score"), levels),
            "source_known_unknown": classify(F.col("source_pii_score"), levels),
            "entity_known_unknown": classify(F.col("entity_pii_score"), levels),
            "max_record_known_unknown": classify(F.col("max_record_pii_score"), levels),
        }
    )


def levels(
    view: DataFrame,
    weights: Mapping[str, float] = WEIGHTS,
    bounds: Mapping[str, float] = LEVELS,
) -> DataFrame:
    """Row-level result: entity, source, the four scores and their levels."""
    return with_levels(scored(view, weights), bounds).select(
        "entity_id",
        "source",
        "record_pii_score",
        "row_known_unknown",
        "source_pii_score",
        "source_known_unknown",
        "entity_pii_score",
        "entity_known_unknown",
        "max_record_pii_score",
        "max_record_known_unknown",
    )


def profile_levels(
    prof: DataFrame, weights: Mapping[str, float] = WEIGHTS, bounds: Mapping[str, float] = LEVELS
) -> DataFrame:
    """``levels`` on the profile: same columns plus ``records``, the number of rows each line stands for."""
    return with_levels(profile_scores(prof, weights), bounds).drop("bits")
