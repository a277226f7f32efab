"""Report 3: how entities connect the sources.

The overlap operators first reduce every entity to its set of sources and count equal sets. Pairs and regions are
then made from the distinct sets, not from the entities.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators.report_global import entity_sizes
from kinweave.operators.report_source import source_entity_sizes


def overall_consolidation(prof: DataFrame) -> DataFrame:
    """Four lines ``source, resolution_type, value``: entities with one and with more records, and the records in
    them. An empty table gives no lines."""
    single = F.col("records") == 1
    totals = entity_sizes(prof).agg(
        F.count("*").alias("entities"),
        F.count_if(single).alias("singles"),
        F.count_if(~single).alias("merged"),
        F.sum(F.when(single, F.lit(0)).otherwise(F.col("records"))).alias("merged_records"),
    )

    def line(source: str, kind: str, value: str) -> Column:
        return F.struct(
            F.lit(source).alias("source"),
            F.lit(kind).alias("resolution_type"),
            F.col(value).cast("bigint").alias("value"),
        )

    lines = F.array(
        line("Clusters", "1 Record Clusters", "singles"),
        line("Clusters", "2+ Record Clusters", "merged"),
        line("Source IDs", "1 Record to 1 Cluster", "singles"),
        line("Source IDs", "2+ Records to 1 Cluster", "merged_records"),
    )
    return totals.filter("entities > 0").select(F.inline(lines))


def source_count(prof: DataFrame) -> DataFrame:
    """Entities by number of sources (1 to 4, 5+; "Check" when no source is known), their records, and how many of
    them have more records than sources."""
    n = F.col("sources")
    label = (
        F.when(n == 1, F.lit("1 Source"))
        .when(n.between(2, 4), F.concat(n.cast("string"), F.lit(" Sources")))
        .when(n >= 5, F.lit("5+ Sources"))
        .otherwise(F.lit("Check"))
    )
    return (
        source_entity_sizes(prof)
        .groupBy("entity_id")
        .agg(F.count("source").alias("sources"), F.sum("records").alias("records"))
        .groupBy(label.alias("number_of_sources"))
        .agg(
            F.count("*").alias("entity_ids"),
            F.sum("records").alias("source_count"),
            F.count_if(F.col("records") > F.col("sources")).alias("intra_source_dupe_count"),
        )
        .orderBy("number_of_sources")
    )


def top_sources(prof: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` sources with most records (ties by name), in name order."""
    return (
        prof.groupBy("source")
        .agg(F.sum("records").alias("record_count"))
        .orderBy(F.desc("record_count"), "source")
        .limit(k)
        .orderBy("source")
    )


def source_sets(prof: DataFrame, sources: DataFrame | None = None, keep_null_entity: bool = False) -> DataFrame:
    """``sources, cnt``: distinct sorted sets of sources and the number of entities having exactly that set.

    ``sources`` (column ``source``) are the few sources looked at, if not all. A set holds each source of one entity
    once, so its length is bounded by the number of sources.
    """
    pairs = prof.filter(F.col("source").isNotNull())
    if not keep_null_entity:
        pairs = pairs.filter(F.col("entity_id").isNotNull())
    if sources is not None:
        chosen = sources.agg(F.collect_set("source")).scalar()
        pairs = pairs.filter(F.array_contains(chosen, F.col("source")))
    return (
        pairs.groupBy("entity_id")
        .agg(F.sort_array(F.collect_set("source")).alias("sources"))
        .groupBy("sources")
        .agg(F.count("*").alias("cnt"))
    )


def overlap_groups(prof: DataFrame, sources: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """``venn_group, cnt``: entities by the exact set of chosen sources they appear in, names joined by ", ".

    ``sources`` defaults to the three largest. The null entity counts as one. ``limit``, if any, is the report length.
    """
    chosen = top_sources(prof) if sources is None else sources
    out = source_sets(prof, chosen, keep_null_entity=True).select(
        F.array_join("sources", ", ").alias("venn_group"), "cnt"
    )
    out = out.orderBy("venn_group")
    return out if limit is None else out.limit(limit)


def venn_regions(prof: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """``sources, venn_group, cnt`` for every combination of the chosen sources (default: all) that occurs. The set
    itself is the key, so there may be any number of sources."""
    return source_sets(prof, sources, keep_null_entity=True).select(
        "sources", F.array_join("sources", ", ").alias("venn_group"), "cnt"
    )


def all_venn_regions(prof: DataFrame, names: Sequence[str]) -> DataFrame:
    """``region, venn_group, cnt`` for every non-empty combination of a few sources named by a person, 0 where none.

    Region numbers count in binary over the sources in name order: A, B, AB, C, AC, BC, ABC. There are 2 to the number
    of sources less one of them, made by all tasks.
    """
    ordered = sorted({n for n in names if n is not None})
    spark = prof.sparkSession
    regions = spark.range(1, 1 << len(ordered)).withColumnRenamed("id", "region")
    bits = [F.when(F.col("region").bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(ordered)]
    regions = regions.select("region", F.array_compact(F.array(*bits)).cast("array<string>").alias("sources"))
    chosen = spark.range(1).select(F.explode(F.array(*map(F.lit, ordered)).cast("array<string>")).alias("source"))
    counts = source_sets(prof, chosen, keep_null_entity=True)
    return (
        regions.join(counts, "sources", "left")
        .select(
            "region",
            F.array_join("sources", ", ").alias("venn_group"),
            F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"),
        )
        .orderBy("region")
    )


def pairwise_overlap(prof: DataFrame) -> DataFrame:
    """``source_1, source_2, cnt``: entities the two sources share, in both directions."""
    return (
        source_sets(prof)
        .filter(F.size("sources") > 1)
        .withColumn("source_1", F.explode("sources"))
        .withColumn("source_2", F.explode("sources"))
        .filter("source_1 <> source_2")
        .groupBy("source_1", "source_2")
        .agg(F.sum("cnt").alias("cnt"))
        .orderBy("source_1", "source_2")
    )


def overlap_matrix(prof: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """``pairwise_overlap`` with one column per second source (null where nothing is shared).

    Pass ``sources`` to fix the columns; otherwise Spark looks the names up first.
    """
    pairs = pairwise_overlap(prof).groupBy("source_1")
    pivoted = pairs.pivot("source_2", list(sources)) if sources else pairs.pivot("source_2")
    return pivoted.agg(F.sum("cnt"))
