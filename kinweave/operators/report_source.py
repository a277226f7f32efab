"""Report 2: what resolution did to the records of each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.scoring import count_text, percent_text, share_percent
from kinweave.operators.report_global import _before_after


def source_entity_sizes(prof: DataFrame) -> DataFrame:
    """``source, entity_id, records``: one line per entity in a source."""
    return prof.groupBy("entity_id", "source").agg(F.sum("records").alias("records"))


def by_source(prof: DataFrame) -> DataFrame:
    """``source, source_ids, entity_ids``, largest first.

    Distinct entities are counted in two steps (by source and entity, then by source), so a source that holds
    most records is spread over all tasks until only partial counts are left.
    """
    return (
        source_entity_sizes(prof)
        .groupBy("source")
        .agg(F.sum("records").alias("source_ids"), F.count("entity_id").alias("entity_ids"))
        .orderBy(F.desc("source_ids"), "source")
    )


def dedupe_by_source(prof: DataFrame) -> DataFrame:
    """``by_source`` with the de-duplication rate (3 places), as percent text, and the records removed."""
    kept = F.try_divide(F.col("entity_ids").cast("double"), F.col("source_ids").cast("double"))
    kept_percent = F.try_divide(
        F.col("entity_ids").cast("double") * F.lit(100.0), F.col("source_ids").cast("double")
    )
    return by_source(prof).select(
        "source",
        "source_ids",
        "entity_ids",
        F.round(F.lit(1.0) - kept, 3).alias("source_dupe_rate"),
        percent_text(F.round(F.lit(100.0) - kept_percent, 1)).alias("source_dedupe_rate_perc"),
        (F.col("source_ids") - F.col("entity_ids")).alias("records_de_duped"),
    )


def consolidation(prof: DataFrame) -> DataFrame:
    """Entities of each source by the number of records merged into them: 1, 2, or 3 and more."""
    label = (
        F.when(F.col("records") == 1, F.lit("1 Record to 1 Cluster"))
        .when(F.col("records") == 2, F.lit("2 Records to 1 Cluster"))
        .otherwise(F.lit("3+ Records to 1 Cluster"))
    )
    return (
        source_entity_sizes(prof)
        .groupBy("source", label.alias("records_in_cluster"))
        .agg(F.count("*").alias("cnt"))
        .orderBy("source", "records_in_cluster")
    )


def improvement_by_source(graded: DataFrame) -> DataFrame:
    """``report_global.improvement`` within each source; shares are of the side's total in that source.

    The window holds one line per level of a source.
    """
    joined = _before_after(graded, ["source"])
    of_source = Window.partitionBy("source")
    before_total = F.sum("before_cnt").over(of_source)
    after_total = F.sum("after_cnt").over(of_source)
    return (
        joined.select(
            "source",
            F.col("level").alias("pii_known_unknown"),
            "before_cnt",
            "after_cnt",
            share_percent(F.col("before_cnt"), before_total).alias("percent_of_before"),
            share_percent(F.col("after_cnt"), after_total).alias("percent_of_after"),
        )
        .withColumns(
            {
                "before_cnt_text": count_text(F.col("before_cnt")),
                "after_cnt_text": count_text(F.col("after_cnt")),
                "percent_of_before_text": percent_text(F.col("percent_of_before")),
                "percent_of_after_text": percent_text(F.col("percent_of_after")),
            }
        )
        .orderBy("source", "pii_known_unknown")
    )


def source_level_entities(graded: DataFrame) -> DataFrame:
    """Entities of each source by source level and entity level, each entity counted once per source."""
    return (
        graded.select(
            "source",
            "entity_id",
            "source_pii_score",
            "source_known_unknown",
            "entity_pii_score",
            "entity_known_unknown",
        )
        .distinct()
        .groupBy("source", "source_known_unknown", "entity_known_unknown")
        .agg(F.count("*").alias("entities"))
        .orderBy("source", "source_known_unknown", "entity_known_unknown")
    )
