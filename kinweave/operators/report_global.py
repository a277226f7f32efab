"""Report 1: what resolution did to the records as a whole.

``prof`` is ``scores.profile`` or ``scores.sizes``; ``graded`` is ``scores.profile_levels``. Every aggregate below is
combined on the map side, and no window runs over records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.scoring import count_text, percent_text, share_percent


def entity_sizes(prof: DataFrame) -> DataFrame:
    """``entity_id, records``: one line per entity, the null entity included."""
    return prof.groupBy("entity_id").agg(F.sum("records").alias("records"))


def records_vs_entities(prof: DataFrame) -> DataFrame:
    """``source_ids`` (records) and ``entity_ids`` (distinct entities, null not counted)."""
    return entity_sizes(prof).agg(
        F.coalesce(F.sum("records"), F.lit(0)).cast("bigint").alias("source_ids"),
        F.count("entity_id").alias("entity_ids"),
    )


def dedupe_rate(prof: DataFrame) -> DataFrame:
    """``record_cnt, entity_cnt, de_dupe_rate``; the rate is null on an empty table."""
    counts = records_vs_entities(prof)
    return counts.select(
        F.col("source_ids").alias("record_cnt"),
        F.col("entity_ids").alias("entity_cnt"),
        (F.lit(1.0) - F.try_divide(F.col("entity_ids").cast("double"), F.col("source_ids").cast("double"))).alias(
            "de_dupe_rate"
        ),
    )


def _before_after(graded: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, level, before_cnt, after_cnt``: records by row level and by entity level side by side.

    The same lines as a full join of the two counts on keys and level, from one pass: every line of the profile gives
    its records to two levels. A side without records is null, and as null equals nothing in a join, records without a
    level stay in one line per side.
    """
    sides = F.array(
        F.struct(F.lit(True).alias("is_before"), F.col("row_known_unknown").alias("level")),
        F.struct(F.lit(False).alias("is_before"), F.col("entity_known_unknown").alias("level")),
    )
    own_line = F.when(F.col("level").isNull(), F.col("is_before"))
    return (
        graded.select(*keys, "records", F.inline(sides))
        .groupBy(*keys, "level", own_line.alias("_own"))
        .agg(
            F.sum(F.when(F.col("is_before"), F.col("records"))).alias("before_cnt"),
            F.sum(F.when(~F.col("is_before"), F.col("records"))).alias("after_cnt"),
        )
        .drop("_own")
    )


def improvement(graded: DataFrame) -> DataFrame:
    """Record counts per level before (row level) and after (entity level), with shares of each side.

    ``perc_post_of_pre`` keeps the older reading, "after" divided by the total of "before". The window covers
    one line per level.
    """
    everything = Window.partitionBy()
    before_total = F.sum("before_cnt").over(everything)
    after_total = F.sum("after_cnt").over(everything)
    out = _before_after(graded, []).select(
        F.col("level").alias("pii_classification"),
        "before_cnt",
        "after_cnt",
        share_percent(F.col("before_cnt"), before_total).alias("perc_pre"),
        share_percent(F.col("after_cnt"), after_total).alias("perc_post"),
        share_percent(F.col("after_cnt"), before_total).alias("perc_post_of_pre"),
    )
    return out.withColumns(
        {
            "before_cnt_text": count_text(F.col("before_cnt")),
            "after_cnt_text": count_text(F.col("after_cnt")),
            "perc_pre_text": percent_text(F.col("perc_pre")),
            "perc_post_text": percent_text(F.col("perc_post")),
        }
    ).orderBy("pii_classification")


def shift(graded: DataFrame) -> DataFrame:
    """Records by level before and level after."""
    return (
        graded.groupBy(
            F.col("row_known_unknown").alias("pre_level"), F.col("entity_known_unknown").alias("post_level")
        )
        .agg(F.sum("records").alias("record_cnt"))
        .orderBy("pre_level", "post_level")
    )


def shift_matrix(graded: DataFrame, level_names: list[str]) -> DataFrame:
    """``shift`` as a matrix: one line per level before, one column per level after (missing = 0)."""
    return (
        shift(graded).groupBy("pre_level").pivot("post_level", level_names).agg(F.sum("record_cnt")).fillna(0)
    )
