"""The whole resolution report from one pass over the records."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from kinweave.functions.scoring import LEVELS, WEIGHTS
from kinweave.operators import report_global, report_overlap, report_source, scores
from kinweave.sources.shared import SharedTable, materialise


def identity_report(
    records: DataFrame,
    mapping: Mapping[str, str] | None = None,
    weights: Mapping[str, float] = WEIGHTS,
    levels: Mapping[str, float] = LEVELS,
) -> tuple[dict[str, DataFrame], list[SharedTable]]:
    """Name to result of every report, and the two shared tables they read (drop them when done).

    The records are read once, to write their profile; the graded profile is written next. All reports work on these
    two, whose size depends on entities and sources, not on records.
    """
    prof = materialise(scores.profile(scores.unified_view(records, mapping), weights), "profile")
    graded = materialise(scores.profile_levels(prof.df, weights, levels), "graded")
    top = report_overlap.top_sources(prof.df)
    reports = {
        "records_vs_entities": report_global.records_vs_entities(prof.df),
        "dedupe_rate": report_global.dedupe_rate(prof.df),
        "improvement": report_global.improvement(graded.df),
        "shift": report_global.shift(graded.df),
        "by_source": report_source.by_source(prof.df),
        "dedupe_by_source": report_source.dedupe_by_source(prof.df),
        "consolidation": report_source.consolidation(prof.df),
        "improvement_by_source": report_source.improvement_by_source(graded.df),
        "source_level_entities": report_source.source_level_entities(graded.df),
        "overall_consolidation": report_overlap.overall_consolidation(prof.df),
        "source_count": report_overlap.source_count(prof.df),
        "top_sources": top,
        "overlap_groups": report_overlap.overlap_groups(prof.df, top),
        "venn_regions": report_overlap.all_venn_regions(prof.df, [r["source"] for r in top.collect()]),
        "pairwise_overlap": report_overlap.pairwise_overlap(prof.df),
    }
    return reports, [prof, graded]
