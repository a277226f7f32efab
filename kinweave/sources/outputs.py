"""Sinks of a resolution run and of the tag table."""

from __future__ import annotations

from pyspark.sql import DataFrame

OUTPUT_SCHEMA = "resolution_outputs"


def write_resolution(unified: DataFrame, scores: DataFrame, target: str, as_tables: bool = True) -> None:
    """Store the resolved records and the match edges as ``unified_coalesced`` and ``unified_scores``.

    ``target`` is ``catalog.schema`` (or ``schema``) for tables, or a folder.
    """
    for name, df in {"unified_coalesced": unified, "unified_scores": scores}.items():
        if as_tables:
            df.write.mode("overwrite").saveAsTable(f"{target}.{name}")
        else:
            df.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{name}")
