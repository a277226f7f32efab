"""From a column catalogue to stored tags and a manifest."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.operators import manifest, pii, tags
from kinweave.sources.manifests import write_manifest
from kinweave.sources.shared import SharedTable, materialise
from kinweave.sources.tag_table import TagTable


@dataclass(frozen=True)
class Scan:
    """A classified catalogue, kept as a shared table, with its roll-ups."""

    table: SharedTable
    summary: DataFrame
    schemas: DataFrame

    @property
    def columns(self) -> DataFrame:
        return self.table.df


def scan_columns(
    columns: DataFrame, skip_prefix: str, answers: DataFrame | None = None, listing: DataFrame | None = None
) -> Scan:
    """Classify all columns, by name rules or by a model's ``answers``, with no semantic on numeric types and one
    primary key per table."""
    own = pii.skip_tables(columns, skip_prefix)
    if listing is not None:
        listing = pii.skip_tables(listing, skip_prefix)
    found = pii.classify_columns(own) if answers is None else pii.ingest_answers(own, answers)
    table = materialise(pii.single_pk(pii.numeric_guard(found)), "scan")
    summary = pii.table_summary(table.df, listing)
    return Scan(table, summary, pii.schema_rollup(summary))


def store_tags(scan: Scan, at: Column, path: str) -> tuple[DataFrame, DataFrame]:
    """Commit the scan's tags to the tag table below ``path`` and return it with the check of its counts.

    Another writer's tags of other tables stay; ``tag_table.Conflict`` is raised if it tags the same tables meanwhile.
    """
    batch = tags.tag_plan(scan.columns)
    table = TagTable(batch.sparkSession, path)
    stored = table.read(table.commit(batch, at) or None)
    return stored, tags.verify_upsert(stored, batch)


def store_manifest(
    scan: Scan, settings: Mapping[str, Any], path: str, rules: manifest.ManifestRules | None = None
) -> DataFrame:
    """Write the resolution manifest of a scan and return the fields that had to stay out.

    With ``rules`` the manifest is checked first, and nothing is written if it breaks one.
    """
    nested = manifest.nest_fields(manifest.resolution_config(scan.columns))
    if rules is not None:
        checked = manifest.validate_manifest(manifest.documents(nested, settings, "run"), rules)
        broken = checked.filter(~F.col("valid")).select("path", "first_error").first()
        if broken is not None:
            raise ValueError(f"manifest of {broken['path']} is not valid: {broken['first_error']}")
    write_manifest(nested, settings, path)
    return manifest.unsupported_fields(scan.columns)
