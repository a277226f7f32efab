"""From tagged source tables to resolved records and match edges."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import resolution, similar
from kinweave.operators.components import connected_components
from kinweave.sources.manifests import manifest_fields
from kinweave.sources.shared import SharedTable, materialise


def manifest_semantics(manifest: DataFrame) -> dict[str, dict[str, str]]:
    """The tagged columns of each table of a manifest (``path, fields``), as ``resolve`` wants them.

    A job names its tables one by one, so this is no more than the driver has to know to open them.
    """
    found: dict[str, dict[str, str]] = {}
    fields = manifest_fields(manifest).select("path", "field_name", F.get("semantics", F.lit(0)).alias("tag"))
    for row in fields.filter("tag IS NOT NULL").collect():
        found.setdefault(row["path"], {})[row["field_name"]] = row["tag"]
    return found


def resolve_manifest(
    spark: SparkSession,
    manifest: DataFrame,
    keys: Mapping[str, str | Sequence[str]] | None = None,
    read: Callable[[str], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame, list[SharedTable]]:
    """``resolve`` for the tables of a manifest, opened by ``read`` (default: by table name).

    The key of a table is its columns tagged ``pk``, in name order; ``keys`` names it where none is (numeric keys carry
    no tag).
    """
    semantics = manifest_semantics(manifest)
    tagged = {}
    for path, columns in semantics.items():
        if found := sorted(c for c, tag in columns.items() if tag == "pk"):
            tagged[path] = found
    chosen = {**tagged, **(keys or {})}
    lacking = sorted(set(semantics) - set(chosen))
    if lacking:
        raise ValueError(f"no key column known for {', '.join(lacking)}")
    opener = read or spark.table
    return resolve({path: opener(path) for path in semantics}, semantics, chosen)


def resolve(
    tables: Mapping[str, DataFrame],
    semantics: Mapping[str, Mapping[str, str]],
    keys: Mapping[str, str | Sequence[str]],
    weights: Mapping[str, float] = resolution.MATCH_WEIGHTS,
    threshold: float = resolution.MATCH_THRESHOLD,
    alike: Mapping[str, float] = similar.SIMILAR_WEIGHTS,
) -> tuple[DataFrame, DataFrame, list[SharedTable]]:
    """``unified_coalesced``, ``unified_scores`` and the shared tables they read (drop them once both are stored).

    ``alike`` is what a value with one wrong letter is worth, by field; empty: only equal values agree.
    """
    records = materialise(resolution.standardise(tables, semantics, keys), "records")
    found = resolution.pair_scores(resolution.pairs(records.df, resolution.match_rules(weights, threshold)), weights)
    if alike:
        near = similar.similar_pairs(records.df, weights, alike, threshold)
        found = found.unionByName(similar.similar_scores(near, weights, alike))
    edges = materialise(found, "edges")
    entities = connected_components(edges.df)
    return resolution.unified(records.df, entities), edges.df, [records, edges]
