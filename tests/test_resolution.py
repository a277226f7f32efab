import random

import pytest

from checks import resolution_queries
from kinweave.operators import components, resolution
from kinweave.plans import tagging
from kinweave.plans.resolve import resolve, resolve_manifest
from kinweave.sources import catalog, manifests, outputs
from kinweave.sources.outputs import write_resolution

SCHEMA = "record_id string, datasource string, " + ", ".join(f"{f} string" for f in resolution.FIELDS)


def groups_of(edges, nodes):
    """Components by union-find, named by their smallest node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def brute_force_entities(records):
    """Compare every pair by its summed agreement."""
    edges = []
    for i, a in enumerate(records):
        for b in records[:i]:
            agree = sum(
                w for f, w in resolution.MATCH_WEIGHTS.items() if a[f] is not None and a[f] == b[f]
            )
            if agree >= resolution.MATCH_THRESHOLD:
                edges.append((a["record_id"], b["record_id"]))
    return groups_of(edges, [r["record_id"] for r in records])


def random_records(n, seed):
    rnd = random.Random(seed)

    def pick(field, values, missing):
        return None if rnd.random() < missing else f"{field}{rnd.randrange(values)}"

    sizes = {"given_name": 6, "surname": 6, "email": 60, "phone": 60, "address": 25, "birthdate": 12}
    return [
        {"record_id": f"r{i:04d}", "datasource": "s", **{f: pick(f, k, 0.6) for f, k in sizes.items()}}
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_entities_equal_all_pairs(spark, seed):
    records = random_records(250, seed)
    df = spark.createDataFrame([tuple(r.values()) for r in records], SCHEMA)
    edges = resolution.pair_scores(resolution.pairs(df))
    found = resolution.unified(df, components.connected_components(edges))
    assert {r.record_id: r.entity_id for r in found.collect()} == brute_force_entities(records)
    assert edges.filter(f"score < {resolution.MATCH_THRESHOLD}").isEmpty()
    assert edges.filter("NOT confidence BETWEEN 0 AND 1").isEmpty()


def test_rules_are_minimal_and_reach_the_threshold():
    rules = resolution.match_rules()
    assert ("email",) in rules and ("phone",) in rules and ("address", "birthdate") in rules
    for rule in rules:
        total = sum(resolution.MATCH_WEIGHTS[f] for f in rule)
        assert total >= resolution.MATCH_THRESHOLD
        assert all(total - resolution.MATCH_WEIGHTS[f] < resolution.MATCH_THRESHOLD for f in rule)
    with pytest.raises(ValueError):
        resolution.match_rules({"a": 0.0}, 1.0)


def test_a_key_held_by_a_third_of_all_records(spark):
    """A junk value shared by a third of the records costs one line per record, and none is left out."""
    df = spark.range(3000).selectExpr(
        "concat('r', lpad(id, 5, '0')) AS record_id",
        "'s' AS datasource",
        "CAST(NULL AS STRING) AS given_name",
        "CAST(NULL AS STRING) AS surname",
        "CASE WHEN id % 3 = 0 THEN 'none@x.org' ELSE concat('u', id, '@x.org') END AS email",
        "CAST(NULL AS STRING) AS phone",
        "CAST(NULL AS STRING) AS address",
        "CAST(NULL AS STRING) AS birthdate",
    )
    found = resolution.pairs(df)
    assert found.count() == 999
    entities = resolution.unified(df, components.connected_components(found))
    sizes = sorted(r["count"] for r in entities.groupBy("entity_id").count().collect())
    assert sizes == [1] * 2000 + [1000]


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(60)],
        [(0, i) for i in range(1, 40)] + [(100, i) for i in range(30, 50)],
        [(5, 5), (7, 8), (8, 7), (7, 8)],
        [(i, (i * 7) % 31) for i in range(31)],
    ],
    ids=["path", "two stars", "loops and repeats", "mixed"],
)
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "id_a bigint, id_b bigint")
    found = {r.node: r.component for r in components.connected_components(df).collect()}
    assert found == groups_of(edges, {n for e in edges for n in e})


def test_records_without_a_key_leave_other_links_alone(spark):
    rows = [(1, 7, "a@x.org"), (2, 7, "a@x.org"), (None, 7, "a@x.org"), (3, None, "a@x.org"), (2, 7, "b@x.org")]
    table = spark.createDataFrame(rows, "k int, j int, mail string")
    records = resolution.standardise({"t": table}, {"t": {"mail": "email"}}, {"t": ["k", "j"]})
    assert records.count() == 3
    pairs = resolution.pairs(records.unionByName(records.limit(1).selectExpr("CAST(NULL AS STRING) AS record_id", *records.columns[1:])))
    assert pairs.select("id_a", "id_b").collect() == [("t:2\x1f7", "t:1\x1f7")]
    refused = resolution.rejected({"t": table}, {"t": ["k", "j"]})
    assert {tuple(r) for r in refused.collect()} == {("t", None, "no key", 2), ("t", "2\x1f7", "repeated key", 2)}


def test_components_of_nothing(spark):
    assert components.connected_components(spark.createDataFrame([], "id_a string, id_b string")).count() == 0


def test_standardise(spark, rows):
    people = spark.createDataFrame(
        [(1, "  Ann  Lee Smith", "A@X.org ", "+1 (555) 12-34", "03/04/1990", "Main St", "Ulm"), (2, "", None, "n/a", "x", "", None)],
        "k int, who string, mail string, tel string, born string, street string, town string",
    )
    tags = {"who": "full-name", "mail": "email", "tel": "phone", "born": "birthdate", "street": "address", "town": "city"}
    got = rows(resolution.standardise({"s.people": people}, {"s.people": tags}, {"s.people": "k"}))
    assert got == [
        ("s.people:1", "s.people", "ann", "lee smith", "a@x.org", "15551234", "main st ulm", "1990-03-04"),
        ("s.people:2", "s.people", None, None, None, None, None, None),
    ]


def test_plan_and_stored_outputs(spark, tmp_path):
    a = spark.createDataFrame([(1, "x@x.org", "1"), (2, "y@x.org", "2")], "id int, mail string, tel string")
    b = spark.createDataFrame([(1, "X@X.ORG"), (2, "z@x.org")], "id int, email string")
    records, edges, shared = resolve(
        {"a": a, "b": b}, {"a": {"mail": "email", "tel": "phone"}, "b": {"email": "email"}}, {"a": "id", "b": "id"}
    )
    write_resolution(records, edges, str(tmp_path), as_tables=False)
    for table in shared:
        table.drop()
    stored = spark.read.parquet(str(tmp_path / "unified_coalesced"))
    assert {(r.record_id, r.entity_id) for r in stored.collect()} == {
        ("a:1", "a:1"),
        ("b:1", "a:1"),
        ("a:2", "a:2"),
        ("b:2", "b:2"),
    }
    assert spark.read.parquet(str(tmp_path / "unified_scores")).count() == 1


def test_from_manifest(spark, tmp_path):
    """Catalogue, rules, manifest file, resolution: the whole way."""
    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    spark.createDataFrame([("k1", "A@x.org", "1"), ("k2", None, "2")], "customer_uuid string, email string, phone string").write.mode(
        "overwrite"
    ).saveAsTable("src.web")
    spark.createDataFrame([(1, "a@x.org"), (2, "b@x.org")], "nr int, email string").write.mode("overwrite").saveAsTable("src.crm")
    columns = catalog.column_catalog(spark, ["src.web", "src.crm"])
    scan = tagging.scan_columns(columns, "_resolved")
    tagging.store_manifest(scan, {"output_schema_name": "out"}, str(tmp_path / "m"))
    manifest = manifests.read_manifest(spark, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="spark_catalog.src.crm"):
        resolve_manifest(spark, manifest)
    records, edges, shared = resolve_manifest(spark, manifest, {"spark_catalog.src.crm": "nr"})
    entities = {r.record_id.split(".")[-1]: r.entity_id.split(".")[-1] for r in records.collect()}
    assert entities == {"web:k1": "crm:1", "crm:1": "crm:1", "web:k2": "web:k2", "crm:2": "crm:2"}
    assert edges.count() == 1 and len(shared) == 2


def test_outputs_as_tables(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS resolved_here")
    df = spark.range(3)
    write_resolution(df, df, "resolved_here")
    assert spark.table("resolved_here.unified_scores").count() == 3


def test_stored_overlap_finds_edges_once(spark, tmp_path, monkeypatch):
    """What is stored reads written edges and records: neither is made again for each of its readers."""
    plans = []

    def kept(unified, scores, path, as_tables):
        plans.extend(df._jdf.queryExecution().optimizedPlan().toString().lower() for df in (unified, scores))
        outputs.write_resolution(unified, scores, path, as_tables)

    monkeypatch.setattr(resolution_queries, "write_resolution", kept)
    spark.range(40).selectExpr("id AS k", "concat('u', id % 20, '@x.org') AS mail").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    records = resolution.standardise({"one": table.filter("k < 20"), "two": table.filter("k >= 20")}, {n: {"mail": "email"} for n in ("one", "two")}, {"one": "k", "two": "k"})
    monkeypatch.setattr(resolution_queries, "_records", lambda s, d: records)
    found = resolution_queries._stored_overlap(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [("one", "two", 20), ("two", "one", 20)]
    assert len(plans) == 2 and not any("levenshtein" in p or "regexp_replace" in p for p in plans)
