"""Entities that grow by batches, against all pairs of all records."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import skew
from kinweave.operators import entity_store
from kinweave.operators.entity_store import Conflict, EntityStore
from kinweave.sources.shared import materialise
from test_resolution import SCHEMA, brute_force_entities, random_records


def grouped(entities):
    """Each record's group, whatever its name."""
    members = {}
    for record, entity in entities:
        members.setdefault(entity, []).append(record)
    return sorted(sorted(m) for m in members.values())


def frame(spark, records):
    return spark.createDataFrame([tuple(r.values()) for r in records], SCHEMA)


def stored(store, version=None):
    return [(r.record_id, r.entity_id) for r in store.entities(version).collect()]


def test_batches_give_the_entities_of_all_records(spark, tmp_path):
    records = random_records(240, 5)
    random.Random(1).shuffle(records)
    store = EntityStore(spark, str(tmp_path / "store"), buckets=7)
    seen, names = 0, {}
    for end in (100, 180, 240):
        assert store.add(frame(spark, records[seen:end])) == store.version()
        seen = end
        found = dict(stored(store))
        assert len(found) == seen and grouped(found.items()) == grouped(brute_force_entities(records[:seen]).items())
        # A name changes only by a merge that is told.
        merged = {r.retired: r.entity_id for r in store.merges().collect()}
        assert all(found[r] == merged.get(old, old) for r, old in names.items())
        assert not set(merged.values()) & set(merged)
        names = found
    before = sorted(stored(store))
    assert store.compact() == 4 and sorted(stored(store)) == before
    assert len(stored(store, 1)) == 100 and len(stored(store, 2)) == 180
    bridge = [{"record_id": "zz", "datasource": "s", **dict.fromkeys(list(records[0])[2:], None), "email": "email0", "phone": "phone0"}]
    store.add(frame(spark, bridge))
    assert grouped(stored(store)) == grouped(brute_force_entities(records + bridge).items())


def person(record_id, **fields):
    return (record_id, "s", *(fields.get(f) for f in SCHEMA.replace(" string", "").split(", ")[2:]))


def test_records_that_come_again_merges_nulls_and_no_rows(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], SCHEMA)
    assert store.add(none) == 0 and store.entities().count() == 0 and store.merges().count() == 0

    def add(*rows):
        return store.add(spark.createDataFrame(list(rows), SCHEMA))

    add(person("a", email="x"), person("b", email="y"), person("c"), person(None, email="x"), person("a", email="x"))
    assert sorted(stored(store)) == [("a", "a"), ("b", "b"), ("c", "c")]
    add(person("d", email="y", phone="7"), person("e", email="q"))
    assert sorted(stored(store)) == [("a", "a"), ("b", "b"), ("c", "c"), ("d", "b"), ("e", "e")]
    add(person("b", email="q"), person("c"))  # a new value of a known record
    assert dict(stored(store))["e"] == "b" and store.entities().count() == 5
    add(person("0", email="x", phone="7"))  # all of b goes to a, also what e had become
    assert sorted(stored(store)) == [("0", "a"), ("a", "a"), ("b", "a"), ("c", "c"), ("d", "a"), ("e", "a")]
    assert {(r.retired, r.entity_id) for r in store.merges().collect()} == {("b", "a"), ("e", "a")}
    assert store.add(none) == 4 and dict(stored(store, 2))["d"] == "b"
    with pytest.raises(ValueError):
        store.entities(9)


def test_a_key_of_a_third_and_untouched_buckets(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path / "store"), rules=(("email",),), buckets=64)
    many = spark.range(3000).select(
        F.concat(F.lit("r"), F.lpad("id", 5, "0")).alias("record_id"), F.when(F.col("id") % 3 == 0, F.lit("none@x")).otherwise(F.concat("id", F.lit("@x"))).alias("email")
    )
    store.add(many)
    assert store.entities().filter("entity_id = 'r00000'").count() == 1000
    store.add(spark.createDataFrame([("new", "1@x")], "record_id string, email string"))
    assert dict(stored(store))["new"] == "r00001"
    first, second = store._commits(None)
    assert len(first.buckets) == 64 and len(second.buckets) == 1
    touched = store._keys_in([first], [5, 9]).inputFiles()
    assert touched and all("bucket=5/" in f or "bucket=9/" in f for f in touched)


def test_two_writers_of_one_version(spark, tmp_path):
    store = EntityStore(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([person("a", email="x")], SCHEMA)
    store.add(one)
    before = sorted(stored(store))
    with pytest.raises(Conflict):
        store.add(spark.createDataFrame([person("b", email="x")], SCHEMA), since=0)
    assert sorted(stored(store)) == before and store.version() == 1


def test_a_batch_is_read_once_and_stored_tables_are_not_written_again(spark, tmp_path, monkeypatch):
    written = []
    for module in (entity_store, skew):
        monkeypatch.setattr(module, "materialise", lambda df, name: written.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or materialise(df, name))
    (tmp_path / "given").mkdir()
    frame(spark, random_records(60, 2)).write.parquet(str(tmp_path / "given/one"))
    store = EntityStore(spark, str(tmp_path / "store"), buckets=3)
    for _ in range(2):
        store.add(spark.read.parquet(str(tmp_path / "given/one")).withColumn("email", F.expr("regexp_replace(email, 'x+', 'x')")))
    assert store.version() == 2 and store.entities().count() == 60
    assert sum("regexp_replace" in plan for _, plan in written) == 2
    assert sum(name == "right" for name, _ in written) == 2  # the smallest record of each key, once a batch
