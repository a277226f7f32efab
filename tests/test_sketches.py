"""Column profiles: exact counts, sketches against exact values, merging, keys."""

import pytest
from pyspark.sql import functions as F

from kinweave.operators import sketches


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(20_000).selectExpr(
        "id", "id % 500 AS some", "CAST(IF(id % 4 = 0, NULL, id) AS STRING) AS holes", "id * 0.5D AS half", "IF(id % 2 = 0, 'NaN', '1')::double AS odd"
    )


COLUMNS = ["id", "some", "holes", "half", "odd"]


def _read(df):
    return {r.column_name: r for r in sketches.read_profiles(df).collect()}


def test_profile(people):
    found = _read(sketches.column_profiles({"people": (people, COLUMNS)}))
    assert {c: r.n_null for c, r in found.items()} == {"id": 0, "some": 0, "holes": 5000, "half": 0, "odd": 0}
    assert all(r.n_rows == 20_000 for r in found.values())
    for column, exact in {"id": 20_000, "some": 500, "holes": 15_000, "half": 20_000, "odd": 2}.items():
        assert abs(found[column].n_distinct - exact) <= 0.04 * exact
    assert abs(found["half"].median - 5000) <= 0.03 * 10_000
    assert found["odd"].median == 1 and found["holes"].median is None
    assert (found["id"].min_length, found["id"].max_length) == (1, 5)
    assert {c for c, r in found.items() if r.may_be_key} == {"id", "half"}


def test_batches_merge_to_the_whole(people):
    parts = [sketches.column_profiles({"people": (people.filter(F.col("id") % 3 == k), COLUMNS)}) for k in range(3)]
    merged, whole = _read(sketches.merge_profiles(*parts)), _read(sketches.column_profiles({"people": (people, COLUMNS)}))
    for column, row in whole.items():
        other = merged[column]
        assert (other.n_rows, other.n_null, other.min_length, other.max_length) == (row.n_rows, row.n_null, row.min_length, row.max_length)
        assert other.n_distinct == pytest.approx(row.n_distinct, rel=0.02)
        assert other.may_be_key == row.may_be_key


def test_no_rows_and_no_values(spark, people):
    nothing = sketches.column_profiles({"none": (people.limit(0), COLUMNS)})
    found = _read(nothing)
    assert all(r.n_rows == 0 and r.n_distinct == 0 and r.median is None and not r.may_be_key for r in found.values())
    nulls = spark.sql("SELECT CAST(NULL AS INT) AS id FROM range(3)")
    row = _read(sketches.column_profiles({"nulls": (nulls, ["id"])}))["id"]
    assert (row.n_rows, row.n_null, row.n_distinct, row.median, row.may_be_key) == (3, 3, 0, None, False)
    whole = sketches.merge_profiles(nothing, sketches.column_profiles({"none": (people, COLUMNS)}))
    assert _read(whole)["id"].may_be_key


def test_keys_need_unique_values(spark, people, rows):
    scan = spark.createDataFrame(
        [("people", "id", "pk"), ("people", "some", "pk"), ("people", "holes", "email"), ("people", "half", None), ("other", "id", "pk")],
        "table_name string, column_name string, semantic string",
    )
    got = sketches.confirm_keys(scan, sketches.column_profiles({"people": (people, COLUMNS)}))
    assert got.columns == scan.columns
    assert {(t, c): s for t, c, s in rows(got)} == {
        ("people", "id"): "pk", ("people", "some"): None, ("people", "holes"): "email", ("people", "half"): None, ("other", "id"): "pk",
    }
