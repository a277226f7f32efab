"""Sources planned from listings, and catalogues made of footers."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains

from kinweave.sources import footers, planned

CHUNKS = [(7, 'a,"x, ""y"""\nb,""\n'), (3, 'c,\nd,"two\nlines"\ne,5\n'), (5, ""), (9, "f,6\n")]


@pytest.fixture
def chunks(spark, tmp_path):
    rows = []
    for index, text in CHUNKS:
        path = tmp_path / f"chunk-{index}.csv"
        path.write_text(text)
        rows.append((index, str(path), {7: 2, 3: 3, 5: 0, 9: 1}[index]))
    listing = str(tmp_path / "listing")
    spark.createDataFrame(rows, "chunk_index bigint, path string, rows bigint").write.parquet(listing)
    return listing


def test_chunks_in_order(spark, chunks):
    df = planned.read_chunks(spark, chunks, ["p", "q"])
    got = [tuple(r) for r in df.orderBy("row_number").collect()]
    assert got == [(3, 0, "c", None), (3, 1, "d", "two\nlines"), (3, 2, "e", "5"), (7, 3, "a", 'x, "y"'), (7, 4, "b", ""), (9, 5, "f", "6")]
    assert df.rdd.getNumPartitions() == 3


@pytest.mark.parametrize(
    ("condition", "numbers", "tasks"),
    [("row_number BETWEEN 2 AND 3", [2, 3], 2), ("row_number = 4", [4], 1), ("row_number > 4", [5], 1), ("row_number IN (0, 5)", [0, 5], 3),
     ("chunk_index = 7", [3, 4], 1), ("row_number < 3 AND p = 'd'", [1], 1), ("row_number >= 99", [], 1), ("row_number IS NULL", [], 3)],
)
def test_filters_choose_chunks(spark, chunks, condition, numbers, tasks):
    df = planned.read_chunks(spark, chunks, ["p", "q"]).filter(condition)
    assert [r.row_number for r in df.orderBy("row_number").collect()] == numbers
    assert df.rdd.getNumPartitions() <= tasks


def test_chunk_that_is_short_or_missing_fails(spark, chunks, tmp_path):
    (tmp_path / "chunk-7.csv").write_text("a,b\n")
    with pytest.raises(Exception, match="holds 1 rows, not 2"):
        planned.read_chunks(spark, chunks, ["p", "q"]).collect()
    assert planned.read_chunks(spark, chunks, ["p", "q"]).filter("row_number < 3").count() == 3
    (tmp_path / "chunk-7.csv").unlink()
    with pytest.raises(Exception, match="chunk-7"):
        planned.read_chunks(spark, chunks, ["p", "q"]).collect()


def test_bounds():
    bounds = planned.Bounds()
    assert bounds.take(GreaterThan(("k",), 3)) and bounds.take(LessThanOrEqual(("k",), 9)) and not bounds.take(In(("k",), (5, 7)))
    assert (bounds.low, bounds.high) == (5, 7) and not bounds.take(StringContains(("k",), "x")) and bounds.take(EqualTo(("k",), 6))
    assert (bounds.low, bounds.high) == (6, 6)
    assert planned.range_bounds(10, 19, 1000, "k", 300) == {"partitionColumn": "k", "lowerBound": "10", "upperBound": "20", "numPartitions": "4"}
    assert planned.range_bounds(5, 5, 10**9, "k")["numPartitions"] == "1"


@pytest.fixture
def ranged(spark, tmp_path):
    """Three files of row groups with ten keys each, one of them with null keys."""
    for f in range(3):
        keys = [f * 100 + i if (f, i % 10) != (2, 3) else None for i in range(40)]
        table = pa.table({"k": pa.array(keys, pa.int64()), "v": [f"v{i}" for i in range(40)]})
        pq.write_table(table, str(tmp_path / f"part-{f}.parquet"), row_group_size=10)
    listing = str(tmp_path / "groups")
    groups = footers.row_groups(footers.list_files(spark, str(tmp_path)), "k")
    groups.write.parquet(listing)
    return listing


def test_ranges(spark, ranged):
    df = planned.read_ranges(spark, ranged, "k", rows_per_task=20)
    assert df.columns == ["k", "v"] and df.count() == 120 and df.rdd.getNumPartitions() == 6
    assert df.filter("k IS NULL").count() == 4
    some = df.filter("k BETWEEN 105 AND 114")
    assert sorted(r.k for r in some.collect()) == list(range(105, 115))
    # Two groups hold such keys, four do not tell.
    assert some.rdd.getNumPartitions() == 3
    assert df.filter("k > 130 AND v = 'v39'").collect()[0].k == 139
    assert df.filter("k > 10000").count() == 0


def test_footers(spark, tmp_path):
    """Many files, their conflicts, and no file opened by the driver."""
    for i in range(60):
        columns = {"a": pa.array([i], pa.int64() if i % 30 else pa.int32())}
        if i % 20:
            columns["b"] = ["x"]
        pq.write_table(pa.table(columns), str(tmp_path / f"{i}.parquet"))
    files = footers.list_files(spark, str(tmp_path))
    lines = footers.file_columns(files).selectExpr("'t' AS table_name", "*")
    assert lines.count() == 117 and lines.rdd.getNumPartitions() == 2
    merged = {r.column_name: r for r in footers.merged_columns(lines).collect()}
    assert merged["a"].types == ["bigint", "int"] and merged["a"].data_type is None and merged["a"].conflict == "type"
    assert merged["b"].data_type == "string" and merged["b"].conflict == "missing" and merged["b"].files == 57
    (tmp_path / "bad.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="[Pp]arquet"):
        footers.file_columns(footers.list_files(spark, str(tmp_path))).count()
