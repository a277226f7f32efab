"""Commits of the tag table: concurrent writers, crashes, older versions, compaction."""

import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from kinweave.sources.tag_table import Conflict, TagTable

SCHEMA = "database_name string, schema_name string, table_name string, column_name string, semantic_type string"


def at():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


@pytest.fixture
def table(spark, tmp_path):
    return TagTable(spark, str(tmp_path / "tags"))


@pytest.fixture
def batch(spark):
    return lambda *lines: spark.createDataFrame([("d", "s", *line.split()) for line in lines], SCHEMA)


def held(df):
    return sorted(f"{r.table_name} {r.column_name} {r.semantic_type}" for r in df.collect())


def test_versions(table, batch, spark):
    assert table.version() == 0 and held(table.read()) == []
    assert table.commit(batch("t a email", "t b phone", "u a email"), at()) == 1
    assert table.commit(batch("t c surname"), at()) == 2
    assert held(table.read()) == ["t c surname", "u a email"]
    assert held(table.read(1)) == ["t a email", "t b phone", "u a email"]
    assert table.commit(batch(), at()) == 2 and table.version() == 2
    # A table named without a complete tag loses its tags.
    lacking = spark.createDataFrame([("d", "s", "u", None, "email"), (None, "s", "t", "c", "email")], SCHEMA)
    assert table.commit(lacking, at()) == 3 and held(table.read()) == ["t c surname"]
    with pytest.raises(ValueError, match="no version 9"):
        table.read(9)


def test_writers_of_different_tables_both_stay(table, batch):
    table.commit(batch("t a email"), at())
    base = table.version()
    assert table.commit(batch("u a phone"), at(), since=base) == 2
    assert table.commit(batch("v a phone"), at(), since=base) == 3
    with pytest.raises(Conflict, match="d.s.u"):
        table.commit(batch("u b email", "w a email"), at(), since=base)
    assert held(table.read()) == ["t a email", "u a phone", "v a phone"]
    assert table.commit(batch("u b email"), at()) == 4


def test_a_race_loses_nothing(table, batch):
    batches = [batch(f"t{i} a email") for i in range(6)]
    with ThreadPoolExecutor(6) as pool:
        versions = list(pool.map(lambda b: table.commit(b, at(), since=0), batches))
    assert sorted(versions) == [1, 2, 3, 4, 5, 6]
    assert held(table.read()) == [f"t{i} a email" for i in range(6)]


def test_a_crash_before_the_rename_shows_the_old_state(table, batch, tmp_path):
    table.commit(batch("t a email"), at())
    folder = next((tmp_path / "tags" / "data").iterdir())
    shutil.copytree(folder, folder.with_name(uuid.uuid4().hex))
    (tmp_path / "tags" / "log" / ".x.tmp").write_text("half")
    assert table.version() == 1 and held(table.read()) == ["t a email"]
    assert not table._claim(1, folder.name, whole=False)


def test_compaction(table, batch):
    assert table.compact() == 0
    for i in range(3):
        table.commit(batch(f"t{i} a email", f"x c{i} phone"), at())
    assert table.compact() == 4 and len(table.entries()) == 1 and table.compact() == 4
    expected = ["t0 a email", "t1 a email", "t2 a email", "x c2 phone"]
    assert held(table.read()) == expected and held(table.read(2)) == ["t0 a email", "t1 a email", "x c1 phone"]
    # A writer that began before is no conflict of the compaction.
    assert table.commit(batch("y a email"), at(), since=3) == 5
    assert held(table.read()) == [*expected, "y a email"]
    with pytest.raises(Conflict, match="d.s.t2"):
        table.commit(batch("t2 b email"), at(), since=1)
