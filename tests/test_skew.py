"""Joins with a table of one line per key when one key, or none, holds a large share of all rows."""

import pytest

from kinweave.functions import skew


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_by_key(spark, rows, how):
    """A third of the rows under one key, a third without a key, the rest spread."""
    left = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN id % 500 END AS k", "CASE WHEN id % 5 > 0 THEN 'x' END AS j"
    )
    right = spark.range(250).selectExpr("id AS k", "'x' AS j", "id * 2 AS v").unionByName(
        spark.createDataFrame([(None, "x", 1), (300, None, 2)], "k bigint, j string, v bigint")
    )
    got = skew.join_by_key(left, right, ["k", "j"], how)
    plain = left.join(right, ["k", "j"], how)
    assert got.columns == plain.columns
    assert rows(got) == rows(plain)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_a_hot_key_is_split(spark, tmp_path, how):
    """Rows are read once, and the partition of the hot key is dealt to several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        path = str(tmp_path / "rows")
        spark.range(0, 200_000, numPartitions=16).selectExpr("id", "IF(id % 2 = 0, 0, id) AS k").write.parquet(path)
        left = spark.read.parquet(path)
        right = left.groupBy("k").count()
        joined = skew.join_by_key(left, right, ["k"], how)
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
        # Paths are shortened in plans; only the rows' own scan reads these two columns.
        assert plan.split("Initial Plan")[0].count("ReadSchema: struct<id:bigint,k:bigint>") == 1
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
