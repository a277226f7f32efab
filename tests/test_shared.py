import os

import pytest

from kinweave.sources import shared


def test_written_table_has_no_lineage_and_can_be_dropped(spark):
    table = shared.materialise(spark.range(5).selectExpr("id", "array(id) AS a"), "t")
    assert table.df.count() == 5 and "Range" not in table.df._jdf.queryExecution().toString()
    assert table.path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert os.path.isdir(table.path)
    table.drop()
    assert not os.path.exists(table.path)


def test_scratch_is_dropped_as_a_whole(spark):
    paths = [shared.materialise(spark.range(1), "t").path for _ in range(2)]
    shared.drop_scratch(spark)
    assert not any(os.path.exists(p) for p in paths)


def test_a_cluster_must_name_the_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
