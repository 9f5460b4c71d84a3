from __future__ import annotations

import pytest

from spreadrank import storage
from spreadrank.storage import publish


class Context:
    def __init__(self, master, folder=None):
        self.master, self.folder = master, folder

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


class Session:
    def __init__(self, master, named=None, folder=None):
        self.sparkContext = Context(master, folder)
        self.conf = {} if named is None else {"spark.checkpoint.dir": named}


def test_folder_is_the_one_the_session_names():
    session = Session("yarn", "hdfs://shared/")
    assert storage.work_dir(session) == "hdfs://shared"
    assert session.sparkContext.folder == "hdfs://shared/"


def test_folder_set_on_the_context_is_kept():
    assert storage.work_dir(Session("yarn", folder="hdfs://other/x")) == "hdfs://other/x"


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,512]"])
def test_cluster_without_a_folder_is_refused(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.work_dir(Session(master))


def test_a_local_session_gets_a_folder():
    session = Session("local[4]")
    assert storage.work_dir(session) == session.sparkContext.folder


def test_checkpointed_groups_are_not_shuffled_again(spark):
    fixed = storage.fixed_plans(spark)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    table = fixed.range(1000).selectExpr("id % 7 as a", "id % 11 as b", "id as v")
    grouped = storage.checkpoint_grouped(table, 3, ["a", "b"], ["a", "b"], "v")
    other = spark.range(70).selectExpr("id % 7 as a", "id % 11 as b")
    joined = other.hint("merge").join(grouped, ["a", "b"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert joined.count() == 70
    grouped.unpersist()


def test_a_run_leaves_nothing_behind(spark):
    import os

    with storage.scratch(spark) as folder:
        storage.materialize(spark.range(3), "a")
        assert any(name.startswith("a-") for name in os.listdir(folder.removeprefix("file://")))
    assert not os.path.exists(folder.removeprefix("file://"))
    assert "run-" not in storage.new_folder(spark, "b").rsplit("/", 2)[1]


def test_a_write_that_stops_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "table")
    publish(spark, path, lambda to: spark.range(5).write.parquet(to))

    def half(to):
        spark.range(9).write.parquet(to)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        publish(spark, path, half)
    assert spark.read.parquet(path).count() == 5
    # Stopped between the two renames: the old table is put back first.
    (tmp_path / "table").rename(tmp_path / "_table.old")
    with pytest.raises(RuntimeError):
        publish(spark, path, half)
    assert spark.read.parquet(path).count() == 5
    publish(spark, path, lambda to: spark.range(7).write.parquet(to))
    assert spark.read.parquet(path).count() == 7
    assert [p.name for p in tmp_path.iterdir()] == ["table"]
