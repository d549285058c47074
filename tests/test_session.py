import glob

import pytest

from lexmill import session


class Conf:
    def __init__(self, **values):
        self.values = values

    def get(self, name, default=None):
        return self.values.get(name, default)


class Fake:
    """A session on a cluster, as far as shared_dir looks at it."""

    def __init__(self, master, **values):
        self.conf = Conf(**values)
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return Conf()


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"])
def test_a_cluster_without_a_shared_folder_is_an_error(master):
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Fake(master))
    assert session.shared_dir(Fake(master, **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_tables_are_deleted_on_release(spark):
    since = session.written()
    a = session.materialise(spark.range(3), "a")
    b = session.bucketed(spark.range(100), "id", 3, "b")
    c = session.materialise(a, "c")
    assert (a.count(), b.count()) == (3, 100)
    session.release(spark, since, keep=1)
    assert c.count() == 3
    folder = session.shared_dir(spark).removeprefix("file://")
    assert not glob.glob(f"{folder}/lexmill-a-*") and not glob.glob(f"{folder}/lexmill-b-*") and glob.glob(f"{folder}/lexmill-c-*")
    session.release(spark, since)
    assert not glob.glob(f"{folder}/lexmill-c-*")


def test_buckets_spare_the_shuffle(spark):
    a, b = (session.bucketed(spark.range(1000).selectExpr("id % 50 AS k", f"id AS {c}"), "k", 3, c) for c in "xy")
    plan = a.join(b.hint("shuffle_hash"), "k").groupBy("k", "x").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
