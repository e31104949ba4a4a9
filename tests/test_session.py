"""The shared folder, settled tables and prepared ones."""

import pytest
from pyspark.sql import functions as F

from speechprep import session
from speechprep.operators.once import once
from speechprep.sources.tables import load_table, sample_rate


class Stub:
    """A session without ``spark.checkpoint.dir``."""

    def __init__(self, master):
        self.master, self.folder = master, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError):
        session.shared_dir(Stub("yarn"))
    local = Stub("local[2]")
    assert session.shared_dir(local) == local.folder == session.shared_dir(local)


def test_configured_folder_is_used(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        assert session.new_table_path(spark, "x").startswith(folder.rstrip("/"))
    assert session.new_table_path(spark, "x") != session.new_table_path(spark, "x")


def test_settled_table_is_broadcast_only_when_small(spark):
    keys = session.settled(spark.range(50).selectExpr("id as k", "id * 2 as v"), "keys")
    joined = lambda: spark.range(100).withColumnRenamed("id", "k").join(keys, "k")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(joined())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10")
    try:
        assert "SortMergeJoin" in plan(joined()) and joined().count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_once_keeps_an_expression_in_one_place(spark):
    df = once(spark.range(5), c=F.sequence(F.lit(0), F.col("id")))
    plan = df.filter(F.size("c") > 2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sequence(") == 1
    assert df.filter(F.size("c") > 2).count() == 3


def test_split_and_own_sample_rate(spark, tmp_path):
    rows = [("train", ([0.5], 8000)), ("test", ([0.1], None))]
    schema = "split string, audio struct<array: array<float>, sampling_rate: int>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "t"))
    whole = load_table(spark, str(tmp_path / "t"))
    assert load_table(spark, str(tmp_path / "t"), split="train").count() == 1
    rates = {r[0] for r in whole.select(sample_rate(whole)).collect()}
    assert rates == {8000, 24000}
    assert whole.select(sample_rate(whole.drop("audio"))).first()[0] == 24000
