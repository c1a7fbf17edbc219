"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest

from raterkit.session import even_tasks, materialize, scratch_dir, scratch_path


def fake(master, folder=None, context_folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context_folder, setCheckpointDir=lambda f: None)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_cluster_folder_is_used():
    assert scratch_dir(fake("yarn", "hdfs://shared/x")) == "hdfs://shared/x"
    assert scratch_dir(fake("yarn", None, "hdfs://shared/y")) == "hdfs://shared/y"


def test_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(fake("yarn"))


def test_local_session_gets_a_temporary_folder():
    assert "raterkit-" in scratch_dir(fake("local[2]"))


def test_paths_do_not_repeat():
    spark = fake("yarn", "hdfs://shared/")
    one, two = scratch_path(spark, "t"), scratch_path(spark, "t")
    assert one.startswith("hdfs://shared/raterkit/t-") and one != two


def test_written_tables_keep_their_schema(spark):
    df = spark.range(3).selectExpr("id", "cast(null as string) as t", "array(1.0F) as v")
    back = materialize(df, "t")
    assert back.dtypes == df.dtypes and back.count() == 3
    assert materialize(df.limit(0), "t").dtypes == df.dtypes


def test_even_tasks_leave_no_core_idle(spark):
    """One task more than the cores takes as long as twice as many."""
    cores, before = spark.sparkContext.defaultParallelism, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for slots, rows, turns in ((4 * cores, 10 * cores + 1, 2), (2 * cores + 1, 100 * cores, 2), (2, 100 * cores, 1), (4 * cores, 0, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", slots)
            assert even_tasks(spark.range(rows), 10) == turns * cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
