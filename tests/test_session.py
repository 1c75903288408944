import os

import pytest

from ravand import session


class Remote:
    """A session on a cluster without a shared folder."""

    class conf:
        get = staticmethod(lambda key, default: default)

    class sparkContext:
        master = "spark://host:7077"


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Remote)


def test_tables_are_freed(spark):
    table = session.materialize(spark.range(10))
    folder = table._ravand_path.removeprefix("file:").replace("///", "/")
    assert table.count() == 10 and os.path.isdir(folder)
    session.free(table)
    assert not os.path.isdir(folder)


def test_only_small_inputs_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    df = spark.read.parquet(str(tmp_path / "one"))
    assert session.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.range(100).repartition(9).write.parquet(str(tmp_path / "nine"))
    df = spark.read.parquet(str(tmp_path / "nine"))
    assert session.spread(df) is df
