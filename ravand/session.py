"""SparkSession factory and the few session-level helpers operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def create_session(app: str = "ravand", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; `conf` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; a temporary one of its own only for a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ravand-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables written and not yet removed, by path.
_written: dict[str, SparkSession] = {}


def materialize(df: DataFrame) -> DataFrame:
    """`df` written once as a table in the shared folder and read again.

    Cuts lineage without computing the input twice (a reliable checkpoint does) and survives the loss of
    executors. The table is removed by free(), or when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ravand-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    _written[path] = spark
    out = spark.read.parquet(path)
    out._ravand_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Remove tables of materialize() that no result reads any more."""
    for df in tables:
        _remove(df._ravand_path)


def release() -> None:
    """Remove every table that materialize() has written."""
    for path in list(_written):
        _remove(path)


def _remove(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may have ended already
        if path.startswith("file://"):
            shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


atexit.register(release)

#: Bytes that spread() moves at most, and for each core.
SPREAD_MOST, SPREAD_CORE = 1 << 30, 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as there are cores, where its input is small and in fewer files than that.

    For work that costs much more than moving its rows: a small file is one task. Larger inputs, of which Spark
    makes enough partitions itself, are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= min(SPREAD_MOST, cores * SPREAD_CORE) and len(df.inputFiles()) < cores else df
