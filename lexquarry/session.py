"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings a session of this library should have. Only those that change results are
#: set by :func:`prepare`; the sizing ones are left to the cluster.
RESULT_SETTINGS = {"spark.sql.session.timeZone": "UTC"}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and for the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexquarry")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where a session on one machine names none, as in tests, a temporary one is made and recorded in the
    session, so that later calls find it; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lexquarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder[len("file://") :], ignore_errors=True)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/lexquarry/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; the folder is scratch space
        pass


_SETTLED: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete all tables settled so far. To be called when no result of theirs is needed any more."""
    while _SETTLED:
        _remove(spark, _SETTLED.pop())


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    This cuts the lineage with data that outlive any executor, lets several branches reuse
    one computation, and gives the planner true sizes. The files go with :func:`release`, or when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if not _SETTLED:
        atexit.register(release, spark)
    _SETTLED.append(path)
    return spark.read.schema(df.schema).parquet(path)
