"""Session settings the jobs rely on, and staging of reused results."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Local clocks are TIMESTAMP_NTZ; zone rules are evaluated against UTC.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra) -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("loomgrid")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SESSION_CONF, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="loomgrid-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by the cluster.

    One of the local machine serves only where the setting is absent and the whole
    session runs on that machine, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    return _local_dir()


def stage_dir(spark: SparkSession) -> str:
    """Folder of the application's staged tables, removed when its JVM ends."""
    path = f"{shared_dir(spark)}/loomgrid/{spark.sparkContext.applicationId}"
    _remove_at_exit(spark, path)
    return path


def _folder(spark: SparkSession, path: str):
    """A folder and the file system that holds it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@functools.cache
def _remove_at_exit(spark: SparkSession, path: str) -> None:
    # the file system does it, since a job stops its session before Python ends
    folder, system = _folder(spark, path)
    system.mkdirs(folder)
    system.deleteOnExit(folder)


def drop_stages(spark: SparkSession) -> None:
    """Remove every staged table of the application, once no result needs them any more."""
    folder, system = _folder(spark, stage_dir(spark))
    system.delete(folder, True)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Have long texts come to Python in batches of about ``size``, unless the session says otherwise.

    Without it a batch has as many rows as fit its number, however long they are.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, size)


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """Within it, an action's shuffle files go as soon as it ends."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


#: Without them, a hundred rows are written before the size of a page and a row group is looked at, and
#: a row group is what a reader holds at once at most.
LONG_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def stage(
    df: DataFrame, label: str = "stage", folder: str | None = None, long_rows: bool = False
) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, or in ``folder``, and read it back.

    Cuts the lineage where one result feeds several later jobs. The written
    table survives executor loss and later reads prune columns, which an RDD
    checkpoint of the wide sample rows could not. What it shuffled is freed at once, since
    nothing reads that again. It stays until ``drop_stages`` or the end of the application, since
    later jobs may still read it; tables in a folder of the caller's stay there. ``long_rows`` says that
    a row may take megabytes, so that few of them are held at once by who writes or reads them.
    """
    spark = df.sparkSession
    path = f"{folder or stage_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with freeing_shuffles(spark):
        df.write.options(**(LONG_ROWS if long_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
