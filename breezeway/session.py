"""Session and shared-folder helpers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a Python worker gets at once.
BATCH_BYTES = 4 << 20


def local_session(cores: str = "8", app: str = "breezeway", folder: str = "/tmp/breezeway-shared") -> SparkSession:
    """A local session for tests and the bench, which names ``folder`` as shared; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", folder)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors of a session that doesn't have it installed.

    An archive of it is copied to the shared folder, from where late executors get it too.
    """
    package = Path(__file__).resolve().parent
    path = spark._jvm.org.apache.hadoop.fs.Path
    target = path(scratch_path(spark, "code") + f"/{package.name}.zip")
    with tempfile.TemporaryDirectory() as folder:
        archive = shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(path(archive), target)
    spark.sparkContext.addPyFile(target.toString())


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names for checkpoints, which all executors must share.

    A session without one takes a folder inside its warehouse, which is shared as well;
    it is removed when the application ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    folder = f"{warehouse}/scratch-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when its write ends, where the Spark version can do so.

    Else they stay until the driver collects its garbage, and a later step's files come on top.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and freezes values
    that depend on how rows were partitioned. The write's own shuffle files go with its end.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with shuffles_go(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing reads any more; other frames are left alone.

    Whatever was derived from them must have been written itself.
    """
    for table in tables:
        path = getattr(table, "_scratch", None)
        if path:
            folder = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def release_shuffles(spark: SparkSession) -> None:
    """Have the driver collect its garbage, on which Spark removes the shuffle files of jobs that have ended.

    They stay on disk until then, and a driver with much memory may not collect for a long time.
    """
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Rows go to the session's Python workers in batches of BATCH_BYTES from now on, unless it has a limit of its own.

    Spark's default is 10,000 rows or 64 MB; of texts those are tens of MB, which each task then holds
    several times, in the JVM and in its worker. A batch has one row at least, however long.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, BATCH_BYTES)


def plan_name(df: DataFrame) -> tuple:
    """Equal for frames of the same optimized plan over the same files.

    Files that were added or written anew have other names, and so give another name here.
    A frame that shows no plan (a remote session's) is equal to itself only.
    """
    if not hasattr(df, "_jdf"):
        return (id(df),)
    plan = df._jdf.queryExecution().optimizedPlan()
    files = df.sparkSession._jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(df._jdf.inputFiles()).hashCode()
    return plan.semanticHash(), plan.canonicalized().treeString(), files, str(plan.stats().sizeInBytes())
