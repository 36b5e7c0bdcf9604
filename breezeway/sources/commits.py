"""Folders that count only once they are complete.

A version of a table is a folder ``root/<kind>=<n>``. It is written, then marked by an
empty file; readers look at marked folders only, so an interrupted write is never seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MARK = "_COMMITTED"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(spark: SparkSession, path: str) -> None:
    """Mark a folder as complete."""
    mark, fs = _fs(spark, f"{path}/{MARK}")
    fs.create(mark, True).close()


def versions(spark: SparkSession, root: str, kind: str) -> list[int]:
    """Numbers of the complete versions below ``root``, ascending."""
    path, fs = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
    return [n for n in numbers if fs.exists(_fs(spark, f"{root}/{kind}={n}/{MARK}")[0])]


def drop_versions(spark: SparkSession, root: str, kind: str, below: int) -> None:
    """Remove complete versions older than ``below``."""
    for n in versions(spark, root, kind):
        if n < below:
            path, fs = _fs(spark, f"{root}/{kind}={n}")
            fs.delete(path, True)


def write_version(df: DataFrame, root: str, kind: str, n: int) -> None:
    """Write and commit version ``n``; what an interrupted write left there goes."""
    path = f"{root}/{kind}={n}"
    df.write.mode("overwrite").parquet(path)
    commit(df.sparkSession, path)


def read_version(spark: SparkSession, root: str, kind: str, schema: T.StructType, n: int | None = None) -> DataFrame:
    """Version ``n``, or the newest; empty if there is none."""
    known = versions(spark, root, kind)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{kind}={known[-1] if n is None else n}")
