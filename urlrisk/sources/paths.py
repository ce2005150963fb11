"""Path helpers on the session's file system (works for any Hadoop path)."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Files directly below `path`, by name."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isFile())


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(p) if s.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def create_new(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already. One of several callers at the
    same time succeeds."""
    fs, p = _fs(spark, path)
    if fs.getUri().getScheme() == "file":  # Hadoop looks first and creates then, Java does both at once
        file = spark._jvm.java.io.File(fs.makeQualified(p).toUri().getPath())
        file.getParentFile().mkdirs()
        return file.createNewFile()
    try:
        fs.create(p, False).close()
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName() or fs.exists(p):
            return False
        raise


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the cluster names it; where it names none,
    a folder in the warehouse, which driver and executors share as well."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def stored(df, name: str):
    """`df` written below the shared folder and read back: lineage ends there, so
    later jobs neither recompute it nor depend on any executor."""
    import uuid

    spark = df.sparkSession
    root = shared_dir(spark)
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
