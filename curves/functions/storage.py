"""Tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors see. Only a local master gets one made here."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, whose files go when the application ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: short lineage, known size, safe from lost executors."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete what was stored at path; nothing may still be computed from it."""
    path, fs = _folder(spark, path)
    fs.delete(path, True)


def files(spark: SparkSession, folder: str) -> dict[str, int]:
    """Size of each file below a folder by its path in it, but for hidden ones and marks; empty if there is no such folder."""
    base, fs = _folder(spark, folder)
    if not fs.exists(base):
        return {}
    found, root = fs.listFiles(base, True), fs.resolvePath(base).toString().rstrip("/") + "/"
    out = {}
    while found.hasNext():
        entry = found.next()
        path = entry.getPath().toString().removeprefix(root)
        if not path.rsplit("/", 1)[-1].startswith(("_", ".")):
            out[path] = entry.getLen()
    return out


def taken(spark: SparkSession, folder: str) -> bool:
    """Whether there is anything in a folder."""
    base, fs = _folder(spark, folder)
    return bool(fs.exists(base) and len(fs.listStatus(base)))


def publish(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file that is there as a whole or not at all: it gets its name when it is complete."""
    final, fs = _folder(spark, path)
    hidden = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}.{uuid4().hex}")
    stream = fs.create(hidden, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(hidden, final):
        raise OSError(f"could not rename {hidden.toString()} to {path}")
