"""Folders that the driver and all executors share, and files in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, a local session gets a folder of its own; on a cluster,
    whose executors could not read it, that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read again: cuts lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` has made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def filesystem(uri: str):
    """The pyarrow file system of ``uri`` and the path in it; for use in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data) -> None:
    """Write ``data`` (bytes or an iterable of bytes) under a name of its own, then move it into place.

    A retried or doubled task attempt so never leaves a half-written file.
    """
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(own, compression=None) as out:
        for part in [data] if isinstance(data, (bytes, bytearray, memoryview)) else data:
            out.write(part)
    store.move(own, path)
