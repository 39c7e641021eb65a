"""Tables that several readers share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_open: list[list[DataFrame]] = []
#: Rows of a kept table up to which a join sends it to all tasks.
FEW = 100_000


def kept(df: DataFrame) -> DataFrame:
    """``df`` derived once for several readers: a checkpoint in the shared folder, or where none is set the executors' storage, from
    which lost parts are derived again. ``released`` gives its room back; within ``releasing`` that happens at the end."""
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        out = df.checkpoint()
    else:
        out = df.persist()
    if _open:
        _open[-1].append(out)
    return out


def stored(df: DataFrame) -> DataFrame:
    """As ``kept``, for tables as long as the input: Parquet in the shared folder, a fraction of a checkpoint's size."""
    folder = df.sparkSession.sparkContext._jsc.sc().getCheckpointDir()
    if not folder.isDefined():
        return kept(df)
    path = f"{folder.get()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if _open:
        _open[-1].append(out)
    return out


def spread(table: DataFrame) -> DataFrame:
    """``table`` (kept) as the small side of a join: sent to all tasks if it is short, so that rows stay where they are and a long group
    isn't drawn into one task. A longer table, which has many groups, joins by its keys."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


def released(*tables: DataFrame) -> None:
    """Give back the room of tables that ``kept`` has made and that nothing reads any more."""
    for df in tables:
        if hasattr(df, "stored_at"):
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            continue
        plan = df._jdf.queryExecution().analyzed()
        folder = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
        if folder is not None and folder.isDefined():
            at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder.get())
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        df.unpersist()


@contextmanager
def releasing() -> Iterator[None]:
    """Tables kept within are released at the end; results that still depend on them must be written or collected by then."""
    _open.append([])
    try:
        yield
    finally:
        released(*_open.pop())
