"""Tables written to the cluster's shared folder, to cut lineage and to read an intermediate result more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in local tests.
LOCAL_ROOT = "file:///tmp/checkpoints"

#: Spark's setting by which a query's shuffle files are deleted at its end; what is staged is read from the shared folder only.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, LOCAL_ROOT if driver and executors are one process, else the warehouse."""
    alone = spark.sparkContext.master.split("[")[0] == "local"
    return (spark.conf.get("spark.checkpoint.dir", None) or (LOCAL_ROOT if alone else spark.conf.get("spark.sql.warehouse.dir"))).rstrip("/")


def stage(frame: DataFrame, label: str, clean: bool = False) -> DataFrame:
    """Writes `frame` once, as Parquet in the shared folder, and returns a reader of it.

    Every executor sees the files, so a lost executor costs only the tasks that it was running. The folder's name is new
    each time. `discard` deletes it. With `clean` the shuffles of the write are deleted when it has ended.
    """
    path = f"{shared_root(frame.sparkSession)}/{label}-{uuid.uuid4().hex}"
    conf = frame.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true" if clean else before)
    try:
        frame.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = frame.sparkSession.read.schema(frame.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what `stage` wrote for these frames, through Spark's file system layer."""
    for frame in frames:
        path = getattr(frame, "_staged_at", None)
        if path:
            spark = frame.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table that may be broadcast, as the length of its rows in JSON.
SMALL_BYTES = 64 << 20


def small(frame: DataFrame, bound: int) -> DataFrame:
    """A staged `frame`, marked for broadcast if it has at most `bound` rows and SMALL_BYTES bytes; else as it is, for a shuffled join."""
    rows = frame.limit(bound + 1).select(F.octet_length(F.to_json(F.struct(F.struct(*frame.columns)))).alias("bytes"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    if n > bound or size > SMALL_BYTES:
        return frame
    out = F.broadcast(frame)
    out._staged_at = getattr(frame, "_staged_at", None)
    return out
