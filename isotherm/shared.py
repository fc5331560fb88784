"""The cluster's shared folder, and tables written there between the jobs of one computation."""

from __future__ import annotations

import itertools
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables that have been written: a number that grows, the thread that asked for them, and the path.
_made: list[tuple[int, int, str]] = []
_numbers, _lock = itertools.count(1), threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, local mode has a folder of its own; a cluster has to set it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="isotherm-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to; clear() deletes what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _lock:
        _made.append((next(_numbers), threading.get_ident(), path))
    return path


def materialize(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write a table to the shared folder and read it back: the plan behind it is cut, and lost executors lose nothing. options: the writer's."""
    path = new_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A number that all tables written from now on are above: clear(since=...) then deletes later ones only."""
    with _lock:
        return max((t[0] for t in _made), default=0)


def clear(spark: SparkSession, since: int | None = None, keep: int = 0) -> int:
    """Delete the tables that this thread has written since a mark, but for the last `keep` of them, once nothing that reads them is needed any more. How many there were.

    What other threads have written stays, say that of another query or of a stream's batch; without a mark all go.
    """
    with _lock:
        own = [t for t in _made if since is None or t[0] > since and t[1] == threading.get_ident()]
        gone = own[: len(own) - keep]
        for t in gone:
            _made.remove(t)
    jvm, conf, n = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
    for _, _, name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n
