"""Writers of one table: a day belongs to one of them at a time; files that cannot be read are set aside."""

from __future__ import annotations

import contextlib
import logging
import threading
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

#: Seconds after which a claim that nobody has given up or renewed may be taken, those between two tries, and for which a writer waits at most.
LEASE, PAUSE, PATIENCE = 3600.0, 0.2, 7200.0
_making = threading.Lock()  # a local file system does not make files exclusively by itself; shared ones do


class Conflict(RuntimeError):
    """A day was taken by another writer."""


class Claim:
    """A writer's files in the folder _claims of a table, one for each day, which scans do not see."""

    def __init__(self, spark: SparkSession, table: str, names: list[str], lease: float = LEASE):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.folder, self.names, self.lease, self.token = f"{table.rstrip('/')}/_claims", sorted(names), lease, uuid.uuid4().hex
        self.held: list[str] = []
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.folder, name)

    def owner(self, name: str) -> tuple[str, float] | None:
        """Who has a day, and until when."""
        from py4j.protocol import Py4JJavaError

        try:
            stream = self.fs.open(self.path(name))
            try:
                said = bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
            token, until = said.split()
            return token, float(until)
        except Py4JJavaError:
            return None
        except ValueError:  # it is just being written
            return "", time.time() + 1

    def take(self, name: str) -> bool:
        from py4j.protocol import Py4JJavaError

        with _making:
            now = self.owner(name)
            if now is not None and now[1] < time.time() and self.owner(name) == now:
                log.warning("the claim on %s ran out and is taken", name)
                self.fs.delete(self.path(name), False)
                now = None
            if now is not None:
                return False
            try:
                stream = self.fs.create(self.path(name), False)
            except Py4JJavaError:
                return False
            stream.write(f"{self.token} {time.time() + self.lease}".encode())
            stream.close()
        self.held.append(name)
        return True

    def check(self) -> None:
        """Before anything is replaced: every day is still this writer's."""
        if lost := [n for n in self.names if (self.owner(n) or ("",))[0] != self.token]:
            raise Conflict(f"taken by another writer: {', '.join(lost)}")

    def release(self) -> None:
        for name in self.held:
            if (self.owner(name) or ("",))[0] == self.token:
                self.fs.delete(self.path(name), False)
        self.held = []


@contextlib.contextmanager
def claimed(spark: SparkSession, table: str, days: list, lease: float = LEASE, patience: float = PATIENCE) -> Iterator[Claim]:
    """Hold some days of a table. Days are taken in order, so that two writers never wait for each other in a circle."""
    claim = Claim(spark, table, [str(d) for d in days], lease)
    end = time.monotonic() + patience
    try:
        for name in claim.names:
            while not claim.take(name):
                if time.monotonic() > end:
                    raise Conflict(f"{name} has been taken for {patience:g} seconds")
                time.sleep(PAUSE)
        yield claim
    finally:
        claim.release()


# --- unreadable files -----------------------------------------------------------------------------------------


def files_of(spark: SparkSession, table: str, days: list, by: str = "date") -> list[tuple]:
    """(path, bytes, modified) of a table's files in some partitions, whatever they hold, if anything."""
    import datetime as dt

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for day in days:  # a batch has few
        folder = jvm.org.apache.hadoop.fs.Path(table, f"{by}={'__HIVE_DEFAULT_PARTITION__' if day is None else day}")
        fs = folder.getFileSystem(conf)
        if fs.exists(folder):
            files = [f for f in fs.listStatus(folder) if f.isFile() and f.getPath().getName().endswith(".parquet")]
            out += [(f.getPath().toString(), f.getLen(), dt.datetime.fromtimestamp(f.getModificationTime() / 1000)) for f in files]
    return out


def unreadable(spark: SparkSession, files: list[tuple]) -> list[tuple]:
    """Of files (path, ...) those whose footer cannot be read. Tasks read the footers; where they find nothing, the file is looked at once more by itself."""
    from urllib.parse import unquote

    from pyspark.errors import AnalysisException

    name = lambda p: unquote("/".join(p.split("/")[-2:]))  # noqa: E731  folder and file: how a path begins depends on who writes it down
    paths = [f[0] for f in files if f[1]]
    seen: set = set()
    if paths:
        rows = spark.read.option("ignoreCorruptFiles", True).schema("__none int").parquet(*paths)
        seen = {name(r[0]) for r in rows.groupBy("_metadata.file_path").count().collect()}
    out = []
    for f in files:
        if f[1] and name(f[0]) in seen:
            continue
        try:
            _ = spark.read.option("ignoreCorruptFiles", True).parquet(f[0]).schema
        except AnalysisException:  # no schema, as there is no footer
            out.append(f)
    return out


def set_aside(spark: SparkSession, table: str, days: list, by: str = "date") -> list[str]:
    """Move files of some partitions that cannot be read to the folder _unreadable of the table, which scans do not see, with a row each in its list. Their paths."""
    bad = unreadable(spark, files_of(spark, table, days, by))
    if not bad:
        return []
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = f"{table.rstrip('/')}/_unreadable"
    rows = []
    for r in bad:  # as many as writers were killed
        source, to = jvm.org.apache.hadoop.fs.Path(r[0]), f"{folder}/files/{uuid.uuid4().hex}"
        fs = source.getFileSystem(conf)
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{folder}/files"))
        fs.rename(source, jvm.org.apache.hadoop.fs.Path(to))
        log.warning("%s cannot be read and was moved to %s", r[0], to)
        rows.append((*r, to))
    spark.createDataFrame(rows, "path string, bytes long, modified timestamp, moved string").coalesce(1).write.mode("append").json(f"{folder}/list")
    return [r[0] for r in rows]


def set_aside_list(spark: SparkSession, table: str) -> DataFrame:
    """path, bytes, modified and moved of the files that have been set aside."""
    return spark.read.schema("path string, bytes long, modified timestamp, moved string").json(f"{table.rstrip('/')}/_unreadable/list")
