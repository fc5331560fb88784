"""How a stored table lies on disk: the row groups of its Parquet files, with their statistics, read in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = "path string, row_group int, n_rows long, bytes long, least array<double>, most array<double>"
#: Row groups that a task gives on at once.
AT_ONCE = 1_000
#: Bytes of footers that go to Python at once, but for the last of them.
BATCH_BYTES = 8 << 20
#: Rows of a file, for tables with small row groups: a footer has statistics for each of them, and is read as one.
FILE_ROWS = 100_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's limit for batches to BATCH_BYTES, if it is higher."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, str(1 << 26)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def footer(content: Column) -> Column:
    """The end of a Parquet file: its footer, the footer's length in four bytes, the lowest first, and four more."""
    n = F.hex(F.substring(content, -8, 4))
    length = F.conv(F.concat(*[F.substring(n, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("int") + 8
    return F.substring(content, -length, length)


def row_groups(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """path, row_group, n_rows, bytes, and column_min and column_max of some columns of numbers or dates (days since 1970), null without statistics.

    Spark's readers do not give footers, so a task has one file at a time in memory, up to Spark's limit for a binary
    value of 2 GB: this is for looking at a table, not for reading it. Python gets the footers only, about one at a time,
    and gives on AT_ONCE row groups at once; files of a table with small row groups should have FILE_ROWS rows at most.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import datetime as dt

        import pyarrow.parquet as pq

        def number(v: object) -> float | None:
            return None if v is None or isinstance(v, (str, bytes)) else float((v - dt.date(1970, 1, 1)).days) if isinstance(v, dt.date) and not isinstance(v, dt.datetime) else float(v)

        schema = pa.schema([("path", pa.string()), ("row_group", pa.int32()), ("n_rows", pa.int64()), ("bytes", pa.int64()), ("least", pa.list_(pa.float64())), ("most", pa.list_(pa.float64()))])
        for batch in batches:
            for name, end in zip(batch.column("path"), batch.column("footer"), strict=True):
                meta = pq.read_metadata(pa.BufferReader(end.as_buffer()))
                where = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
                for first in range(0, meta.num_row_groups, AT_ONCE):
                    rows = []
                    for g in range(first, min(first + AT_ONCE, meta.num_row_groups)):
                        group = meta.row_group(g)
                        stats = [group.column(where[c]).statistics if c in where else None for c in columns]
                        low, high = ([number(getattr(s, a)) if s is not None and s.has_min_max else None for s in stats] for a in ("min", "max"))
                        rows.append({"path": name.as_py(), "row_group": g, "n_rows": group.num_rows, "bytes": group.total_byte_size, "least": low, "most": high})
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    small_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path", footer(F.col("content")).alias("footer"))
    out = files.mapInArrow(work, GROUP)
    ends = [F.get(side, F.lit(i)).alias(f"{c}_{end}") for i, c in enumerate(columns) for side, end in (("least", "min"), ("most", "max"))]
    return out.select("path", "row_group", "n_rows", "bytes", *ends)


def widths(groups: DataFrame, column: str, within: float) -> DataFrame:
    """One row: row groups, their rows, the share that spans at most `within` of a column, and the mean span."""
    span = F.col(f"{column}_max") - F.col(f"{column}_min")
    return groups.agg(F.count("*").alias("row_groups"), F.sum("n_rows").alias("n_rows"), (F.count_if(span <= within) / F.count("*")).alias("share"), F.avg(span).alias("mean_span"))


def overlaps(groups: DataFrame, column: str) -> DataFrame:
    """Row groups that begin before others, in order of a column, have ended: path, row_group. A table in that order has none but for equal ends."""
    from pyspark.sql import Window

    # a few numbers for each row group, of which there is one for 128 MB
    before = F.max(f"{column}_max").over(Window.orderBy(f"{column}_min", f"{column}_max").rowsBetween(Window.unboundedPreceding, -1))
    return groups.withColumn("__before", before).where(F.col(f"{column}_min") < F.col("__before")).select("path", "row_group")
