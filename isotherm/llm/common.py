"""What the operators share: batches of rows in tasks, sums of arrays over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotherm.shared import clear, mark, materialize, new_path  # noqa: F401  the operators take them from here

#: Bytes of a batch of rows that goes to a task's Python: several batches of texts are held at once on both sides.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> None:
    """Lower the session's limit for batches to BATCH_BYTES, if it is higher: rows of texts make large ones."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(name, str(1 << 26)).lower().removesuffix("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))


def per_batch(df: DataFrame, work: Callable[[pa.RecordBatch], dict | Iterator[dict]], schema: T.StructType | str) -> DataFrame:
    """Apply a function from an Arrow batch to columns (dicts of lists or arrays: one, or several by yielding) in each partition."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                for cols in [out] if isinstance(out, dict) else out:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if not isinstance(cols[f.name], pa.Array) else cols[f.name].cast(f.type) for f in to], schema=to)

    small_batches(df)
    return df.mapInArrow(run, schema)


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of texts; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def key_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, so that no other column's name can clash."""
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batches_of(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with a generator of columns (dicts of lists or arrays); work may keep state through the partition."""
    to = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = arrow_schema(to)
        for cols in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in shape], schema=shape)

    small_batches(df)
    return df.mapInArrow(run, to)


#: Arrays that partitions add up are cut in slabs of so many numbers, and summed up in trees with so many branches.
SLAB, BRANCHES = 1 << 14, 32


def slabs(array: np.ndarray) -> Iterator[dict]:
    """A partition's array as rows part, slab, data (float64 or int64 bytes), without slabs of zeros only."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for k in range(0, len(array), SLAB):
        if array[k : k + SLAB].any():
            yield {"part": [part], "slab": [k // SLAB], "data": [array[k : k + SLAB].tobytes()]}


def tree_sum(rows: DataFrame, size: int, dtype: type) -> np.ndarray:
    """The sum of all partitions' arrays of `size` numbers, from their rows part, slab, data, which should be materialized.

    Each level sums up to BRANCHES rows of a slab, always in the same order, until the driver gets one row for each
    slab: as much at every input size.
    """
    import pandas as pd

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out: np.ndarray | int = 0
        for data in pdf.sort_values("part")["data"]:
            out = out + np.frombuffer(data, dtype)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // BRANCHES], "slab": [int(pdf["slab"].iloc[0])], "data": [out.tobytes()]})

    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        rows = rows.groupBy("slab", F.expr(f"part div {BRANCHES}").alias("p")).applyInPandas(total, "part int, slab int, data binary")
        if parts <= BRANCHES:
            break
        parts = -(-parts // BRANCHES)
    out = np.zeros(size, dtype)
    for _, slab, data in rows.toLocalIterator():
        out[slab * SLAB : slab * SLAB + SLAB] = np.frombuffer(data, dtype)
    return out
