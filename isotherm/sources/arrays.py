"""Grid arrays to rows and back. A file's values stand in order time, latitude, longitude; its axes stand apart from them.

A chunk is a row (file, variable, offset, values): BLOCK values at most from a place in that order on, so that no row
holds a whole file. With a column `at` a chunk is sparse: values stand at these places after its offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a chunk.
BLOCK = 1 << 16


def sliced(arrays: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows with a variable's whole array (variable, time[], lat[], lon[], values[]) as chunks that keep their axes: offset, values."""
    offsets = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.size("values") - 1, F.lit(0)).cast("long"), F.lit(block).cast("long")))
    cut = arrays.select("variable", "time", "lat", "lon", "values", offsets.alias("offset"))
    return cut.withColumn("values", F.slice("values", (F.col("offset") + 1).cast("int"), block))


def cells_of(chunks: DataFrame) -> DataFrame:
    """Chunks with their axes -> variable, time, latitude, longitude, value. Places become axis values inside a row, so that cells do not carry the axes."""
    sparse = "at" in chunks.columns
    ny, nx = F.size("lat").cast("long"), F.size("lon").cast("long")

    def cell(value, k):
        p = F.col("offset") + (F.get("at", k) if sparse else k)
        at = lambda axis, i: F.get(axis, i.cast("int"))
        return F.struct(at("time", F.floor(p / (ny * nx))).alias("time"), at("lat", F.floor(p % (ny * nx) / nx)).alias("latitude"), at("lon", p % nx).alias("longitude"), value.alias("value"))

    return chunks.select("variable", F.explode(F.transform("values", cell)).alias("c")).select("variable", "c.*")


def flatten(arrays: DataFrame, block: int = BLOCK) -> DataFrame:
    """(variable, time[], lat[], lon[], values[]) -> variable, time, latitude, longitude, value."""
    return cells_of(sliced(arrays, block))


def flatten_chunks(chunks: DataFrame, axes: DataFrame, file: str = "file") -> DataFrame:
    """Chunks (file, variable, offset, values, perhaps at) and axes (file, time[], lat[], lon[]) -> variable, time, latitude, longitude, value."""
    return cells_of(chunks.join(axes.select(file, "time", "lat", "lon"), file))


def to_chunks(cells: DataFrame, axes: DataFrame, names: list[str], file: str = "file", block: int = BLOCK) -> DataFrame:
    """Cells (file, time, latitude, longitude, and a column for each name), one row a cell, as sparse chunks: file, variable, offset, at, values.

    Places come from the axes by joins, and chunks are groups of at most `block` cells. Values that are null, and cells
    off the axes, are in no chunk.
    """
    placed = cells
    for axis, column in (("time", "time"), ("lat", "latitude"), ("lon", "longitude")):
        placed = placed.join(axes.select(file, F.posexplode(axis).alias(f"__{axis}", column)), [file, column])
    placed = placed.join(axes.select(file, F.size("lat").cast("long").alias("__ny"), F.size("lon").cast("long").alias("__nx")), file)
    place = (F.col("__time") * F.col("__ny") + F.col("__lat")) * F.col("__nx") + F.col("__lon")
    long = placed.withColumn("__p", place).unpivot([file, "__p"], names, "variable", "value").where("value is not null")
    offset = F.col("__p") - F.col("__p") % block
    out = long.groupBy(file, "variable", offset.alias("offset")).agg(F.sort_array(F.collect_list(F.struct((F.col("__p") % block).cast("int").alias("at"), "value"))).alias("c"))
    return out.select(file, "variable", "offset", F.col("c.at").alias("at"), F.col("c.value").alias("values"))


def to_wide(rows: DataFrame, names: list[str]) -> DataFrame:
    """One column for each named variable."""
    return rows.groupBy("time", "latitude", "longitude").pivot("variable", names).agg(F.first("value", ignorenulls=True))


def to_long(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The other way: keys, variable, value."""
    return df.unpivot(keys, names, "variable", "value")
