"""Scans and sinks: partitioned Parquet, dimensions, registered views, exports, statistics of what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isotherm.model import DATASETS, view_name


def scan(spark: SparkSession, path: str, union_by_name: bool = False, skip_corrupt: bool = False) -> DataFrame:
    """A Hive-partitioned table. union_by_name: files whose columns differ; a missing one is null."""
    reader = spark.read.option("mergeSchema", union_by_name).option("ignoreCorruptFiles", skip_corrupt)
    return reader.parquet(path)


def scan_if_there(spark: SparkSession, path: str, **options) -> DataFrame | None:
    """scan(), or None where nothing is stored."""
    from pyspark.errors import AnalysisException

    try:
        return scan(spark, path, **options)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def create_view(spark: SparkSession, path: str, name: str, union_by_name: bool = False) -> DataFrame:
    return as_view(scan(spark, path, union_by_name), name)


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(view_name(name))
    return df


def register_all(spark: SparkSession, data_dir: str) -> list[str]:
    """A view for every dataset that has data; the others are left out. Stations' files are united by name."""
    stored = {d.view: scan_if_there(spark, f"{data_dir}/{d.name}", union_by_name=not d.gridded) for d in DATASETS.values()}
    return [as_view(df, v) and v for v, df in stored.items() if df is not None]


def write_partitioned(df: DataFrame, path: str, by: tuple[str, ...] = ("date",), compression: str = "zstd", row_group_bytes: int = 128 << 20, mode: str = "append") -> None:
    """Parquet partitioned by the columns that df has of `by`; without any of them one unpartitioned table."""
    writer = df.write.mode(mode).option("compression", compression).option("parquet.block.size", row_group_bytes)
    present = [c for c in by if c in df.columns]
    (writer.partitionBy(*present) if present else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: tuple[str, ...] = ("date",), **options) -> None:
    """Overwrite the partitions that df has rows of; others stay. Doing it again changes nothing."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    for k, v in ({"compression": "zstd"} | options).items():
        writer = writer.option(k, v)
    writer.partitionBy(*by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_dimension(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header, typed."""
    return spark.read.schema(schema).option("header", True).csv(path)


def dimension_to_parquet(spark: SparkSession, csv: str, schema: T.StructType | str, out: str) -> None:
    export_parquet(read_dimension(spark, csv, schema), out)


def storage_stats(df: DataFrame, by: str = "date") -> DataFrame:
    """Files and bytes of each partition of a scanned table."""
    files = df.select(F.col(by), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).distinct()
    return files.groupBy(by).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def storage_totals(stats: DataFrame, by: str = "date") -> DataFrame:
    return stats.agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.count("*").alias("partitions"), F.max("files").alias("most_files"), F.min(by).alias("first"), F.max(by).alias("last"))


def purge_years(spark: SparkSession, path: str, years: list[int], year: str = "year") -> int:
    """Delete the partitions of some years from a table whose last partition column is the year; how many rows went."""
    df = scan(spark, path, union_by_name=True)
    gone = df.where(F.col(year).isin(years))
    folders = [r[0] for r in gone.select(F.regexp_replace("_metadata.file_path", "/[^/]*$", "")).distinct().collect()]  # folders of some years: a few for each station
    n = gone.count()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    if wrong := [f for f in folders if f"/{year}=" not in f[f.rfind("/") :]]:
        raise ValueError(f"the last partition column of {wrong[0]} is not {year}")
    for f in folders:
        folder = jvm.org.apache.hadoop.fs.Path(f)
        folder.getFileSystem(conf).delete(folder, True)
    return n


def without_years(df: DataFrame, years: list[int], year: str = "year") -> DataFrame:
    """What stays when some years are ingested anew."""
    return df.where(~F.col(year).isin(years))


def grid_nodes(df: DataFrame, decimals: int) -> DataFrame:
    """All combinations of the latitudes and longitudes that occur: as many of each as a grid has lines."""
    lats, lons = (df.select(F.round(F.col(c).cast("double"), decimals).alias(c)).distinct() for c in ("latitude", "longitude"))
    axis = lons.agg(F.sort_array(F.collect_set("longitude")).alias("axis"))  # at most 3,600 values on a 0.1 degree grid
    return lats.join(F.broadcast(axis)).select("latitude", F.explode("axis").alias("longitude"))
