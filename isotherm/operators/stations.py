"""The stations' index by year, their latest metadata, and how complete each year is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.model import STATION_META, STATION_RESERVED, variables
from isotherm.sources.tables import scan, scan_if_there


def station_years(df: DataFrame, names: list[str], year: str = "year") -> DataFrame:
    """station_id, year, rows, first and last date, and the variables that have a value at all."""
    counts = [F.count(c).alias(f"__{c}") for c in names]
    out = df.groupBy("station_id", year).agg(F.count("*").alias("n_rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), *counts)
    present = F.filter(F.array(*[F.when(F.col(f"__{c}") > 0, F.lit(c)) for c in names]), lambda x: x.isNotNull())
    return out.withColumn("vars", present).drop(*[f"__{c}" for c in names])


def latest_metadata(df: DataFrame, columns: list[str], year: str = "year") -> DataFrame:
    """Each station's metadata of its most recent year."""
    return df.groupBy("station_id").agg(F.max_by(F.struct(*columns), F.struct(year, *columns)).alias("m")).select("station_id", "m.*")


def station_list(stations: DataFrame, years: DataFrame) -> DataFrame:
    """Stations, also those without years, with their span and the most variables that a year has (0 if none)."""
    agg = years.groupBy("station_id").agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count("*").alias("n_years"), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"), F.max(F.size("vars")).alias("n_vars"))
    return stations.join(agg, "station_id", "left").withColumns({"n_years": F.coalesce("n_years", F.lit(0)), "n_vars": F.coalesce("n_vars", F.lit(0))})


def station_detail(years: DataFrame, station_id: str) -> DataFrame:
    return years.where(F.col("station_id") == station_id).orderBy("year")


def year_status(years: DataFrame) -> DataFrame:
    complete = F.sum(F.when(F.col("date_max") >= F.make_date("year", F.lit(12), F.lit(31)), 1).otherwise(0))
    return years.groupBy("year").agg(F.count("*").alias("stations"), complete.alias("complete"), F.min("date_max").alias("earliest_end"), F.max("date_max").alias("latest_end"))


def classified(status: DataFrame, current_year: int, manifest: DataFrame | None = None) -> DataFrame:
    """current: the current year, which cannot be complete; complete: all stations reached its last day; stale: none did, or there are none; else partial.

    manifest (year, completed_at): adds when each year was fetched last.
    """
    kind = F.when(F.col("year") == current_year, "current").when(F.col("stations") == 0, "stale").when(F.col("complete") == F.col("stations"), "complete").when(F.col("complete") == 0, "stale").otherwise("partial")
    out = status.withColumn("status", kind)
    if manifest is None:
        return out
    return out.join(manifest.groupBy("year").agg(F.max("completed_at").alias("downloaded_at")), "year", "left")


def index_stats(years: DataFrame) -> DataFrame:
    return years.agg(F.countDistinct("station_id").alias("stations"), F.count("*").alias("station_years"), F.sum("n_rows").alias("n_rows"), F.min("date_min").alias("date_min"), F.max("date_max").alias("date_max"))


def rebuild_index(spark, data: str, index: str, reserved: tuple[str, ...] = STATION_RESERVED) -> None:
    """Write the index of station years, and with it the stations' latest metadata, anew from all stored observations."""
    df = scan(spark, data, union_by_name=True, skip_corrupt=True)
    df = df.withColumnRenamed("station", "station_id") if "station" in df.columns else df
    df = df if "year" in df.columns else df.withColumn("year", F.year("date"))
    years = station_years(df, variables(df, reserved))
    meta = [c for c in STATION_META if c in df.columns and c != "station_id"]
    if meta:
        years = years.join(latest_metadata(df, meta), "station_id")
    years.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(index)


def ensure_index(spark, data: str, index: str) -> bool:
    """Rebuild the index if it is missing or empty. Whether it was."""
    stored = scan_if_there(spark, index)
    if stored is not None and not stored.isEmpty():
        return False
    rebuild_index(spark, data, index)
    return True


def require_rows(**frames: DataFrame) -> None:
    """Fail unless every named table has a row."""
    empty = [k for k, df in frames.items() if df.isEmpty()]
    if empty:
        raise ValueError(f"no rows in {', '.join(empty)}")


def prerequisites(spark, paths: dict[str, str]) -> DataFrame:
    """A row for each table that stations need: its name, whether anything is stored, and rows in truth (0 if not)."""
    stored = {k: scan_if_there(spark, p, union_by_name=True) for k, p in paths.items()}
    counts = [(k, 0 if df is None else df.count()) for k, df in stored.items()]  # a few tables
    return spark.createDataFrame([(k, n > 0, n) for k, n in counts], "name string, stored boolean, n long")
