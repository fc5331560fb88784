"""The index of which hours of which variables are stored for each cell and day: 24-bit masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.functions.columns import UNROLLED, hour_bit, in_polygon, mask_to_hours
from isotherm.operators.numbering import numbered


def hour_masks(df: DataFrame, names: list[str], keys: tuple[str, ...] = ("latitude", "longitude", "date")) -> DataFrame:
    """keys, variable, mask: a bit for each hour (0-23) with a value that is not null. Partial masks are merged before the shuffle."""
    long = df.where(F.col("hour_utc").between(0, 23)).unpivot([*keys, "hour_utc"], names, "variable", "value").where("value is not null")
    return long.groupBy(*keys, "variable").agg(F.bit_or(hour_bit()).alias("mask"))


def packed(masks: DataFrame, keys: tuple[str, ...] = ("latitude", "longitude", "date")) -> DataFrame:
    """One row a cell and day, with a map from variable to mask (as many entries as there are variables)."""
    return masks.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("variable", "mask"))).alias("vars"))


def unpacked(coverage: DataFrame, keys: tuple[str, ...] = ("latitude", "longitude", "date")) -> DataFrame:
    return coverage.select(*keys, F.explode("vars").alias("variable", "mask"))


def merged(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("latitude", "longitude", "date")) -> DataFrame:
    """Masks of both, by OR: doing it again changes nothing."""
    return old.unionByName(new).groupBy(*keys, "variable").agg(F.bit_or("mask").alias("mask"))


def cell_ids(known: DataFrame, seen: DataFrame) -> DataFrame:
    """known (cell_id, latitude, longitude) and numbers after its largest for new places, in their order."""
    new = seen.select("latitude", "longitude").distinct().join(known, ["latitude", "longitude"], "left_anti")
    top = known.agg(F.coalesce(F.max("cell_id"), F.lit(0)).alias("top"))
    ids = numbered(new, [F.col("latitude"), F.col("longitude")]).join(F.broadcast(top)).select((F.col("k") + F.col("top")).cast("int").alias("cell_id"), "latitude", "longitude")
    return known.select("cell_id", "latitude", "longitude").unionByName(ids)


def filtered(masks: DataFrame, start=None, end=None, names: list[str] | None = None, hours_mask: int | None = None) -> DataFrame:
    """By dates (inclusive), variables, and hours that must all be there."""
    out = masks.where(F.col("date") >= F.lit(start)) if start is not None else masks
    out = out.where(F.col("date") <= F.lit(end)) if end is not None else out
    out = out.where(F.col("variable").isin(names)) if names else out
    return out.where(F.col("mask").bitwiseAND(F.lit(hours_mask)) == hours_mask) if hours_mask else out


def grid_points(masks: DataFrame, **filters) -> DataFrame:
    """Of each cell: days and variables."""
    return filtered(masks, **filters).groupBy("latitude", "longitude").agg(F.countDistinct("date").alias("n_days"), F.countDistinct("variable").alias("n_variables"))


def cell_detail(masks: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """Of one cell: date, variables with their hours."""
    rows = masks.where((F.abs(F.col("latitude") - latitude) < 1e-4) & (F.abs(F.col("longitude") - longitude) < 1e-4))
    return rows.groupBy("date").agg(F.sort_array(F.collect_list(F.struct("variable", mask_to_hours("mask").alias("hours")))).alias("variables"))


def inside(masks: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """The cells within a polygon of (lat, lon). A small ring is a compiled condition on each row; a large one is tested once a cell."""
    within = in_polygon(F.col("latitude").cast("double"), F.col("longitude").cast("double"), ring)
    if len(ring) <= UNROLLED:
        return masks.where(within)
    return masks.join(masks.select("latitude", "longitude").distinct().where(within), ["latitude", "longitude"], "left_semi")


def region_summary(masks: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """One row: cells, first and last day, mean of variables a cell; zeros for a polygon without cells."""
    per_cell = inside(masks, ring).groupBy("latitude", "longitude").agg(F.min("date").alias("a"), F.max("date").alias("b"), F.countDistinct("variable").alias("v"))
    return per_cell.agg(F.count("*").alias("n_points"), F.min("a").alias("date_min"), F.max("b").alias("date_max"), F.coalesce(F.round(F.avg("v"), 6), F.lit(0.0)).alias("avg_variables"))


def region_gaps(masks: DataFrame, ring: list[tuple[float, float]]) -> DataFrame:
    """Days on which some of the region's cells are missing, and the share of them."""
    own = inside(masks, ring)
    total = own.agg(F.countDistinct("latitude", "longitude").alias("n"))
    days = own.groupBy("date").agg(F.countDistinct("latitude", "longitude").alias("cells"))
    return days.join(F.broadcast(total)).where("cells < n").select("date", "cells", F.round((1 - F.col("cells") / F.col("n")) * 100, 2).alias("missing_pct"))


def diff(requested: DataFrame, masks: DataFrame) -> DataFrame:
    """What is asked and not stored: (latitude, longitude, date, variable, requested_mask) -> missing_mask, without rows that miss nothing."""
    keys = ["latitude", "longitude", "date", "variable"]
    missing = F.col("requested_mask").bitwiseAND(F.bitwise_not(F.coalesce("mask", F.lit(0))))
    return requested.join(masks, keys, "left").withColumn("missing_mask", missing).where("missing_mask <> 0").select(*keys, "requested_mask", "missing_mask")


def date_range(masks: DataFrame) -> DataFrame:
    return masks.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"))


def stats(masks: DataFrame) -> DataFrame:
    return masks.agg(F.count("*").alias("entries"), F.countDistinct("latitude", "longitude").alias("cells"), F.countDistinct("date").alias("dates"), F.countDistinct("variable").alias("variables"))


def stored_order(masks: DataFrame) -> DataFrame:
    return masks.repartitionByRange("date").sortWithinPartitions("date", "latitude", "longitude")


def ensure_index(spark, data: str, index: str, version: str = "1") -> bool:
    """Build the index anew from all data if it is missing, empty or of another version. Whether it was built; files that cannot be read are skipped."""
    from pyspark.errors import AnalysisException

    from isotherm.model import variables
    from isotherm.sources.tables import scan

    try:
        if not scan(spark, index).where(F.col("schema_version") == version).isEmpty():
            return False
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "UNRESOLVED_COLUMN.WITH_SUGGESTION"):
            raise
    df = scan(spark, data, union_by_name=True, skip_corrupt=True)
    stored_order(hour_masks(df, variables(df))).withColumn("schema_version", F.lit(version)).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(index)
    return True
