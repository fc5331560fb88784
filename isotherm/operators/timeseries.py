"""Bucketed series with a cap on points, their statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.columns import bucket, cell_index, convert, timestamp
from isotherm.model import Dataset
from isotherm.operators.quantiles import quantiles

LEVELS = ("raw", "hour", "day", "month")
AGGREGATES = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum}


def location(spec: dict, gridded: bool, resolution: float | None = None) -> Column:
    """point {lat, lon}, box {north, west, south, east} for grids; station {id}, stations {ids}, uf {uf} for stations."""
    kind = spec.get("kind")
    if kind in ("point", "box") and not gridded or kind in ("station", "stations", "uf") and gridded:
        raise ValueError(f"{kind} does not fit this table")
    if kind == "point":
        if resolution:
            return (cell_index("latitude", resolution) == round(spec["lat"] / resolution)) & (cell_index("longitude", resolution) == round(spec["lon"] / resolution))
        return F.col("latitude").between(spec["lat"] - 1e-4, spec["lat"] + 1e-4) & F.col("longitude").between(spec["lon"] - 1e-4, spec["lon"] + 1e-4)
    if kind == "box":
        return F.col("latitude").between(spec["south"], spec["north"]) & F.col("longitude").between(spec["west"], spec["east"])
    if kind == "station":
        return F.col("station_id") == spec["id"]
    if kind == "stations":
        return F.col("station_id").isin(spec["ids"])
    if kind == "uf":
        return F.col("uf") == spec["uf"]
    raise ValueError(f"no location is of kind {kind}")


def series(df: DataFrame, column: str, level: str = "raw", agg: str = "avg", where: Column | None = None, start=None, end=None, ts: Column | None = None) -> DataFrame:
    """ts, y: one aggregate a bucket, days from start to end inclusive, in order."""
    if agg not in AGGREGATES:
        raise ValueError(f"no aggregate is called {agg}")
    out = df.where(where) if where is not None else df
    day = F.col("date") if "date" in df.columns or ts is None else ts.cast("date")
    out = out.where(day >= F.lit(start)) if start is not None else out
    out = out.where(day <= F.lit(end)) if end is not None else out
    return out.groupBy(bucket(ts if ts is not None else timestamp(), level).alias("ts")).agg(AGGREGATES[agg](column).alias("y")).orderBy("ts")


def capped(df: DataFrame, column: str, most: int = 20_000, agg: str = "avg", level: str = "raw", where: Column | None = None, ts: Column | None = None) -> tuple[DataFrame, str, bool]:
    """The finest level, from the asked one on, with at most `most` points; beyond months every so-manieth point. (series, level, cut)."""
    own = df.where(where) if where is not None else df
    ts = ts if ts is not None else timestamp()
    levels = LEVELS[LEVELS.index(level) :]
    counts = own.agg(*[F.countDistinct(bucket(ts, x)).alias(x) for x in levels]).first()
    for x in levels:
        if counts[x] <= most:
            return series(own, column, x, agg, ts=ts), x, x != level
    return strided(series(own, column, "month", agg, ts=ts), counts["month"], most), "month", True


def strided(points: DataFrame, n: int, most: int) -> DataFrame:
    """Every so-manieth of n ordered points, at most about `most`. Aggregated months are few: one task numbers them."""
    step = max(2, math.ceil(n / most))
    numbered = points.withColumn("rn", F.row_number().over(Window.orderBy("ts")) - 1)
    return numbered.where(F.col("rn") % step == 0).drop("rn").orderBy("ts")


@dataclass
class Series:
    name: str
    df: DataFrame
    column: str
    agg: str = "avg"
    level: str = "day"
    where: Column | None = None
    ts: Column | None = None


def many(specs: list[Series]) -> tuple[DataFrame | None, dict[str, str]]:
    """All series as rows (series, ts, y), and the errors of those that cannot be made."""
    from pyspark.errors import AnalysisException

    out, errors = None, {}
    for s in specs:
        try:
            one = series(s.df, s.column, s.level, s.agg, s.where, ts=s.ts).select(F.lit(s.name).alias("series"), "ts", F.col("y").cast("double").alias("y"))
        except (AnalysisException, ValueError) as e:
            errors[s.name] = str(e).splitlines()[0]
        else:
            out = one if out is None else out.unionByName(one)
    return out, errors


def statistics(points: DataFrame, group: list[str], y: str = "y") -> DataFrame:
    """Of finite values: count, min, max, mean, sample variance and deviation (0 for one value), interquartile range."""
    v = F.col(y)
    own = points.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    one = lambda f: F.when(F.count(y) == 1, F.lit(0.0)).otherwise(f(y))
    out = own.groupBy(*group).agg(F.count(y).alias("n"), F.min(y).alias("min"), F.max(y).alias("max"), F.avg(y).alias("mean"), one(F.var_samp).alias("var"), one(F.stddev_samp).alias("std"))
    quarters = quantiles(own, group, y, [0.25, 0.75], ["__low", "__high"]).drop("n")
    quarters = quarters.withColumnsRenamed({g: f"__{g}" for g in group})
    both = out.join(quarters, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group] or F.lit(True), "left")  # without a group one row each
    return both.select(*group, "n", "min", "max", "mean", "var", "std", (F.col("__high") - F.col("__low")).alias("iqr"))


def metadata(df: DataFrame, reserved: tuple[str, ...], dataset: Dataset | None = None) -> DataFrame:
    """A row for each numeric variable of a table: name, values, first and last day; of a dataset also the kind of its places and its resolution."""
    numeric = [c for c, kind in df.dtypes if c not in reserved and kind in ("float", "double", "int", "bigint", "smallint", "tinyint")]
    counts = df.agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"), *[F.count(c).alias(c) for c in numeric])
    out = counts.unpivot(["date_min", "date_max"], numeric, "variable", "n").select("variable", "n", "date_min", "date_max")
    return out if dataset is None else out.withColumns({"kind": F.lit("grid" if dataset.gridded else "station"), "resolution": F.lit(dataset.resolution).cast("double")})


def station_metadata(df: DataFrame, reserved: tuple[str, ...]) -> DataFrame:
    """metadata() of each station: station_id, variable, values, and the first and last day of the station's rows."""
    numeric = [c for c, kind in df.dtypes if c not in reserved and kind in ("float", "double", "int", "bigint", "smallint", "tinyint")]
    counts = df.groupBy("station_id").agg(F.min("date").alias("date_min"), F.max("date").alias("date_max"), *[F.count(c).alias(c) for c in numeric])
    return counts.unpivot(["station_id", "date_min", "date_max"], numeric, "variable", "n").select("station_id", "variable", "n", "date_min", "date_max")


def converted_statistics(points: DataFrame, group: list[str], formula: str, y: str = "y") -> DataFrame:
    """statistics() of series after a conversion of units."""
    return statistics(points.withColumn(y, convert(y, formula)), group, y)
