"""Joins: equal and near columns, station to grid corners, bilinear interpolation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.functions.columns import bilinear, cell_index
from isotherm.shared import materialize

EPSILON = 1e-4


@dataclass
class Source:
    df: DataFrame
    alias: str
    columns: list[str]
    on: list[tuple[str, str]] = field(default_factory=list)  # ("a.x", "x"): equal columns
    near: list[tuple[str, str, float]] = field(default_factory=list)  # ("a.x", "x", epsilon): columns that differ by less
    how: str = "inner"


def build_view(sources: list[Source]) -> DataFrame:
    """Sources joined in order; columns are named alias_column. Every source after the first needs a condition."""
    for s in sources:
        for name in (s.alias, *s.columns):
            if not re.fullmatch(r"[A-Za-z_]\w*", name):
                raise ValueError(f"not an identifier: {name}")
    if not sources:
        raise ValueError("no source")
    named = lambda s: s.df.select(*[F.col(c).alias(f"{s.alias}_{c}") for c in dict.fromkeys([*s.columns, *[b for _, b in s.on], *[b for _, b, _ in s.near]])])
    first = sources[0]
    out = first.df.select(*[F.col(c).alias(f"{first.alias}_{c}") for c in first.df.columns])
    for s in sources[1:]:
        if s.how not in ("inner", "left"):
            raise ValueError("joins are inner or left")
        if not s.on and not s.near:
            raise ValueError(f"{s.alias} has no condition")
        right = named(s)
        left_name = lambda x: x.replace(".", "_", 1)
        equal = [(left_name(a), f"{s.alias}_{b}") for a, b in s.on]
        bands = [(left_name(a), f"{s.alias}_{b}", e) for a, b, e in s.near]
        out = band_join(out, right, equal, bands, s.how)
    wanted = [f"{s.alias}_{c}" for s in sources for c in s.columns]
    return out.select(*wanted)


def band_join(left: DataFrame, right: DataFrame, equal: list[tuple[str, str]], bands: list[tuple[str, str, float]], how: str = "inner") -> DataFrame:
    """abs(a - b) < epsilon as an equi-join: both sides get the number of their band; the right side stands in its own and both next to it.

    Without bands that is a plain join; a pair meets once, in the left row's band, so there are no duplicates.
    """
    left_keys, right_keys = [], []
    for k, (a, b, e) in enumerate(bands):
        left = left.withColumn(f"__l{k}", F.floor(F.col(a).cast("double") / e))
        own = F.floor(F.col(b).cast("double") / e)
        right = right.withColumn(f"__r{k}", F.explode(F.array(own - 1, own, own + 1)))
        left_keys.append(f"__l{k}")
        right_keys.append(f"__r{k}")
    on = [F.col(a) == F.col(b) for a, b in (*equal, *zip(left_keys, right_keys, strict=True))]
    on += [F.abs(F.col(a).cast("double") - F.col(b).cast("double")) < e for a, b, e in bands]
    return left.join(right, on, how).drop(*left_keys, *right_keys)


CORNER = {"bl": (0, 0), "br": (0, 1), "tl": (1, 0), "tr": (1, 1)}


def corner_join_grids(stations: DataFrame, grids: dict[str, tuple[DataFrame, float]], names: list[str]) -> DataFrame:
    """Each station row with the values of several grids (table, resolution) at its four enclosing nodes in each.

    Columns name_corner_grid (bl, br, tl, tr), wx_grid and wy_grid follow the station's own. One equi-join on grid, date,
    hour and the node's integer indexes: the station rows stand four times for each grid in it, and the grids, the
    large side, once; one aggregate brings a station row together again. Corners that a grid lacks are null, and so
    are all of a row without a place or a time. Equal station rows stay as many as they are. A grid has one row a node
    and hour, as last_values() gives them.
    """
    own = stations.columns
    part = lambda c, res: F.floor(F.col(c) / res).cast("int")
    asked = [F.struct(F.lit(g).alias("grid"), F.lit(n).alias("corner"), (part("latitude", res) + a).alias("i"), (part("longitude", res) + b).alias("j")) for g, (_, res) in grids.items() for n, (a, b) in CORNER.items()]
    wanted = stations.select("*", F.explode(F.array(*asked)).alias("__c"))
    nodes = reduce(DataFrame.unionByName, [df.select(F.lit(g).alias("__g"), F.col("date").alias("__d"), F.col("hour_utc").alias("__h"), cell_index("latitude", res).alias("__i"), cell_index("longitude", res).alias("__j"), *[F.col(c).alias(f"__v{k}") for k, c in enumerate(names)]) for g, (df, res) in grids.items()])
    on = (F.col("__c.grid") == F.col("__g")) & (F.col("date") == F.col("__d")) & (F.col("hour_utc") == F.col("__h")) & (F.col("__c.i") == F.col("__i")) & (F.col("__c.j") == F.col("__j"))
    met = wanted.join(nodes, on, "left")
    value = lambda g, n, k: F.max(F.when((F.col("__c.grid") == g) & (F.col("__c.corner") == n), F.col(f"__v{k}")))
    wide = met.groupBy(*own).agg(*[value(g, n, k).alias(f"{c}_{n}_{g}") for g in grids for n in CORNER for k, c in enumerate(names)], F.count(F.lit(1)).alias("__n"))
    out = wide.withColumn("__n", F.explode(F.sequence(F.lit(1), F.floor(F.col("__n") / len(asked)).cast("int")))).drop("__n")
    return out.withColumns({f"{w}_{g}": F.col(c) / res - part(c, res) for g, (_, res) in grids.items() for w, c in (("wx", "longitude"), ("wy", "latitude"))})


def corner_join(stations: DataFrame, grid: DataFrame, resolution: float, names: list[str]) -> DataFrame:
    """corner_join_grids() for one grid: columns name_bl, name_br, name_tl, name_tr; wx and wy."""
    out = corner_join_grids(stations, {"g": (grid, resolution)}, names)
    return out.withColumnsRenamed({c: c[:-2] for c in out.columns if c not in stations.columns})


def interpolated(cornered: DataFrame, names: list[str]) -> DataFrame:
    """Adds name_grid for each name: bilinear between the corners, null if one is missing."""
    return cornered.withColumns({f"{c}_grid": bilinear(F.col("wx"), F.col("wy"), *[F.col(f"{c}_{n}") for n in ("bl", "br", "tl", "tr")]) for c in names})


def interpolated_grids(cornered: DataFrame, grids: list[str], names: list[str]) -> DataFrame:
    """interpolated() for the columns of corner_join_grids(): adds name_grid for each name and grid."""
    return cornered.withColumns({f"{c}_{g}": bilinear(F.col(f"wx_{g}"), F.col(f"wy_{g}"), *[F.col(f"{c}_{n}_{g}") for n in ("bl", "br", "tl", "tr")]) for g in grids for c in names})


def near_station(grid: DataFrame, stations: DataFrame, start, end, margin: float) -> DataFrame:
    """The part of a grid that some stations' interpolation needs: days, and the stations' box with a margin (one row, broadcast)."""
    box = stations.agg(F.min("latitude").alias("s"), F.max("latitude").alias("n"), F.min("longitude").alias("w"), F.max("longitude").alias("e"))
    days = grid.where(F.col("date").between(F.lit(start), F.lit(end)))
    return days.join(F.broadcast(box), F.col("latitude").between(F.col("s") - margin, F.col("n") + margin) & F.col("longitude").between(F.col("w") - margin, F.col("e") + margin), "left_semi")


def values_at_stations(stations: DataFrame, grid: DataFrame, resolution: float, names: list[str]) -> DataFrame:
    """Rows of chosen stations with the grid's values at their places: name_grid for each name, wx and wy, and the corners.

    Of a stored grid partitioned by day only the stations' days are read: the days, a row each, are broadcast, and
    prune the scan when it runs. Of these days only what lies within a cell of the stations' box is shuffled.
    """
    own = materialize(stations, "stations")  # a choice: read for the days, the box and the join
    days = own.select("date").where("date > date'0001-01-01'").distinct()  # Spark prunes by what a predicate has chosen
    box = own.agg(*[f(c).alias(n) for n, f, c in (("__s", F.min, "latitude"), ("__n", F.max, "latitude"), ("__w", F.min, "longitude"), ("__e", F.max, "longitude"))])
    there = grid.join(F.broadcast(days), "date").select("date", "hour_utc", "latitude", "longitude", *names)
    inside = F.col("latitude").between(F.col("__s") - resolution, F.col("__n") + resolution) & F.col("longitude").between(F.col("__w") - resolution, F.col("__e") + resolution)
    near = there.join(F.broadcast(box), inside, "left_semi")  # one row
    return interpolated(corner_join(own, near, resolution, names), names)
