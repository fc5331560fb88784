"""Column functions: rows' transforms, time, grid cells, hour masks, unit conversions. All native expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KELVIN = 273.15


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- grid -----------------------------------------------------------------------------------------------------


def cell_index(c: Column | str, resolution: float) -> Column:
    """Integer index of a coordinate's nearest node. Joins use it, as 32-bit and 64-bit floats of one node differ."""
    return F.round(col(c).cast("double") / F.lit(resolution)).cast("int")


def cell_key(lat: Column | str, lon: Column | str, resolution: float) -> Column:
    """Both indexes in one long: a cell's natural key, unlike a counter, needs no global numbering."""
    return F.shiftleft(cell_index(lat, resolution).cast("long"), 32).bitwiseOR(cell_index(lon, resolution).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def snap(c: Column | str, resolution: float) -> Column:
    """Nearest node."""
    return F.round(F.round(col(c) / resolution) * resolution, 6)


def snap_box(north: Column, west: Column, south: Column, east: Column, resolution: float) -> dict[str, Column]:
    """A box moved outward to the grid: north and east up, south and west down, to six decimals."""
    if resolution <= 0:
        raise ValueError("the resolution must be positive")
    up, down = (lambda c: F.round(F.ceil(c / resolution) * resolution, 6)), (lambda c: F.round(F.floor(c / resolution) * resolution, 6))
    return {"north": up(north), "west": down(west), "south": down(south), "east": up(east)}


def enclosing(c: Column | str, resolution: float, decimals: int) -> tuple[Column, Column]:
    """Edges of the cell around a coordinate by arithmetic: (below, above)."""
    k = F.floor(col(c) / F.lit(resolution))
    return F.round(k * F.lit(resolution), decimals), F.round((k + 1) * F.lit(resolution), decimals)


def corner_edges(lat: Column | str = "latitude", lon: Column | str = "longitude", grids: dict[str, tuple[float, int]] | None = None) -> dict[str, Column]:
    """The four edges of the cell around a place for each grid (resolution, decimals), as 32-bit floats; null without coordinates."""
    out = {}
    for name, (resolution, decimals) in (grids or {"era5": (0.25, 2), "era5_land": (0.1, 1)}).items():
        for c, low, high in ((lat, "lat_bottom", "lat_top"), (lon, "lon_left", "lon_right")):
            below = F.round(F.floor(col(c).cast("double") / resolution) * resolution, decimals)
            out[f"{name}_{low}"], out[f"{name}_{high}"] = below.cast("float"), F.round(below + resolution, decimals).cast("float")
    return out


def enclosing_axis(c: Column | str, axis: Column | str) -> tuple[Column, Column]:
    """The axis's largest value at or below a coordinate, and its smallest above; null beyond its ends. axis: an array."""
    x = col(c)
    return F.array_max(F.filter(axis, lambda v: v <= x)), F.array_min(F.filter(axis, lambda v: v > x))


#: Vertices of a ring up to which its edges are unrolled.
UNROLLED = 64


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a ring of (lat, lon) vertices: the parity of the edges that a ray crosses. Outside for fewer than three."""
    if len(ring) < 3:
        return F.lit(False)
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    n = len(ring)
    box = lat.between(min(lats), max(lats)) & lon.between(min(lons), max(lons))
    if n <= UNROLLED:
        # each edge is a condition of its own, which is compiled; level edges are never crossed
        edges = [(a, b) for a, b in zip(ring, [ring[-1], *ring[:-1]], strict=True) if a[0] != b[0]]
        crossed = [((F.lit(ya) > lat) != (F.lit(yb) > lat)) & (lon < F.lit(xb - xa) * (lat - F.lit(ya)) / F.lit(yb - ya) + F.lit(xa)) for (ya, xa), (yb, xb) in [(tuple(map(float, a)), tuple(map(float, b))) for a, b in edges]]
        return box & reduce(lambda p, c: p != c, crossed, F.lit(False))
    y, x = (F.array(*map(F.lit, map(float, v))) for v in (lats, lons))

    def crosses(i: Column) -> Column:
        j = F.pmod(i + n - 1, F.lit(n))
        yi, yj, xi, xj = F.element_at(y, i + 1), F.element_at(y, j + 1), F.element_at(x, i + 1), F.element_at(x, j + 1)
        span = (yi > lat) != (yj > lat)
        return span & (lon < (xj - xi) * (lat - yi) / F.when(yj == yi, F.lit(1e-30)).otherwise(yj - yi) + xi)

    parity = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(False), lambda a, i: a != crosses(i))
    return box & parity


# --- ingest ---------------------------------------------------------------------------------------------------


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def kelvin_to_celsius(df: DataFrame, units: dict[str, str], columns: list[str] | None = None) -> DataFrame:
    """Columns whose name has "temp" (or those given) and whose unit is K, in degrees Celsius."""
    chosen = [c for c in df.columns if units.get(c) == "K" and (c in columns if columns is not None else "temp" in c)]
    return df.withColumns({c: F.col(c) - KELVIN for c in chosen})


def wind_speeds(df: DataFrame) -> DataFrame:
    """For each pair of columns that differ in _u_ and _v_ the speed, named with _speed_."""
    pairs = [(c, c.replace("_u_", "_v_"), c.replace("_u_", "_speed_")) for c in df.columns if "_u_" in c and c.replace("_u_", "_v_") in df.columns]
    return df.withColumns({s: F.sqrt(F.col(u) * F.col(u) + F.col(v) * F.col(v)) for u, v, s in pairs})


def drop_unused(df: DataFrame, columns: tuple[str, ...] = ("number", "expver")) -> DataFrame:
    return df.drop(*columns)


def round_coordinates(df: DataFrame, decimals: int) -> DataFrame:
    return df.withColumns({c: F.round(c, decimals).cast("float") for c in ("latitude", "longitude")})


def reduce_precision(df: DataFrame, decimals: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every double, rounded, as a 32-bit float."""
    return df.withColumns({c: F.round(c, decimals).cast("float") for c, kind in df.dtypes if kind == "double" and c not in keep})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value to Spark; merging takes it for one unless it is made null."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def split_time(df: DataFrame) -> DataFrame:
    """date and hour_utc from valid_time, or from time where that is absent; both are dropped."""
    source = "valid_time" if "valid_time" in df.columns else "time"
    return df.withColumns({"date": F.to_date(source), "hour_utc": F.hour(source).cast("byte")}).drop("valid_time", "time")


def station_number(c: Column | str) -> Column:
    """A number with a decimal comma, perhaps without a leading zero; empty and -9999 are null."""
    return F.nullif(F.replace(F.trim(col(c)), F.lit(","), F.lit(".")).try_cast("double"), F.lit(-9999.0)).cast("float")


def station_date(c: Column | str) -> Column:
    text = F.trim(col(c))
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy"))).cast("date")


def station_hour(c: Column | str) -> Column:
    """14:00 or 1400 UTC -> 14."""
    return F.substring(F.trim(F.replace(col(c), F.lit("UTC"), F.lit(""))), 1, 2).try_cast("tinyint")


# --- time and masks -------------------------------------------------------------------------------------------


def timestamp(date: Column | str = "date", hour: Column | str = "hour_utc") -> Column:
    return (col(date).cast("timestamp_ntz") + F.make_interval(hours=col(hour).cast("int"))).cast("timestamp_ntz")


def bucket(ts: Column, level: str) -> Column:
    """raw, hour, day or month."""
    if level not in ("raw", "hour", "day", "month"):
        raise ValueError(f"no bucket is called {level}")
    return ts if level == "raw" else F.date_trunc(level, ts).cast("timestamp_ntz")


def hour_bit(hour: Column | str = "hour_utc") -> Column:
    return F.call_function("shiftleft", F.lit(1), col(hour).cast("int"))


def hours_to_mask(hours: Column | str) -> Column:
    return F.aggregate(hours, F.lit(0), lambda a, h: a.bitwiseOR(F.call_function("shiftleft", F.lit(1), h.cast("int"))))


def mask_to_hours(mask: Column | str) -> Column:
    m = col(mask)
    return F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.call_function("shiftright", m, h).bitwiseAND(F.lit(1)) == 1)


# --- interpolation and units ----------------------------------------------------------------------------------


def bilinear(wx: Column, wy: Column, q11: Column, q21: Column, q12: Column, q22: Column) -> Column:
    """Between four corners (left-bottom, right-bottom, left-top, right-top); null if one is."""
    return (1 - wx) * (1 - wy) * q11 + wx * (1 - wy) * q21 + (1 - wx) * wy * q12 + wx * wy * q22


#: The name and the parameters are fixed values: users' statements call it.
BILINEAR_SQL = """CREATE OR REPLACE TEMPORARY FUNCTION bilinear_weights(wx DOUBLE, wy DOUBLE, q11 DOUBLE, q21 DOUBLE, q12 DOUBLE, q22 DOUBLE)
RETURNS DOUBLE RETURN (1 - wx) * (1 - wy) * q11 + wx * (1 - wy) * q21 + (1 - wx) * wy * q12 + wx * wy * q22"""

#: Conversions that users choose by name.
PRESETS = {"k_to_c": "x - 273.15", "c_to_k": "x + 273.15", "k_to_f": "(x - 273.15) * 9 / 5 + 32", "c_to_f": "x * 9 / 5 + 32"}


class _Number:
    """Arithmetic on a Column in which a division by zero gives null."""

    def __init__(self, c: Column):
        self.c = c

    @staticmethod
    def _of(x) -> Column:
        return x.c if isinstance(x, _Number) else F.lit(float(x))

    def __add__(self, x):
        return _Number(self.c + self._of(x))

    def __radd__(self, x):
        return _Number(self._of(x) + self.c)

    def __sub__(self, x):
        return _Number(self.c - self._of(x))

    def __rsub__(self, x):
        return _Number(self._of(x) - self.c)

    def __mul__(self, x):
        return _Number(self.c * self._of(x))

    def __rmul__(self, x):
        return _Number(self._of(x) * self.c)

    def __truediv__(self, x):
        return _Number(F.try_divide(self.c, self._of(x)))

    def __rtruediv__(self, x):
        return _Number(F.try_divide(self._of(x), self.c))

    def __neg__(self):
        return _Number(-self.c)

    def __pos__(self):
        return self


def convert(c: Column | str, formula: str) -> Column:
    """A preset, or arithmetic in x. Null stays null, and a value whose result is not finite stays as it was."""
    text = PRESETS.get(formula, formula).replace(" ", "")
    if not re.fullmatch(r"(?:[x+\-*/()]|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)+", text, re.IGNORECASE) or "**" in text or "//" in text:
        raise ValueError("a formula holds x, numbers, + - * / and parentheses only")
    x = col(c).cast("double")
    try:
        out = _Number._of(eval(text, {"__builtins__": {}}, {"x": _Number(x)}))  # noqa: S307  nothing but arithmetic passes the pattern
    except (SyntaxError, TypeError, NameError, ZeroDivisionError) as e:
        raise ValueError(f"not a formula: {formula}") from e
    return F.when(x.isNull(), x).when(out.isNull() | F.isnan(out) | (F.abs(out) == float("inf")), x).otherwise(out)
