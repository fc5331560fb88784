"""The library's operators as queries over the test tables, each with its twin in SQL where SQL can say it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isotherm.functions import columns as C
from isotherm.operators import catalog, coverage, joins, ml, regions, requests, stations, storage, timeseries
from isotherm.plans.fixtures import BOXES_SQL, DIM_SQL, EVENT_TYPES, GRID_SQL, LATEST_SQL, STATION_SQL, VARIABLES, boxes, grid_latest, grid_obs, read, station_dim, station_obs
from isotherm.plans.registry import QUERIES, SQL, query  # noqa: F401  the entry takes both tables from here
from isotherm.sources.arrays import to_long

RES = 0.25
#: A polygon of (lat, lon) within the test grid, and two regions of rings.
RING = [(-23.9, -49.8), (-21.6, -49.3), (-22.1, -47.6), (-23.4, -48.2)]
KEYS = ["latitude", "longitude", "date", "hour_utc"]


def r(c, d: int = 4):
    return F.round(c, d)


# --- transforms -----------------------------------------------------------------------------------------------


@query(f"WITH {GRID_SQL} SELECT seq.l_orderkey AS k, seq.l_linenumber AS line, round(temperature_2m - 273.15, 4) AS temperature_2m, round(sqrt(wind_u_10m * wind_u_10m + wind_v_10m * wind_v_10m), 4) AS wind_speed_10m FROM grid_obs")
def kelvin_and_wind(spark: SparkSession, sf: str) -> DataFrame:
    out = C.wind_speeds(C.kelvin_to_celsius(grid_obs(spark, sf), {"temperature_2m": "K"}))
    return out.select(F.col("seq.l_orderkey").alias("k"), F.col("seq.l_linenumber").alias("line"), r("temperature_2m").alias("temperature_2m"), r("wind_speed_10m").alias("wind_speed_10m"))


@query(f"WITH {GRID_SQL} SELECT round(latitude, 2)::FLOAT AS latitude, round(longitude, 2)::FLOAT AS longitude, count(*) AS n, max(round(total_precipitation, 5)::FLOAT) AS most FROM grid_obs GROUP BY 1, 2")
def float_precision(spark: SparkSession, sf: str) -> DataFrame:
    out = C.reduce_precision(C.round_coordinates(grid_obs(spark, sf).drop("seq"), 2), 5)
    return out.groupBy("latitude", "longitude").agg(F.count("*").alias("n"), F.max("total_precipitation").alias("most"))


@query("SELECT event_id, ts::DATE AS date, extract(hour FROM ts)::TINYINT AS hour_utc FROM events")
def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_time(read(spark, sf, "events").withColumnRenamed("ts", "valid_time")).select("event_id", "date", "hour_utc")


@query("SELECT c_custkey, round(round(c_acctbal / 100 / 0.25) * 0.25, 6) + 0.0 AS snapped, floor(c_acctbal / 100 / 0.25) * 0.25 AS below, (floor(c_acctbal / 100 / 0.25) + 1) * 0.25 AS above FROM customer")
def snap_and_enclose(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("c_acctbal") / 100
    below, above = C.enclosing(x, RES, 2)
    return read(spark, sf, "customer").select("c_custkey", C.snap(x, RES).alias("snapped"), below.alias("below"), above.alias("above"))


@query("SELECT c_custkey, (SELECT max(v) FROM (SELECT unnest(range(-4, 37)) * 2.5::DOUBLE AS v) WHERE v <= c_acctbal / 100) AS below, (SELECT min(v) FROM (SELECT unnest(range(-4, 37)) * 2.5::DOUBLE AS v) WHERE v > c_acctbal / 100) AS above FROM customer")
def enclosing_lookup(spark: SparkSession, sf: str) -> DataFrame:
    below, above = C.enclosing_axis(F.col("c_acctbal") / 100, F.transform(F.sequence(F.lit(-4), F.lit(36)), lambda k: k * F.lit(2.5)))
    return read(spark, sf, "customer").select("c_custkey", below.alias("below"), above.alias("above"))


@query("SELECT o_orderkey, round(ceil((o_custkey % 97 / 7.0 + 1) / 0.25) * 0.25, 6)::DOUBLE AS north, round(floor(o_custkey % 89 / 7.0 / 0.25) * 0.25, 6)::DOUBLE AS west, round(floor(o_custkey % 97 / 7.0 / 0.25) * 0.25, 6)::DOUBLE AS south, round(ceil((o_custkey % 89 / 7.0 + 1) / 0.25) * 0.25, 6)::DOUBLE AS east FROM orders")
def snap_boxes(spark: SparkSession, sf: str) -> DataFrame:
    y, x = F.col("o_custkey") % 97 / F.lit(7.0), F.col("o_custkey") % 89 / F.lit(7.0)
    return read(spark, sf, "orders").select("o_orderkey", *[v.alias(k) for k, v in C.snap_box(y + 1, x, y, x + 1, RES).items()])


@query("SELECT event_id, round(value - 273.15, 4) AS k_to_c, round((value - 273.15) * 9 / 5 + 32, 4) AS k_to_f, round(CASE WHEN value - 10 = 0 THEN value ELSE 100 / (value - 10) END, 4) AS custom FROM events")
def unit_convert(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", r(C.convert("value", "k_to_c")).alias("k_to_c"), r(C.convert("value", "k_to_f")).alias("k_to_f"), r(C.convert("value", "100 / (x - 10)")).alias("custom"))


@query(f"WITH {GRID_SQL}, l AS (UNPIVOT (SELECT latitude, longitude, date, {', '.join(VARIABLES)} FROM grid_obs) ON {', '.join(VARIABLES)} INTO NAME variable VALUE value) SELECT date, variable, count(value) AS n, round(sum(value), 2) AS total FROM l GROUP BY ALL")
def long_form(spark: SparkSession, sf: str) -> DataFrame:
    long = to_long(grid_obs(spark, sf), ["latitude", "longitude", "date"], list(VARIABLES))
    return long.groupBy("date", "variable").agg(F.count("value").alias("n"), r(F.sum("value"), 2).alias("total"))


# --- storage --------------------------------------------------------------------------------------------------


@query(f"WITH {LATEST_SQL} SELECT latitude, longitude, date, hour_utc, {', '.join(f'round({c}, 6) AS {c}' for c in VARIABLES)} FROM latest")
def dedup_last_value(spark: SparkSession, sf: str) -> DataFrame:
    return grid_latest(spark, sf).select(*KEYS, *[r(c, 6).alias(c) for c in VARIABLES])


@query(f"""WITH {LATEST_SQL}, a AS (SELECT * EXCLUDE (wind_u_10m) FROM latest WHERE extract(day FROM date) <= 20), b AS (SELECT latitude, longitude, date, hour_utc, temperature_2m + 1 AS temperature_2m, total_precipitation, wind_u_10m FROM latest WHERE extract(day FROM date) >= 10 AND hour_utc % 2 = 0),
both_ AS (SELECT *, NULL::DOUBLE AS wind_u_10m, 0 AS side FROM a UNION ALL BY NAME SELECT *, NULL::DOUBLE AS wind_v_10m, 1 AS side FROM b)
SELECT latitude, longitude, date, hour_utc, {', '.join(f'round(arg_max({c}, side) FILTER (WHERE {c} IS NOT NULL), 6) AS {c}' for c in VARIABLES)} FROM both_ GROUP BY latitude, longitude, date, hour_utc""")
def merge_on_key(spark: SparkSession, sf: str) -> DataFrame:
    own = grid_latest(spark, sf)
    old = own.where(F.dayofmonth("date") <= 20).drop("wind_u_10m")
    new = own.where((F.dayofmonth("date") >= 10) & (F.col("hour_utc") % 2 == 0)).withColumn("temperature_2m", F.col("temperature_2m") + 1).drop("wind_v_10m")
    return storage.merge_on_key(old, new, KEYS).select(*KEYS, *[r(c, 6).alias(c) for c in VARIABLES])


@query(f"WITH {GRID_SQL} SELECT date, sum(n)::BIGINT AS rows_before, count(*) AS rows_after FROM (SELECT date, count(*) AS n FROM grid_obs GROUP BY latitude, longitude, date, hour_utc) GROUP BY date")
def dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return storage.dedup_counts(grid_obs(spark, sf), KEYS)


@query(f"WITH {GRID_SQL} SELECT floor(latitude / 5)::BIGINT AS tile_lat, floor(longitude / 5)::BIGINT AS tile_lon, count(*) AS n, min(longitude) AS west, max(longitude) AS east FROM grid_obs GROUP BY 1, 2")
def tile_order_keys(spark: SparkSession, sf: str) -> DataFrame:
    return grid_obs(spark, sf).groupBy(*storage.tile_columns()).agg(F.count("*").alias("n"), F.min("longitude").alias("west"), F.max("longitude").alias("east"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber >= 3)")
def pending_chunks(spark: SparkSession, sf: str) -> DataFrame:
    done = read(spark, sf, "lineitem").where("l_linenumber >= 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return storage.pending(read(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT o_orderkey, extract(day FROM last_day(o_orderdate))::INT AS n_days, 24 AS n_hours FROM orders")
def manifest_defaults(spark: SparkSession, sf: str) -> DataFrame:
    m = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.lit(None).cast("array<int>").alias("days"), F.lit(None).cast("array<int>").alias("hours"))
    return storage.with_manifest_defaults(m).select("o_orderkey", F.size("days").alias("n_days"), F.size("hours").alias("n_hours"))


@query(f"WITH {GRID_SQL} SELECT DISTINCT a.latitude, b.longitude FROM grid_obs a CROSS JOIN (SELECT DISTINCT longitude FROM grid_obs) b")
def grid_nodes(spark: SparkSession, sf: str) -> DataFrame:
    from isotherm.sources.tables import grid_nodes

    return grid_nodes(grid_obs(spark, sf), 2)


# --- coverage -------------------------------------------------------------------------------------------------

MASKS_SQL = GRID_SQL + f", masks AS (SELECT latitude, longitude, date, variable, bit_or(1 << hour_utc)::INT AS mask FROM (UNPIVOT (SELECT latitude, longitude, date, hour_utc, {', '.join(VARIABLES)} FROM grid_obs) ON {', '.join(VARIABLES)} INTO NAME variable VALUE value) WHERE value IS NOT NULL GROUP BY ALL)"


def masks_of(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.hour_masks(grid_obs(spark, sf), list(VARIABLES))


@query(f"WITH {MASKS_SQL} SELECT * FROM masks")
def hour_mask(spark: SparkSession, sf: str) -> DataFrame:
    return masks_of(spark, sf)


@query(f"WITH {MASKS_SQL} SELECT latitude, longitude, date, count(*)::INT AS n_variables, sum(bit_count(mask))::BIGINT AS hours FROM masks GROUP BY ALL")
def coverage_packed(spark: SparkSession, sf: str) -> DataFrame:
    packed = coverage.packed(masks_of(spark, sf))
    hours = F.aggregate(F.map_values("vars"), F.lit(0).cast("long"), lambda a, m: a + F.bit_count(m))
    return packed.select("latitude", "longitude", "date", F.size("vars").alias("n_variables"), hours.alias("hours"))


@query(f"WITH {MASKS_SQL} SELECT latitude, longitude, date, variable, bit_or(m)::INT AS mask FROM (SELECT latitude, longitude, date, variable, mask & 4095 AS m FROM masks UNION ALL SELECT latitude, longitude, date, variable, mask & 16773120 FROM masks) GROUP BY ALL")
def coverage_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = masks_of(spark, sf)
    half = lambda bits: m.withColumn("mask", F.col("mask").bitwiseAND(F.lit(bits)))
    return coverage.merged(half(4095), half(16773120))


@query(f"WITH {MASKS_SQL} SELECT latitude, longitude, count(DISTINCT date) AS n_days, count(DISTINCT variable) AS n_variables FROM masks WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND mask & 17 = 17 GROUP BY ALL")
def grid_points_hours(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.grid_points(masks_of(spark, sf), start=dt.date(2024, 1, 5), end=dt.date(2024, 1, 25), hours_mask=17)


@query(f"WITH {MASKS_SQL} SELECT date, variable, list_aggregate(list_filter(range(24), lambda h: (mask >> h) & 1 = 1), 'string_agg', ',') AS hours FROM masks WHERE latitude = -23.0 AND longitude = -49.5")
def cell_detail(spark: SparkSession, sf: str) -> DataFrame:
    detail = coverage.cell_detail(masks_of(spark, sf), -23.0, -49.5).select("date", F.explode("variables").alias("v"))
    return detail.select("date", "v.variable", F.array_join(F.transform("v.hours", lambda h: h.cast("string")), ",").alias("hours"))


def ring_sql(lat: str, lon: str) -> str:
    edges = [f"(({ya} > {lat}) <> ({yb} > {lat}) AND {lon} < ({xb} - {xa}) * ({lat} - {ya}) / ({yb} - {ya}) + {xa})::INT" for (ya, xa), (yb, xb) in [(tuple(f"({v}::DOUBLE)" for v in RING[k]), tuple(f"({v}::DOUBLE)" for v in RING[k - 1])) for k in range(len(RING))]]
    return f"({' + '.join(edges)}) % 2 = 1"


INSIDE_SQL = MASKS_SQL + f", own AS (SELECT * FROM masks WHERE {ring_sql('latitude', 'longitude')})"


@query(f"WITH {GRID_SQL} SELECT DISTINCT latitude, longitude FROM grid_obs WHERE {ring_sql('latitude', 'longitude')}")
def point_in_polygon(spark: SparkSession, sf: str) -> DataFrame:
    return grid_obs(spark, sf).select("latitude", "longitude").distinct().where(C.in_polygon(F.col("latitude"), F.col("longitude"), RING))


@query(f"WITH {INSIDE_SQL} SELECT count(*) AS n_points, min(a) AS date_min, max(b) AS date_max, coalesce(round(avg(v), 6), 0) AS avg_variables FROM (SELECT min(date) AS a, max(date) AS b, count(DISTINCT variable) AS v FROM own GROUP BY latitude, longitude)")
def region_summary(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.region_summary(masks_of(spark, sf), RING)


@query(f"WITH {INSIDE_SQL}, d AS (SELECT date, count(DISTINCT (latitude, longitude)) AS cells FROM own WHERE variable = 'total_precipitation' AND mask & 255 > 0 GROUP BY date), n AS (SELECT count(DISTINCT (latitude, longitude)) AS n FROM own WHERE variable = 'total_precipitation' AND mask & 255 > 0) SELECT date, cells, round((1 - cells / n) * 100, 2) AS missing_pct FROM d, n WHERE cells < n")
def region_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.region_gaps(masks_of(spark, sf).where("variable = 'total_precipitation' and mask & 255 > 0"), RING)


@query(f"WITH {MASKS_SQL} SELECT count(*) AS entries, count(DISTINCT (latitude, longitude)) AS cells, count(DISTINCT date) AS dates, count(DISTINCT variable) AS variables FROM masks")
def coverage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.stats(masks_of(spark, sf))


REQUEST_SQL = MASKS_SQL + ", request AS (SELECT latitude, longitude, date, variable, 1052672 AS requested_mask FROM (SELECT DISTINCT latitude, longitude FROM grid_obs) CROSS JOIN (SELECT DISTINCT date FROM grid_obs) CROSS JOIN (SELECT unnest(['temperature_2m', 'total_precipitation', 'snow']) AS variable)), missing AS (SELECT latitude, longitude, date, variable, requested_mask, (requested_mask & ~coalesce(mask, 0))::INT AS missing_mask FROM request LEFT JOIN masks USING (latitude, longitude, date, variable) WHERE requested_mask & ~coalesce(mask, 0) <> 0)"


def request_of(spark: SparkSession, sf: str) -> DataFrame:
    """Hours 12 and 20 of three variables everywhere on the days and in the box that the grid has."""
    g = grid_obs(spark, sf).agg(F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.min("latitude").alias("south"), F.max("longitude").alias("east"), F.min("date").alias("start"), F.max("date").alias("end"))
    rows = g.withColumns({"variables": F.array(*map(F.lit, ("temperature_2m", "total_precipitation", "snow"))), "hours": F.array(F.lit(12), F.lit(20))})
    return requests.expand(rows, RES, disjoint=True)


@query(f"WITH {REQUEST_SQL} SELECT * FROM request")
def request_expand(spark: SparkSession, sf: str) -> DataFrame:
    return request_of(spark, sf)


@query(f"WITH {REQUEST_SQL} SELECT * FROM missing")
def coverage_diff(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.diff(request_of(spark, sf), masks_of(spark, sf))


@query(f"WITH {REQUEST_SQL}, a AS (SELECT count(*) AS requested_cells, sum(bit_count(requested_mask))::BIGINT AS requested_hours FROM request), b AS (SELECT count(*) AS missing_cells, coalesce(sum(bit_count(missing_mask)), 0)::BIGINT AS missing_hours FROM missing) SELECT *, round((1 - missing_cells / requested_cells) * 100, 2) AS savings_pct, floor(missing_cells / requested_cells * 1000000)::BIGINT AS missing_bytes FROM a, b")
def diff_preview(spark: SparkSession, sf: str) -> DataFrame:
    asked = request_of(spark, sf)
    return requests.diff_preview(asked, coverage.diff(asked, masks_of(spark, sf)), 1_000_000)


@query(f"WITH {REQUEST_SQL} SELECT * FROM missing ORDER BY latitude, longitude, date, variable LIMIT 100")
def missing_sample(spark: SparkSession, sf: str) -> DataFrame:
    return requests.missing_sample(coverage.diff(request_of(spark, sf), masks_of(spark, sf)))


COMPONENTS_SQL = f"""WITH RECURSIVE {GRID_SQL}, cells AS MATERIALIZED (SELECT DISTINCT round(latitude / 0.25)::INT AS i, round(longitude / 0.25)::INT AS j, date, hour_utc FROM grid_obs WHERE total_precipitation > 40),
reach AS (SELECT date, hour_utc, i, j, i AS a, j AS b FROM cells UNION SELECT r.date, r.hour_utc, r.i, r.j, c.i, c.j FROM reach r JOIN cells c ON r.date = c.date AND r.hour_utc = c.hour_utc AND abs(r.a - c.i) + abs(r.b - c.j) = 1),
named AS (SELECT date, hour_utc, i, j, min((a, b)) AS root FROM reach GROUP BY ALL)
SELECT date, hour_utc, round((max(i) + 0.5) * 0.25, 6)::DOUBLE AS north, round((min(j) - 0.5) * 0.25, 6)::DOUBLE AS west, round((min(i) - 0.5) * 0.25, 6)::DOUBLE AS south, round((max(j) + 0.5) * 0.25, 6)::DOUBLE AS east, count(*) AS n_cells FROM named GROUP BY date, hour_utc, root"""


@query(COMPONENTS_SQL)
def components(spark: SparkSession, sf: str) -> DataFrame:
    wet = grid_obs(spark, sf).where("total_precipitation > 40").select("date", "hour_utc", C.cell_index("latitude", RES).alias("i"), C.cell_index("longitude", RES).alias("j"))
    group = ["date", "hour_utc"]
    return requests.component_boxes(requests.cell_components(wet, group), group, RES).drop("component")


CHUNKS_SQL = f"""WITH RECURSIVE {REQUEST_SQL}, m AS MATERIALIZED (SELECT year(date)::INT AS year, month(date)::INT AS month, variable, round(latitude / 0.25)::INT AS i, round(longitude / 0.25)::INT AS j, day(date)::INT AS day, missing_mask FROM missing),
cells AS MATERIALIZED (SELECT DISTINCT year, month, variable, i, j FROM m),
reach AS (SELECT year, month, variable, i, j, i AS a, j AS b FROM cells UNION SELECT r.year, r.month, r.variable, r.i, r.j, c.i, c.j FROM reach r JOIN cells c ON r.year = c.year AND r.month = c.month AND r.variable = c.variable AND abs(r.a - c.i) + abs(r.b - c.j) = 1),
named AS (SELECT year, month, variable, i, j, min((a, b)) AS root FROM reach GROUP BY ALL),
boxes AS (SELECT year, month, variable, root, round((max(i) + 0.5) * 0.25, 6)::DOUBLE AS north, round((min(j) - 0.5) * 0.25, 6)::DOUBLE AS west, round((min(i) - 0.5) * 0.25, 6)::DOUBLE AS south, round((max(j) + 0.5) * 0.25, 6)::DOUBLE AS east, count(*) AS n_cells FROM named GROUP BY ALL),
days AS (SELECT year, month, variable, root, array_to_string(list_sort(list(DISTINCT day)), ',') AS days, bit_or(missing_mask)::INT AS hours_mask FROM m JOIN named USING (year, month, variable, i, j) GROUP BY ALL)
SELECT year, month, variable, north, west, south, east, n_cells, days, hours_mask FROM boxes JOIN days USING (year, month, variable, root)"""


@query(CHUNKS_SQL)
def missing_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = requests.missing_chunks(coverage.diff(request_of(spark, sf), masks_of(spark, sf)), RES)
    return chunks.select("year", "month", "variable", "north", "west", "south", "east", "n_cells", F.array_join(F.transform("days", lambda d: d.cast("string")), ",").alias("days"), "hours_mask")


# --- requests and rectangles ----------------------------------------------------------------------------------


@query("SELECT o_orderkey AS request_id, year(d)::INT AS year, month(d)::INT AS month, min(d)::DATE AS first_day, max(d)::DATE AS last_day, count(*) AS n_days FROM (SELECT o_orderkey, unnest(generate_series(o_orderdate::DATE, o_orderdate::DATE + (o_custkey % 70)::INT, INTERVAL 1 DAY)) AS d FROM orders) GROUP BY ALL")
def month_plan(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return requests.months(read(spark, sf, "orders").select(F.col("o_orderkey").alias("request_id"), day.alias("start"), F.date_add(day, (F.col("o_custkey") % 70).cast("int")).alias("end")))


ESTIMATE_SQL = BOXES_SQL + ", e AS (SELECT *, ((ceil(round((north - south) / 0.25, 9)) + 1) * (ceil(round((east - west) / 0.25, 9)) + 1))::BIGINT AS points, (n_variables * n_hours * n_days)::INT AS fields FROM boxes)"


@query(f"WITH {ESTIMATE_SQL} SELECT o_orderkey, points, fields, points * fields * 8 AS bytes, points * fields * 8 > 1000000 OR fields > 1000 AS too_large FROM e")
def size_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return requests.estimate(boxes(spark, sf), RES, 1_000_000, 1000).select("o_orderkey", "points", "fields", "bytes", "too_large")


@query(f"WITH {ESTIMATE_SQL}, k AS (SELECT *, greatest(1, least(floor(200000.0 / (n_variables * n_hours * points * 8)), floor(600.0 / (n_variables * n_hours)))) AS k FROM e), d AS (SELECT o_orderkey AS request_id, k, unnest(range(1, n_days + 1)) AS day FROM k) SELECT request_id, floor((day - 1) / k)::INT AS block, min(day)::INT AS first_day, max(day)::INT AS last_day FROM d GROUP BY ALL")
def pack_days(spark: SparkSession, sf: str) -> DataFrame:
    e = requests.estimate(boxes(spark, sf), RES).withColumnRenamed("o_orderkey", "request_id")
    return requests.pack_days(e, most_bytes=200_000, most_fields=600)


@query(f"""WITH {BOXES_SQL}, p AS (SELECT *, ceil(sqrt(7))::INT AS longer, ceil(7 / ceil(sqrt(7)))::INT AS shorter FROM boxes), q AS (SELECT *, CASE WHEN north - south >= east - west THEN longer ELSE shorter END AS ny, CASE WHEN north - south >= east - west THEN shorter ELSE longer END AS nx FROM p), y AS (SELECT *, unnest(range(ny)) AS y FROM q), x AS (SELECT *, unnest(range(nx)) AS x FROM y)
SELECT o_orderkey, round(south + (north - south) / ny * (y + 1), 6) AS north, round(west + (east - west) / nx * x, 6) AS west, round(south + (north - south) / ny * y, 6) AS south, round(west + (east - west) / nx * (x + 1), 6) AS east FROM x""")
def split_area(spark: SparkSession, sf: str) -> DataFrame:
    return requests.split_area(boxes(spark, sf).select("o_orderkey", "north", "west", "south", "east"), 7)


#: All boxes lie on a grid of 0.25 degrees: the oracle counts its cells.
CELLS_SQL = BOXES_SQL + ", c AS (SELECT DISTINCT key, y, x FROM (SELECT key, x, unnest(range((south * 4)::INT, (north * 4)::INT)) AS y FROM (SELECT *, unnest(range((west * 4)::INT, (east * 4)::INT)) AS x FROM boxes)))"


@query(f"WITH {CELLS_SQL} SELECT key, round(count(*) * 0.0625, 6)::DOUBLE AS area FROM c GROUP BY key")
def rect_union_area(spark: SparkSession, sf: str) -> DataFrame:
    return requests.union_area(boxes(spark, sf), "key")


@query(f"WITH {CELLS_SQL}, held AS (SELECT key, count(*) AS n FROM c WHERE y BETWEEN 4 AND 35 AND x BETWEEN 4 AND 31 GROUP BY key), k AS (SELECT DISTINCT key FROM boxes) SELECT key, round((32 * 28 - coalesce(n, 0)) * 0.0625, 6)::DOUBLE AS area FROM k LEFT JOIN held USING (key) WHERE 32 * 28 > coalesce(n, 0)")
def rect_subtract(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes(spark, sf)
    targets = b.select("key").distinct().select("key", F.lit(9.0).alias("north"), F.lit(1.0).alias("west"), F.lit(1.0).alias("south"), F.lit(8.0).alias("east"))
    left = requests.residual(targets, b.select("key", "north", "south", "west", "east"), "key")
    return left.groupBy("key").agg(F.round(F.sum((F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))), 6).alias("area"))


# --- stations -------------------------------------------------------------------------------------------------

YEARS_SQL = STATION_SQL + ", years AS (SELECT station_id, extract(year FROM date)::INT AS year, count(*) AS n_rows, min(date) AS date_min, max(date) AS date_max, concat_ws(',', " + ", ".join(f"CASE WHEN count({c}) > 0 THEN '{c}' END" for c in EVENT_TYPES) + ") AS vars, " + " + ".join(f"(count({c}) > 0)::INT" for c in EVENT_TYPES) + " AS n FROM station_obs GROUP BY ALL)"


def years_of(spark: SparkSession, sf: str) -> DataFrame:
    return stations.station_years(station_obs(spark, sf).withColumn("year", F.year("date")), list(EVENT_TYPES))


@query(f"WITH {YEARS_SQL} SELECT station_id, year, n_rows, date_min, date_max, vars FROM years")
def station_index(spark: SparkSession, sf: str) -> DataFrame:
    return years_of(spark, sf).withColumn("vars", F.array_join("vars", ","))


@query(f"WITH {YEARS_SQL}, {DIM_SQL} SELECT station_id, altitude, uf, regiao, y.year_min, y.year_max, coalesce(y.n_years, 0) AS n_years, y.date_min, y.date_max, coalesce(y.n_vars, 0)::INT AS n_vars FROM station_dim LEFT JOIN (SELECT station_id, min(year) AS year_min, max(year) AS year_max, count(*) AS n_years, min(date_min) AS date_min, max(date_max) AS date_max, max(n) AS n_vars FROM years GROUP BY 1) y USING (station_id)")
def station_list(spark: SparkSession, sf: str) -> DataFrame:
    return stations.station_list(station_dim(spark, sf), years_of(spark, sf))


STATUS_SQL = """years AS (SELECT 'S' || o_custkey % (year(o_orderdate) - 1991) AS station_id, year(o_orderdate)::INT AS year, max(o_orderdate::DATE) AS date_max FROM orders GROUP BY ALL),
s AS (SELECT year, count(*) AS stations, sum((date_max >= make_date(year, 12, 31))::INT)::BIGINT AS complete, min(date_max) AS earliest_end, max(date_max) AS latest_end FROM years GROUP BY year)"""


@query(f"WITH {STATUS_SQL} SELECT year, stations, complete, earliest_end, latest_end, CASE WHEN year = 1997 THEN 'current' WHEN complete = stations THEN 'complete' WHEN complete = 0 THEN 'stale' ELSE 'partial' END AS status, d.downloaded_at FROM s LEFT JOIN (SELECT (1992 + c_custkey % 5)::INT AS year, max(c_custkey) AS downloaded_at FROM customer GROUP BY 1) d USING (year)")
def year_status(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("o_orderdate")
    rows = read(spark, sf, "orders").select(F.concat(F.lit("S"), F.pmod(F.col("o_custkey"), year - 1991)).alias("station_id"), year.alias("year"), F.col("o_orderdate").cast("date").alias("date"), "o_totalprice")
    fetched = read(spark, sf, "customer").select((1992 + F.col("c_custkey") % 5).cast("int").alias("year"), F.col("c_custkey").alias("completed_at"))
    return stations.classified(stations.year_status(stations.station_years(rows, ["o_totalprice"])), 1997, fetched)


@query("SELECT 'S' || (o_custkey % 40) AS station_id, arg_max(round(o_totalprice, 2), (year(o_orderdate), round(o_totalprice, 2))) AS altitude FROM orders GROUP BY 1")
def station_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") % 40).cast("string")).alias("station_id"), F.year("o_orderdate").alias("year"), F.round("o_totalprice", 2).alias("altitude"))
    return stations.latest_metadata(rows, ["altitude"])


# --- joins ----------------------------------------------------------------------------------------------------


@query("SELECT e.event_id AS e_event_id, c.c_custkey AS c_c_custkey FROM events e JOIN customer c ON e.user_id = c.c_custkey AND abs(e.value - c.c_acctbal / 100) < 5.0")
def band_join(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").withColumn("v", F.col("c_acctbal") / 100)
    return joins.build_view([joins.Source(read(spark, sf, "events"), "e", ["event_id"]), joins.Source(c, "c", ["c_custkey"], [("e.user_id", "c_custkey")], [("e.value", "v", 5.0)])])


@query("SELECT p.p_partkey AS a, s.s_suppkey AS b FROM part p JOIN supplier s ON abs(p.p_retailprice - s.s_acctbal) < 3.0")
def band_join_only(spark: SparkSession, sf: str) -> DataFrame:
    return joins.band_join(read(spark, sf, "part"), read(spark, sf, "supplier"), [], [("p_retailprice", "s_acctbal", 3.0)]).select(F.col("p_partkey").alias("a"), F.col("s_suppkey").alias("b"))


CORNER_SQL = LATEST_SQL + ", " + STATION_SQL + """, own AS (SELECT *, floor(latitude / 0.25)::INT AS i, floor(longitude / 0.25)::INT AS j FROM station_obs), nodes AS (SELECT date, hour_utc, round(latitude / 0.25)::INT AS i, round(longitude / 0.25)::INT AS j, temperature_2m AS t FROM latest),
cornered AS (SELECT o.*, longitude / 0.25 - o.j AS wx, latitude / 0.25 - o.i AS wy, bl.t AS bl, br.t AS br, tl.t AS tl, tr.t AS tr FROM own o
LEFT JOIN nodes bl ON bl.date = o.date AND bl.hour_utc = o.hour_utc AND bl.i = o.i AND bl.j = o.j LEFT JOIN nodes br ON br.date = o.date AND br.hour_utc = o.hour_utc AND br.i = o.i AND br.j = o.j + 1
LEFT JOIN nodes tl ON tl.date = o.date AND tl.hour_utc = o.hour_utc AND tl.i = o.i + 1 AND tl.j = o.j LEFT JOIN nodes tr ON tr.date = o.date AND tr.hour_utc = o.hour_utc AND tr.i = o.i + 1 AND tr.j = o.j + 1),
meshed AS (SELECT *, (1 - wx) * (1 - wy) * bl + wx * (1 - wy) * br + (1 - wx) * wy * tl + wx * wy * tr AS grid FROM cornered)"""


def cornered(spark: SparkSession, sf: str) -> DataFrame:
    return joins.interpolated(joins.corner_join(station_obs(spark, sf), grid_latest(spark, sf), RES, ["temperature_2m"]), ["temperature_2m"])


@query(f"WITH {CORNER_SQL} SELECT station_id, date, hour_utc, wx, wy, round(bl, 4) AS bl, round(br, 4) AS br, round(tl, 4) AS tl, round(tr, 4) AS tr FROM meshed")
def corner_join(spark: SparkSession, sf: str) -> DataFrame:
    return cornered(spark, sf).select("station_id", "date", "hour_utc", "wx", "wy", *[r(f"temperature_2m_{n}").alias(n) for n in ("bl", "br", "tl", "tr")])


@query(f"WITH {CORNER_SQL} SELECT station_id, date, hour_utc, round(view - grid, 4) AS difference FROM meshed WHERE view IS NOT NULL AND grid IS NOT NULL")
def obs_minus_grid(spark: SparkSession, sf: str) -> DataFrame:
    out = cornered(spark, sf).withColumn("difference", r(F.col("view") - F.col("temperature_2m_grid")))
    return out.where("difference is not null").select("station_id", "date", "hour_utc", "difference")


@query(f"WITH {LATEST_SQL} SELECT a.date, count(*) AS n, round(sum(a.temperature_2m - b.temperature_2m), 2) AS difference FROM latest a JOIN latest b ON a.date = b.date AND a.latitude = b.latitude AND a.longitude = b.longitude AND a.hour_utc = (b.hour_utc + 1) % 24 GROUP BY a.date")
def grid_vs_grid(spark: SparkSession, sf: str) -> DataFrame:
    g = grid_latest(spark, sf).withColumns({"i": C.cell_index("latitude", RES), "j": C.cell_index("longitude", RES)})
    a, b = g.select("date", "i", "j", F.col("hour_utc").alias("h"), F.col("temperature_2m").alias("a")), g.select("date", "i", "j", ((F.col("hour_utc") + 1) % 24).alias("h"), F.col("temperature_2m").alias("b"))
    return a.join(b, ["date", "i", "j", "h"]).groupBy("date").agg(F.count("*").alias("n"), r(F.sum(F.col("a") - F.col("b")), 2).alias("difference"))


# --- aggregates and series ------------------------------------------------------------------------------------


@query("SELECT ts::DATE AS date, event_type, round(avg(value), 7) AS mean, round(min(value), 4) AS least, round(max(value), 4) AS most, round(stddev_samp(value), 7) AS spread, count(*) AS n FROM events GROUP BY ALL")
def daily_mean(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events")
    return e.groupBy(F.to_date("ts").alias("date"), "event_type").agg(r(F.avg("value"), 7).alias("mean"), r(F.min("value")).alias("least"), r(F.max("value")).alias("most"), r(F.stddev_samp("value"), 7).alias("spread"), F.count("*").alias("n"))


@query(f"WITH {GRID_SQL} SELECT round(latitude) AS lat, round(longitude) AS lon, round(avg(temperature_2m), 4) AS mean, count(*) AS n FROM grid_obs GROUP BY 1, 2")
def spatial_agg(spark: SparkSession, sf: str) -> DataFrame:
    return grid_obs(spark, sf).groupBy(F.round("latitude").alias("lat"), F.round("longitude").alias("lon")).agg(r(F.avg("temperature_2m")).alias("mean"), F.count("*").alias("n"))


@query(f"WITH {GRID_SQL} SELECT date, round(sum(total_precipitation), 3) AS total FROM grid_obs GROUP BY date HAVING sum(total_precipitation) > 10 ORDER BY total DESC, date LIMIT 10")
def topk_wet_days(spark: SparkSession, sf: str) -> DataFrame:
    wet = grid_obs(spark, sf).groupBy("date").agg(r(F.sum("total_precipitation"), 3).alias("total"))
    return wet.where("total > 10").orderBy(F.desc("total"), "date").limit(10)


@query("SELECT extract(year FROM o_orderdate)::INT AS year, extract(month FROM o_orderdate)::INT AS month, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY ALL")
def year_month(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 6).alias("mean"))


@query(f"WITH {GRID_SQL} SELECT DISTINCT latitude, longitude FROM grid_obs")
def distinct_points(spark: SparkSession, sf: str) -> DataFrame:
    return grid_obs(spark, sf).select("latitude", "longitude").distinct()


@query("SELECT event_type, count(*) AS n, round(max(value), 4) AS most FROM events WHERE value > 5 AND (event_type = 'click' OR event_type LIKE 'v%' OR user_id IN (1, 2, 3)) GROUP BY event_type")
def visual_query(spark: SparkSession, sf: str) -> DataFrame:
    where = {"op": "and", "items": [("value", ">", 5), {"op": "or", "items": [("event_type", "=", "click"), ("event_type", "like", "v%"), ("user_id", "in", [1, 2, 3])]}]}
    e = read(spark, sf, "events").withColumn("value", r("value"))
    return catalog.visual_query(e, where=where, group_by=["event_type"], aggregates=[("count", "*", "n"), ("max", "value", "most")], order=("n", True))


def _series(level: str, sql: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = read(spark, sf, "events")
        return timeseries.series(e, "value", level, where=F.col("event_type") == "view", start=dt.date(2024, 1, 3), end=dt.date(2024, 1, 28), ts=F.col("ts")).select("ts", r("y").alias("y"))

    run.__name__ = f"series_{level}"
    query(f"SELECT {sql} AS ts, round(avg(value), 4) AS y FROM events WHERE event_type = 'view' AND ts::DATE BETWEEN DATE '2024-01-03' AND DATE '2024-01-28' GROUP BY 1")(run)


for _level in timeseries.LEVELS:
    _series(_level, "ts" if _level == "raw" else f"date_trunc('{_level}', ts)::TIMESTAMP")


@query("WITH n AS (SELECT count(DISTINCT ts) AS raw, count(DISTINCT date_trunc('hour', ts)) AS hour, count(DISTINCT date_trunc('day', ts)) AS day FROM events), l AS (SELECT CASE WHEN raw <= 600 THEN 'raw' WHEN hour <= 600 THEN 'hour' WHEN day <= 600 THEN 'day' ELSE 'month' END AS level FROM n) SELECT CASE level WHEN 'raw' THEN ts ELSE date_trunc(level, ts) END::TIMESTAMP AS ts, round(avg(value), 4) AS y FROM events, l GROUP BY 1")
def series_capped(spark: SparkSession, sf: str) -> DataFrame:
    out, _, _ = timeseries.capped(read(spark, sf, "events"), "value", 600, ts=F.col("ts"))
    return out.select("ts", r("y").alias("y"))


@query("WITH m AS (SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS ts, round(avg(o_totalprice), 3) AS y FROM orders GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS rn, greatest(2, ceil(count(*) OVER () / 25)) AS step FROM m) SELECT ts, y FROM n WHERE rn % step = 0")
def series_stride(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp_ntz"))
    out, _, _ = timeseries.capped(o, "o_totalprice", 25, level="month", ts=F.col("ts"))
    return out.select("ts", r("y", 3).alias("y"))


@query("SELECT event_type, count(value) AS n, round(min(value), 4) AS min, round(max(value), 4) AS max, round(avg(value), 4) AS mean, round(var_samp(value), 3) AS var, round(stddev_samp(value), 4) AS std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) AS iqr FROM events GROUP BY event_type")
def series_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = timeseries.statistics(read(spark, sf, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *[r(c, 3 if c == "var" else 4).alias(c) for c in ("min", "max", "mean", "var", "std", "iqr")])


@query(f"WITH {STATION_SQL} SELECT 'clicks' AS series, date_trunc('day', date)::TIMESTAMP AS ts, round(avg(click), 4) AS y FROM station_obs WHERE station_id = 'S3' GROUP BY ALL UNION ALL SELECT 'views', date_trunc('day', date)::TIMESTAMP, round(max(view), 4) FROM station_obs WHERE station_id IN ('S1', 'S2') GROUP BY ALL")
def series_many(spark: SparkSession, sf: str) -> DataFrame:
    own = station_obs(spark, sf)
    specs = [timeseries.Series("clicks", own, "click", where=timeseries.location({"kind": "station", "id": "S3"}, False)), timeseries.Series("views", own, "view", "max", where=timeseries.location({"kind": "stations", "ids": ["S1", "S2"]}, False))]
    out, errors = timeseries.many(specs)
    if errors:
        raise ValueError(str(errors))
    return out.select("series", "ts", r("y").alias("y"))


@query(f"WITH {GRID_SQL} SELECT variable, n, date_min, date_max FROM (UNPIVOT (SELECT min(date) AS date_min, max(date) AS date_max, {', '.join(f'count({c}) AS {c}' for c in VARIABLES)} FROM grid_obs) ON {', '.join(VARIABLES)} INTO NAME variable VALUE n)")
def series_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.metadata(grid_obs(spark, sf).drop("seq"), ("latitude", "longitude", "hour_utc", "date"))


# --- regions --------------------------------------------------------------------------------------------------


def members_of(spark: SparkSession, sf: str) -> DataFrame:
    """Two regions of the test grid: the ring, and a square with a square hole."""
    square = [(-23.6, -49.7), (-21.4, -49.7), (-21.4, -47.4), (-23.6, -47.4)]
    hole = [(-22.8, -49.1), (-22.1, -49.1), (-22.1, -48.1), (-22.8, -48.1)]
    rows = [(g, k, n, y, x) for g, k, ring in (("ring", 0, RING), ("square", 0, square), ("square", 1, hole)) for n, (y, x) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "region string, ring int, n int, lat double, lon double")
    return regions.membership(grid_obs(spark, sf).select(F.lit("era5").alias("dataset"), "latitude", "longitude").distinct(), vertices)


MEMBERS_SQL = GRID_SQL + f", nodes AS (SELECT DISTINCT latitude, longitude FROM grid_obs), members AS (SELECT 'era5' AS dataset, 'ring' AS region, * FROM nodes WHERE {ring_sql('latitude', 'longitude')} UNION ALL SELECT 'era5', 'square', * FROM nodes WHERE latitude BETWEEN -23.6 AND -21.4 AND longitude BETWEEN -49.7 AND -47.4 AND NOT (latitude BETWEEN -22.8 AND -22.1 AND longitude BETWEEN -49.1 AND -48.1))"


@query(f"WITH {MEMBERS_SQL} SELECT * FROM members")
def region_membership(spark: SparkSession, sf: str) -> DataFrame:
    return members_of(spark, sf)


@query(f"WITH {MEMBERS_SQL} SELECT dataset, region, count(*) AS cells FROM members GROUP BY ALL")
def region_counts(spark: SparkSession, sf: str) -> DataFrame:
    return regions.counts(members_of(spark, sf))


@query(f"WITH {MEMBERS_SQL} SELECT g.date, count(*) AS n, round(sum(g.temperature_2m), 2) AS total FROM grid_obs g WHERE (latitude, longitude) IN (SELECT (latitude, longitude) FROM members) GROUP BY g.date")
def region_clip(spark: SparkSession, sf: str) -> DataFrame:
    keep = regions.keep_set(members_of(spark, sf), "era5", ["ring", "square"])
    return regions.clip(grid_obs(spark, sf), keep, RES).groupBy("date").agg(F.count("*").alias("n"), r(F.sum("temperature_2m"), 2).alias("total"))


@query(f"WITH {BOXES_SQL} SELECT key, max(north) AS north, min(west) AS west, min(south) AS south, max(east) AS east FROM boxes GROUP BY key")
def bbox_union(spark: SparkSession, sf: str) -> DataFrame:
    return regions.union_box(boxes(spark, sf), "key")


# --- modelling ------------------------------------------------------------------------------------------------


@query(f"WITH {CORNER_SQL} SELECT station_id, date, hour_utc, extract(month FROM date)::INT AS month, extract(doy FROM date)::INT AS day_of_year, round(grid, 4) AS grid FROM meshed WHERE view IS NOT NULL AND grid IS NOT NULL")
def features(spark: SparkSession, sf: str) -> DataFrame:
    out = ml.features(cornered(spark, sf), ["view", "temperature_2m_grid"])
    return out.select("station_id", "date", "hour_utc", "month", "day_of_year", r("temperature_2m_grid").alias("grid"))


SPLIT_SQL = "ranked AS (SELECT event_id, value, ts::DATE AS date, row_number() OVER (ORDER BY ts::DATE DESC, event_id DESC) AS k, count(*) OVER () AS n FROM events), parted AS (SELECT event_id, value, k <= greatest(1, floor(n * 0.2)) AS is_test FROM ranked)"


@query(f"WITH {SPLIT_SQL} SELECT event_id, is_test FROM parted")
def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").withColumn("date", F.to_date("ts"))
    return ml.temporal_split(e, 0.2, ["date", "event_id"]).select("event_id", "is_test")


@query(f"WITH {CORNER_SQL}, e AS (SELECT view AS a, grid AS p FROM meshed WHERE view IS NOT NULL AND grid IS NOT NULL) SELECT round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(avg(abs(a - p)), 6) AS mae, round(1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*)), 6) AS r2 FROM e")
def residual_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = ml.metrics(cornered(spark, sf), "view", "temperature_2m_grid")
    return m.select(*[r(c, 6).alias(c) for c in ("rmse", "mae", "r2")])


@query(f"WITH {CORNER_SQL} SELECT count(*) AS n_rows, count(view) AS n_view, count(bl) AS n_bl, count(CASE WHEN view IS NOT NULL AND bl IS NOT NULL THEN 1 END) AS complete FROM meshed")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return ml.gate(cornered(spark, sf).withColumnRenamed("temperature_2m_bl", "bl"), ["view", "bl"])


@query("SELECT event_type, date, round(y, 7) AS y, round(avg(y) OVER (PARTITION BY event_type ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 7) AS week FROM (SELECT event_type, ts::DATE AS date, avg(value) AS y FROM events GROUP BY ALL)")
def moving_mean(spark: SparkSession, sf: str) -> DataFrame:
    daily = read(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("date")).agg(F.avg("value").alias("y"))
    week = F.avg("y").over(Window.partitionBy("event_type").orderBy("date").rowsBetween(-6, 0))
    return daily.select("event_type", "date", r("y", 7).alias("y"), r(week, 7).alias("week"))


from isotherm.plans import lookups, modelled, planned, stored  # noqa: E402, F401  they add their queries
