"""Queries of the smaller operators: manifests, requests, stations, two grids, places, regions, users' objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions import columns as C
from isotherm.model import DATASETS, merged_catalogue
from isotherm.operators import catalog, coverage, joins, ml, regions, requests, stations, storage, timeseries
from isotherm.plans.fixtures import BOXES_SQL, DIM_SQL, GRID_SQL, LATEST_SQL, STATION_SQL, VARIABLES, boxes, grid_latest, grid_obs, read, station_dim, station_obs
from isotherm.plans.queries import ESTIMATE_SQL, KEYS, MASKS_SQL, MEMBERS_SQL, RES, YEARS_SQL, masks_of, members_of, r, years_of
from isotherm.plans.registry import query

# --- transforms -----------------------------------------------------------------------------------------------


@query(f"WITH {GRID_SQL} SELECT date, max(temperature_2m) AS t2m, min(total_precipitation) AS tp FROM grid_obs GROUP BY date")
def renamed_columns(spark: SparkSession, sf: str) -> DataFrame:
    raw = grid_obs(spark, sf).withColumns({"number": F.lit(0), "expver": F.lit("1")})
    short = C.drop_unused(C.rename(raw, {"temperature_2m": "t2m", "total_precipitation": "tp", "absent": "x"}))
    if "number" in short.columns or "expver" in short.columns:
        raise ValueError("unused columns are left")
    return short.groupBy("date").agg(F.max("t2m").alias("t2m"), F.min("tp").alias("tp"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal / 100 END AS y, c_acctbal / 50 - 100 AS x FROM customer),
e AS (SELECT *, round(floor(y / 0.25) * 0.25, 2) AS b25, round(floor(x / 0.25) * 0.25, 2) AS l25, round(floor(y / 0.1) * 0.1, 1) AS b1, round(floor(x / 0.1) * 0.1, 1) AS l1 FROM c)
SELECT c_custkey, b25::FLOAT AS era5_lat_bottom, round(b25 + 0.25, 2)::FLOAT AS era5_lat_top, l25::FLOAT AS era5_lon_left, round(l25 + 0.25, 2)::FLOAT AS era5_lon_right,
b1::FLOAT AS era5_land_lat_bottom, round(b1 + 0.1, 1)::FLOAT AS era5_land_lat_top, l1::FLOAT AS era5_land_lon_left, round(l1 + 0.1, 1)::FLOAT AS era5_land_lon_right FROM e""")
def corner_edges(spark: SparkSession, sf: str) -> DataFrame:
    places = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal") / 100).alias("latitude"), (F.col("c_acctbal") / 50 - 100).alias("longitude"))
    return places.select("c_custkey", *[v.alias(k) for k, v in C.corner_edges().items()])


# --- manifests and requests -----------------------------------------------------------------------------------

#: Chunks of a month: orders; they have days 1 to 20 or all, hours 0 to 11 or all, and two of three variables.
CHUNK_SQL = """chunks AS (SELECT o_orderkey AS chunk_id, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, o_custkey % 3 AS without, o_custkey % 2 AS half, o_custkey % 5 AS few, (o_custkey % 9 + 4)::DOUBLE AS north, (o_custkey % 7)::DOUBLE AS west, (o_custkey % 9)::DOUBLE AS south, (o_custkey % 7 + 5)::DOUBLE AS east FROM orders)"""
NAMES = ("tp", "t2m", "u10")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_custkey")
    names = F.array(*map(F.lit, NAMES))
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("chunk_id"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), F.array_remove(names, F.get(names, (k % 3).cast("int"))).alias("variables"),
        F.sequence(F.lit(1), F.when(k % 2 == 1, 20).otherwise(31)).alias("days"), F.sequence(F.lit(0), F.when(k % 5 == 0, 11).otherwise(23)).alias("hours"),
        (k % 9 + 4).cast("double").alias("north"), (k % 7).cast("double").alias("west"), (k % 9).cast("double").alias("south"), (k % 7 + 5).cast("double").alias("east"),
    )


ASKED_SQL = CHUNK_SQL + ", asked AS (SELECT year, month, unnest([0, 1, 2]) AS v FROM (SELECT DISTINCT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders))"


@query(f"WITH {ASKED_SQL} SELECT a.year * 100 + a.month AS request_id, ['tp', 't2m', 'u10'][a.v + 1] AS variable, count(*) AS n, min(c.north) AS north FROM asked a JOIN chunks c ON a.year = c.year AND a.month = c.month AND c.without <> a.v AND c.half = 0 AND c.few > 0 GROUP BY ALL")
def covering_chunks(spark: SparkSession, sf: str) -> DataFrame:
    months = read(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).distinct()
    asked = months.withColumn("variable", F.explode(F.array(*map(F.lit, NAMES))))
    asked = asked.select(F.struct((F.col("year") * 100 + F.col("month")).alias("id"), "variable").alias("request_id"), "year", "month", "variable", F.sequence(F.lit(1), F.lit(28)).alias("days"), F.sequence(F.lit(0), F.lit(12)).alias("hours"))
    found = storage.covering(asked, chunks(spark, sf))
    return found.groupBy(F.col("request_id.id").alias("request_id"), F.col("request_id.variable").alias("variable")).agg(F.count("*").alias("n"), F.min("north").alias("north"))


@query(f"""WITH {ASKED_SQL}, cells AS (SELECT year, month, v, y, x FROM asked, (SELECT unnest(range(1, 13)) AS y), (SELECT unnest(range(0, 12)) AS x)),
held AS (SELECT DISTINCT c.year, c.month, c.v, c.y, c.x FROM cells c JOIN chunks k ON c.year = k.year AND c.month = k.month AND k.without <> c.v AND k.half = 0 AND k.few > 0 AND c.y >= k.south AND c.y < k.north AND c.x >= k.west AND c.x < k.east)
SELECT year, month, ['tp', 't2m', 'u10'][v + 1] AS variable, 1 AS first_day, day(last_day(make_date(year, month, 1)))::INT AS n_days, count(*)::DOUBLE AS area FROM (SELECT * FROM cells EXCEPT SELECT * FROM held) GROUP BY ALL""")
def incremental_plan(spark: SparkSession, sf: str) -> DataFrame:
    span = read(spark, sf, "orders").agg(F.trunc(F.min("o_orderdate").cast("date"), "month").alias("start"), F.last_day(F.max("o_orderdate").cast("date")).alias("end"))
    asked = span.select(F.lit(1).alias("request_id"), F.array(*map(F.lit, NAMES)).alias("variables"), "start", "end", F.sequence(F.lit(0), F.lit(23)).alias("hours"), F.lit(12.9).alias("north"), F.lit(0.1).alias("west"), F.lit(1.2).alias("south"), F.lit(11.8).alias("east"))
    plan = requests.incremental_plan(asked, chunks(spark, sf), 1.0)
    return plan.groupBy("year", "month", "variable").agg(F.min(F.get("days", F.lit(0))).alias("first_day"), F.max(F.size("days")).alias("n_days"), F.sum((F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))).alias("area"))


@query("SELECT o_orderkey, (((1.0 / 0.25)::INT + 1) * ((1.5 / 0.25)::INT + 1) * (o_custkey % 9 + 1) * 2)::BIGINT AS cells FROM orders")
def request_cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = boxes(spark, sf).select("o_orderkey", "north", "west", "south", "east", "start").join(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    rows = rows.withColumns({"end": F.date_add("start", (F.col("o_custkey") % 9).cast("int")), "variables": F.array(F.lit("a"), F.lit("b"))})
    return rows.select("o_orderkey", requests.cell_count(RES).cast("long").alias("cells"))


@query(f"WITH {ESTIMATE_SQL} SELECT count(*) AS requests, count(CASE WHEN points * fields * 8 > 1000000 OR fields > 1000 THEN 1 END) AS too_large, sum(fields)::BIGINT AS fields, sum(points * fields * 8)::BIGINT AS bytes FROM e")
def plan_totals(spark: SparkSession, sf: str) -> DataFrame:
    return requests.estimate_totals(requests.estimate(boxes(spark, sf), RES, 1_000_000, 1000))


@query("SELECT o_orderkey, greatest(2, ceil(round(o_custkey / 100.0 * 1.2, 9)))::BIGINT AS splits FROM orders")
def split_counts(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select("o_orderkey", requests.splits_needed(F.col("o_custkey") / 100).cast("long").alias("splits"))


@query("SELECT o_orderkey, unnest(range(o_custkey % 4))::BIGINT AS variable FROM orders WHERE o_custkey % 4 > 0")
def one_variable_requests(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_custkey") % 4
    rows = read(spark, sf, "orders").select("o_orderkey", F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).alias("variables"))
    return requests.by_variable(rows)


@query("SELECT DISTINCT unnest(range(year(o_orderdate), year(o_orderdate) + 1 + (o_custkey % 3)::INT))::INT AS year FROM orders")
def request_years(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return requests.years(read(spark, sf, "orders").select(day.alias("start"), F.add_months(day, (F.col("o_custkey") % 3 * 12).cast("int")).alias("end")))


# --- coverage and stations ------------------------------------------------------------------------------------


@query(f"WITH {GRID_SQL}, p AS (SELECT DISTINCT latitude, longitude FROM grid_obs), k AS (SELECT *, row_number() OVER (ORDER BY latitude, longitude) AS n FROM p WHERE latitude < -23) SELECT n::INT AS cell_id, latitude, longitude FROM k UNION ALL SELECT (row_number() OVER (ORDER BY latitude, longitude) + (SELECT max(n) FROM k))::INT, latitude, longitude FROM p WHERE latitude >= -23")
def cell_numbers(spark: SparkSession, sf: str) -> DataFrame:
    seen = grid_obs(spark, sf)
    none = spark.createDataFrame([], "cell_id int, latitude double, longitude double")
    return coverage.cell_ids(coverage.cell_ids(none, seen.where("latitude < -23")), seen)


@query(f"WITH {MASKS_SQL} SELECT min(date) AS date_min, max(date) AS date_max FROM masks")
def coverage_dates(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.date_range(masks_of(spark, sf))


@query(f"WITH {YEARS_SQL} SELECT station_id, year, n_rows, date_min, date_max FROM years WHERE station_id = 'S7'")
def station_detail(spark: SparkSession, sf: str) -> DataFrame:
    return stations.station_detail(years_of(spark, sf), "S7").drop("vars")


@query(f"WITH {YEARS_SQL} SELECT count(DISTINCT station_id) AS stations, count(*) AS station_years, sum(n_rows)::BIGINT AS n_rows, min(date_min) AS date_min, max(date_max) AS date_max FROM years")
def station_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stations.index_stats(years_of(spark, sf))


# --- two grids ------------------------------------------------------------------------------------------------


def corner_sql(alias: str, nodes: str, res: float) -> str:
    at = [(n, a, b) for n, (a, b) in joins.CORNER.items()]
    return " ".join(f"LEFT JOIN {nodes} {alias}{n} ON {alias}{n}.date = o.date AND {alias}{n}.hour_utc = o.hour_utc AND {alias}{n}.i = floor(o.latitude / {res}) + {a} AND {alias}{n}.j = floor(o.longitude / {res}) + {b}" for n, a, b in at)


#: The second grid has every other node, half a degree apart.
TWO_SQL = f"""{LATEST_SQL}, {STATION_SQL}, fine AS (SELECT date, hour_utc, round(latitude / 0.25)::INT AS i, round(longitude / 0.25)::INT AS j, temperature_2m AS t FROM latest),
coarse AS (SELECT date, hour_utc, round(latitude / 0.5)::INT AS i, round(longitude / 0.5)::INT AS j, temperature_2m AS t FROM latest WHERE round(latitude / 0.25) % 2 = 0 AND round(longitude / 0.25) % 2 = 0)
SELECT o.station_id, o.date, o.hour_utc, {', '.join(f'round(f{n}.t, 4) AS {n}_fine, round(c{n}.t, 4) AS {n}_coarse' for n in joins.CORNER)} FROM station_obs o {corner_sql('f', 'fine', 0.25)} {corner_sql('c', 'coarse', 0.5)}"""


@query(f"WITH {TWO_SQL}")
def two_grid_corners(spark: SparkSession, sf: str) -> DataFrame:
    fine = grid_latest(spark, sf)
    coarse = fine.where((C.cell_index("latitude", 0.25) % 2 == 0) & (C.cell_index("longitude", 0.25) % 2 == 0))
    out = joins.corner_join_grids(station_obs(spark, sf), {"fine": (fine, 0.25), "coarse": (coarse, 0.5)}, ["temperature_2m"])
    return out.select("station_id", "date", "hour_utc", *[r(f"temperature_2m_{n}_{g}").alias(f"{n}_{g}") for n in joins.CORNER for g in ("fine", "coarse")])


@query(f"WITH {LATEST_SQL}, {STATION_SQL}, b AS (SELECT min(latitude) AS s, max(latitude) AS n, min(longitude) AS w, max(longitude) AS e FROM station_obs WHERE station_id IN ('S3', 'S14')) SELECT date, count(*) AS n FROM latest, b WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND latitude BETWEEN s - 0.25 AND b.n + 0.25 AND longitude BETWEEN w - 0.25 AND e + 0.25 GROUP BY date")
def grid_near_stations(spark: SparkSession, sf: str) -> DataFrame:
    some = station_obs(spark, sf).where("station_id in ('S3', 'S14')")
    return joins.near_station(grid_latest(spark, sf), some, "2024-01-05", "2024-01-20", 0.25).groupBy("date").agg(F.count("*").alias("n"))


# --- aggregates and series ------------------------------------------------------------------------------------


@query(f"WITH {GRID_SQL} SELECT latitude, longitude, round(avg(sqrt(wind_u_10m * wind_u_10m + wind_v_10m * wind_v_10m)), 4) AS speed FROM grid_obs GROUP BY ALL ORDER BY speed DESC, latitude, longitude LIMIT 10")
def topk_windy_places(spark: SparkSession, sf: str) -> DataFrame:
    places = C.wind_speeds(grid_obs(spark, sf)).groupBy("latitude", "longitude").agg(r(F.avg("wind_speed_10m")).alias("speed"))
    return places.orderBy(F.desc("speed"), "latitude", "longitude").limit(10)


@query("SELECT (SELECT count(*) FROM events WHERE value > 20) AS total, least(100, (SELECT count(*) FROM events WHERE value > 20)) AS shown, (SELECT count(*) FROM events WHERE value > 20) > 100 AS truncated")
def limited_with_total(spark: SparkSession, sf: str) -> DataFrame:
    rows, total, cut = catalog.with_total(read(spark, sf, "events").where("value > 20").orderBy("event_id"), 100)
    return rows.agg(F.count("*").alias("shown")).select(F.lit(total).cast("long").alias("total"), "shown", F.lit(cut).alias("truncated"))


@query(f"WITH {GRID_SQL} SELECT DISTINCT latitude, longitude, date, hour_utc FROM grid_obs")
def keys_once(spark: SparkSession, sf: str) -> DataFrame:
    return storage.last_values(grid_obs(spark, sf).select(*KEYS, "seq"), KEYS, "seq")


def profile_sql(table: str, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4)::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, round(max({c}), 4)::DOUBLE AS max FROM {table}" for c in names)


@query(f"WITH {GRID_SQL} {profile_sql('grid_obs', ['temperature_2m', 'wind_u_10m', 'total_precipitation'])}")
def numeric_profile(spark: SparkSession, sf: str) -> DataFrame:
    p = ml.profile(grid_obs(spark, sf), ["temperature_2m", "wind_u_10m", "total_precipitation"])
    return p.select("feature", "n", *[r(c).alias(c) for c in p.columns[2:]])


@query(f"WITH {GRID_SQL} SELECT 'box' AS place, date_trunc('day', date)::TIMESTAMP AS ts, round(avg(temperature_2m), 4) AS y FROM grid_obs WHERE latitude BETWEEN -23.5 AND -22.5 AND longitude BETWEEN -49.5 AND -48.5 GROUP BY ALL UNION ALL SELECT 'point', date_trunc('day', date)::TIMESTAMP, round(max(temperature_2m), 4) FROM grid_obs WHERE latitude = -23.25 AND longitude = -49.25 GROUP BY ALL")
def series_of_places(spark: SparkSession, sf: str) -> DataFrame:
    own = grid_obs(spark, sf)
    box = timeseries.location({"kind": "box", "north": -22.5, "west": -49.5, "south": -23.5, "east": -48.5}, True)
    point = timeseries.location({"kind": "point", "lat": -23.25003, "lon": -49.24998}, True, RES)
    out, _ = timeseries.many([timeseries.Series("box", own, "temperature_2m", where=box), timeseries.Series("point", own, "temperature_2m", "max", where=point)])
    return out.select(F.col("series").alias("place"), "ts", r("y").alias("y"))


@query(f"WITH {STATION_SQL}, {DIM_SQL} SELECT date_trunc('month', date)::TIMESTAMP AS ts, round(sum(purchase), 3) AS y FROM station_obs JOIN station_dim USING (station_id) WHERE uf = (SELECT min(uf) FROM station_dim) GROUP BY ALL")
def series_of_a_state(spark: SparkSession, sf: str) -> DataFrame:
    dim = station_dim(spark, sf)
    uf = dim.agg(F.min("uf")).first()[0]
    own = station_obs(spark, sf).join(dim.select("station_id", "uf"), "station_id")
    return timeseries.series(own, "purchase", "month", "sum", timeseries.location({"kind": "uf", "uf": uf}, False)).select("ts", r("y", 3).alias("y"))


@query("SELECT event_type, count(value) AS n, round(avg(value * 9 / 5 + 32), 4) AS mean, round(stddev_samp(value * 9 / 5 + 32), 4) AS std FROM events GROUP BY event_type")
def converted_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = timeseries.converted_statistics(read(spark, sf, "events"), ["event_type"], "c_to_f", "value")
    return s.select("event_type", "n", r("mean").alias("mean"), r("std").alias("std"))


@query(f"WITH {LATEST_SQL} SELECT variable, n, 'grid' AS kind, 0.25::DOUBLE AS resolution FROM (UNPIVOT (SELECT {', '.join(f'count({c}) AS {c}' for c in VARIABLES)} FROM latest) ON {', '.join(VARIABLES)} INTO NAME variable VALUE n)")
def grid_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.metadata(grid_latest(spark, sf), ("latitude", "longitude", "hour_utc", "date"), DATASETS["era5"]).select("variable", "n", "kind", "resolution")


# --- regions --------------------------------------------------------------------------------------------------


@query(f"WITH {MEMBERS_SQL}, all_regions AS (SELECT DISTINCT r_name AS region FROM region UNION SELECT 'ring') SELECT 'era5' AS dataset, region, coalesce(n, 0) AS cells FROM all_regions LEFT JOIN (SELECT region, count(*) AS n FROM members GROUP BY region) USING (region)")
def region_counts_zero(spark: SparkSession, sf: str) -> DataFrame:
    known = read(spark, sf, "region").select(F.col("r_name").alias("region")).union(spark.range(1).select(F.lit("ring"))).distinct()
    return regions.counts(members_of(spark, sf), known)


@query(f"WITH {MEMBERS_SQL} SELECT DISTINCT region FROM members")
def available_regions(spark: SparkSession, sf: str) -> DataFrame:
    return regions.available(members_of(spark, sf), "era5")


#: Boxes of nations as states and of their market segments as municipalities, from customers.
PLACES_SQL = """c AS (SELECT *, c_acctbal / 100 AS y, (c_custkey % 360 - 180)::DOUBLE AS x FROM customer JOIN nation ON c_nationkey = n_nationkey),
places AS (SELECT 'uf' AS kind, n_name AS name, n_name AS uf, max(y) AS north, min(x) AS west, min(y) AS south, max(x) AS east FROM c GROUP BY n_name UNION ALL SELECT 'municipio', c_mktsegment, n_name, max(y), min(x), min(y), max(x) FROM c GROUP BY c_mktsegment, n_name)"""


def places(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    c = c.withColumns({"y": F.col("c_acctbal") / 100, "x": (F.col("c_custkey") % 360 - 180).cast("double")})
    box = [F.max("y").alias("north"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east")]
    states = c.groupBy(F.lit("uf").alias("kind"), F.col("n_name").alias("name"), F.col("n_name").alias("uf")).agg(*box)
    return states.unionByName(c.groupBy(F.lit("municipio").alias("kind"), F.col("c_mktsegment").alias("name"), F.col("n_name").alias("uf")).agg(*box))


@query(f"WITH {PLACES_SQL} SELECT north, west, south, east FROM places WHERE kind = 'municipio' ORDER BY name, uf LIMIT 1")
def region_box(spark: SparkSession, sf: str) -> DataFrame:
    towns = places(spark, sf).where("kind = 'municipio'")
    first = towns.agg(F.min(F.struct("name", "uf")).alias("f")).first()["f"]
    return spark.createDataFrame([regions.lookup_box(towns, first["name"].title(), first["uf"].lower())], "north double, west double, south double, east double")


@query(f"WITH {PLACES_SQL} SELECT name, uf, north, west, south, east FROM places WHERE kind = 'municipio'")
def region_listing(spark: SparkSession, sf: str) -> DataFrame:
    return regions.listing(places(spark, sf), "municipio")


@query(f"WITH {PLACES_SQL}, asked AS (SELECT o_orderkey AS request_id, 'uf' AS kind, n_name AS name FROM orders JOIN nation ON o_custkey % 25 = n_nationkey UNION ALL SELECT o_orderkey, 'municipio', 'MACHINERY/' || n_name FROM orders JOIN nation ON o_custkey % 25 = n_nationkey WHERE o_orderkey % 2 = 0), named AS (SELECT kind, CASE WHEN kind = 'uf' THEN name ELSE name || '/' || uf END AS name, north, west, south, east FROM places) SELECT request_id, arg_max(n.kind, n.kind = 'municipio') AS kind, arg_max(north, n.kind = 'municipio') AS north, arg_max(west, n.kind = 'municipio') AS west FROM asked a JOIN named n ON a.kind = n.kind AND a.name = n.name GROUP BY request_id")
def resolved_areas(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").join(F.broadcast(read(spark, sf, "nation")), F.col("o_custkey") % 25 == F.col("n_nationkey"))
    states = o.select(F.col("o_orderkey").alias("request_id"), F.lit("uf").alias("kind"), F.lower("n_name").alias("name"))
    towns = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("request_id"), F.lit("municipio").alias("kind"), F.concat(F.lit("MACHINERY/"), "n_name").alias("name"))
    named = places(spark, sf).withColumn("name", F.when(F.col("kind") == "uf", F.col("name")).otherwise(F.concat_ws("/", "name", "uf")))
    return regions.resolve_area(named, states.unionByName(towns)).select("request_id", "kind", "north", "west")


@query("SELECT p_type AS api_name, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS datasets, min(p_size)::VARCHAR AS unit FROM part GROUP BY p_type")
def variable_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("api_name"), F.col("p_size").alias("unit"))
    return merged_catalogue(rows).withColumn("unit", F.col("unit").cast("string"))


# --- users' objects -------------------------------------------------------------------------------------------


@query("SELECT event_id, round((1 - 0.25) * (1 - 0.5) * value + 0.25 * (1 - 0.5) * (value + 1) + (1 - 0.25) * 0.5 * (value * 2) + 0.25 * 0.5 * user_id, 4) AS y FROM events")
def bilinear_function(spark: SparkSession, sf: str) -> DataFrame:
    catalog.register_builtin(spark)
    read(spark, sf, "events").createOrReplaceTempView("weighted_events")
    return spark.sql("SELECT event_id, round(bilinear_weights(0.25, 0.5, value, value + 1, value * 2, user_id), 4) AS y FROM weighted_events")


@query("SELECT event_type, count(*) AS n, round(max(value * 2 + 1), 4) AS most FROM events WHERE value > 10 GROUP BY event_type")
def user_objects(spark: SparkSession, sf: str) -> DataFrame:
    """A macro and a view that needs it, made before it by name; both work after the replay, and a broken one does not stop them."""
    read(spark, sf, "events").createOrReplaceTempView("own_events")
    objects = spark.createDataFrame([("big_events", "view", "SELECT event_type, doubled_up(value) AS v FROM own_events WHERE value > 10", 1), ("broken", "view", "SELECT * FROM not_there", 2), ("doubled_up", "macro", "(x DOUBLE) RETURNS DOUBLE RETURN x * 2 + 1", 3)], catalog.OBJECT)
    catalog.replay(spark, objects)
    return catalog.safe_sql(spark, "SELECT event_type, count(*) AS n, round(max(v), 4) AS most FROM big_events GROUP BY event_type")


@query("SELECT user_id, round(sum(value) + 1, 3) AS y FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def typed_statements(spark: SparkSession, sf: str) -> DataFrame:
    """A view and a macro typed in the query box, and a query that uses them."""
    read(spark, sf, "events").createOrReplaceTempView("typed_events")
    objects = spark.createDataFrame([], catalog.OBJECT)
    for k, text in enumerate(("-- mine\nCREATE VIEW purchases AS SELECT 1 AS x", "CREATE OR REPLACE VIEW purchases AS SELECT user_id, sum(value) AS total FROM typed_events WHERE event_type = 'purchase' GROUP BY user_id;", "CREATE MACRO one_more(x DOUBLE) AS x + 1")):
        _, objects = catalog.run_text(spark, objects, text, k)
    if objects.count() != 2:
        raise ValueError("a view and a macro are kept")
    catalog.replay(spark, objects)
    out, _ = catalog.run_text(spark, objects, "SELECT user_id, round(one_more(total), 3) AS y FROM purchases", 9)
    return out


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type HAVING count(*) > 5")
def read_only_statement(spark: SparkSession, sf: str) -> DataFrame:
    read(spark, sf, "events").createOrReplaceTempView("plain_events")
    return catalog.safe_sql(spark, "WITH e AS (SELECT event_type FROM plain_events) SELECT event_type, count(*) AS n FROM e GROUP BY event_type HAVING count(*) > 5;")


@query("SELECT 'event_id' AS name, 'int' AS type, count(event_id) AS n FROM events UNION ALL SELECT 'ts', 'datetime', count(ts) FROM events UNION ALL SELECT 'user_id', 'int', count(user_id) FROM events UNION ALL SELECT 'event_type', 'str', count(event_type) FROM events UNION ALL SELECT 'value', 'float', count(value) FROM events UNION ALL SELECT 'l_linenumber', 'int', count(l_linenumber) FROM lineitem")
def view_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of a view and of a statement that is only analysed, with their short types, and how many values each has."""
    own = read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    own.createOrReplaceTempView("described_events")
    text = f"SELECT l_linenumber FROM parquet.`{sf}/lineitem.parquet`"
    types = dict([*catalog.view_schema(spark, "described_events"), *catalog.preview(spark, text), *catalog.view_schema(spark, "nowhere")])
    n = lambda df: df.agg(F.lit("n").alias("k"), *[F.count(c).alias(c) for c in df.columns]).unpivot(["k"], df.columns, "name", "n")
    kinds = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return n(own).unionByName(n(catalog.safe_sql(spark, text))).select("name", F.element_at(kinds, F.col("name")).alias("type"), "n")


@query(f"""WITH {LATEST_SQL}, {STATION_SQL}, land AS (SELECT * FROM latest WHERE hour_utc % 2 = 0), both_grids AS (SELECT count(CASE WHEN a.temperature_2m IS NOT NULL AND b.temperature_2m IS NOT NULL THEN 1 END) + count(CASE WHEN a.total_precipitation IS NOT NULL AND b.total_precipitation IS NOT NULL THEN 1 END) AS n FROM latest a JOIN land b USING (date, hour_utc, latitude, longitude))
SELECT 'daily_mean' AS template, count(DISTINCT date) AS n FROM latest UNION ALL SELECT 'grid_coverage', count(DISTINCT (latitude, longitude)) FROM latest UNION ALL SELECT 'era5_and_land', n FROM both_grids UNION ALL SELECT 'recent', least(100, count(*)) FROM latest
UNION ALL SELECT 'station_years', count(DISTINCT (station_id, year(date))) FROM station_obs UNION ALL SELECT 'station_and_grid', count(CASE WHEN view IS NOT NULL AND click IS NOT NULL THEN 1 END) FROM station_obs""")
def templates(spark: SparkSession, sf: str) -> DataFrame:
    """All templates, run over their views; the rows of each."""
    from isotherm.sources.arrays import to_long

    grid, own, names = grid_latest(spark, sf), station_obs(spark, sf), ["temperature_2m", "total_precipitation"]
    land = grid.where("hour_utc % 2 = 0")
    views = {"era5": grid, "era5_long": to_long(grid, KEYS, names).where("value is not null"), "era5_land_long": to_long(land, KEYS, names).where("value is not null"), "inmet": own, "inmet_with_grid": own.withColumns({"temperature": F.col("view"), "temperature_grid": F.col("click")})}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    parts = [catalog.safe_sql(spark, text).agg(F.count("*").alias("n")).select(F.lit(name).alias("template"), "n") for name, text in catalog.TEMPLATES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
