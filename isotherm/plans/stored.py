"""Queries whose tables are written and read again: sources and sinks, merging, indexes, incremental ingest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.operators import claims, coverage, ml, stations, storage
from isotherm.plans.fixtures import EVENT_TYPES, GRID_SQL, LATEST_SQL, STATION_SQL, VARIABLES, grid_latest, grid_obs, read, station_obs
from isotherm.plans.queries import CORNER_SQL, KEYS, MASKS_SQL, YEARS_SQL, cornered, r
from isotherm.plans.registry import query
from isotherm.shared import new_path
from isotherm.sources import arrays, station_files, tables
from isotherm.streaming.incremental import ingest_new

ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in VARIABLES)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, *[r(c, 6).alias(c) for c in VARIABLES])


def stored_grid(spark: SparkSession, sf: str, name: str = "era5") -> str:
    """The grid's observations, once a key, as a table partitioned by day."""
    path = f"{new_path(spark, 'data')}/{name}"
    tables.write_partitioned(storage.tile_order(grid_latest(spark, sf)), path)
    return path


@query(f"WITH {LATEST_SQL} SELECT date, count(*) AS n, round(sum(temperature_2m), 3) AS total FROM latest WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY date")
def partitioned_scan(spark: SparkSession, sf: str) -> DataFrame:
    tables.create_view(spark, stored_grid(spark, sf), "scanned-grid")
    return spark.sql("SELECT date, count(*) AS n, round(sum(temperature_2m), 3) AS total FROM scanned_grid WHERE date BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY date")


@query(f"WITH {LATEST_SQL} SELECT date, count(*) AS n, count(CASE WHEN day(date) > 15 THEN wind_u_10m END) AS n_wind, count(CASE WHEN day(date) <= 15 THEN total_precipitation END) AS n_rain FROM latest GROUP BY date")
def union_by_name_scan(spark: SparkSession, sf: str) -> DataFrame:
    path, own = new_path(spark, "drifting"), grid_latest(spark, sf)
    tables.write_partitioned(own.where("day(date) <= 15").drop("wind_u_10m"), path)
    tables.write_partitioned(own.where("day(date) > 15").drop("total_precipitation"), path)
    df = tables.scan(spark, path, union_by_name=True, skip_corrupt=True)
    return df.groupBy("date").agg(F.count("*").alias("n"), F.count("wind_u_10m").alias("n_wind"), F.count("total_precipitation").alias("n_rain"))


@query(f"WITH {GRID_SQL} SELECT hour_utc, count(*) AS n, max(temperature_2m) AS most FROM grid_obs GROUP BY hour_utc")
def unpartitioned_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "plain")
    tables.write_partitioned(grid_obs(spark, sf).drop("date", "seq"), path, compression="gzip")
    return tables.scan(spark, path).groupBy("hour_utc").agg(F.count("*").alias("n"), F.max("temperature_2m").alias("most"))


@query(f"WITH {STATION_SQL} SELECT station_id AS station, year(date)::INT AS year, count(*) AS n, min(date) AS date_min, max(date) AS date_max, round(sum(view), 4) AS views FROM station_obs GROUP BY ALL")
def station_year_sink(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "station-years")
    station_files.write_station_years(station_obs(spark, sf).withColumn("year", F.year("date")), path)
    return tables.scan(spark, path, union_by_name=True).groupBy("station", "year").agg(F.count("*").alias("n"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), r(F.sum("view")).alias("views"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_export(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "csv")
    tables.export_csv(read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    return tables.read_dimension(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def parquet_export(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "parquet")
    tables.export_parquet(read(spark, sf, "orders"), path)
    tables.create_view(spark, path, "exported-orders")
    return spark.sql("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM exported_orders GROUP BY o_orderstatus")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def dimension_table(spark: SparkSession, sf: str) -> DataFrame:
    csv, out = new_path(spark, "csv"), new_path(spark, "dimension")
    tables.export_csv(read(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), csv)
    tables.dimension_to_parquet(spark, csv, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", out)
    return tables.scan(spark, out)


@query(f"WITH {LATEST_SQL}, {STATION_SQL} SELECT 'era5' AS view, count(*) AS n FROM latest UNION ALL SELECT 'inmet', count(*) FROM station_obs")
def registered_views(spark: SparkSession, sf: str) -> DataFrame:
    base = stored_grid(spark, sf).rsplit("/", 1)[0]
    station_files.write_station_years(station_obs(spark, sf).withColumn("year", F.year("date")), f"{base}/inmet")
    found = tables.register_all(spark, base)
    return spark.sql(" UNION ALL ".join(f"SELECT '{v}' AS view, count(*) AS n FROM {v}" for v in found))


@query(f"WITH {GRID_SQL} SELECT DISTINCT date, true AS stored, (SELECT count(DISTINCT date) FROM grid_obs) AS partitions FROM grid_obs")
def stored_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files and bytes vary with the machine: each day has some, and as many partitions as days are counted."""
    stats = tables.storage_stats(tables.scan(spark, stored_grid(spark, sf)))
    totals = tables.storage_totals(stats).select("partitions")
    return stats.select("date", ((F.col("files") > 0) & (F.col("bytes") > 0)).alias("stored")).join(F.broadcast(totals))  # one row


@query("SELECT 'S' || o_custkey % 5 AS station, year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE year(o_orderdate) NOT IN (1993, 1995) GROUP BY ALL")
def purged_years(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "years")
    own = read(spark, sf, "orders").select(F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("station"), F.year("o_orderdate").alias("year"), "o_totalprice")
    tables.write_partitioned(own, path, ("station", "year"))
    tables.purge_years(spark, path, [1993, 1995])
    return tables.scan(spark, path).groupBy("station", "year").agg(F.count("*").alias("n"))


#: A file of each station: odd ones as the old era wrote them, with the code in the metadata, even ones as the new era.
@query(f"WITH {STATION_SQL} SELECT 'A' || (100 + substr(station_id, 2)::INT) AS station_id, 'SP' AS uf, round(latitude, 4)::FLOAT AS latitude, 2024 AS year, date, hour_utc::TINYINT AS hour_utc, round(click, 3)::FLOAT AS precipitation, round(view, 3)::FLOAT AS pressure FROM station_obs")
def station_texts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.substring("station_id", 2, 9).cast("int")
    new = n % 2 == 0
    comma = lambda c, d: F.replace(F.format_string(f"%.{d}f", c), F.lit("."), F.lit(","))
    number = lambda c: F.when(F.col(c).isNull(), F.when(new, F.lit("")).otherwise(F.lit("-9999"))).otherwise(comma(F.col(c), 3))
    day = F.when(new, F.date_format("date", "yyyy/MM/dd")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    hour = F.when(new, F.format_string("%02d00 UTC", "hour_utc")).otherwise(F.format_string("%02d:00", "hour_utc"))
    line = F.concat_ws(";", day, hour, number("click"), number("view"), F.lit(";" * 15))
    code = F.format_string("A%d", n + 100)
    head = F.concat_ws("\r\n", F.when(new, F.lit("REGIAO:;SE")).otherwise(F.lit("REGIÃO:;SE")), F.lit("UF:;SP"), F.concat(F.lit("CODIGO (WMO):;"), F.when(new, F.lit("")).otherwise(code)), F.concat(F.lit("LATITUDE:;"), comma(F.col("latitude"), 4)), F.when(new, F.lit("Data;Hora UTC;x")).otherwise(F.lit("DATA (YYYY-MM-DD);HORA (UTC);x")))
    files = station_obs(spark, sf).withColumns({"line": line, "head": head, "file": F.concat(F.lit("INMET_SE_SP_"), code, F.lit("_X_01-01-2024_A_31-12-2024.CSV"))})
    files = files.groupBy("file").agg(F.concat_ws("\r\n", F.first("head"), F.array_join(F.sort_array(F.collect_list("line")), "\r\n"), F.lit("")).alias("text"))
    rows = station_files.parse_station_texts(files)
    return rows.select("station_id", "uf", "latitude", "year", "date", "hour_utc", "precipitation", "pressure")


@query(f"WITH {LATEST_SQL} SELECT date, latitude, longitude, hour_utc, temperature_2m, wind_u_10m FROM latest")
def grid_arrays(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's observations as the arrays that files hold, with gaps as nulls, and back to rows."""
    own = grid_latest(spark, sf)
    axes, cells = axes_of(own), own.select(F.col("date").alias("file"), *clock(), "latitude", "longitude", "temperature_2m", "wind_u_10m")
    whole = arrays.to_chunks(cells, axes, ["temperature_2m", "wind_u_10m"], block=24 * 144)  # a chunk is a day
    n = F.size("time") * F.size("lat") * F.size("lon")
    values = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.get("values", (F.array_position("at", k) - 1).cast("int")))
    filled = whole.join(axes, "file").select("variable", "time", "lat", "lon", values.alias("values"))
    return days_again(arrays.flatten(filled, 500).where("value is not null"))


def clock() -> list:
    return [(F.col("date").cast("timestamp_ntz") + F.make_interval(hours=F.col("hour_utc"))).alias("time")]


def axes_of(own: DataFrame) -> DataFrame:
    """A file for each day, with all hours, and the latitudes and longitudes of the grid, a dozen each."""
    lines = own.agg(F.sort_array(F.collect_set("latitude")).alias("lat"), F.sort_array(F.collect_set("longitude")).alias("lon"))
    hours = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.col("date").cast("timestamp_ntz") + F.make_interval(hours=h))
    return own.select("date").distinct().join(F.broadcast(lines)).select(F.col("date").alias("file"), hours.alias("time"), "lat", "lon")


def days_again(rows: DataFrame) -> DataFrame:
    wide = arrays.to_wide(rows, ["temperature_2m", "wind_u_10m"])
    return wide.select(F.to_date("time").alias("date"), "latitude", "longitude", F.hour("time").alias("hour_utc"), "temperature_2m", "wind_u_10m")


@query(f"WITH {LATEST_SQL} SELECT date, latitude, longitude, hour_utc, temperature_2m, wind_u_10m FROM latest")
def grid_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The same through chunks of 1,000 places, written by variable and read again."""
    own, path = grid_latest(spark, sf), new_path(spark, "chunks")
    cells, axes = own.select(F.col("date").alias("file"), *clock(), "latitude", "longitude", "temperature_2m", "wind_u_10m"), axes_of(own)
    tables.write_partitioned(arrays.to_chunks(cells, axes, ["temperature_2m", "wind_u_10m"], block=1000).repartitionByRange("variable", "file", "offset").sortWithinPartitions("variable", "file", "offset"), path, ("variable",))
    return days_again(arrays.flatten_chunks(tables.scan(spark, path), axes))


# --- merging --------------------------------------------------------------------------------------------------


@query(f"WITH {LATEST_SQL} SELECT latitude, longitude, date, hour_utc, {ROUNDED} FROM latest")
def collapsed_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "doubled")
    tables.write_partitioned(grid_obs(spark, sf), path)
    storage.collapse(spark, path, order="seq")
    return rounded(tables.scan(spark, path))


@query(f"WITH {GRID_SQL}, n AS (SELECT date, count(*) AS n, count(DISTINCT (latitude, longitude, hour_utc)) AS m FROM grid_obs GROUP BY date) SELECT count(CASE WHEN n > m THEN 1 END) AS partitions, sum(n)::BIGINT AS rows_before, sum(m)::BIGINT AS rows_after FROM n")
def collapse_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "doubled")
    tables.write_partitioned(grid_obs(spark, sf), path)
    out = storage.collapse(spark, path, order="seq")
    return spark.createDataFrame([tuple(out.values())], "partitions long, rows_before long, rows_after long")


@query(f"WITH {LATEST_SQL} SELECT date, count(*) AS n, round(sum(CASE WHEN day(date) % 7 = 0 THEN temperature_2m + 1 ELSE temperature_2m END), 3) AS total FROM latest GROUP BY date")
def replaced_partitions(spark: SparkSession, sf: str) -> DataFrame:
    path = stored_grid(spark, sf)
    week = grid_latest(spark, sf).where("day(date) % 7 = 0").withColumn("temperature_2m", F.col("temperature_2m") + 1)
    for _ in range(2):  # again, which changes nothing
        tables.replace_partitions(week, path)
    return tables.scan(spark, path).groupBy("date").agg(F.count("*").alias("n"), r(F.sum("temperature_2m"), 3).alias("total"))


MERGED_SQL = f"""WITH {LATEST_SQL}, a AS (SELECT * FROM latest WHERE day(date) <= 20), b AS (SELECT latitude, longitude, date, hour_utc, temperature_2m + 1 AS temperature_2m, NULL::DOUBLE AS wind_u_10m, wind_v_10m, total_precipitation FROM latest WHERE day(date) >= 15),
both_ AS (SELECT *, 0 AS side FROM a UNION ALL BY NAME SELECT *, 1 AS side FROM b)
SELECT latitude, longitude, date, hour_utc, {', '.join(f'round(arg_max({c}, side) FILTER (WHERE {c} IS NOT NULL), 6) AS {c}' for c in VARIABLES)} FROM both_ GROUP BY latitude, longitude, date, hour_utc"""


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = grid_latest(spark, sf)
    return own.where("day(date) <= 20"), own.where("day(date) >= 15").withColumns({"temperature_2m": F.col("temperature_2m") + 1, "wind_u_10m": F.lit(None).cast("double")})


@query(MERGED_SQL)
def merged_table(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "merged")
    old, new = halves(spark, sf)
    for df in (old, new, new):  # the last again, which changes nothing
        storage.merge_into(spark, path, df)
    return rounded(tables.scan(spark, path))


@query(MERGED_SQL)
def healed_table(spark: SparkSession, sf: str) -> DataFrame:
    """As merged_table, with what killed writers leave: files that cannot be read among the good ones of every day."""
    path = new_path(spark, "healed")
    old, new = halves(spark, sf)
    storage.merge_into(spark, path, old)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for day in storage.days_of(new):
        broken = jvm.org.apache.hadoop.fs.Path(path, f"date={day}/part-half.parquet")
        stream = broken.getFileSystem(conf).create(broken, False)
        stream.write(b"PAR1 and no end")
        stream.close()
    storage.merge_into(spark, path, new)
    listed = claims.set_aside_list(spark, path)
    if listed.count() != len(storage.days_of(new)):
        raise ValueError("not all unreadable files are listed")
    return rounded(tables.scan(spark, path))


@query(MERGED_SQL)
def incremental_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """New files are merged as they come; a run that starts from nothing on the same files changes nothing."""
    source, data, index, base = (new_path(spark, n) for n in ("source", "data", "index", "progress"))
    for k, df in enumerate(halves(spark, sf)):
        df.write.mode("append").parquet(source)
        ingest_new(spark, source, df.schema, data, index, f"{base}/{min(k, 0)}")
    ingest_new(spark, source, df.schema, data, index, f"{base}/again")
    return rounded(tables.scan(spark, data))


@query("SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM orders WHERE (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) AND o_orderkey % 5 <> 0")
def manifest_changes(spark: SparkSession, sf: str) -> DataFrame:
    ids = read(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk_id"))
    kept = storage.recorded(ids.where("chunk_id % 2 = 0").withColumn("state", F.lit("old")), ids.where("chunk_id % 3 = 0").withColumn("state", F.lit("new")))
    return storage.forgotten(kept, ids.where("chunk_id % 5 = 0"))


# --- indexes --------------------------------------------------------------------------------------------------


@query(f"WITH {MASKS_SQL} SELECT latitude, longitude, date, variable, mask FROM masks")
def coverage_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    data, index = new_path(spark, "data"), new_path(spark, "index")
    tables.write_partitioned(grid_obs(spark, sf).drop("seq"), data)
    for version in ("1", "2", "2"):
        coverage.ensure_index(spark, data, index, version)
    return tables.scan(spark, index).drop("schema_version")


@query(f"WITH {YEARS_SQL} SELECT station_id, year, n_rows, date_min, date_max, vars FROM years")
def station_index_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    data, index = new_path(spark, "stations"), new_path(spark, "index")
    station_files.write_station_years(station_obs(spark, sf).withColumn("year", F.year("date")), data)
    for _ in range(2):
        stations.ensure_index(spark, data, index)
    kept = F.filter(F.array(*map(F.lit, EVENT_TYPES)), lambda x: F.array_contains("vars", x))
    return tables.scan(spark, index).select("station_id", "year", "n_rows", "date_min", "date_max", F.array_join(kept, ",").alias("vars"))


# --- modelling ------------------------------------------------------------------------------------------------


@query("SELECT ts::DATE AS date, count(*) AS n FROM events GROUP BY 1")
def cached_load(spark: SparkSession, sf: str) -> DataFrame:
    source, cache = new_path(spark, "events"), new_path(spark, "cache")
    read(spark, sf, "events").write.parquet(source)
    events = spark.read.parquet(source)
    make = lambda: events.groupBy(F.to_date("ts").alias("date")).agg(F.count("*").alias("n"))
    ml.cached(spark, cache, "days of events, 1", [events], make)
    return ml.cached(spark, cache, "days of events, 1", [events], lambda: make().limit(0))  # it is fresh, so it stays


@query(f"WITH {CORNER_SQL}, e AS (SELECT view AS a, grid AS p FROM meshed WHERE view IS NOT NULL AND grid IS NOT NULL) SELECT 'interpolation' AS name, round(sqrt(avg((a - p) * (a - p))), 4) AS rmse FROM e")
def run_log(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "runs")
    scores = ml.metrics(cornered(spark, sf), "view", "temperature_2m_grid").first().asDict()
    began = dt.datetime.now()
    ml.log_run(spark, path, "interpolation", {"resolution": 0.25}, scores, (dt.datetime.now() - began).total_seconds())
    return tables.scan(spark, path).select("name", r(F.try_element_at("metrics", F.lit("rmse"))).alias("rmse"))
