"""The library's kinds of tables, as projections of the test tables; each in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VARIABLES = ("temperature_2m", "wind_u_10m", "wind_v_10m", "total_precipitation")
EVENT_TYPES = ("click", "view", "purchase", "signup", "error")


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def grid_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly observations on a 12 x 12 grid of 0.25 degrees, with duplicates, gaps and nulls."""
    t = read(spark, sf, "lineitem")
    i, j = F.col("l_partkey") % 12, (F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 12
    return t.select(
        (F.lit(-24.0) + i * 0.25).alias("latitude"),
        (F.lit(-50.0) + j * 0.25).alias("longitude"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("l_orderkey") % 30).cast("int")).alias("date"),
        F.pmod(F.floor(F.col("l_orderkey") / 30) + F.col("l_linenumber"), F.lit(24)).cast("int").alias("hour_utc"),
        (F.col("l_quantity") + 273.15).alias("temperature_2m"),
        (F.col("l_discount") * 100).alias("wind_u_10m"),
        (F.col("l_tax") * 100).alias("wind_v_10m"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") / 1000).alias("total_precipitation"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"),
    )


GRID_SQL = """grid_obs AS (SELECT -24.0::DOUBLE + (l_partkey % 12) * 0.25::DOUBLE AS latitude, -50.0::DOUBLE + ((l_suppkey * 7 + l_linenumber) % 12) * 0.25::DOUBLE AS longitude,
  DATE '2024-01-01' + (l_orderkey % 30)::INT AS date, ((l_orderkey // 30 + l_linenumber) % 24)::INT AS hour_utc, l_quantity + 273.15::DOUBLE AS temperature_2m,
  l_discount * 100 AS wind_u_10m, l_tax * 100 AS wind_v_10m, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice / 1000 END AS total_precipitation,
  {'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_suppkey': l_suppkey, 'l_extendedprice': l_extendedprice} AS seq FROM lineitem)"""


def grid_latest(spark: SparkSession, sf: str) -> DataFrame:
    """One row a key: the last value of each column that is not null."""
    from isotherm.operators.storage import last_values

    return last_values(grid_obs(spark, sf), ["latitude", "longitude", "date", "hour_utc"], "seq")


LATEST_SQL = GRID_SQL + """, latest AS MATERIALIZED (SELECT latitude, longitude, date, hour_utc, """ + ", ".join(f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in VARIABLES) + """ FROM grid_obs GROUP BY latitude, longitude, date, hour_utc)"""


def station_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rows of 40 stations, one measurement for each type of event."""
    n = F.col("user_id") % 40
    e = read(spark, sf, "events").select(n.cast("int").alias("n"), F.to_date("ts").alias("date"), F.hour("ts").cast("int").alias("hour_utc"), "event_type", "value")
    wide = e.groupBy("n", "date", "hour_utc").agg(*[F.round(F.avg(F.when(F.col("event_type") == k, F.col("value"))), 6).alias(k) for k in EVENT_TYPES])
    lat, lon = F.lit(-24.0) + (F.col("n") % 10) * 0.25 + 0.0625, F.lit(-50.0) + F.floor(F.col("n") / 10) * 0.25 + 0.1875
    return wide.select(F.concat(F.lit("S"), "n").alias("station_id"), lat.alias("latitude"), lon.alias("longitude"), "date", "hour_utc", *EVENT_TYPES)


STATION_SQL = """station_obs AS (SELECT 'S' || n AS station_id, -24.0::DOUBLE + (n % 10) * 0.25::DOUBLE + 0.0625::DOUBLE AS latitude, -50.0::DOUBLE + (n // 10) * 0.25::DOUBLE + 0.1875::DOUBLE AS longitude, date, hour_utc, """ + ", ".join(EVENT_TYPES) + """ FROM
  (SELECT (user_id % 40)::INT AS n, ts::DATE AS date, extract(hour FROM ts)::INT AS hour_utc, """ + ", ".join(f"round(avg(value) FILTER (WHERE event_type = '{k}'), 6) AS {k}" for k in EVENT_TYPES) + """ FROM events GROUP BY ALL))"""


def station_dim(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier").join(read(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = s.groupBy((F.col("s_suppkey") % 40).alias("n")).agg(F.min_by(F.struct("s_acctbal", "n_name", "r_name"), "s_suppkey").alias("m"))
    return first.select(F.concat(F.lit("S"), F.col("n").cast("string")).alias("station_id"), F.col("m.s_acctbal").alias("altitude"), F.col("m.n_name").alias("uf"), F.col("m.r_name").alias("regiao"))


DIM_SQL = """station_dim AS (SELECT 'S' || (s_suppkey % 40) AS station_id, arg_min(s_acctbal, s_suppkey) AS altitude, arg_min(n_name, s_suppkey) AS uf, arg_min(r_name, s_suppkey) AS regiao
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY s_suppkey % 40)"""


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles of requests: a key for each month, with a box from each order's customer."""
    o = read(spark, sf, "orders")
    k = F.col("o_custkey")
    return o.select(
        F.concat(F.date_format("o_orderdate", "yyyy-MM")).alias("key"), "o_orderkey",
        (k % 40 / 4.0 + 1.0).alias("north"), (k % 37 / 4.0).alias("west"), (k % 40 / 4.0).alias("south"), (k % 37 / 4.0 + 1.5).alias("east"),
        F.col("o_orderdate").cast("date").alias("start"), (k % 5 + 1).cast("int").alias("n_variables"), (k % 24 + 1).cast("int").alias("n_hours"), (k % 31 + 1).cast("int").alias("n_days"),
    )


BOXES_SQL = """boxes AS (SELECT strftime(o_orderdate, '%Y-%m') AS key, o_orderkey, (o_custkey % 40) / 4.0::DOUBLE + 1.0::DOUBLE AS north, (o_custkey % 37) / 4.0::DOUBLE AS west, (o_custkey % 40) / 4.0::DOUBLE AS south,
  (o_custkey % 37) / 4.0::DOUBLE + 1.5::DOUBLE AS east, o_orderdate::DATE AS start, (o_custkey % 5 + 1)::INT AS n_variables, (o_custkey % 24 + 1)::INT AS n_hours, (o_custkey % 31 + 1)::INT AS n_days FROM orders)"""
