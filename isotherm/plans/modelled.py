"""Queries of fitted models, of values at stations, of areas by name, and of users' objects as they change."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions import columns as C
from isotherm.operators import catalog, coverage, joins, layout, ml, regions, stations, storage, timeseries
from isotherm.plans.fixtures import DIM_SQL, EVENT_TYPES, GRID_SQL, LATEST_SQL, STATION_SQL, VARIABLES, grid_latest, grid_obs, read, station_dim, station_obs
from isotherm.plans.lookups import corner_sql
from isotherm.plans.queries import KEYS, MASKS_SQL, RES, masks_of, r
from isotherm.plans.registry import query
from isotherm.plans.stored import stored_grid
from isotherm.shared import materialize, new_path
from isotherm.sources import tables

# --- models ---------------------------------------------------------------------------------------------------

#: The wind's speed at a place and hour from its parts and the rest that is observed there. The trees here are few; the operator's usual number is 400.
INPUTS = ["temperature_2m", "wind_u_10m", "wind_v_10m", "latitude", "longitude", "month", "day_of_year", "hour"]
LABEL, TREES, SHARE = "wind_speed", 12, 0.25
WHOLE_SQL = f"""WITH {LATEST_SQL}, whole AS (SELECT *, sqrt(wind_u_10m * wind_u_10m + wind_v_10m * wind_v_10m) AS wind_speed, row_number() OVER (ORDER BY date DESC, hour_utc DESC, latitude DESC, longitude DESC) AS k, count(*) OVER () AS n FROM latest WHERE {' AND '.join(f'{c} IS NOT NULL' for c in VARIABLES)}),
parts AS (SELECT *, k <= greatest(1, floor(n * {SHARE})) AS is_test FROM whole)"""


def fitted(spark: SparkSession, sf: str):
    """The rows in two parts by time, and the trees fitted on the earlier one."""
    rows = ml.features(grid_latest(spark, sf), [*VARIABLES]).withColumn(LABEL, F.sqrt(F.col("wind_u_10m") * F.col("wind_u_10m") + F.col("wind_v_10m") * F.col("wind_v_10m")))
    parts = materialize(ml.temporal_split(rows, SHARE, ["date", "hour_utc", "latitude", "longitude"]), "parts")
    return parts, ml.train(parts.where("not is_test"), INPUTS, LABEL, trees=TREES, depth=5, rate=0.3)


@query(f"{WHOLE_SQL} SELECT latitude, longitude, date, hour_utc, round({LABEL}, 6) AS actual, true AS is_difference, true AS is_finite FROM parts WHERE is_test")
def model_predictions(spark: SparkSession, sf: str) -> DataFrame:
    parts, model = fitted(spark, sf)
    out = ml.predictions(model, parts.where("is_test"), LABEL)
    same = F.abs(F.col("residual") + F.col("prediction") - F.col(LABEL)) < 1e-9
    return out.select(*KEYS, r(LABEL, 6).alias("actual"), same.alias("is_difference"), (~F.isnan("prediction") & (F.abs("prediction") < 1e9)).alias("is_finite"))


@query(f"{WHOLE_SQL} SELECT count(CASE WHEN NOT is_test THEN 1 END) AS n_train, count(CASE WHEN is_test THEN 1 END) AS n_test, true AS better_than_mean FROM parts")
def model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees err half as much as the mean of what they were fitted on, or less."""
    parts, model = fitted(spark, sf)
    test = parts.where("is_test")
    scored = ml.metrics(ml.predictions(model, test, LABEL), LABEL, "prediction").select("rmse")
    mean = parts.where("not is_test").agg(F.avg(LABEL).alias("mean"))
    plain = ml.metrics(test.join(F.broadcast(mean)), LABEL, "mean").select(F.col("rmse").alias("plain"))  # one row each
    counts = parts.agg(F.count_if(~F.col("is_test")).alias("n_train"), F.count_if("is_test").alias("n_test"))
    return counts.join(scored).join(plain).select("n_train", "n_test", (F.col("rmse") < F.col("plain") / 2).alias("better_than_mean"))


@query(f"{WHOLE_SQL} SELECT unnest({INPUTS}) AS feature, 1.0::DOUBLE AS of_all, true AS is_share, max(CASE WHEN NOT is_test THEN date END) AS fitted_until FROM parts")
def model_importances(spark: SparkSession, sf: str) -> DataFrame:
    parts, model = fitted(spark, sf)
    found = ml.importances(model, INPUTS)
    if {f for f, _ in found[:2]} != {"wind_u_10m", "wind_v_10m"}:
        raise ValueError(f"the wind goes by {found[0][0]}")
    rows = spark.createDataFrame(found, "feature string, share double").withColumn("of_all", F.round(F.lit(sum(x for _, x in found)), 9))
    until = parts.where("not is_test").agg(F.max("date").alias("fitted_until"))
    return rows.join(F.broadcast(until)).select("feature", "of_all", F.col("share").between(0, 1).alias("is_share"), "fitted_until")


# --- values at stations ---------------------------------------------------------------------------------------

#: Thirteen variables made of the four that are observed.
NAMES = [f"v{k}" for k in range(13)]


def thirteen(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, *[(F.col(VARIABLES[k % 4]) * (1 + k * 0.1370371)).alias(c) for k, c in enumerate(NAMES)])


def mesh_sql(alias: str, res: float, v: str, k: int) -> str:
    x, y = f"(o.longitude / {res} - floor(o.longitude / {res}))", f"(o.latitude / {res} - floor(o.latitude / {res}))"
    at = {n: f"{alias}{n}.{v}" for n in joins.CORNER}
    return f"round((1 + {k} * 0.1370371::DOUBLE) * ((1 - {x}) * (1 - {y}) * {at['bl']} + {x} * (1 - {y}) * {at['br']} + (1 - {x}) * {y} * {at['tl']} + {x} * {y} * {at['tr']}), 3)"


VIEW_SQL = f"""WITH {LATEST_SQL}, {STATION_SQL}, fine AS (SELECT *, round(latitude / 0.25)::INT AS i, round(longitude / 0.25)::INT AS j FROM latest),
coarse AS (SELECT * REPLACE (round(latitude / 0.5)::INT AS i, round(longitude / 0.5)::INT AS j) FROM fine WHERE i % 2 = 0 AND j % 2 = 0)
SELECT o.station_id, o.date, o.hour_utc, {', '.join(f"{mesh_sql('f', 0.25, VARIABLES[k % 4], k)} AS {c}_fine, {mesh_sql('c', 0.5, VARIABLES[k % 4], k)} AS {c}_coarse" for k, c in enumerate(NAMES))} FROM station_obs o {corner_sql('f', 'fine', 0.25)} {corner_sql('c', 'coarse', 0.5)}"""


@query(VIEW_SQL)
def bilinear_view(spark: SparkSession, sf: str) -> DataFrame:
    """Thirteen variables of two grids at every station's row, by one join and one aggregate."""
    fine = thirteen(grid_latest(spark, sf))
    coarse = fine.where((C.cell_index("latitude", 0.25) % 2 == 0) & (C.cell_index("longitude", 0.25) % 2 == 0))
    out = joins.interpolated_grids(joins.corner_join_grids(station_obs(spark, sf), {"fine": (fine, 0.25), "coarse": (coarse, 0.5)}, NAMES), ["fine", "coarse"], NAMES)
    return out.select("station_id", "date", "hour_utc", *[r(f"{c}_{g}", 3).alias(f"{c}_{g}") for c in NAMES for g in ("fine", "coarse")])


@query(f"WITH {LATEST_SQL}, {STATION_SQL}, fine AS (SELECT *, round(latitude / 0.25)::INT AS i, round(longitude / 0.25)::INT AS j FROM latest) SELECT o.station_id, o.date, o.hour_utc, round(o.view, 6) AS view, {mesh_sql('f', 0.25, 'temperature_2m', 0)} AS temperature, {mesh_sql('f', 0.25, 'wind_u_10m', 0)} AS wind FROM station_obs o {corner_sql('f', 'fine', 0.25)} WHERE o.station_id IN ('S3', 'S14', 'S27') AND o.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def station_values(spark: SparkSession, sf: str) -> DataFrame:
    """Some stations over some days, with what a stored grid has at their places: only these days of it are read."""
    some = station_obs(spark, sf).where("station_id in ('S3', 'S14', 'S27')").where(F.col("date").between(dt.date(2024, 1, 5), dt.date(2024, 1, 20)))
    grid = tables.scan(spark, stored_grid(spark, sf))
    out = joins.values_at_stations(some, grid, RES, ["temperature_2m", "wind_u_10m"])
    return out.select("station_id", "date", "hour_utc", r("view", 6).alias("view"), r("temperature_2m_grid", 3).alias("temperature"), r("wind_u_10m_grid", 3).alias("wind"))


@query(f"WITH {STATION_SQL}, s AS (SELECT station_id, min(date) AS date_min, max(date) AS date_max, {', '.join(f'count({c}) AS {c}' for c in EVENT_TYPES)} FROM station_obs GROUP BY station_id) SELECT station_id, variable, n, date_min, date_max FROM (UNPIVOT s ON {', '.join(EVENT_TYPES)} INTO NAME variable VALUE n)")
def station_variables(spark: SparkSession, sf: str) -> DataFrame:
    return timeseries.station_metadata(station_obs(spark, sf), ("latitude", "longitude", "hour_utc"))


@query(f"WITH {GRID_SQL}, {DIM_SQL} SELECT 'era5' AS name, true AS stored, count(*) AS n FROM grid_obs UNION ALL SELECT 'era5_land', false, 0 UNION ALL SELECT 'stations', true, count(*) FROM station_dim")
def prerequisites(spark: SparkSession, sf: str) -> DataFrame:
    """What stations need before their corners can be joined: one of both grids is not there, which stops the job."""
    paths = {n: new_path(spark, n) for n in ("era5", "era5_land", "stations")}
    tables.write_partitioned(grid_obs(spark, sf).drop("seq"), paths["era5"])
    station_dim(spark, sf).write.parquet(paths["stations"])
    out = stations.prerequisites(spark, paths)
    try:
        stations.require_rows(**{row["name"]: out.where(F.col("name") == row["name"]).where("stored") for row in out.collect()})
    except ValueError as e:
        if str(e) != "no rows in era5_land":
            raise
        return out
    raise ValueError("a table that is not there was not missed")


# --- areas by name --------------------------------------------------------------------------------------------

#: Five kinds of regions, as boxes of customers: towns are market segments of a nation, states nations.
AREAS_SQL = """c AS (SELECT *, c_acctbal / 100 AS y, (c_custkey % 360 - 180)::DOUBLE AS x FROM customer JOIN nation ON c_nationkey = n_nationkey),
named AS (SELECT 'municipio' AS kind, c_mktsegment AS name, n_name AS uf, y, x FROM c UNION ALL SELECT 'rg_imediata', c_mktsegment || ' ' || n_regionkey, NULL, y, x FROM c UNION ALL SELECT 'rg_intermediaria', 'Region ' || n_regionkey, NULL, y, x FROM c UNION ALL SELECT 'uf', n_name, n_name, y, x FROM c UNION ALL SELECT 'pais', CASE WHEN c_nationkey < 20 THEN 'Brasil' ELSE 'Chile' END, NULL, y, x FROM c),
areas AS (SELECT kind, name, uf, max(y) AS north, min(x) AS west, min(y) AS south, max(x) AS east FROM named GROUP BY kind, name, uf)"""


def areas(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer").join(F.broadcast(read(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    one = lambda kind, name, uf=None: F.struct(F.lit(kind).alias("kind"), name.alias("name"), (F.lit(None).cast("string") if uf is None else uf).alias("uf"))
    segment, nation, part = F.col("c_mktsegment"), F.col("n_name"), F.col("n_regionkey").cast("string")
    kinds = F.array(one("municipio", segment, nation), one("rg_imediata", F.concat_ws(" ", segment, part)), one("rg_intermediaria", F.concat(F.lit("Region "), part)), one("uf", nation, nation), one("pais", F.when(F.col("c_nationkey") < 20, "Brasil").otherwise("Chile")))
    rows = c.select(F.explode(kinds).alias("k"), (F.col("c_acctbal") / 100).alias("y"), (F.col("c_custkey") % 360 - 180).cast("double").alias("x"))
    return rows.groupBy("k.kind", "k.name", "k.uf").agg(F.max("y").alias("north"), F.min("x").alias("west"), F.min("y").alias("south"), F.max("x").alias("east"))


@query(f"""WITH {AREAS_SQL}, o AS (SELECT o_orderkey AS request_id, o_custkey % 11 AS p, lower(n_name) AS nation, n_regionkey FROM orders JOIN nation ON o_custkey % 25 = n_nationkey),
q AS (SELECT request_id, CASE WHEN p = 9 THEN 'chile' WHEN p = 10 THEN 'Chile' END AS pais, CASE WHEN p IN (0, 1, 2, 7, 9) THEN 'machinery' END AS municipio, CASE WHEN p IN (3, 7) THEN 'MACHINERY ' || n_regionkey END AS rg_imediata, CASE WHEN p = 4 THEN 'region ' || n_regionkey END AS rg_intermediaria, CASE WHEN p IN (0, 1, 5) THEN nation WHEN p = 6 THEN 'nowhere' END AS uf FROM o),
k AS (SELECT *, (municipio IS NOT NULL)::INT + (rg_imediata IS NOT NULL)::INT + (rg_intermediaria IS NOT NULL)::INT + (uf IS NOT NULL)::INT AS n, CASE WHEN municipio IS NOT NULL THEN 'municipio' WHEN rg_imediata IS NOT NULL THEN 'rg_imediata' WHEN rg_intermediaria IS NOT NULL THEN 'rg_intermediaria' WHEN uf IS NOT NULL THEN 'uf' ELSE 'pais' END AS kind, lower(coalesce(municipio, rg_imediata, rg_intermediaria, uf, pais, 'brasil')) AS name FROM q),
m AS (SELECT k.request_id, k.kind, k.name, any_value(CASE WHEN k.n > 1 AND (rg_imediata IS NOT NULL OR rg_intermediaria IS NOT NULL) THEN 'only one of municipio, rg_imediata' WHEN k.n > 0 AND lower(pais) <> 'brasil' THEN 'parts of other countries are not known' END) AS broken, count(a.kind) AS met, min(north) AS north, min(west) AS west, min(south) AS south, min(east) AS east FROM k LEFT JOIN areas a ON a.kind = k.kind AND lower(a.name) = k.name AND (k.kind <> 'municipio' OR k.uf IS NULL OR k.uf = lower(a.uf)) GROUP BY ALL),
e AS (SELECT *, coalesce(broken, CASE WHEN met = 0 THEN 'unknown: ' || name WHEN met > 1 THEN 'in several places: ' || name END) AS error FROM m)
SELECT request_id, kind, CASE WHEN error IS NULL THEN north END AS north, CASE WHEN error IS NULL THEN west END AS west, CASE WHEN error IS NULL THEN south END AS south, CASE WHEN error IS NULL THEN east END AS east, error FROM e""")
def area_requests(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").join(F.broadcast(read(spark, sf, "nation")), F.col("o_custkey") % 25 == F.col("n_nationkey"))
    p, part = F.col("o_custkey") % 11, F.col("n_regionkey").cast("string")
    asked = o.select(
        F.col("o_orderkey").alias("request_id"), F.when(p == 9, "chile").when(p == 10, "Chile").alias("pais"), F.when(p.isin(0, 1, 2, 7, 9), "machinery").alias("municipio"),
        F.when(p.isin(3, 7), F.concat(F.lit("MACHINERY "), part)).alias("rg_imediata"), F.when(p == 4, F.concat(F.lit("region "), part)).alias("rg_intermediaria"), F.when(p.isin(0, 1, 5), F.lower("n_name")).when(p == 6, "nowhere").alias("uf"),
    )
    return regions.resolved_requests(areas(spark, sf), asked)


# --- users' objects as they change ----------------------------------------------------------------------------


@query("SELECT event_type, round(sum(value) * 3, 3) AS y FROM events GROUP BY event_type")
def object_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Objects made, made again, replaced and deleted: what is there may not be made anew unless it is replaced, and what is deleted can be."""
    read(spark, sf, "events").createOrReplaceTempView("changing_events")
    objects = spark.createDataFrame([], catalog.OBJECT)
    objects = catalog.upsert(objects, "Totals", "view", "SELECT 1 AS x", 1, replace=False)
    try:
        catalog.upsert(objects, "totals", "view", "SELECT 2 AS x", 2, replace=False)
    except ValueError as e:
        if str(e) != "totals exists":
            raise
    else:
        raise ValueError("an object was made twice")
    objects = catalog.upsert(objects, "thrice", "macro", "(x DOUBLE) RETURNS DOUBLE RETURN x * 2", 3)
    objects = catalog.upsert(objects, "thrice", "macro", "(x DOUBLE) RETURNS DOUBLE RETURN x * 3", 4)
    objects = catalog.without(objects, "TOTALS")
    objects = catalog.upsert(objects, "totals", "view", "SELECT event_type, sum(value) AS total FROM changing_events GROUP BY event_type", 5, replace=False)
    if sorted(row["name"] for row in objects.collect()) != ["thrice", "totals"]:
        raise ValueError("two objects are left")
    catalog.replay(spark, objects)
    return catalog.safe_sql(spark, "SELECT event_type, round(thrice(total), 3) AS y FROM totals")


# --- layout ---------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n_rows, true AS most_are_narrow, true AS are_narrower_than_unsorted FROM lineitem")
def narrow_row_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Thirty by thirty degrees in tile order: four fifths of the row groups span 11 degrees or less, and all in the mean a quarter of what those of the same rows as they came do."""
    t = read(spark, sf, "lineitem")
    wide = t.select((F.pmod(F.hash("l_partkey", "l_suppkey"), F.lit(600)) / 20 - 30).alias("latitude"), (F.pmod(F.hash("l_orderkey", "l_linenumber"), F.lit(600)) / 20 - 60).alias("longitude"), F.lit(6).alias("hour_utc"), "l_quantity")
    measured = []
    for rows in (storage.tile_order(wide, "no column"), wide):
        path = new_path(spark, "layout")
        rows.write.options(**{"maxRecordsPerFile": layout.FILE_ROWS, "parquet.block.size": 1024, "parquet.page.size.row.check.min": 10, "parquet.block.size.row.check.min": 10, "parquet.block.size.row.check.max": 10}).parquet(path)
        measured.append(layout.widths(layout.row_groups(spark, path, ["longitude"]), "longitude", 11.0))
    tiled, plain = measured
    both = tiled.join(plain.select(F.col("mean_span").alias("plain")))  # one row each
    return both.select("n_rows", (F.col("share") >= 0.8).alias("most_are_narrow"), (F.col("mean_span") < F.col("plain") / 4).alias("are_narrower_than_unsorted"))


@query(f"WITH {MASKS_SQL} SELECT count(*) AS n_rows, 0 AS overlaps, min(date) AS first, max(date) AS last FROM masks")
def index_order(spark: SparkSession, sf: str) -> DataFrame:
    """The index of hours as it is stored: row groups in order of their days, which do not overlap."""
    path = new_path(spark, "index")
    coverage.stored_order(masks_of(spark, sf)).write.options(**{"maxRecordsPerFile": layout.FILE_ROWS, "parquet.block.size": 4096}).parquet(path)
    groups = materialize(layout.row_groups(spark, path, ["date"]), "groups")
    day = lambda c: F.date_add(F.lit(dt.date(1970, 1, 1)), F.col(c).cast("int"))
    span = groups.agg(F.sum("n_rows").alias("n_rows"), F.min("date_min").alias("d0"), F.max("date_max").alias("d1"))
    return span.select("n_rows", F.lit(layout.overlaps(groups, "date").count()).alias("overlaps"), day("d0").alias("first"), day("d1").alias("last"))
