"""Queries of plans within limits, with the splitting cascade in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.columns import hours_to_mask
from isotherm.operators import planning
from isotherm.plans.fixtures import read
from isotherm.plans.lookups import CHUNK_SQL, NAMES, chunks
from isotherm.plans.queries import CHUNKS_SQL, RES, masks_of
from isotherm.plans.registry import query


def cascade_sql(res: float, most_bytes: int, most_fields: int) -> str:
    """CTEs from seeds (seed, year, month, variables, north, west, south, east) and sd (seed, k, day, mask), k from 1, to pieces: days by recursion, one day after the other."""
    points = lambda n, w, s, e: f"((ceil(round(({n} - {s}) / {res}, 9)) + 1) * (ceil(round(({e} - {w}) / {res}, 9)) + 1))::BIGINT"
    fits = lambda fields, pts: f"({fields} <= {most_fields} AND {fields} * {pts} * 8 <= {most_bytes})"
    up, down = (lambda x: f"round(ceil({x} / {res}) * {res}, 6)"), (lambda x: f"round(floor({x} / {res}) * {res}, 6)")
    dims = "list_reduce(range(1, n + 1), lambda s, k: CASE WHEN (s // 1000) * (s % 1000) >= n THEN s WHEN (north - south) / (s // 1000) >= (east - west) / (s % 1000) THEN s + 1000 ELSE s + 1 END, 1001)"
    return f"""z AS MATERIALIZED (SELECT s.*, {points('north', 'west', 'south', 'east')} AS points, nd, m, len(variables) AS nv FROM seeds s JOIN (SELECT seed, count(*) AS nd, bit_or(mask) AS m FROM sd GROUP BY seed) USING (seed)),
large AS MATERIALIZED (SELECT * FROM z WHERE NOT {fits('nv * nd * bit_count(m)', 'points')}),
g AS (SELECT l.seed, k, 1 AS block, 1 AS n, mask AS m, day FROM large l JOIN sd ON sd.seed = l.seed AND k = 1 UNION ALL
SELECT g.seed, sd.k, CASE WHEN {fits('nv * (g.n + 1) * bit_count(g.m | mask)', 'points')} THEN block ELSE block + 1 END, CASE WHEN {fits('nv * (g.n + 1) * bit_count(g.m | mask)', 'points')} THEN n + 1 ELSE 1 END, CASE WHEN {fits('nv * (g.n + 1) * bit_count(g.m | mask)', 'points')} THEN g.m | mask ELSE mask END, sd.day FROM g JOIN large l USING (seed) JOIN sd ON sd.seed = g.seed AND sd.k = g.k + 1),
b AS MATERIALIZED (SELECT seed, NULL::VARCHAR AS t1, list(day ORDER BY k) AS days, m FROM z JOIN sd USING (seed) WHERE seed NOT IN (SELECT seed FROM large) GROUP BY seed, m
UNION ALL SELECT seed, CASE WHEN any_value(nd) > 1 THEN printf('d%02d-%02d', min(day), max(day)) END, list(day ORDER BY k), arg_max(g.m, k) FROM g JOIN large USING (seed) GROUP BY seed, block),
bz AS MATERIALIZED (SELECT b.*, year, month, variables, nv, north, west, south, east, points, nv * len(days) * bit_count(b.m) AS f FROM b JOIN z USING (seed)),
tall AS MATERIALIZED (SELECT *, {dims} AS d FROM (SELECT *, unnest([2, 4, 8, 16, 32, 64]) AS n FROM bz WHERE points > 1 AND NOT {fits('f', 'points')})),
fit AS (SELECT *, {fits('f', points(up('north'), down('west'), down('round(north - (north - south) / (d // 1000), 6)'), up('round(west + (east - west) / (d % 1000), 6)')))} AS ok FROM tall),
chosen AS MATERIALIZED (SELECT * EXCLUDE (ok) FROM fit QUALIFY n = coalesce(min(n) FILTER (ok AND n < 64) OVER (PARTITION BY seed, days), 64)),
tiles AS (SELECT * EXCLUDE (north, west, south, east), y * (d % 1000) + x + 1 AS number, {up('round(north - (north - south) / (d // 1000) * y, 6)')} AS north, {down('round(west + (east - west) / (d % 1000) * x, 6)')} AS west, {down('round(north - (north - south) / (d // 1000) * (y + 1), 6)')} AS south, {up('round(west + (east - west) / (d % 1000) * (x + 1), 6)')} AS east
FROM (SELECT *, unnest(range(d % 1000)) AS x FROM (SELECT *, unnest(range(d // 1000)) AS y FROM chosen))),
once AS (SELECT seed, t1, (d // 1000) * (d % 1000) AS many, min(number) AS number, days, m, year, month, variables, nv, north, west, south, east FROM tiles GROUP BY ALL),
a AS (SELECT * EXCLUDE (many, number, days, m, year, month, variables, nv, north, west, south, east), 'a-' || many || '-part-' || number AS t2, days, m, year, month, variables, nv, north, west, south, east FROM once
UNION ALL SELECT seed, t1, NULL::VARCHAR, days, m, year, month, variables, nv, north, west, south, east FROM bz WHERE points <= 1 OR {fits('f', 'points')}),
ap AS (SELECT *, {points('north', 'west', 'south', 'east')} AS points FROM a),
v AS (SELECT *, CASE WHEN {fits('nv * len(days) * bit_count(m)', 'points')} THEN [variables] ELSE list_transform(variables, lambda v: [v]) END AS vs FROM ap),
p AS (SELECT * EXCLUDE (variables), unnest(vs) AS variables FROM v),
pieces AS (SELECT *, concat_ws('_', seed, t2, t1, CASE WHEN nv > len(variables) THEN 'v-' || regexp_replace(variables[1], '[^0-9A-Za-z]', '-', 'g') END) AS chunk_id, (len(variables) * len(days) * bit_count(m))::BIGINT AS fields, (len(variables) * len(days) * bit_count(m))::BIGINT * points * 8 AS bytes FROM p)"""


def shown(pieces: DataFrame) -> DataFrame:
    return pieces.withColumns({"variables": F.array_join("variables", ","), "days": F.array_join(F.col("days").cast("array<string>"), ","), "too_large": F.col("error").isNotNull()}).drop("seed", "error")


def shown_sql(most_bytes: int, most_fields: int) -> str:
    return f"SELECT chunk_id, year, month, array_to_string(variables, ',') AS variables, array_to_string(days, ',') AS days, m::INT AS hours_mask, north, west, south, east, points, fields, bytes, fields > {most_fields} OR bytes > {most_bytes} AS too_large FROM pieces"


#: Every order asks for something: one to five variables, one to 24 hours, up to 31 days of a month or two, a box of up to 9.75 by 9 degrees off the grid.
ASKED = "o_orderkey AS k, o_custkey AS c, o_orderdate::DATE AS day"
PLAN_LIMITS = planning.Limits(60_000, 150)
PLAN_SQL = f"""WITH RECURSIVE o AS (SELECT {ASKED} FROM orders),
r AS (SELECT k AS request_id, c, day AS first, day + (c % 31)::INT AS last, list_transform(range(c % 4 + 1), lambda i: 'v.' || i) AS variables, ((1 << (c % 24 + 1)::INT) - 1)::INT AS mask, round(ceil((c % 20 + (c % 40) / 4.0 + 0.1) / 0.25) * 0.25, 6)::DOUBLE AS north, round(floor((c % 37 / 4.0 + 0.1) / 0.25) * 0.25, 6)::DOUBLE AS west, round(floor((c % 20) / 0.25) * 0.25, 6)::DOUBLE AS south, round(ceil((c % 37 / 2.0 + 0.3) / 0.25) * 0.25, 6)::DOUBLE AS east FROM o),
rd AS (SELECT request_id, unnest(generate_series(first, last, INTERVAL 1 DAY))::DATE AS d, mask FROM r),
rm AS (SELECT request_id, year(d)::INT AS year, month(d)::INT AS month FROM rd GROUP BY ALL),
seeds AS (SELECT request_id || '_' || printf('%04d%02d', year, month) AS seed, year, month, variables, north, west, south, east FROM r JOIN rm USING (request_id)),
sd AS (SELECT request_id || '_' || printf('%04d%02d', year(d), month(d)) AS seed, row_number() OVER (PARTITION BY request_id, year(d), month(d) ORDER BY d) AS k, day(d)::INT AS day, mask FROM rd),
{cascade_sql(RES, PLAN_LIMITS.most_bytes, PLAN_LIMITS.most_fields)} {shown_sql(PLAN_LIMITS.most_bytes, PLAN_LIMITS.most_fields)}"""


def asked_of(spark: SparkSession, sf: str) -> DataFrame:
    c, day = F.col("o_custkey"), F.col("o_orderdate").cast("date")
    names = F.transform(F.sequence(F.lit(0), (c % 4).cast("int")), lambda i: F.concat(F.lit("v."), i.cast("string")))
    return read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("request_id"), names.alias("variables"), day.alias("start"), F.date_add(day, (c % 31).cast("int")).alias("end"), F.sequence(F.lit(0), (c % 24).cast("int")).alias("hours"),
        (c % 20 + c % 40 / 4.0 + 0.1).alias("north"), (c % 37 / 4.0 + 0.1).alias("west"), (c % 20).cast("double").alias("south"), (c % 37 / 2.0 + 0.3).alias("east"),
    )


@query(PLAN_SQL)
def plan_requests(spark: SparkSession, sf: str) -> DataFrame:
    return shown(planning.plan_requests(asked_of(spark, sf), RES, PLAN_LIMITS))


#: As above, from orders as seeds: each day of the month asks for hours of its own.
UNEVEN_SQL = f"""WITH RECURSIVE o AS (SELECT {ASKED} FROM orders),
seeds AS (SELECT k::VARCHAR AS seed, year(day)::INT AS year, month(day)::INT AS month, list_transform(range(c % 3 + 1), lambda i: 'v.' || i) AS variables, 2.0::DOUBLE + c % 5 AS north, 0.0::DOUBLE AS west, 1.0::DOUBLE AS south, 0.5::DOUBLE + c % 3 AS east FROM o),
sd AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY day) AS k, day, mask FROM (SELECT k::VARCHAR AS seed, d::INT AS day, (xor(c * 7919, d * 104729) % 16777216 & ((1 << (c % 24 + 1)::INT) - 1))::INT AS mask FROM (SELECT *, unnest(range(1, (c % 28 + 2)::INT)) AS d FROM o)) WHERE mask <> 0),
{cascade_sql(RES, PLAN_LIMITS.most_bytes, PLAN_LIMITS.most_fields)} {shown_sql(PLAN_LIMITS.most_bytes, PLAN_LIMITS.most_fields)}"""


@query(UNEVEN_SQL)
def plan_uneven_days(spark: SparkSession, sf: str) -> DataFrame:
    c, day = F.col("o_custkey"), F.col("o_orderdate").cast("date")
    hours = lambda d: ((c * 7919).bitwiseXOR(d * 104729) % 16777216).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (c % 24 + 1).cast("int")) - 1).cast("int")
    days = F.transform(F.sequence(F.lit(1), (c % 28 + 1).cast("int")), lambda d: F.struct(d.alias("day"), hours(d.cast("long")).alias("mask")))
    names = F.transform(F.sequence(F.lit(0), (c % 3).cast("int")), lambda i: F.concat(F.lit("v."), i.cast("string")))
    seeds = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("seed"), F.year(day).alias("year"), F.month(day).alias("month"), names.alias("variables"), days.alias("days"), (c % 5 + 2).cast("double").alias("north"), F.lit(0.0).alias("west"), F.lit(1.0).alias("south"), (c % 3 + 0.5).cast("double").alias("east"))
    return shown(planning.split_to_fit(seeds, RES, PLAN_LIMITS))


LEFT_LIMITS = planning.Limits(50_000, 400)


#: The boxes of a plan of what is left are not unique, so what they ask in all is compared: all cells that no chunk has, and that every piece is within the limits.
@query(f"""WITH {CHUNK_SQL}, asked AS (SELECT DISTINCT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month FROM orders), n AS (SELECT year, month, unnest([0, 1, 2]) AS v FROM asked),
cells AS (SELECT year, month, v, y, x FROM n, (SELECT unnest(range(1, 13)) AS y), (SELECT unnest(range(0, 12)) AS x)),
held AS (SELECT DISTINCT c.year, c.month, c.v, c.y, c.x FROM cells c JOIN chunks k ON c.year = k.year AND c.month = k.month AND k.without <> c.v AND k.half = 0 AND k.few > 0 AND c.y >= k.south AND c.y < k.north AND c.x >= k.west AND c.x < k.east)
SELECT year, month, ['tp', 't2m', 'u10'][v + 1] AS variable, (n * 24 * day(last_day(make_date(year, month, 1))))::DOUBLE AS cell_hours, false AS too_large FROM (SELECT year, month, v, count(*) AS n FROM (SELECT * FROM cells EXCEPT SELECT * FROM held) GROUP BY ALL)""")
def plan_incremental(spark: SparkSession, sf: str) -> DataFrame:
    span = read(spark, sf, "orders").agg(F.trunc(F.min("o_orderdate").cast("date"), "month").alias("start"), F.last_day(F.max("o_orderdate").cast("date")).alias("end"))
    asked = span.select(F.lit(1).alias("request_id"), F.array(*map(F.lit, NAMES)).alias("variables"), "start", "end", F.sequence(F.lit(0), F.lit(23)).alias("hours"), F.lit(12.9).alias("north"), F.lit(0.1).alias("west"), F.lit(1.2).alias("south"), F.lit(11.8).alias("east"))
    pieces = planning.plan_incremental(asked, chunks(spark, sf), 1.0, LEFT_LIMITS)
    asks = (F.col("north") - F.col("south")) * (F.col("east") - F.col("west")) * F.size("days") * F.bit_count("hours_mask")
    return pieces.groupBy("year", "month", F.get("variables", F.lit(0)).alias("variable")).agg(F.sum(asks).alias("cell_hours"), F.max(F.col("error").isNotNull()).alias("too_large"))


#: Regions of what is missing, as in CHUNKS_SQL, whose days keep their own hours.
MISSING_LIMITS = planning.Limits(3_000, 40)
MISSING_SQL = f"""{CHUNKS_SQL[: CHUNKS_SQL.index('days AS (')]}seeds AS (SELECT (year, month, variable, root)::VARCHAR AS seed, year, month, [variable] AS variables, north, west, south, east FROM boxes),
sd AS (SELECT seed, row_number() OVER (PARTITION BY seed ORDER BY day) AS k, day, mask FROM (SELECT (year, month, variable, root)::VARCHAR AS seed, day::INT AS day, bit_or(missing_mask)::INT AS mask FROM m JOIN named USING (year, month, variable, i, j) GROUP BY ALL)),
{cascade_sql(RES, MISSING_LIMITS.most_bytes, MISSING_LIMITS.most_fields)} SELECT * EXCLUDE (chunk_id) FROM ({shown_sql(MISSING_LIMITS.most_bytes, MISSING_LIMITS.most_fields)})"""


@query(MISSING_SQL)
def plan_missing(spark: SparkSession, sf: str) -> DataFrame:
    from isotherm.plans.fixtures import grid_obs

    span = grid_obs(spark, sf).agg(F.max("latitude").alias("north"), F.min("longitude").alias("west"), F.min("latitude").alias("south"), F.max("longitude").alias("east"), F.min("date").alias("start"), F.max("date").alias("end"))
    asked = span.withColumns({"variables": F.array(*map(F.lit, ("temperature_2m", "total_precipitation", "snow"))), "hours": F.array(F.lit(12), F.lit(20))})
    return shown(planning.plan_missing(asked, masks_of(spark, sf), RES, MISSING_LIMITS)).drop("chunk_id")
