"""Users' views and functions, read-only SQL, visual queries, templates: Spark's catalog does the work."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.columns import BILINEAR_SQL

#: Words that read-only statements must not hold anywhere, string literals included.
DENIED = ("insert", "update", "delete", "drop", "create", "alter", "truncate", "merge", "copy", "attach", "detach", "call", "grant", "revoke", "set", "load", "refresh")
RESERVED = ("era5", "era5_land", "inmet", "bilinear_weights")
OBJECT = "name string, kind string, body string, created long"


def validate(name: str, kind: str) -> None:
    if not re.fullmatch(r"[A-Za-z_]\w*", name) or name.lower() in RESERVED:
        raise ValueError(f"not a name for an object: {name}")
    if kind not in ("view", "macro"):
        raise ValueError("objects are views or macros")


def upsert(objects: DataFrame, name: str, kind: str, body: str, created: int, replace: bool = True) -> DataFrame:
    """The table of objects with one added or replaced; names are the same whatever their case."""
    validate(name, kind)
    same = F.lower("name") == name.lower()
    if not replace and not objects.where(same).isEmpty():
        raise ValueError(f"{name} exists")
    return objects.where(~same).unionByName(objects.sparkSession.createDataFrame([(name, kind, body, created)], OBJECT))


def without(objects: DataFrame, name: str) -> DataFrame:
    return objects.where(F.lower("name") != name.lower())


def replay(spark: SparkSession, objects: DataFrame) -> DataFrame:
    """Make all objects in the order of their creation; a row for each says whether it worked. Those that fail are tried once more."""
    rows = objects.orderBy("created", "name").collect()  # what users have typed: a few rows
    status: dict[str, str | None] = {}
    for _ in range(2):
        for r in rows:
            if status.get(r["name"], "") is not None:
                status[r["name"]] = make(spark, r["name"], r["kind"], r["body"])
    return spark.createDataFrame([(k, v is None, v) for k, v in status.items()], "name string, ok boolean, error string")


def make(spark: SparkSession, name: str, kind: str, body: str) -> str | None:
    """Create a temporary view (body: a query) or function (body: (parameters) RETURNS type RETURN expression). The error, if any."""
    try:
        validate(name, kind)
        spark.sql(f"CREATE OR REPLACE TEMPORARY {'VIEW' if kind == 'view' else 'FUNCTION'} {name} {'AS ' if kind == 'view' else ''}{body}")
    except (AnalysisException, ParseException, ValueError) as e:
        return str(e).splitlines()[0]
    return None


def register_builtin(spark: SparkSession) -> None:
    spark.sql(BILINEAR_SQL)


def preview(spark: SparkSession, body: str) -> list[tuple[str, str]]:
    """A query's columns; it is analysed, not run."""
    return short_types(spark.sql(body))


#: Names that users see for types.
SHORT = {"float": "float", "double": "float", "decimal": "float", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "boolean": "bool", "date": "date", "timestamp": "datetime", "timestamp_ntz": "datetime"}


def short_types(df: DataFrame) -> list[tuple[str, str]]:
    return [(c, SHORT.get(kind.split("(")[0], "str")) for c, kind in df.dtypes]


def view_schema(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """Columns of a view; none for one that is not there."""
    return short_types(spark.table(name)) if spark.catalog.tableExists(name) else []


def safe_sql(spark: SparkSession, text: str, limit: int | None = None) -> DataFrame:
    """A SELECT or WITH statement without denied words."""
    body = text.strip().rstrip(";")
    if not re.match(r"(?is)^(select|with)\b", body) or ";" in body:
        raise ValueError("only one SELECT or WITH statement is run")
    if found := re.search(rf"(?i)\b({'|'.join(DENIED)})\b", body):
        raise ValueError(f"{found[0]} is not allowed")
    df = spark.sql(body)
    return df.limit(limit) if limit else df


def with_total(df: DataFrame, limit: int) -> tuple[DataFrame, int, bool]:
    """At most `limit` rows, how many there are in truth, and whether some are left out."""
    total = df.count()
    return df.limit(limit), total, total > limit


#: The statements that define objects, as users type them.
DDL = re.compile(r"(?is)create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(view|macro|function)\s+(?:if\s+not\s+exists\s+)?[`\"]?([a-z_]\w*)[`\"]?\s*(.*)")


def run_text(spark: SparkSession, objects: DataFrame, text: str, created: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What a query box runs: a SELECT, or one CREATE VIEW, MACRO or FUNCTION, which is made and kept. (result, objects).

    A macro is written as its parameters with types, AS and an expression, or as a function's RETURNS and RETURN. What
    cannot be made is an error and is not kept; one of the same name is replaced.
    """
    body = re.sub(r"(?s)^(?:\s+|--[^\n]*\n|/\*.*?\*/)+", "", text).strip().rstrip(";")
    found = DDL.fullmatch(body)
    if not found:
        return safe_sql(spark, text, limit), objects
    kind, name, rest = ("view" if found[1].lower() == "view" else "macro"), found[2], found[3]
    validate(name, kind)
    if ";" in rest:
        raise ValueError("only one statement is run")
    if kind == "view":
        rest = re.sub(r"(?i)^as\b\s*", "", rest)
    elif macro := re.fullmatch(r"(?is)(\([^()]*\))\s*as\s+(.*)", rest):
        rest = f"{macro[1]} RETURN {macro[2]}"
    if error := make(spark, name, kind, rest):
        raise ValueError(error)
    there = not objects.where(F.lower("name") == name.lower()).isEmpty()
    status = spark.createDataFrame([(kind.upper(), name, "replaced" if there else "created")], "object string, name string, status string")
    return status, upsert(objects, name, kind, rest, created)


def visual_query(df: DataFrame, columns: list[str] | None = None, where: dict | None = None, group_by: list[str] | None = None, aggregates: list[tuple[str, str, str]] | None = None, order: tuple[str, bool] | None = None, limit: int | None = None) -> DataFrame:
    """where: {"op": "and" or "or", "items": [conditions (column, operator, value) or such groups]}; aggregates: (function, column, name)."""
    out = df.where(_condition(where)) if where else df
    if group_by or aggregates:
        functions = {"avg": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "stddev": F.stddev}
        out = out.groupBy(*(group_by or [])).agg(*[functions[f](c).alias(n) for f, c, n in aggregates or [("count", "*", "count")]])
    elif columns:
        out = out.select(*columns)
    if order:
        out = out.orderBy(F.desc(order[0]) if order[1] else F.asc(order[0]))
    return out.limit(limit) if limit else out


def _condition(group):
    if isinstance(group, dict):
        parts = [_condition(x) for x in group["items"]]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if group["op"] == "and" else (out | p)
        return out
    name, op, value = group
    c = F.col(name)
    tests = {"=": lambda: c == value, "<>": lambda: c != value, "<": lambda: c < value, "<=": lambda: c <= value, ">": lambda: c > value, ">=": lambda: c >= value, "in": lambda: c.isin(value), "like": lambda: c.like(value), "null": c.isNull, "not null": c.isNotNull}
    return tests[op]()


#: Queries over the registered views, in Spark SQL. The long form (variable, value) is to_long()'s.
TEMPLATES = {
    "daily_mean": "SELECT date, avg(temperature_2m) AS mean_temperature FROM era5 GROUP BY date ORDER BY date",
    "grid_coverage": "SELECT DISTINCT latitude, longitude FROM era5 ORDER BY latitude, longitude",
    "era5_and_land": "SELECT a.date, a.latitude, a.longitude, a.variable, a.value AS era5, b.value AS land, a.value - b.value AS difference FROM era5_long a JOIN era5_land_long b USING (date, hour_utc, latitude, longitude, variable)",
    "recent": "SELECT * FROM era5 ORDER BY date DESC, hour_utc DESC LIMIT 100",
    "station_years": "SELECT station_id, year(date) AS year, count(*) AS n FROM inmet GROUP BY ALL ORDER BY station_id, year",
    "station_and_grid": "SELECT station_id, date, hour_utc, temperature - temperature_grid AS difference FROM inmet_with_grid WHERE temperature IS NOT NULL AND temperature_grid IS NOT NULL",
}
