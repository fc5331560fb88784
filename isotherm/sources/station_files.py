"""Irregular station files: Latin-1, semicolons, decimal commas, lines of metadata before a header that has to be found."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.columns import station_date, station_hour, station_number

#: How a header's first two fields begin, and the order of a data line's measurements after date and hour.
HEADER = ("DATA", "HORA")
MEASUREMENTS = (
    "precipitation", "pressure", "pressure_max", "pressure_min", "radiation", "temperature", "dewpoint", "temperature_max", "temperature_min", "dewpoint_max", "dewpoint_min", "humidity_max", "humidity_min", "humidity",
    "wind_direction", "wind_gust", "wind_speed",
)
#: Letters with marks, and what they are compared as.
ACCENTS = ("ÁÀÂÃÄÇÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑ", "AAAAACEEEEIIIIOOOOOUUUUN")
#: How the keys of metadata lines begin, without marks.
META_KEYS = {"regiao": "REGIAO", "uf": "UF", "nome": "ESTACAO", "station_id": "CODIGO", "latitude": "LATITUDE", "longitude": "LONGITUDE", "altitude": "ALTITUDE", "data_fundacao": "DATA DE FUNDACAO"}


def read_station_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each dated line of each file, with the file's metadata. Lines beyond the known fields are cut; shorter ones fail."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.decode("content", "ISO-8859-1").alias("text"))
    return parse_station_texts(files)


def parse_station_texts(files: DataFrame) -> DataFrame:
    """files: file, text. A file is one row: its lines' meaning depends on where its header stands. One without a header is an error.

    year is the file's: the first that its lines have, or else the last of its name.
    """
    lines = files.select("file", F.transform(F.split("text", "\n"), lambda x: F.rtrim(F.replace(x, F.lit("\r"), F.lit("")))).alias("lines"))
    begins = lambda x, k: F.startswith(F.upper(F.ltrim(F.coalesce(F.get(F.split(x, ";"), k), F.lit("")))), F.lit(HEADER[k]))
    header = F.array_position(F.transform("lines", lambda x: begins(x, 0) & begins(x, 1)), True).cast("int")
    lines = lines.withColumn("header", header)
    lines = lines.withColumn("header", F.when(F.col("header") > 0, F.col("header")).otherwise(F.raise_error(F.concat(F.lit("no header in "), "file")).cast("int")))
    head = F.transform(F.slice("lines", 1, F.col("header") - 1), lambda x: F.split(x, ";"))
    plain = lambda x: F.translate(F.upper(F.trim(F.replace(x, F.lit(":"), F.lit("")))), *ACCENTS)

    def meta(start: str):
        return F.trim(F.get(F.get(F.filter(head, lambda x: plain(F.get(x, 0)).startswith(start)), 0), 1))

    named = {k: meta(v) for k, v in META_KEYS.items()}
    files = lines.select("file", *[v.alias(k) for k, v in named.items()], F.slice("lines", F.col("header") + 1, F.size("lines")).alias("lines"))
    name = F.split("file", "_")  # the source, two areas, the station
    files = files.withColumns({"station_id": F.coalesce(F.nullif("station_id", F.lit("")), F.when(F.upper(F.get(name, F.lit(0))) == "INMET", F.upper(F.get(name, F.lit(3)))))} | {c: station_number(c) for c in ("latitude", "longitude", "altitude")})
    by_name = F.regexp_extract("file", r"(\d{4})(?!.*\d{4})", 1).try_cast("int")
    by_line = F.array_min(F.transform("lines", lambda x: F.year(station_date(F.get(F.split(x, ";"), 0)))))
    files = files.withColumn("year", F.coalesce(by_line, by_name))
    rows = files.withColumn("line", F.explode("lines")).drop("lines").where(F.trim("line") != "").withColumn("field", F.split("line", ";"))
    rows = rows.withColumn("field", F.when(F.size("field") >= 19, F.col("field")).otherwise(F.raise_error(F.concat(F.lit("fewer than 19 fields in "), "file")).cast("array<string>")))
    rows = rows.withColumns({"date": station_date(F.get("field", 0)), "hour_utc": station_hour(F.get("field", 1))} | {c: station_number(F.get("field", k + 2)) for k, c in enumerate(MEASUREMENTS)})
    return rows.where("date is not null").drop("line", "field")


def write_station_years(df: DataFrame, path: str) -> None:
    from isotherm.sources.tables import replace_partitions

    replace_partitions(df.sortWithinPartitions("station_id", "date", "hour_utc").withColumnRenamed("station_id", "station"), path, ("station", "year"))
