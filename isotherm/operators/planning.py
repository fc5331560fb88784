"""Requests that fit a service's limits: what is too large is split by days, then by area, then by variables.

A piece is a row: variables, days of a month, hours and a box. Each tier looks at what its predecessor left, keeps what
fits and splits the rest; a piece that the last tier cannot make fit is an error row. All splitting is arithmetic within
a row, so a plan of any number of requests needs no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isotherm.functions.columns import hours_to_mask, snap_box
from isotherm.operators.requests import BOX, by_months, division, grid_points, incremental_plan, missing_days

#: Most parts of an area; its parts are doubled until they fit or are so many.
MOST_PARTS = 64


@dataclass(frozen=True)
class Limits:
    """What a request may ask for: bytes at 8 a value, and fields (variables x hours x days)."""

    most_bytes: int = 300 << 20
    most_fields: int = 12_000

    def allow(self, fields: Column, points: Column) -> Column:
        return (fields <= self.most_fields) & (fields * points * 8 <= self.most_bytes)

    def room(self, points: Column, variables: Column) -> Column:
        """The most that days x hours of so many points may be for all the variables."""
        by_bytes = F.when(points > 0, F.call_function("div", F.lit(self.most_bytes), points * 8))
        return F.call_function("div", F.least(F.lit(self.most_fields).cast("long"), by_bytes), F.size(variables))


def day_blocks(days: Column, room: Column) -> Column:
    """Blocks (first, n, mask) of an array of (day, mask), in its order, first counting from 1: a block is closed where the next day would pass the room.

    As a block asks for the hours of all its days, a day with other hours makes the days before it dearer; blocks are
    so found by going through the days, not by dividing.
    """
    none = F.struct(F.array().cast("array<struct<first:int,n:int,mask:int>>").alias("closed"), F.lit(1).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("mask"))

    def closed(s: Column) -> Column:
        return F.concat(s["closed"], F.array(F.struct(s["first"].alias("first"), s["n"].alias("n"), s["mask"].alias("mask"))))

    def add(s: Column, day: Column) -> Column:
        mask = s["mask"].bitwiseOR(day["mask"])
        fits = (s["n"] > 0) & ((s["n"] + 1) * F.bit_count(mask) <= room)
        longer = F.struct(s["closed"].alias("closed"), s["first"].alias("first"), (s["n"] + 1).alias("n"), mask.alias("mask"))
        alone = F.struct(F.when(s["n"] > 0, closed(s)).otherwise(s["closed"]).alias("closed"), (s["first"] + s["n"]).alias("first"), F.lit(1).alias("n"), day["mask"].alias("mask"))
        return F.when(fits, longer).otherwise(alone)

    return F.aggregate(days, none, add, closed)


#: How many parts an area may have: twice as many each time.
DOUBLED = [1 << k for k in range(1, MOST_PARTS.bit_length())]


def divided(seeds: DataFrame, resolution: float, limits: Limits) -> DataFrame:
    """Seeds with the rows and columns (__d) that make each number of DOUBLED parts, and the points of the first part on the grid (__p), until those fit the fields of the seed's dearest block (__f); null beyond, and where no block's area is split.

    Each division goes on where the one with half as many parts has ended.
    """
    tall, wide = F.col("north") - F.col("south"), F.col("east") - F.col("west")
    out, last = seeds, F.when(~limits.allow(F.col("__f"), F.col("points")) & (F.col("points") > 1), F.struct(F.lit(1).alias("ny"), F.lit(1).alias("nx")))
    for n in DOUBLED:
        out = out.withColumn(f"__d{n}", division(tall, wide, F.lit(n), last))
        if n < MOST_PARTS:
            south, east = F.round(F.col("north") - tall / F.col(f"__d{n}.ny"), 6), F.round(F.col("west") + wide / F.col(f"__d{n}.nx"), 6)
            first = snap_box(F.round("north", 6), F.round("west", 6), south, east, resolution)
            out = out.withColumn(f"__p{n}", F.when(F.col(f"__d{n}").isNotNull(), grid_points(resolution, first)))
            last = F.when(~limits.allow(F.col("__f"), F.col(f"__p{n}")), F.col(f"__d{n}"))
    return out


#: Seeds without a box give no piece.
PLACED = " and ".join(f"{c} is not null" for c in BOX)


def most_divided() -> Column:
    """The rows and columns that the dearest block of a seed needs; null if its area is not split."""
    return F.coalesce(*[F.col(f"__d{n}") for n in reversed(DOUBLED)])


def tiled(rows: DataFrame, resolution: float) -> DataFrame:
    """A row for each part of a box that __dims (ny, nx) divides: the part on the grid, each once, and its label __t2. Where __dims is null, boxes stay as they are.

    Parts are products of ranges of latitudes and of longitudes. Those that are equal once they are on the grid are
    neighbours, so a part that is there already has its predecessor's edges.
    """
    split = F.col("__dims").isNotNull()
    count = lambda c: F.coalesce(F.col(f"__dims.{c}"), F.lit(1))
    tall, wide = F.col("north") - F.col("south"), F.col("east") - F.col("west")
    out = rows.withColumns({"__ny": count("ny"), "__nx": count("nx")}).withColumns({"__h": tall / F.col("__ny"), "__w": wide / F.col("__nx")})
    on_grid = lambda y0, x0, y1, x1: snap_box(F.round(y0, 6), F.round(x0, 6), F.round(y1, 6), F.round(x1, 6), resolution)

    def part(y: Column, x: Column) -> dict[str, Column]:
        at = lambda k: F.col("north") - F.col("__h") * k, lambda k: F.col("west") + F.col("__w") * k
        return on_grid(at[0](y), at[1](x), at[0](y + 1), at[1](x + 1))

    for k, n, sides in (("__y", "__ny", ("north", "south")), ("__x", "__nx", ("west", "east"))):
        out = out.withColumn(k, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
        own, before = part(F.col("__y"), F.col("__x")) if k == "__x" else part(F.col(k), F.col(k)), part(F.col(k) - 1, F.col(k) - 1)
        out = out.withColumns({f"__{c}": F.when(split, own[c]).otherwise(F.col(c)) for c in sides})
        out = out.where((F.col(k) == 0) | (F.col(f"__{sides[0]}") != before[sides[0]]) | (F.col(f"__{sides[1]}") != before[sides[1]]))
    label = F.concat(F.lit("a-"), (F.col("__ny") * F.col("__nx")).cast("string"), F.lit("-part-"), (F.col("__y") * F.col("__nx") + F.col("__x") + 1).cast("string"))
    return out.withColumns({c: F.col(f"__{c}") for c in BOX} | {"__t2": F.when(split, label)})


def two_digits(day: Column) -> Column:
    """A day of a month as text, looked up where that is possible: it is made for each piece."""
    return F.coalesce(F.get(F.array(*[F.lit(f"{k:02d}") for k in range(32)]), day), F.lpad(day.cast("string"), 2, "0"))


def pieces(rows: DataFrame, block: dict[str, Column], resolution: float, limits: Limits) -> DataFrame:
    """A piece for each part of a row's box, block and, where all variables are too many, variable.

    rows: seed, year, month, variables (__v), box, its division (__dims), blocks (__b) and whether these are labelled
    (__many). block: what a block asks for, days (its days), n of them, from and to (the first and last), mask, from columns
    with __b being one block.
    """
    out = tiled(rows, resolution)
    # what a part's pieces share is made before they are
    out = out.withColumns({"points": grid_points(resolution).cast("long"), "__head": F.concat_ws("_", "seed", "__t2", F.when(F.col("__many"), F.lit("d")))}).withColumn("__b", F.explode("__b"))
    out = out.withColumns({"days": block["days"], "hours_mask": block["mask"], "__hours": block["n"].cast("long") * F.bit_count(block["mask"])})
    if_many = lambda c: F.when(F.col("__many"), c).otherwise("")
    label = F.concat("__head", if_many(two_digits(block["from"])), if_many(F.lit("-")), if_many(two_digits(block["to"])))
    fits = limits.allow(F.size("__v") * F.col("__hours"), F.col("points"))
    # one number for all variables, or one for each of them
    out = out.withColumn("__k", F.explode(F.when(fits, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("__v") - 1))))
    out = out.withColumn("variables", F.when(fits, F.col("__v")).otherwise(F.array(F.get("__v", F.col("__k")))))
    alone = F.when(F.size("__v") > F.size("variables"), F.concat(F.lit("_v-"), F.regexp_replace(F.get("variables", F.lit(0)), "[^0-9A-Za-z]", "-"))).otherwise("")
    out = out.withColumns({"chunk_id": F.concat(label, alone), "fields": F.size("variables") * F.col("__hours")})
    out = out.withColumn("bytes", F.col("fields") * F.col("points") * 8)
    error = F.format_string(f"%d bytes of {limits.most_bytes}, %d fields of {limits.most_fields}", "bytes", "fields")
    return out.select("seed", "chunk_id", "year", "month", "variables", "days", "hours_mask", *BOX, "points", "fields", "bytes", F.when(~limits.allow(F.col("fields"), F.col("points")), error).alias("error"))


def split_to_fit(seeds: DataFrame, resolution: float, limits: Limits = Limits()) -> DataFrame:
    """Pieces of seeds (seed, year, month, variables, days, and a box on the grid), days being an array of (day, mask of hours).

    Returns seed, chunk_id, year, month, variables, days, hours_mask, the box, points, fields, bytes, and error, which is
    null for pieces within the limits. chunk_id is the seed with a label for each tier that has split it, so pieces
    have different ones if seeds have. Seeds without days, hours, variables or a box ask for nothing and give no piece.

    What is found by going through days or divisions is found once a seed; blocks whose area needs as many parts
    share these, and a piece is made from columns alone.
    """
    asked = F.aggregate("days", F.lit(0), lambda m, d: m.bitwiseOR(d["mask"]))
    out = seeds.where(PLACED).select("seed", "year", "month", F.col("variables").alias("__v"), F.filter("days", lambda d: d["mask"] != 0).alias("__d"), *BOX, asked.alias("__m")).where("size(__v) > 0 and __m <> 0")
    out = out.withColumn("points", grid_points(resolution).cast("long")).withColumn("__room", limits.room(F.col("points"), F.col("__v")))
    out = out.withColumn("__whole", F.size("__d") * F.bit_count("__m") <= F.col("__room"))
    whole = F.array(F.struct(F.lit(1).alias("first"), F.size("__d").alias("n"), F.col("__m").alias("mask")))
    out = out.withColumn("__b", F.when(F.col("__whole"), whole).otherwise(day_blocks(F.col("__d"), F.col("__room"))))
    fields = lambda b: F.size("__v") * b["n"].cast("long") * F.bit_count(b["mask"])
    out = divided(out.withColumn("__f", F.array_max(F.transform("__b", fields))), resolution, limits)
    out = out.withColumn("__split", most_divided().isNotNull()).withColumn("__dims", F.array(*[F.col(f"__d{n}") for n in DOUBLED]))

    def level(b: Column) -> Column:
        """Where the dimensions are that a block needs, counted from 1; 0 if it fits."""
        at = F.when(limits.allow(fields(b), F.col("points")), 0)
        for k, n in enumerate(DOUBLED[:-1], 1):
            at = at.when(limits.allow(fields(b), F.col(f"__p{n}")), k)
        return at.otherwise(len(DOUBLED))

    def share(k: Column) -> Column:
        return F.struct(F.get("__dims", k - 1).alias("__dims"), F.filter("__b", lambda b, i: F.get("__levels", i) == k).alias("__b"))

    out = out.withColumn("__levels", F.when(F.col("__split"), F.transform("__b", level)))
    alone = F.struct(F.lit(None).cast("struct<ny:int,nx:int>").alias("__dims"), F.col("__b"))
    out = out.withColumn("__s", F.when(F.col("__split"), F.transform(F.array_distinct("__levels"), share)).otherwise(F.array(alone)))
    # an array is never empty; exploded as an outer one it is not made twice, once to look whether it is
    out = out.select("seed", "year", "month", "__v", *BOX, F.col("__d.day").alias("__days"), (~F.col("__whole") & (F.size("__d") > 1)).alias("__many"), F.explode_outer("__s").alias("__s"))
    out = out.select("seed", "year", "month", "__v", *BOX, "__days", "__many", "__s.*")
    first, n = F.col("__b.first"), F.col("__b.n")
    block = {"n": n, "mask": F.col("__b.mask"), "from": F.get("__days", first - 1), "to": F.get("__days", first + n - 2), "days": F.slice("__days", first, n)}
    return pieces(out, block, resolution, limits)


def split_months(months: DataFrame, resolution: float, limits: Limits = Limits()) -> DataFrame:
    """As split_to_fit(), of seeds whose days follow each other and ask for the same hours: first_day and last_day, days of a month, and the mask __mask. Blocks are so found by dividing: all have as many days, but for the last; areas are split where a day alone does not fit, and all blocks then need the same parts."""
    out = months.where(PLACED).where("size(variables) > 0 and __mask <> 0")
    out = out.withColumns({"__v": F.col("variables"), "__nd": F.col("last_day") - F.col("first_day") + 1, "points": grid_points(resolution).cast("long")})
    out = out.withColumn("__most", F.call_function("div", limits.room(F.col("points"), F.col("__v")), F.bit_count("__mask")))
    out = out.withColumn("__n", F.greatest(F.lit(1), F.least("__nd", "__most").cast("int")))
    out = divided(out.withColumn("__f", F.size("__v") * F.col("__n").cast("long") * F.bit_count("__mask")), resolution, limits)
    many = (F.col("__most") < F.col("__nd")) & (F.col("__nd") > 1)
    out = out.select("seed", "year", "month", "__v", *BOX, "__mask", "__n", "last_day", many.alias("__many"), most_divided().alias("__dims"), F.sequence("first_day", "last_day", "__n").alias("__b"))
    last = F.least(F.col("__b") + F.col("__n") - 1, F.col("last_day"))
    return pieces(out, {"n": last - F.col("__b") + 1, "mask": F.col("__mask"), "from": F.col("__b"), "to": last, "days": F.sequence("__b", last)}, resolution, limits)


def checked(pieces: DataFrame) -> DataFrame:
    """Pieces, if all are within the limits; else an error with the figures of the first that is not."""
    if bad := pieces.where("error is not null").orderBy("chunk_id").limit(1).collect():
        raise ValueError(f"{bad[0]['chunk_id']} does not fit: {bad[0]['error']}; fewer hours a day, a smaller area or higher limits are needed")
    return pieces


def seed_of(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def _month(year: str = "year", month: str = "month") -> Column:
    return F.format_string("%04d%02d", year, month)


def plan_requests(requests: DataFrame, resolution: float, limits: Limits = Limits()) -> DataFrame:
    """A full plan of requests (request_id, variables, start, end, hours, a box): the box snapped outward, months apart, each split to fit.

    A request can become hundreds of pieces, so requests are dealt out by their ids first, be their files as few as they
    may. Requests without an id have no piece; of rows that share one each has its own.
    """
    snapped = snap_box(*[F.col(c) for c in BOX], resolution) | {"__mask": hours_to_mask("hours")}
    asked = requests.where("request_id is not null").select("request_id", "variables", "start", "end", *[c.alias(k) for k, c in snapped.items()])
    # by number: few bytes can be many pieces, so small partitions are not to be joined again
    each = by_months(asked.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), "request_id"))
    seed = seed_of(F.col("request_id").cast("string"), _month())
    return split_months(each.withColumns({"seed": seed, "first_day": F.dayofmonth("first_day"), "last_day": F.dayofmonth("last_day")}), resolution, limits)


def plan_incremental(requests: DataFrame, manifest: DataFrame, resolution: float, limits: Limits = Limits()) -> DataFrame:
    """A plan of what the manifest of finished chunks lacks: incremental_plan()'s boxes, each split to fit. Nothing is lacking: no rows."""
    left = incremental_plan(requests, manifest, resolution)
    place = F.concat_ws(",", *[F.col(c).cast("string") for c in BOX])
    days = F.transform("days", lambda d: F.struct(d.alias("day"), hours_to_mask("hours").alias("mask")))
    seeds = left.select(seed_of(F.col("request_id").cast("string"), _month(), "variable", place).alias("seed"), "year", "month", F.array("variable").alias("variables"), days.alias("days"), *BOX)
    return split_to_fit(seeds, resolution, limits)


def plan_missing(requests: DataFrame, masks: DataFrame, resolution: float, limits: Limits = Limits()) -> DataFrame:
    """A plan of the cells and hours that a store lacks: requests are snapped and expanded, held against its hour masks, and each month's connected regions become seeds whose days have their own hours.

    requests as for plan_requests(); masks as coverage keeps them: latitude, longitude, date, variable, mask.
    """
    from isotherm.operators.coverage import diff
    from isotherm.operators.requests import expand

    snapped = requests.withColumns(snap_box(*[F.col(c) for c in BOX], resolution))
    regions = missing_days(diff(expand(snapped, resolution), masks), resolution)
    place = F.concat_ws(",", *[F.col(c).cast("string") for c in BOX])
    seeds = regions.select(seed_of(_month(), "variable", place, "component").alias("seed"), "year", "month", F.array("variable").alias("variables"), "days", *BOX)
    return split_to_fit(seeds, resolution, limits)
