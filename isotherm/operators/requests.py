"""Request tables: expansion to cells, estimates, packing, splitting; rectangles; missing regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.shared import materialize


BOX = ("north", "west", "south", "east")


def axis(low: Column, high: Column, resolution: float, align: str = "node") -> Column:
    """Values from low to high: nodes (multiples of the resolution), or centres of cells."""
    first = F.lit(resolution / 2) if align == "center" else F.lit(0.0)
    n = F.floor((high - low) / resolution + 1e-9).cast("int") + (0 if align == "center" else 1)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.round(low + first + k * resolution, 6))


def expand(requests: DataFrame, resolution: float, align: str = "node", disjoint: bool = False) -> DataFrame:
    """(north, west, south, east, start, end, variables, hours) -> latitude, longitude, date, variable, requested_mask. Lazy: nothing is held. disjoint:
    no two of the requests share a cell, and nothing is shuffled; else masks of shared cells are joined.
    """
    from isotherm.functions.columns import hours_to_mask

    out = requests.withColumn("requested_mask", hours_to_mask("hours"))
    out = out.withColumn("date", F.explode(F.sequence("start", "end"))).withColumn("variable", F.explode("variables"))
    out = out.withColumn("latitude", F.explode(axis(F.col("south"), F.col("north"), resolution, align)))
    out = out.withColumn("longitude", F.explode(axis(F.col("west"), F.col("east"), resolution, align)))
    cell = ["latitude", "longitude", "date", "variable"]
    return out.select(*cell, "requested_mask") if disjoint else out.groupBy(*cell).agg(F.bit_or("requested_mask").alias("requested_mask"))


def cell_count(resolution: float) -> Column:
    """Cells of a request row, without expanding it."""
    side = lambda a, b: F.floor((F.col(a) - F.col(b)) / resolution + 1e-9) + 1
    return side("north", "south") * side("east", "west") * (F.datediff("end", "start") + 1) * F.size("variables")


def by_months(requests: DataFrame) -> DataFrame:
    """Requests once for each month that they have days of, the first and last clipped: year, month, first_day, last_day. No day is expanded, and nothing is shuffled."""
    low, high = F.least("start", "end"), F.greatest("start", "end")
    each = requests.where("start is not null and end is not null").withColumn("__m", F.explode(F.sequence(F.trunc(low, "month"), high, F.expr("interval 1 month"))))
    return each.withColumns({"year": F.year("__m"), "month": F.month("__m"), "first_day": F.greatest("__m", low), "last_day": F.least(F.last_day("__m"), high)}).drop("__m")


def months(requests: DataFrame) -> DataFrame:
    """A row for each month of a request, the first and last clipped: first_day, last_day, n_days."""
    days = by_months(requests.select("request_id", "start", "end"))
    n = (F.datediff("last_day", "first_day") + 1).cast("long")
    return days.groupBy("request_id", "year", "month").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum(n).alias("n_days"))


def grid_points(resolution: float, box: dict[str, Column] | None = None) -> Column:
    """Nodes of a row's box, or of one that is given."""
    at = box or {c: F.col(c) for c in BOX}
    side = lambda a, b: F.ceil(F.round((at[a] - at[b]) / resolution, 9)) + 1
    return side("north", "south") * side("east", "west")


def estimate(requests: DataFrame, resolution: float, most_bytes: int = 300 << 20, most_fields: int = 12_000) -> DataFrame:
    """points, bytes (8 a value), fields, and whether either limit is passed. Columns n_variables, n_hours, n_days are given."""
    fields = F.col("n_variables") * F.col("n_hours") * F.col("n_days")
    out = requests.withColumns({"points": grid_points(resolution), "fields": fields})
    out = out.withColumn("bytes", F.col("points") * F.col("fields") * 8)
    return out.withColumn("too_large", (F.col("bytes") > most_bytes) | (F.col("fields") > most_fields))


def estimate_totals(estimated: DataFrame) -> DataFrame:
    """One row for a whole plan: requests, those beyond a limit, fields and bytes."""
    return estimated.agg(F.count("*").alias("requests"), F.count_if("too_large").alias("too_large"), F.coalesce(F.sum("fields"), F.lit(0)).alias("fields"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def by_variable(requests: DataFrame) -> DataFrame:
    """A row for each variable of a request: variables (array) becomes variable. Requests without one have no row."""
    return requests.withColumn("variable", F.explode("variables")).drop("variables")


def days_a_block(most_bytes: int = 300 << 20, most_fields: int = 12_000) -> Column:
    """Days of equal weight that fit a budget, one at least."""
    a_day = F.col("n_variables") * F.col("n_hours")
    return F.greatest(F.lit(1), F.least(F.floor(F.lit(most_bytes) / (a_day * F.col("points") * 8)), F.floor(F.lit(most_fields) / a_day)))


def pack_days(requests: DataFrame, **budget) -> DataFrame:
    """Consecutive days in blocks under the budget: request_id, block, first_day, last_day (numbers from 1)."""
    k = requests.withColumn("k", days_a_block(**budget))
    days = k.select("request_id", "k", F.explode(F.sequence(F.lit(1), F.col("n_days").cast("int"))).alias("day"))
    return days.groupBy("request_id", F.floor((F.col("day") - 1) / F.col("k")).cast("int").alias("block")).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def splits_needed(ratio: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(F.round(ratio * 1.2, 9)))


def division(tall: Column, wide: Column, parts: Column, start: Column | None = None) -> Column:
    """Struct (ny, nx) of rows and columns with at least so many cells: the side whose pieces are longer, or the height of equal ones, gets one more until that is so. start: from where to go on."""
    begun = F.struct(F.lit(1).alias("ny"), F.lit(1).alias("nx")) if start is None else start

    def more(s: Column) -> Column:
        higher = tall / s["ny"] >= wide / s["nx"]
        return F.struct((s["ny"] + higher.cast("int")).alias("ny"), (s["nx"] + (~higher).cast("int")).alias("nx"))

    steps = parts.cast("int") if start is None else parts.cast("int") - start["ny"] * start["nx"]  # each makes one cell more at least
    return F.aggregate(F.sequence(F.lit(1), steps), begun, lambda s, _: F.when(s["ny"] * s["nx"] < parts, more(s)).otherwise(s))


def tiles(box: dict[str, Column], parts: Column) -> Column:
    """Array of the boxes that a box is divided into, from north to south and west to east; edges to six decimals."""
    tall, wide = box["north"] - box["south"], box["east"] - box["west"]
    cells = division(tall, wide, parts)

    def tile(d: Column) -> Column:
        y, x = tall / d["ny"], wide / d["nx"]
        return F.flatten(F.transform(F.sequence(F.lit(0), d["ny"] - 1), lambda i: F.transform(F.sequence(F.lit(0), d["nx"] - 1), lambda j: F.struct(
            F.round(box["north"] - y * i, 6).alias("north"), F.round(box["west"] + x * j, 6).alias("west"), F.round(box["north"] - y * (i + 1), 6).alias("south"), F.round(box["west"] + x * (j + 1), 6).alias("east")))))

    # the division is made once: a lambda over an array with it alone
    return F.flatten(F.transform(F.array(cells), tile))


def split_area(boxes: DataFrame, parts: Column | int) -> DataFrame:
    """Boxes in at least so many parts, the longer side cut first; edges to six decimals."""
    n = F.lit(parts) if isinstance(parts, int) else parts
    out = boxes.withColumn("__tile", F.explode(tiles({c: F.col(c) for c in BOX}, n)))
    return out.withColumns({c: F.col(f"__tile.{c}") for c in BOX}).drop("__tile")


# --- rectangles -----------------------------------------------------------------------------------------------


def intersect(a: str, b: str) -> dict[str, Column]:
    """The common box of two aliased rows' boxes; it is one if north > south and east > west."""
    c = lambda s, k: F.col(f"{s}.{k}")
    return {"north": F.least(c(a, "north"), c(b, "north")), "south": F.greatest(c(a, "south"), c(b, "south")), "west": F.greatest(c(a, "west"), c(b, "west")), "east": F.least(c(a, "east"), c(b, "east"))}


#: Boxes of a cell up to which it is solved as it is; cells with more are cut in CUTS x CUTS.
MOST_BOXES = 512
CUTS = 4


def clipped(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Boxes' parts in their row's cell, each once, without those that have no area there."""
    part = {"west": F.greatest("west", "cell.x0"), "east": F.least("east", "cell.x1"), "south": F.greatest("south", "cell.y0"), "north": F.least("north", "cell.y1")}
    return rows.withColumns(part).where("east > west and north > south").select(*keep, "cell", "west", "east", "south", "north").distinct()


def cut_up(cell: Column) -> Column:
    """The CUTS x CUTS parts of a cell as an array."""
    side = lambda a, b: [cell[a] + (cell[b] - cell[a]) * (k / CUTS) for k in range(CUTS)] + [cell[b]]
    xs, ys = side("x0", "x1"), side("y0", "y1")
    return F.array(*[F.struct(x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")) for x0, x1 in zip(xs, xs[1:], strict=False) for y0, y1 in zip(ys, ys[1:], strict=False)])


def solvable(cells: DataFrame, boxes: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Cells (key, id, and their edges) and their boxes' parts (id, and a box), cut until a cell has at most so many; cells that one box covers are left out.

    Cells with more are cut up, and their boxes again clipped; boxes that look alike in a cell are one, so cells
    need not become smaller than the distances between edges. A large box is in few cells: those inside it are
    covered, and what else lies there is dropped. Each round counts, and joins, by key and cell; nothing is held.
    """
    done, own, turn = [], ["cell"], 0
    covers = (F.col("west") <= F.col("cell.x0")) & (F.col("east") >= F.col("cell.x1")) & (F.col("south") <= F.col("cell.y0")) & (F.col("north") >= F.col("cell.y1"))
    while True:
        stats = boxes.groupBy(key, *own).agg(F.count("*").alias("n"), F.max(covers).alias("full"))
        state = materialize(cells.join(stats, [key, *own], "left").select(key, "cell", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("full", F.lit(False)).alias("full")).where("not full").withColumn("id", F.monotonically_increasing_id() + (turn << 56)), "cells")
        small, large = state.where(F.col("n") <= most).select(key, "cell", "id"), state.where(F.col("n") > most)
        done.append((small.select(key, "id", "cell.*"), boxes.join(small, [key, *own]).select("id", "west", "east", "south", "north")))
        turn += 1
        if large.isEmpty():
            break
        cut = large.select(key, F.col("cell").alias("whole"), F.explode(cut_up(F.col("cell"))).alias("cell"))
        parts = boxes.withColumnRenamed("cell", "whole").join(cut, [key, "whole"])
        cells, boxes = cut.select(key, "cell"), materialize(clipped(parts, [key]), "parts")
    return reduce(DataFrame.unionByName, [c for c, _ in done]), reduce(DataFrame.unionByName, [b for _, b in done])


def joined(boxes: DataFrame, same: list[str], low: str, high: str) -> DataFrame:
    """Boxes that are equal in `same` and touch along the other side as one."""
    side = Window.partitionBy(*same).orderBy(low)
    runs = boxes.withColumn("new", F.when(F.lag(high).over(side) == F.col(low), 0).otherwise(1)).withColumn("run", F.sum("new").over(side))
    return runs.groupBy(*same, "run").agg(F.min(low).alias(low), F.max(high).alias(high)).drop("run")


def gaps_of(targets: DataFrame, holes: DataFrame, key: str, most: int) -> DataFrame:
    """What is left of each target, as boxes (key, north, west, south, east): the gaps in the strips of its cells."""
    cell = lambda t: F.struct(F.col(f"{t}west").alias("x0"), F.col(f"{t}east").alias("x1"), F.col(f"{t}south").alias("y0"), F.col(f"{t}north").alias("y1")).alias("cell")
    cells = targets.select(key, cell("")).where("cell.x1 > cell.x0 and cell.y1 > cell.y0")
    boxes = materialize(clipped(cells.join(holes.select(key, *BOX), key), [key]), "holes")
    cells, boxes = solvable(cells, boxes, key, most)
    edges = cells.select("id", F.explode(F.array("x0", "x1")).alias("a")).unionByName(boxes.select("id", F.explode(F.array("west", "east")).alias("a"))).distinct()
    strips = edges.withColumn("b", F.lead("a").over(Window.partitionBy("id").orderBy("a"))).where("b is not null")
    held = strips.join(boxes, "id").where("west <= a and east >= b").select("id", "a", "b", "south", "north")
    # a hole of no height at the top of each strip closes its last gap, and one at its bottom begins the first
    ends = strips.join(cells, "id").select("id", "a", "b", F.explode(F.array("y0", "y1")).alias("south")).withColumn("north", F.col("south"))
    order = Window.partitionBy("id", "a").orderBy("south", "north")
    seen = F.max("north").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = held.unionByName(ends).withColumn("from", seen).where("south > from")
    return gaps.join(cells.select("id", key), "id").select(key, F.col("a").alias("west"), F.col("b").alias("east"), F.col("from").alias("south"), F.col("south").alias("north"))


def residual(targets: DataFrame, holes: DataFrame, key: str, most: int = MOST_BOXES) -> DataFrame:
    """Each target box without its holes, as boxes: strips between the edges, the gaps in them, and equal neighbours joined again.

    targets: key and a box, one row a key. holes: key and boxes, any number with any edges: a key's area is cut into
    cells with at most `most` of them, so that strips meet the boxes of their cell only.
    """
    wide = joined(gaps_of(targets, holes, key, most), [key, "south", "north"], "west", "east")
    return joined(wide, [key, "west", "east"], "south", "north").select(key, "north", "west", "south", "east")  # what a cell's border has cut


def area(boxes: DataFrame, key: str) -> DataFrame:
    return boxes.groupBy(key).agg(F.sum((F.col("north") - F.col("south")) * (F.col("east") - F.col("west"))).alias("area"))


def union_area(boxes: DataFrame, key: str, most: int = MOST_BOXES) -> DataFrame:
    """The area that each key's boxes cover together: that of the box around them without what is left of it."""
    around = boxes.where("north > south and east > west").groupBy(key).agg(F.max("north").alias("north"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"))
    left = area(gaps_of(around, boxes, key, most), key).withColumnRenamed("area", "left")
    return area(around, key).join(left, key, "left").select(key, F.round(F.col("area") - F.coalesce("left", F.lit(0.0)), 6).alias("area"))


# --- missing regions ------------------------------------------------------------------------------------------


def cell_components(cells: DataFrame, group: list[str]) -> DataFrame:
    """Cells (group, i, j) with a label of their 4-connected component within the group: the smallest run's number.

    Runs of neighbouring j in a row i are nodes; runs that overlap in neighbouring rows are links. The components of
    the links are made by alternating stars, so long chains take a logarithmic number of rounds.
    """
    from isotherm.operators.stars import components

    row = Window.partitionBy(*group, "i").orderBy("j")
    marked = cells.select(*group, "i", "j").distinct().withColumn("island", F.col("j") - F.row_number().over(row))
    named = materialize(marked.withColumn("run", F.xxhash64(*group, "i", "island")), "cells")  # read for both sides of the links, and at the end
    runs = named.groupBy(*group, "i", "run").agg(F.min("j").alias("j0"), F.max("j").alias("j1"))
    a, b = runs.alias("a"), runs.withColumn("i", F.col("i") - 1).alias("b")
    on = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group] + [F.col("a.i") == F.col("b.i"), F.col("a.j0") <= F.col("b.j1"), F.col("b.j0") <= F.col("a.j1")]
    roots = components(a.join(b, on).select(F.col("a.run").alias("a"), F.col("b.run").alias("b")))
    return named.join(roots, named["run"] == roots["node"], "left").select(*group, "i", "j", F.coalesce("root", "run").alias("component"))


def component_boxes(labelled: DataFrame, group: list[str], resolution: float) -> DataFrame:
    """The box of each component, half a cell beyond its outer centres, and its cells."""
    box = labelled.groupBy(*group, "component").agg(*[f(c).alias(n) for c, f, n in (("i", F.min, "i0"), ("i", F.max, "i1"), ("j", F.min, "j0"), ("j", F.max, "j1"))], F.count("*").alias("n_cells"))
    edge = lambda c, d: F.round((F.col(c) + d) * resolution, 6)
    return box.select(*group, "component", edge("i1", 0.5).alias("north"), edge("j0", -0.5).alias("west"), edge("i0", -0.5).alias("south"), edge("j1", 0.5).alias("east"), "n_cells")


def missing_regions(missing: DataFrame, resolution: float) -> tuple[DataFrame, DataFrame]:
    """coverage.diff() rows -> cells (year, month, variable, i, j, component, day, missing_mask), and each connected region's box."""
    from isotherm.functions.columns import cell_index

    group = ["year", "month", "variable"]
    cells = missing.select(F.year("date").alias("year"), F.month("date").alias("month"), "variable", cell_index("latitude", resolution).alias("i"), cell_index("longitude", resolution).alias("j"), F.dayofmonth("date").alias("day"), "missing_mask")
    labelled = cell_components(cells, group)
    return cells.join(labelled, [*group, "i", "j"]), component_boxes(labelled, group, resolution)


def missing_chunks(missing: DataFrame, resolution: float) -> DataFrame:
    """coverage.diff() rows -> a chunk for each month, variable and connected region: box, days, mask of hours."""
    key = ["year", "month", "variable", "component"]
    cells, regions = missing_regions(missing, resolution)
    days = cells.groupBy(*key).agg(F.sort_array(F.collect_set("day")).alias("days"), F.bit_or("missing_mask").alias("hours_mask"))
    return regions.join(days, key)


def missing_days(missing: DataFrame, resolution: float) -> DataFrame:
    """missing_chunks() whose days have their own hours: an array of (day, mask), at most a month long."""
    key = ["year", "month", "variable", "component"]
    cells, regions = missing_regions(missing, resolution)
    each = cells.groupBy(*key, "day").agg(F.bit_or("missing_mask").alias("mask"))
    days = each.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("day", "mask"))).alias("days"))
    return regions.join(days, key)


def diff_preview(requested: DataFrame, missing: DataFrame, total_bytes: int = 0) -> DataFrame:
    """One row: cells (of a day and variable) and cell-hours asked and missing, the share of cells that need not be fetched, and total_bytes by the share that has to be."""
    of = lambda df, c, n: df.agg(F.count("*").alias(f"{n}_cells"), F.coalesce(F.sum(F.bit_count(c).cast("long")), F.lit(0)).alias(f"{n}_hours"))
    both = of(requested, "requested_mask", "requested").crossJoin(of(missing, "missing_mask", "missing"))  # one row each
    share = F.when(F.col("requested_cells") > 0, F.col("missing_cells") / F.col("requested_cells")).otherwise(F.lit(1.0))
    return both.withColumns({"savings_pct": F.round((1 - share) * 100, 2), "missing_bytes": F.floor(share * total_bytes).cast("long")})


def missing_sample(missing: DataFrame, rows: int = 100) -> DataFrame:
    """The first missing cells, by place, day and variable."""
    return missing.orderBy("latitude", "longitude", "date", "variable").limit(rows)


def incremental_plan(requests: DataFrame, manifest: DataFrame, resolution: float) -> DataFrame:
    """What of some requests the manifest of finished chunks lacks, as boxes: request_id, variable, year, month, days, hours and a box.

    requests: request_id, variables, start, end, hours and a box, which is snapped outward to the grid. A chunk covers
    its box for a variable and month if it has all of the days and hours asked there. Boxes of a month do not overlap.
    """
    from isotherm.functions.columns import snap_box
    from isotherm.operators.storage import covering

    box = ["north", "west", "south", "east"]
    snapped = requests.withColumns(snap_box(*[F.col(c) for c in box], resolution))
    each = by_variable(snapped.join(months(requests), "request_id"))
    each = each.withColumn("days", F.sequence(F.dayofmonth("first_day"), F.dayofmonth("last_day")))
    target = F.concat_ws("\u0001", F.col("request_id").cast("string"), "variable", F.col("year").cast("string"), F.col("month").cast("string"))
    each = each.select(target.alias("target"), "request_id", "variable", "year", "month", "days", "hours", *box)
    holes = covering(each.drop("request_id").withColumnRenamed("target", "request_id"), manifest).withColumnRenamed("request_id", "target")
    left = residual(each.select("target", *box), holes, "target")
    return left.join(each.drop(*box), "target").select("request_id", "variable", "year", "month", "days", "hours", *box)


def years(ranges: DataFrame) -> DataFrame:
    """The years that ranges of dates (start, end) touch, each once."""
    return ranges.select(F.explode(F.sequence(F.year("start"), F.year("end"))).alias("year")).distinct()
