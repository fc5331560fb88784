"""Which grid nodes belong to which region; regions' boxes by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.shared import materialize


#: Degrees of a cell's side, from the coarsest to the finest; each is a whole multiple of the next.
SIZES = (2.0, 0.25)
#: Edges that pass a cell by less than this count as touching it.
TOUCH = 1e-9


def edges_of(vertices: DataFrame) -> DataFrame:
    """The edges (region, y0, x0, y1, x1) of vertices (region, ring, n, lat, lon), rings closed by themselves."""
    ring = Window.partitionBy("region", "ring").orderBy("n")
    all_ring = Window.partitionBy("region", "ring")
    nxt = lambda c: F.coalesce(F.lead(c).over(ring), F.min_by(c, "n").over(all_ring))
    return vertices.select("region", F.col("lat").cast("double").alias("y0"), F.col("lon").cast("double").alias("x0"), nxt("lat").cast("double").alias("y1"), nxt("lon").cast("double").alias("x1"))


def crossing(y: Column) -> Column:
    """The longitude where an edge crosses a latitude that it spans."""
    return (F.col("x1") - F.col("x0")) * (y - F.col("y0")) / (F.col("y1") - F.col("y0")) + F.col("x0")


def spans(y: Column) -> Column:
    return (F.col("y0") > y) != (F.col("y1") > y)


def by_rows(edges: DataFrame, size: float) -> DataFrame:
    """Edges once for each row i of cells that they touch."""
    low, high = F.least("y0", "y1") - TOUCH, F.greatest("y0", "y1") + TOUCH
    return edges.withColumn("i", F.explode(F.sequence(F.floor(low / size), F.floor(high / size))))


def touched(edges: DataFrame, size: float) -> DataFrame:
    """Cells (region, i, j) that an edge passes through: in each row of cells the part of the edge within it."""
    level = F.col("y0") == F.col("y1")
    ends = [F.greatest(F.least("y0", "y1"), F.col("i") * size), F.least(F.greatest("y0", "y1"), (F.col("i") + 1) * size)]
    a, b = (F.when(level, F.col(x)).otherwise(crossing(y)) for x, y in zip(("x0", "x1"), ends, strict=True))
    least, most = F.least(F.col("a"), F.col("b")) - TOUCH, F.greatest(F.col("a"), F.col("b")) + TOUCH
    cells = by_rows(edges, size).select("region", "i", a.alias("a"), b.alias("b"))
    return cells.select("region", "i", F.explode(F.sequence(F.floor(least / size), F.floor(most / size))).alias("j")).distinct()


def cover(vertices: DataFrame, sizes: tuple[float, ...] = SIZES) -> DataFrame:
    """The cells (region, level, i, j, inside) that cover regions: those wholly inside, as large as can be, and of the finest size those that an edge passes through.

    At each level the cells of the border are split; of the others those stay whose middle is inside: along the middle
    line of a row of cells, edges and cells are put in order once, and the edges to a cell's right are counted.
    """
    edges = materialize(edges_of(vertices), "edges")
    box = edges.groupBy("region").agg(*[f(c).alias(n) for n, f, c in (("s", F.min, "y0"), ("n", F.max, "y0"), ("w", F.min, "x0"), ("e", F.max, "x0"))])
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / sizes[0]), F.floor(F.col(b) / sizes[0])))
    asked = box.withColumn("i", span("s", "n")).withColumn("j", span("w", "e")).select("region", "i", "j")
    out = None
    for level, size in enumerate(sizes):
        border = touched(edges, size).withColumn("border", F.lit(True))
        both = asked.join(border, ["region", "i", "j"], "left").withColumn("border", F.coalesce("border", F.lit(False)))
        middle = (F.col("i") + 0.5) * size
        crossed = by_rows(edges, size).where("y0 <> y1").where(spans(middle)).select("region", "i", F.lit(None).cast("long").alias("j"), F.lit(False).alias("border"), crossing(middle).alias("x"), F.lit(1).alias("edge"))
        cells = both.withColumns({"x": (F.col("j") + 0.5) * size, "edge": F.lit(0)})
        right = F.sum("edge").over(Window.partitionBy("region", "i").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, 0))
        known = cells.unionByName(crossed).withColumn("inside", ~F.col("border") & (right % 2 == 1)).where("edge = 0 and (border or inside)")
        known = materialize(known.select("region", F.lit(level).alias("level"), "i", "j", "inside"), "cover")
        last = level == len(sizes) - 1
        kept = known if last else known.where("inside")
        out = kept if out is None else out.unionByName(kept)
        if not last:
            times = round(size / sizes[level + 1])
            part = lambda c: F.explode(F.sequence(F.col(c) * times, F.col(c) * times + times - 1))  # noqa: B023, E731
            asked = known.where("not inside").select("region", part("i").alias("i"), "j").select("region", "i", part("j").alias("j"))
    return out


def candidates(nodes: DataFrame, covered: DataFrame, sizes: tuple[float, ...] = SIZES) -> DataFrame:
    """Nodes with the region of each covering cell that they lie in, and whether it is wholly inside. A node has one cell of each size."""
    y, x = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    each = F.array(*[F.struct(F.lit(level).alias("level"), F.floor(y / size).alias("i"), F.floor(x / size).alias("j")) for level, size in enumerate(sizes)])
    placed = nodes.withColumn("__c", F.explode(each)).select("dataset", "latitude", "longitude", "__c.level", "__c.i", "__c.j")
    return placed.join(covered, ["level", "i", "j"]).select("dataset", "region", "latitude", "longitude", "i", "inside")


def membership(nodes: DataFrame, vertices: DataFrame, sizes: tuple[float, ...] = SIZES) -> DataFrame:
    """Distinct nodes (dataset, latitude, longitude) within the polygons of vertices (region, ring, n, lat, lon), rings closed by themselves.

    Nodes in cells wholly inside a region are taken unseen. A node in a cell of the border meets the region's edges in
    its row of the finest cells only, and is inside if a ray crosses an odd number of them. All rings of a region count
    together: holes are rings.
    """
    found = candidates(nodes.select("dataset", "latitude", "longitude").distinct(), cover(vertices, sizes), sizes)
    y, x = F.col("latitude").cast("double"), F.col("longitude").cast("double")
    edges = by_rows(edges_of(vertices), sizes[-1]).where("y0 <> y1")
    met = found.where("not inside").join(edges, ["region", "i"]).where(spans(y) & (x < crossing(y)))
    node = ["dataset", "region", "latitude", "longitude"]
    odd = met.groupBy(*node).agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    return found.where("inside").select(*node).unionByName(odd.select(*node))


def keep_set(members: DataFrame, dataset: str, regions: list[str]) -> DataFrame:
    """Distinct nodes of some regions; a region that is not there is an error."""
    known = {r["region"] for r in members.select("region").distinct().collect()}  # names of regions: a few dozen
    if unknown := sorted(set(regions) - known):
        raise ValueError(f"unknown regions: {', '.join(unknown)}")
    return members.where((F.col("dataset") == dataset) & F.col("region").isin(regions)).select("latitude", "longitude").distinct()


def clip(df: DataFrame, keep: DataFrame, resolution: float) -> DataFrame:
    """Rows whose node is kept, by integer index."""
    from isotherm.functions.columns import cell_index

    nodes = keep.select(cell_index("latitude", resolution).alias("__a"), cell_index("longitude", resolution).alias("__b")).distinct()
    return df.join(nodes, (cell_index("latitude", resolution) == F.col("__a")) & (cell_index("longitude", resolution) == F.col("__b")), "left_semi")


def counts(members: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Nodes of each dataset and region; regions (region): those without nodes count 0."""
    n = members.groupBy("dataset", "region").agg(F.count("*").alias("cells"))
    if regions is None:
        return n
    every = regions.select("region").join(members.select("dataset").distinct())  # a handful of datasets
    return every.join(n, ["dataset", "region"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))


def listing(boxes: DataFrame, kind: str) -> DataFrame:
    """The regions of a kind with their boxes, by name and state."""
    return boxes.where(F.col("kind") == kind).select("name", "uf", "north", "west", "south", "east").orderBy("name", "uf")


def available(members: DataFrame, dataset: str) -> DataFrame:
    """The regions that a dataset has nodes in, by name."""
    return members.where(F.col("dataset") == dataset).select("region").distinct().orderBy("region")


def lookup_box(boxes: DataFrame, name: str, uf: str | None = None) -> dict:
    """The box of the region with a name, whatever its case. An unknown name, or one that several states have, is an error."""
    found = boxes.where(F.lower("name") == name.lower())
    found = found.where(F.lower("uf") == uf.lower()) if uf else found
    rows = found.orderBy("name", "uf").limit(11).collect()
    if not rows:
        raise ValueError(f"no region is called {name}")
    if len(rows) > 1:
        raise ValueError(f"{name} is in several states: " + ", ".join(str(r["uf"]) for r in rows[:10]))
    return {k: rows[0][k] for k in ("north", "west", "south", "east")}


#: From the smallest kind of region to the largest.
KINDS = ("municipio", "rg_imediata", "rg_intermediaria", "uf", "pais")


def resolve_area(boxes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, kind, name) -> the box of the smallest kind that a request names."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    met = requests.join(boxes, (requests["kind"] == boxes["kind"]) & (F.lower(requests["name"]) == F.lower(boxes["name"]))).select("request_id", requests["kind"], "north", "west", "south", "east")
    return met.groupBy("request_id").agg(F.min_by(F.struct("kind", "north", "west", "south", "east"), F.struct(order, "north", "west")).alias("b")).select("request_id", "b.*")


#: Fixed value: the country whose parts are known.
COUNTRY = "brasil"


def resolved_requests(boxes: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_id, and a name or null for each of KINDS) -> request_id, kind, box and error, which is null where the box is known.

    The smallest kind that is named decides; without any it is the country, COUNTRY unless named. Only municipio and
    uf may stand together, the state then telling towns of one name apart; parts of other countries are not known. A
    name that is nowhere, or in several places, is an error, as are requests that break these rules. Names are the same
    whatever their case. Places are counted by name before requests meet them, so each request meets one row and stays
    one, whatever is asked most.
    """
    parts = KINDS[:-1]
    given = F.filter(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in parts]), lambda k: k.isNotNull())
    country = F.lower(F.coalesce("pais", F.lit(COUNTRY)))
    alone = (F.size("given") > 1) & (F.size(F.array_except("given", F.array(F.lit("municipio"), F.lit("uf")))) > 0)
    broken = F.when(alone, F.concat(F.lit("only one of "), F.array_join("given", ", "))).when((F.size("given") > 0) & (country != COUNTRY), F.lit("parts of other countries are not known"))
    kind = F.coalesce(F.get("given", F.lit(0)), F.lit("pais"))
    name = F.coalesce(*[F.when(F.col("kind") == k, F.lower(k)) for k in parts], country)
    asked = requests.withColumn("given", given).withColumns({"broken": broken, "kind": kind}).withColumn("name", name)
    asked = asked.select("request_id", "kind", "name", "broken", F.when(F.col("kind") == "municipio", F.lower("uf")).alias("state")).alias("a")
    places = boxes.select("kind", F.lower("name").alias("name"), F.lower("uf").alias("uf"), F.struct("north", "west", "south", "east").alias("box"))
    found = [F.count("*").alias("n"), F.min("box").alias("box")]
    anywhere = places.groupBy("kind", "name").agg(*found).withColumn("state", F.lit(None).cast("string"))
    known = anywhere.unionByName(places.where("uf is not null").groupBy("kind", "name", F.col("uf").alias("state")).agg(*found)).alias("b")
    same = (F.col("a.kind") == F.col("b.kind")) & (F.col("a.name") == F.col("b.name")) & F.col("a.state").eqNullSafe(F.col("b.state"))
    # a row or two for each region of a country, thousands in all
    met = asked.join(F.broadcast(known), same, "left").select("request_id", "a.kind", "a.name", "broken", F.coalesce("n", F.lit(0)).alias("n"), "box")
    error = F.coalesce("broken", F.when(F.col("n") == 0, F.concat(F.lit("unknown: "), "name")).when(F.col("n") > 1, F.concat(F.lit("in several places: "), "name")))
    out = met.withColumn("error", error)
    return out.select("request_id", "kind", *[F.when(F.col("error").isNull(), F.col(f"box.{c}")).alias(c) for c in ("north", "west", "south", "east")], "error")


def union_box(boxes: DataFrame, *group: str) -> DataFrame:
    return boxes.groupBy(*group).agg(F.max("north").alias("north"), F.min("west").alias("west"), F.min("south").alias("south"), F.max("east").alias("east"))
