"""Merging by key, duplicates, spatial order, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isotherm.shared import clear, mark, materialize

KEYS = ("latitude", "longitude", "hour_utc")


def last_values(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key; of each other column the last value that is not null, by a unique order column (or struct)."""
    values = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(*[F.expr(f"max_by(`{c}`, `{order}`) filter (where `{c}` is not null)").alias(c) for c in values]) if values else df.select(*keys).distinct()


def merge_on_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows into old ones: of each column the new value unless it is null; columns that one side lacks come from the other.

    Both sides must have one row a key (last_values). One shuffle of each side by the key.
    """
    columns = list(dict.fromkeys([c for c in (*old.columns, *new.columns) if c not in keys]))
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.join(n, on, "full_outer")

    def pick(c: str):
        sides = [F.col(f"{s}.{c}") for s, df in (("n", new), ("o", old)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    return both.select(*map(pick, keys), *map(pick, columns))


def merge_into(spark, path: str, new: DataFrame, keys: tuple[str, ...] = KEYS, order: str | None = None, by: str = "date") -> None:
    """Upsert into a partitioned table; only the partitions that new has rows of are read and rewritten. Doing it again changes nothing.

    The batch is made once, and its days, of which a batch has few, are named in the scan, which so reads no others.
    NaN is no value and does not overwrite one. Writers of one day wait for each other. Files of these days that cannot
    be read, say of a writer that was killed, are set aside, and the day is written anew without them.
    """
    from isotherm.functions.columns import nan_to_null
    from isotherm.operators.claims import claimed, set_aside
    from isotherm.sources.tables import replace_partitions

    on, begun = [by, *keys], mark()
    new = nan_to_null(new)
    fresh = materialize(last_values(new, on, order) if order else new, "batch")
    days = days_of(fresh, by)
    with claimed(spark, path, days) as claim:
        set_aside(spark, path, days, by)
        old = partitions_of(spark, path, fresh, by, days)
        merged = materialize(merge_on_key(nan_to_null(old), fresh, on), "merged") if old is not None else fresh
        claim.check()
        replace_partitions(tile_order(merged, by), path, (by,))
    clear(spark, begun)


def days_of(batch: DataFrame, by: str = "date") -> list:
    return [r[0] for r in batch.select(by).distinct().collect()]


def partitions_of(spark, path: str, batch: DataFrame, by: str = "date", days: list | None = None) -> DataFrame | None:
    """A stored table's partitions that a batch has rows of; None if nothing is stored."""
    from isotherm.sources.tables import scan_if_there

    old = scan_if_there(spark, path, union_by_name=True)
    days = days_of(batch, by) if days is None else days
    return old if old is None else old.where(F.col(by).isin([d for d in days if d is not None]) | (F.col(by).isNull() if None in days else F.lit(False)))


def collapse(spark, path: str, keys: tuple[str, ...] = KEYS, order: str | None = None, by: str = "date") -> dict[str, int]:
    """Collapse a stored table's duplicates in place: partitions rewritten, and rows before and after in the whole table.

    Only partitions that have duplicates are rewritten. Without an order column the last value is that of the last
    file, by time and name, and of the last row in it. NaN is no value.
    """
    from isotherm.functions.columns import nan_to_null
    from isotherm.operators.claims import claimed
    from isotherm.sources.tables import replace_partitions, scan

    df, begun = scan(spark, path, union_by_name=True), mark()
    counts = dedup_counts(df, list(keys), by).collect()  # a row for each partition
    touched = [r[by] for r in counts if r["rows_before"] > r["rows_after"]]
    if touched:
        with claimed(spark, path, touched) as claim:
            rows = scan(spark, path, union_by_name=True).where(F.col(by).isin(touched))
            if not order:
                rows = rows.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.row_index").alias("__seq"))
            once = last_values(nan_to_null(rows), [by, *keys], order or "__seq")
            # read and written are the same folders: the rows go to the shared folder first
            once = materialize(once, "collapsed")
            claim.check()
            replace_partitions(tile_order(once, by), path, (by,))
        clear(spark, begun)
    return {"partitions": len(touched), "rows_before": sum(r["rows_before"] for r in counts), "rows_after": sum(r["rows_after"] for r in counts)}


def dedup_counts(df: DataFrame, keys: list[str], by: str = "date") -> DataFrame:
    """Of each partition: rows, and rows once duplicates are collapsed."""
    per_key = df.groupBy(by, *[k for k in keys if k != by]).agg(F.count("*").alias("n"))
    return per_key.groupBy(by).agg(F.sum("n").alias("rows_before"), F.count("*").alias("rows_after"))


def tile_columns(lat: str = "latitude", lon: str = "longitude", degrees: int = 5):
    return F.floor(F.col(lat) / degrees).alias("tile_lat"), F.floor(F.col(lon) / degrees).alias("tile_lon")


def tile_order(df: DataFrame, by: str = "date", degrees: int = 5) -> DataFrame:
    """Rows of neighbouring places together: range partitions by date and tile, sorted by tile, place and hour, so that row groups are narrow."""
    lat, lon = tile_columns(degrees=degrees)
    tiled = df.withColumns({"__lat": lat, "__lon": lon})
    first = [by] if by in df.columns else []
    hour = ["hour_utc"] if "hour_utc" in df.columns else []
    return tiled.repartitionByRange(*first, "__lat", "__lon").sortWithinPartitions(*first, "__lat", "__lon", "latitude", "longitude", *hour).drop("__lat", "__lon")


def pending(requested: DataFrame, manifest: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Requests that the manifest of finished work lacks."""
    return requested.join(manifest.select(key), key, "left_anti")


def recorded(manifest: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The manifest with finished chunks added; a chunk recorded again replaces its record."""
    return manifest.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def forgotten(manifest: DataFrame, chunks: DataFrame | None = None, key: str = "chunk_id") -> DataFrame:
    """The manifest without some chunks; without any if none are named."""
    return manifest.limit(0) if chunks is None else manifest.join(chunks.select(key), key, "left_anti")


def with_manifest_defaults(manifest: DataFrame) -> DataFrame:
    """Records of the first version: days null means the whole month, hours null all 24."""
    first = F.make_date("year", "month", F.lit(1))
    return manifest.withColumns({"days": F.coalesce("days", F.sequence(F.lit(1), F.dayofmonth(F.last_day(first)))), "hours": F.coalesce("hours", F.sequence(F.lit(0), F.lit(23)))})


#: Degrees of a coarse cell by which boxes meet.
COARSE = 15.0


def coarse_cells(south, north, west, east):
    """Array of the coarse cells (i, j) that a box touches."""
    span = lambda a, b: F.sequence(F.floor(a / COARSE), F.floor(b / COARSE))
    return F.flatten(F.transform(span(south, north), lambda i: F.transform(span(west, east), lambda j: F.struct(i.alias("i"), j.alias("j")))))


def covering(requests: DataFrame, manifest: DataFrame) -> DataFrame:
    """request_id and box of every finished chunk of a request's month that has its variable, all its days and all its hours.

    Days and hours are masks of bits, so that a chunk has what is asked if nothing is left of it. They meet by year,
    month and variable, and, if requests have boxes, by coarse cell: then only chunks that touch a request's box are
    given, each once, in the cell where the part that both have begins. A chunk or request without days or hours meets
    nothing.
    """
    from isotherm.functions.columns import hours_to_mask

    boxes, key = ["north", "west", "south", "east"], ["year", "month", "variable"]
    bits = lambda df: [hours_to_mask(F.transform("days", lambda d: d - 1)).alias("days"), hours_to_mask("hours").alias("hours")]
    placed = all(c in requests.columns for c in boxes)
    cell = [F.explode(coarse_cells(*map(F.col, ("south", "north", "west", "east")))).alias("cell")] if placed else []
    r = requests.select("request_id", *key, *bits(requests), *(boxes if placed else []), *cell).alias("r")
    m = manifest.select("year", "month", F.explode(F.array_distinct("variables")).alias("variable"), *bits(manifest), *boxes)
    m = m.select("*", *cell).alias("m")
    on = [F.col(f"r.{k}") == F.col(f"m.{k}") for k in (*key, *(["cell"] if placed else []))]
    on += [F.col(f"r.{c}").bitwiseAND(F.bitwise_not(F.col(f"m.{c}"))) == 0 for c in ("days", "hours")]
    if placed:
        low, left = F.greatest("r.south", "m.south"), F.greatest("r.west", "m.west")
        on += [low <= F.least("r.north", "m.north"), left <= F.least("r.east", "m.east"), F.floor(low / COARSE) == F.col("r.cell.i"), F.floor(left / COARSE) == F.col("r.cell.j")]
    return r.join(m, on).select("r.request_id", *[f"m.{c}" for c in boxes])
