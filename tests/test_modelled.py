"""Values at stations read few days; areas by name and their errors; metadata; layout."""

import datetime as dt

from pyspark.sql import functions as F

from isotherm.operators import joins, regions, stations
from isotherm.sources import tables


def test_only_the_stations_days_are_read(spark, tmp_path):
    grid = spark.range(40 * 16).select((F.lit(-10.0) + F.floor(F.col("id") / 4) % 4 / 4).alias("latitude"), (F.lit(5.0) + F.col("id") % 4 / 4).alias("longitude"), F.date_add(F.lit(dt.date(2024, 1, 1)), F.floor(F.col("id") / 16).cast("int")).alias("date"), F.lit(6).alias("hour_utc"), F.col("id").cast("double").alias("t"))
    path = str(tmp_path / "grid")
    tables.write_partitioned(grid, path)
    own = spark.createDataFrame([("S1", -9.9, 5.1, dt.date(2024, 1, 3), 6), ("S1", -9.9, 5.1, dt.date(2024, 1, 9), 6), ("S2", -9.6, 5.6, dt.date(2024, 1, 9), 7), ("S2", 50.0, 5.6, dt.date(2025, 1, 9), 6), ("S3", None, None, None, None)], "station_id string, latitude double, longitude double, date date, hour_utc int")
    out = joins.values_at_stations(own, tables.scan(spark, path), 0.25, ["t"])
    got = {(r["station_id"], r["date"]): r["t_grid"] for r in out.collect()}
    assert len(got) == 5 and abs(got["S1", dt.date(2024, 1, 3)] - 34) < 1e-9 and abs(got["S1", dt.date(2024, 1, 9)] - 130) < 1e-9
    assert [v for k, v in got.items() if k[0] != "S1"] == [None] * 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    out.collect()
    text = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert any("dynamicpruning" in line for line in text.splitlines() if "PartitionFilters" in line)


BOX = "kind string, name string, uf string, north double, west double, south double, east double"


def test_areas_by_name(spark):
    boxes = spark.createDataFrame([("municipio", "Bom Jesus", "PI", 1.0, 2.0, 0.0, 3.0), ("municipio", "Bom Jesus", "RS", 4.0, 5.0, 3.0, 6.0), ("uf", "PI", "PI", 9.0, 1.0, 0.0, 9.0), ("rg_imediata", "Sul", None, 7.0, 7.0, 6.0, 8.0), ("pais", "Brasil", None, 20.0, -20.0, -20.0, 20.0), ("pais", "Chile", None, 30.0, -30.0, -30.0, 30.0)], BOX)
    asked = spark.createDataFrame([
        (1, None, None, None, None, None), (2, "CHILE", None, None, None, None), (3, "Peru", None, None, None, None), (4, None, "bom jesus", None, None, None), (5, None, "bom jesus", None, None, "rs"), (6, None, None, None, None, "pi"),
        (7, None, None, "SUL", None, None), (8, None, None, "Sul", None, "PI"), (9, "Chile", None, "Sul", None, None), (10, "brasil", None, None, "Norte", None), (11, None, "x", None, None, "PI"),
    ], "request_id int, pais string, municipio string, rg_imediata string, rg_intermediaria string, uf string")
    got = {r["request_id"]: (r["kind"], r["north"], r["error"]) for r in regions.resolved_requests(boxes, asked).collect()}
    assert got == {
        1: ("pais", 20.0, None), 2: ("pais", 30.0, None), 3: ("pais", None, "unknown: peru"), 4: ("municipio", None, "in several places: bom jesus"), 5: ("municipio", 4.0, None), 6: ("uf", 9.0, None),
        7: ("rg_imediata", 7.0, None), 8: ("rg_imediata", None, "only one of rg_imediata, uf"), 9: ("rg_imediata", None, "parts of other countries are not known"), 10: ("rg_intermediaria", None, "unknown: norte"), 11: ("municipio", None, "unknown: x"),
    }


def test_requests_for_a_name_meet_one_row(spark):
    """Many requests for one name, which is that of many places: nothing is dealt by name, sorted or gathered by request."""
    boxes = spark.range(200).selectExpr("'municipio' AS kind", "'Centro' AS name", "concat('S', id) AS uf", "double(id) AS north", "0D AS west", "0D AS south", "1D AS east")
    null = "cast(null AS string) AS"
    asked = spark.range(5_000).selectExpr("id AS request_id", f"{null} pais", "'centro' AS municipio", f"{null} rg_imediata", f"{null} rg_intermediaria", "if(id % 2 = 0, concat('s', id % 200), null) AS uf")
    out = regions.resolved_requests(boxes, asked)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    own = plan[plan.index("BroadcastHashJoin") :]
    assert "Aggregate" not in plan[: plan.index("BroadcastHashJoin")] and own.count("BroadcastHashJoin") == 1
    rows = out.collect()
    assert len(rows) == 5_000 and all(r["error"] == "in several places: centro" and r["north"] is None if r["request_id"] % 2 else r["error"] is None and r["north"] == r["request_id"] % 200 for r in rows)


def test_what_stations_need(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "there"))
    spark.range(0).write.parquet(str(tmp_path / "empty"))
    got = stations.prerequisites(spark, {k: str(tmp_path / k) for k in ("there", "empty", "nowhere")}).collect()
    assert [tuple(r) for r in got] == [("there", True, 3), ("empty", False, 0), ("nowhere", False, 0)]


def test_row_groups_are_those_of_the_footers(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from isotherm.operators import layout

    path = tmp_path / "t"
    path.mkdir()
    pq.write_table(pa.table({"x": [1.0, 2.0, 9.0, 4.0, 5.0], "d": [dt.date(1970, 1, k) for k in (1, 2, 3, 4, 5)], "s": list("abcde")}), path / "a.parquet", row_group_size=2)
    pq.write_table(pa.table({"x": pa.array([None, None], pa.float64()), "d": [dt.date(1970, 1, 9)] * 2}), path / "b.parquet")
    groups = layout.row_groups(spark, str(path), ["x", "d", "s", "nowhere"])
    got = sorted((r["path"][-9:], r["row_group"], r["n_rows"], r["x_min"], r["x_max"], r["d_min"], r["d_max"], r["s_min"], r["nowhere_max"]) for r in groups.collect())
    assert got == [("a.parquet", 0, 2, 1.0, 2.0, 0.0, 1.0, None, None), ("a.parquet", 1, 2, 4.0, 9.0, 2.0, 3.0, None, None), ("a.parquet", 2, 1, 5.0, 5.0, 4.0, 4.0, None, None), ("b.parquet", 0, 2, None, None, 8.0, 8.0, None, None)]
    [w] = layout.widths(groups, "x", 1.0).collect()
    assert (w["row_groups"], w["n_rows"], w["share"], w["mean_span"]) == (4, 7, 0.5, 2.0)
    assert [r["row_group"] for r in layout.overlaps(groups.where("x_min is not null"), "x").collect()] == [2]
    assert layout.overlaps(groups, "d").count() == 0


def test_row_groups_need_footers_only(spark, tmp_path):
    """A file's pages don't reach Python, and its row groups come in batches; small row groups come in files of bounded size."""
    from pathlib import Path

    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from isotherm.operators import layout
    from isotherm.plans.queries import QUERIES
    from isotherm.shared import clear, mark, shared_dir

    path = tmp_path / "t"
    path.mkdir()
    pq.write_table(pa.table({"x": [float(k) for k in range(5_000)], "s": ["%d" % k * 100 for k in range(5_000)]}), path / "a.parquet", row_group_size=2, compression="none")
    groups = layout.row_groups(spark, str(path), ["x"])
    size, end = spark.read.format("binaryFile").load(str(path)).select("length", F.length(layout.footer(F.col("content")))).first()
    assert end == pq.read_metadata(path / "a.parquet").serialized_size + 8 < size / 2
    plan = groups._jdf.queryExecution().optimizedPlan().toString()
    assert "footer" in plan[plan.index("MapInArrow") :] and "content" not in plan[plan.index("MapInArrow") : plan.index("Project", plan.index("MapInArrow"))]
    rows = groups.orderBy("row_group").collect()
    assert [r["row_group"] for r in rows] == list(range(2_500)) and [r["x_min"] for r in rows] == [2.0 * k for k in range(2_500)]
    # the query's own files
    begun, most = mark(), layout.FILE_ROWS
    layout.FILE_ROWS = 500
    try:
        [r] = QUERIES["narrow_row_groups"](spark, "/root/testdata/sf0.001").collect()
        files = [f for d in sorted(Path(shared_dir(spark).removeprefix("file://")).glob("layout-*"), key=lambda d: d.stat().st_mtime)[-2:] for f in d.glob("*.parquet")]
        assert r["n_rows"] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
        assert max(pq.read_metadata(f).num_rows for f in files) == 500
    finally:
        layout.FILE_ROWS = most
        clear(spark, begun)
