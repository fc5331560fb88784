import datetime as dt

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from isotherm.functions import columns as C
from isotherm.operators import catalog, coverage, joins, ml, regions, requests, stations, storage, timeseries
from isotherm.sources import arrays, station_files, tables
from isotherm.streaming import incremental

OLD = "REGIÃO:;SE\nUF:;SP\nESTAÇÃO:;SAO PAULO\nCODIGO (WMO):;A701\nLATITUDE:;-23,5\nLONGITUDE:;-46,6\nALTITUDE:;785,6\nDATA DE FUNDAÇÃO (YYYY-MM-DD):;2006-07-25\nDATA (YYYY-MM-DD);HORA (UTC);" + ";".join("abcdefghijklmnopq") + ";\n"
NEW = OLD.replace("REGIÃO", "REGIAO").replace("ESTAÇÃO", "ESTACAO").replace("DATA (YYYY-MM-DD);HORA (UTC)", "Data;Hora UTC")


def line(day, hour, *values):
    return ";".join([day, hour, *values, *[""] * (17 - len(values))]) + ";\n"


def test_station_files_of_both_eras(spark, tmp_path):
    (tmp_path / "INMET_SE_SP_A701_X_2000.CSV").write_bytes((OLD + line("2000-10-05", "14:00", "0,2", "-9999") + line("", "")).encode("latin-1"))
    (tmp_path / "INMET_SE_SP_A702_X_2026.CSV").write_bytes((NEW.replace("A701", "") + line("2026/01/01", "0100 UTC", ",8", "")).encode("latin-1"))
    rows = {r["station_id"]: r for r in station_files.read_station_files(spark, str(tmp_path)).collect()}
    a, b = rows["A701"], rows["A702"]
    assert (a["date"], a["hour_utc"], round(a["precipitation"], 4), a["pressure"]) == (dt.date(2000, 10, 5), 14, 0.2, None)
    assert (b["date"], b["hour_utc"], round(b["precipitation"], 4), b["uf"], b["nome"]) == (dt.date(2026, 1, 1), 1, 0.8, "SP", "SAO PAULO")
    assert round(a["latitude"], 4) == -23.5 and a["year"] == 2000
    (tmp_path / "bad.csv").write_bytes((OLD + "2000-10-05;14:00;1\n").encode("latin-1"))
    with pytest.raises(Exception, match="fewer than 19"):
        station_files.read_station_files(spark, str(tmp_path)).collect()
    (tmp_path / "bad.csv").write_bytes("UF:;SP\n2000-10-05;14:00;1\n".encode("latin-1"))
    with pytest.raises(Exception, match="no header in bad.csv"):
        station_files.read_station_files(spark, str(tmp_path)).collect()


def test_arrays_to_rows_and_back(spark):
    times = [dt.datetime(2020, 1, 1, h) for h in range(2)]
    df = spark.createDataFrame([("t2m", times, [1.0, 2.0], [3.0, 4.0, 5.0], [float(k) for k in range(12)])], "variable string, time array<timestamp_ntz>, lat array<double>, lon array<double>, values array<double>")
    rows = {(r["time"].hour, r["latitude"], r["longitude"]): r["value"] for r in arrays.flatten(df).collect()}
    assert len(rows) == 12 and rows[1, 2.0, 4.0] == 10.0
    wide = arrays.to_wide(arrays.flatten(df), ["t2m"])
    assert wide.count() == 12 and wide.columns[-1] == "t2m"


def grid(spark, rows):
    return spark.createDataFrame(rows, "latitude double, longitude double, hour_utc int, date date, temp double, rain double, seq int")


DAY = dt.date(2024, 1, 1)


def test_merge_is_idempotent_and_new_wins(spark, tmp_path):
    path = str(tmp_path / "obs")
    storage.merge_into(spark, path, grid(spark, [(1.0, 2.0, 0, DAY, 5.0, None, 1), (1.0, 2.0, 0, DAY, None, 7.0, 2)]), order="seq")
    new = grid(spark, [(1.0, 2.0, 0, DAY, 6.0, None, 1), (1.0, 2.0, 1, DAY, 8.0, None, 2)])
    for _ in range(2):
        storage.merge_into(spark, path, new, order="seq")
    rows = {r["hour_utc"]: (r["temp"], r["rain"]) for r in spark.read.parquet(path).collect()}
    assert rows == {0: (6.0, 7.0), 1: (8.0, None)}
    stats = tables.storage_stats(spark.read.parquet(path)).first()
    assert stats["files"] >= 1 and stats["bytes"] > 0


def test_merging_reads_the_batch_days_only(spark, tmp_path):
    path = str(tmp_path / "obs")
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    tables.write_partitioned(grid(spark, [(1.0, 2.0, 0, d, 1.0, None, 1) for d in days]).drop("seq"), path)
    old = storage.partitions_of(spark, path, grid(spark, [(1.0, 2.0, 0, days[1], 2.0, None, 1)]))
    plan = old._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-02" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] or "19724" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert {f.split("date=")[1][:10] for f in old.select(F.col("_metadata.file_path")).distinct().toPandas().iloc[:, 0]} == {"2024-01-02"}
    assert storage.partitions_of(spark, str(tmp_path / "none"), old) is None


def test_collapse_of_files_takes_the_later_file(spark, tmp_path):
    path = str(tmp_path / "obs")
    for temp in (1.0, 2.0):
        tables.write_partitioned(grid(spark, [(1.0, 2.0, 0, DAY, temp, temp if temp < 2 else None, 1), (1.0, 2.0, int(temp), dt.date(2024, 1, 2), temp, None, 1)]).drop("seq"), path)
    assert storage.collapse(spark, path) == {"partitions": 1, "rows_before": 4, "rows_after": 3}
    assert [(r["temp"], r["rain"]) for r in spark.read.parquet(path).where(F.col("date") == F.lit(DAY)).collect()] == [(2.0, 1.0)]
    assert storage.collapse(spark, path) == {"partitions": 0, "rows_before": 3, "rows_after": 3}


def test_the_stream_takes_the_later_file_not_the_larger_value(spark, tmp_path):
    src, data, index = (str(tmp_path / x) for x in ("src", "data", "index"))
    for temp in (9.0, 3.0):
        rows = grid(spark, [(1.0, 2.0, 0, DAY, temp, None, 1)]).drop("seq")
        rows.coalesce(1).write.mode("append").parquet(src)
    incremental.ingest_new(spark, src, rows.schema, data, index, str(tmp_path / "progress"))
    assert [r["temp"] for r in spark.read.parquet(data).collect()] == [3.0]


def test_corners_of_repeated_and_placeless_stations(spark):
    g = grid(spark, [(float(y), float(x), 0, DAY, 10.0 * y + x, None, 1) for y in (0, 1) for x in (0, 1)])
    rows = [("a", 0.5, 0.25, DAY, 0), ("a", 0.5, 0.25, DAY, 0), ("b", None, 0.25, DAY, 0), ("c", 0.5, 0.25, DAY, None), (None, 5.0, 0.25, DAY, 0)]
    df = spark.createDataFrame(rows, "station_id string, latitude double, longitude double, date date, hour_utc int")
    out = joins.interpolated(joins.corner_join(df, g, 1.0, ["temp"]), ["temp"]).collect()
    assert sorted((str(r["station_id"]), r["temp_grid"]) for r in out if r["temp_grid"] is not None) == [("a", 5.25)] * 2 and len(out) == 5
    assert [r["temp_tr"] for r in out if r["station_id"] == "a"] == [11.0, 11.0]


def test_years_are_classified(spark):
    years = spark.createDataFrame([("a", 2023, dt.date(2023, 12, 31)), ("b", 2023, dt.date(2023, 12, 31)), ("a", 2024, dt.date(2024, 12, 31)), ("b", 2024, DAY), ("a", 2025, dt.date(2025, 4, 10)), ("a", 2026, dt.date(2026, 12, 31))], "station_id string, year int, date_max date")
    out = stations.classified(stations.year_status(years), 2026)
    assert {r["year"]: r["status"] for r in out.collect()} == {2023: "complete", 2024: "partial", 2025: "stale", 2026: "current"}


def test_incremental_plan(spark):
    asked = spark.createDataFrame([(1, ["t"], DAY, dt.date(2024, 1, 31), [0, 12], -10.0, -50.0, -20.0, -40.0)], "request_id int, variables array<string>, start date, end date, hours array<int>, north double, west double, south double, east double")
    chunk = "chunk_id string, year int, month int, variables array<string>, days array<int>, hours array<int>, north double, west double, south double, east double"
    done = lambda east, names=("t",), hours=(0, 6, 12): spark.createDataFrame([("c", 2024, 1, list(names), list(range(1, 32)), list(hours), -10.0, -50.0, -20.0, east)], chunk)
    box = lambda m: [(r["north"], r["west"], r["south"], r["east"]) for r in requests.incremental_plan(asked, m, 0.5).collect()]
    assert box(done(-40.0).limit(0)) == box(done(-40.0, names=("u",))) == box(done(-40.0, hours=(0,))) == [(-10.0, -50.0, -20.0, -40.0)]
    assert box(done(-40.0)) == [] and box(done(-45.0)) == [(-10.0, -45.0, -20.0, -40.0)]


def test_tile_order_makes_narrow_row_groups(spark, tmp_path):
    df = spark.range(40_000).select((F.col("id") % 200 * 0.2 - 30).alias("latitude"), (F.floor(F.col("id") / 200) * 0.2 - 60).alias("longitude"), F.lit(0).alias("hour_utc"), F.lit(DAY).alias("date"))
    tables.write_partitioned(storage.tile_order(df.repartition(4)), str(tmp_path / "t"), row_group_bytes=8_000)
    spans = []
    for f in (tmp_path / "t").rglob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        at = m.schema.names.index("longitude")
        spans += [m.row_group(k).column(at).statistics.max - m.row_group(k).column(at).statistics.min for k in range(m.num_row_groups)]
    assert sum(s <= 11 for s in spans) >= 0.8 * len(spans)


def test_replaced_partitions_leave_others(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, d string")
    tables.write_partitioned(df, path, ("d",))
    tables.replace_partitions(spark.createDataFrame([(3, "a")], "x int, d string"), path, ("d",))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(2, "b"), (3, "a")]


def test_streaming_replay_changes_nothing(spark, tmp_path):
    src, data, index = (str(tmp_path / x) for x in ("src", "data", "index"))
    rows = grid(spark, [(1.0, 2.0, h, DAY, float(h), None, h) for h in range(5)]).drop("seq")
    rows.write.parquet(src)
    for k in range(2):
        incremental.ingest_new(spark, src, rows.schema, data, index, str(tmp_path / f"check{k}"))
        masks = spark.read.parquet(index).collect()
        assert [(m["variable"], m["mask"]) for m in masks] == [("temp", 31)]
        assert spark.read.parquet(data).count() == 5


def test_polygon_edges_and_masks(spark):
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0), (2.0, -1.0)], "a double, b double")
    assert [r[0] for r in df.select(C.in_polygon(F.col("a"), F.col("b"), square)).collect()] == [True, False, False]
    assert not df.where(C.in_polygon(F.col("a"), F.col("b"), square[:2])).count()
    m = spark.createDataFrame([([0, 5, 23],)], "h array<int>").select(C.hours_to_mask("h").alias("m")).select("m", C.mask_to_hours("m").alias("h")).first()
    assert m["m"] == 1 + 32 + (1 << 23) and m["h"] == [0, 5, 23]


def test_node_and_centre_alignment(spark):
    req = spark.createDataFrame([(1.0, 0.0, 0.0, 1.0)], "north double, west double, south double, east double")
    node, centre = (req.select(requests.axis(F.col("south"), F.col("north"), 0.5, a)).first()[0] for a in ("node", "center"))
    assert node == [0.0, 0.5, 1.0] and centre == [0.25, 0.75]


def test_residual_boxes(spark):
    t = spark.createDataFrame([("a", 4.0, 0.0, 0.0, 4.0)], "key string, north double, west double, south double, east double")
    h = spark.createDataFrame([("a", 3.0, 1.0, 1.0, 3.0), ("a", 9.0, 3.0, 2.0, 9.0)], t.schema)
    left = requests.residual(t, h, "key").collect()
    assert sum((r["north"] - r["south"]) * (r["east"] - r["west"]) for r in left) == 16 - 4 - 2
    assert requests.residual(t, t, "key").count() == 0


def test_long_chain_is_one_component(spark):
    cells = spark.createDataFrame([("g", k // 2, (k + 1) // 2) for k in range(60)] + [("g", 100, 0)], "g string, i int, j int")
    assert requests.cell_components(cells, ["g"]).select("component").distinct().count() == 2


def test_formulas(spark):
    df = spark.createDataFrame([(2.0,), (None,), (0.0,)], "v double")
    assert [r[0] for r in df.select(C.convert("v", "10 / x + 1")).collect()] == [6.0, None, 0.0]
    for bad in ("x; drop", "x ** 9", "y + 1", "(x", "1 / 0 + x"):
        with pytest.raises(ValueError):
            C.convert("v", bad)


def test_catalog(spark):
    catalog.register_builtin(spark)
    assert spark.sql("SELECT bilinear_weights(0.5, 0.5, 1, 2, 3, 4)").first()[0] == 2.5
    objects = spark.createDataFrame([("bad_view", "view", "SELECT * FROM nowhere", 1), ("two", "view", "SELECT 2 AS x", 2), ("plus", "macro", "(a INT) RETURNS INT RETURN a + 1", 3)], catalog.OBJECT)
    status = {r["name"]: r["ok"] for r in catalog.replay(spark, objects).collect()}
    assert status == {"bad_view": False, "two": True, "plus": True}
    assert catalog.safe_sql(spark, "select plus(x) from two").first()[0] == 3
    assert catalog.view_schema(spark, "two") == [("x", "int")] and catalog.view_schema(spark, "nowhere") == []
    assert catalog.upsert(objects, "TWO", "view", "SELECT 3", 4).count() == 3
    for bad in ("drop table x", "select 1; select 2", "select 'update'"):
        with pytest.raises(ValueError):
            catalog.safe_sql(spark, bad)
    with pytest.raises(ValueError):
        catalog.validate("era5", "view")


def test_statements_that_define_objects(spark):
    objects = spark.createDataFrame([], catalog.OBJECT)
    run = lambda o, text: catalog.run_text(spark, o, text, 1)
    status, objects = run(objects, "/* mine */ CREATE OR REPLACE VIEW typed_foo AS SELECT 1 AS a")
    assert tuple(status.first()) == ("VIEW", "typed_foo", "created")
    status, objects = run(objects, "create view Typed_Foo as select 2 as b")
    assert tuple(status.first()) == ("VIEW", "Typed_Foo", "replaced") and objects.count() == 1
    _, objects = run(objects, "CREATE OR REPLACE MACRO typed_add(x INT) AS x + 1")
    assert run(objects, "SELECT typed_add(41) AS v")[0].first()["v"] == 42 and catalog.view_schema(spark, "typed_foo") == [("b", "int")]
    for bad in ("CREATE VIEW era5 AS SELECT 1", "CREATE VIEW evil AS SELECT 1; DROP TABLE x", "DROP TABLE x", "CREATE VIEW worse AS SELECT * FROM nowhere"):
        with pytest.raises(ValueError):
            run(objects, bad)


def test_regions(spark):
    boxes = spark.createDataFrame([("uf", "Acre", "AC", 1.0, 2.0, 0.0, 3.0), ("municipio", "Bom", "AC", 1.0, 2.0, 0.0, 3.0), ("municipio", "Bom", "SP", 5.0, 6.0, 4.0, 7.0)], "kind string, name string, uf string, north double, west double, south double, east double")
    assert regions.lookup_box(boxes, "bom", "sp")["north"] == 5.0
    for args in (("bom",), ("none",)):
        with pytest.raises(ValueError):
            regions.lookup_box(boxes, *args)
    asked = spark.createDataFrame([(1, "uf", "ACRE"), (1, "municipio", "Bom")], "request_id int, kind string, name string")
    assert regions.resolve_area(boxes, asked).first()["kind"] == "municipio"


def test_statistics_of_one_value_and_none_finite(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", float("nan")), ("b", float("inf"))], "g string, y double")
    rows = timeseries.statistics(df, ["g"]).collect()
    assert [(r["g"], r["n"], r["var"]) for r in rows] == [("a", 1, 0.0)]


def test_locations_must_fit(spark):
    with pytest.raises(ValueError):
        timeseries.location({"kind": "station", "id": "x"}, True)
    out, errors = timeseries.many([timeseries.Series("s", spark.range(1), "nope")])
    assert out is None and "s" in errors


def test_gradient_boosting_on_stations(spark, tmp_path):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) * 2 + 1.0).alias("y"), F.date_add(F.lit(DAY), (F.col("id") / 20).cast("int")).alias("date"), "id")
    parts = ml.temporal_split(df, 0.25, ["date", "id"])
    assert parts.where("is_test").count() == 100
    model = ml.train(parts.where("not is_test"), ["x"], "y", trees=10, depth=3, rate=0.5)
    scores = ml.metrics(ml.predictions(model, parts.where("is_test"), "y"), "y", "prediction").first()
    assert scores["r2"] > 0.9 and ml.importances(model, ["x"])[0][0] == "x"
    ml.log_run(spark, str(tmp_path / "runs"), "m", {"trees": 10}, scores.asDict(), 1.0)
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 1
    with pytest.raises(ValueError):
        ml.gate(df, ["nope"])


def test_build_view_checks(spark):
    df = spark.createDataFrame([(1, 2.0)], "a int, b double")
    out = joins.build_view([joins.Source(df, "l", ["a"]), joins.Source(df, "r", ["b"], [], [("l.b", "b", 0.1)], "left")])
    assert out.columns == ["l_a", "r_b"] and out.first()["r_b"] == 2.0
    for bad in ([joins.Source(df, "l", ["a"]), joins.Source(df, "r", ["b"])], [joins.Source(df, "l;", ["a"])], []):
        with pytest.raises(ValueError):
            joins.build_view(bad)


def test_cell_ids_go_on(spark):
    known = spark.createDataFrame([(4, 1.0, 1.0)], "cell_id int, latitude double, longitude double")
    seen = spark.createDataFrame([(1.0, 1.0), (0.0, 3.0), (0.0, 2.0)], "latitude double, longitude double")
    assert sorted(map(tuple, coverage.cell_ids(known, seen).collect())) == [(4, 1.0, 1.0), (5, 0.0, 2.0), (6, 0.0, 3.0)]


def test_station_prerequisites(spark):
    with pytest.raises(ValueError, match="land"):
        stations.require_rows(era5=spark.range(1), land=spark.range(0))


def test_index_is_built_when_it_has_to_be(spark, tmp_path):
    data, index = str(tmp_path / "data"), str(tmp_path / "index")
    tables.write_partitioned(grid(spark, [(1.0, 2.0, h, DAY, 1.0, None, h) for h in range(3)]).drop("seq"), data)
    (tmp_path / "data" / "date=2024-01-01" / "part-broken.parquet").write_bytes(b"not parquet")
    assert [coverage.ensure_index(spark, data, index, v) for v in ("1", "1", "2")] == [True, False, True]
    assert [(r["variable"], r["mask"]) for r in spark.read.parquet(index).collect()] == [("temp", 7)]


def test_years_of_ranges(spark):
    df = spark.createDataFrame([(dt.date(2019, 5, 1), dt.date(2021, 1, 1)), (dt.date(2021, 5, 1), dt.date(2021, 6, 1))], "start date, end date")
    assert sorted(r["year"] for r in requests.years(df).collect()) == [2019, 2020, 2021]


def test_written_tables_are_deleted(spark):
    from isotherm import shared

    begun = shared.mark()
    a, b = (shared.materialize(spark.range(n), "t") for n in (2, 3))
    assert shared.clear(spark, begun, keep=1) == 1 and b.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(a.inputFiles()[0]).count()
    assert shared.clear(spark, begun) == 1 and shared.mark() == begun
