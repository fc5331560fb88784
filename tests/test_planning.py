"""The splitting cascade against a plain one in Python, its limits and errors."""

import math
import random

import pytest

from isotherm.operators import planning

BOX = ("north", "west", "south", "east")
RES = 0.25


def points(box, res=RES):
    n, w, s, e = box
    return (math.ceil(round((n - s) / res, 9)) + 1) * (math.ceil(round((e - w) / res, 9)) + 1)


def snapped(box, res=RES):
    n, w, s, e = box
    return tuple(round(f(x / res) * res, 6) for f, x in ((math.ceil, n), (math.floor, w), (math.floor, s), (math.ceil, e)))


def parts_of(box, most):
    n, w, s, e = box
    ny = nx = 1
    while ny * nx < most:
        ny, nx = (ny + 1, nx) if (n - s) / ny >= (e - w) / nx else (ny, nx + 1)
    y, x = (n - s) / ny, (e - w) / nx
    return [(round(n - i * y, 6), round(w + j * x, 6), round(n - (i + 1) * y, 6), round(w + (j + 1) * x, 6)) for i in range(ny) for j in range(nx)]


def plain(variables, days, box, limits):
    """(days, mask, variables, box) of each piece, whether it fits or not."""
    fields = lambda v, d, m: len(v) * len(d) * m.bit_count()
    fits = lambda v, d, m, b: fields(v, d, m) <= limits.most_fields and fields(v, d, m) * points(b) * 8 <= limits.most_bytes
    days = [(d, m) for d, m in days if m]
    asked = 0
    for _, m in days:
        asked |= m
    blocks = [([d for d, _ in days], asked)]
    if not fits(variables, *blocks[0], box):
        blocks = []
        for d, m in days:
            if blocks and fits(variables, [*blocks[-1][0], d], blocks[-1][1] | m, box):
                blocks[-1] = ([*blocks[-1][0], d], blocks[-1][1] | m)
            else:
                blocks.append(([d], m))
    out = []
    for d, m in blocks:
        areas = [box]
        if not fits(variables, d, m, box) and points(box) > 1:
            n = 2
            while n < 64 and not fits(variables, d, m, snapped(parts_of(box, n)[0])):
                n *= 2
            areas = list(dict.fromkeys(map(snapped, parts_of(box, n))))
        for b in areas:
            out += [(tuple(d), m, tuple(v), b) for v in ([variables] if fits(variables, d, m, b) else [[x] for x in variables])]
    return out


@pytest.mark.parametrize("limits", [planning.Limits(), planning.Limits(40_000, 200), planning.Limits(2_000, 50), planning.Limits(10**9, 5)])
def test_pieces_are_those_of_a_plain_cascade(spark, limits):
    rnd, rows = random.Random(1), []
    for k in range(60):
        n, w = rnd.randrange(-40, 40) / 4, rnd.randrange(-40, 40) / 4
        box = (n + rnd.randrange(0, 40) / 4, w, n, w + rnd.choice([0, 0.25, 1, 12.5]))
        days = [(d, rnd.choice([1, 3, 0xFFFFFF, 0xFFF000, 0])) for d in range(1, rnd.randrange(2, 32))]
        rows.append((f"s{k}", 2024, 1, [f"v{i}" for i in range(rnd.randrange(0, 4))], days, *map(float, box)))
    seeds = spark.createDataFrame(rows, "seed string, year int, month int, variables array<string>, days array<struct<day:int,mask:int>>, north double, west double, south double, east double")
    got = planning.split_to_fit(seeds, RES, limits).collect()
    want = sorted((r[0], *p) for r in rows if r[3] and any(m for _, m in r[4]) for p in plain(r[3], r[4], r[5:], limits))
    assert sorted((r["seed"], tuple(r["days"]), r["hours_mask"], tuple(r["variables"]), tuple(r[c] for c in BOX)) for r in got) == want
    assert len({r["chunk_id"] for r in got}) == len(got)
    for r in got:
        fields = len(r["variables"]) * len(r["days"]) * r["hours_mask"].bit_count()
        assert (r["fields"], r["bytes"]) == (fields, fields * points([r[c] for c in BOX]) * 8)
        assert (r["error"] is None) == (fields <= limits.most_fields and r["bytes"] <= limits.most_bytes)
    # all cells of all days, hours and variables that were asked are in some piece
    cells = lambda b: {(y, x) for y in range(round(b[2] / RES), round(b[0] / RES) + 1) for x in range(round(b[1] / RES), round(b[3] / RES) + 1)}
    for r in rows[:12]:
        own = [p for p in got if p["seed"] == r[0]]
        for v in r[3]:
            for d, m in r[4]:
                pieces = [p for p in own if v in p["variables"] and d in p["days"]]
                assert not m or set().union(*(cells([p[c] for c in BOX]) for p in pieces)) == cells(r[5:])
                assert all(m & ~p["hours_mask"] == 0 for p in pieces)


REQUEST = "request_id int, variables array<string>, start date, end date, hours array<int>, north double, west double, south double, east double"


def test_requests_are_split_as_a_plain_cascade_does(spark):
    """Days with the same hours are put into blocks by dividing; limits on either side of a day, a block and a part."""
    import datetime as dt

    rnd, rows = random.Random(2), []
    for k in range(24):
        n, w, start = rnd.uniform(-10, 10), rnd.uniform(-10, 10), dt.date(2024, 1, rnd.randrange(1, 32))
        rows.append((k, [f"v.{i}" for i in range(rnd.randrange(0, 4))], start, start + dt.timedelta(rnd.randrange(0, 40)), list(range(rnd.choice([0, 1, 5, 24]))), n + rnd.choice([0, 1, 9]), w, n, w + rnd.choice([0, 0.3, 12])))
    rows.append((24, ["v"], dt.date(2024, 1, 1), dt.date(2024, 1, 3), [1], None, 0.0, 0.0, 1.0))
    for limits in (planning.Limits(), planning.Limits(60_000, 150), planning.Limits(2_000, 50), planning.Limits(10**9, 5)):
        want = []
        for k, variables, start, end, hours, *box in rows[:-1]:
            days = [start + dt.timedelta(i) for i in range((end - start).days + 1)]
            for month in {d.month for d in days} if variables and hours else ():
                pieces = plain(variables, [(d.day, sum(1 << h for h in hours)) for d in days if d.month == month], snapped(box), limits)
                want += [(k, month, *p) for p in pieces]
        got = planning.plan_requests(spark.createDataFrame(rows, REQUEST), RES, limits).collect()
        assert sorted((int(r["chunk_id"].split("_")[0]), r["month"], tuple(r["days"]), r["hours_mask"], tuple(r["variables"]), tuple(r[c] for c in BOX)) for r in got) == sorted(want)
        assert len({r["chunk_id"] for r in got}) == len(got)


def test_requests_are_not_gone_through_by_days(spark):
    """Blocks of days with the same hours need no step a day or block, and partitions of requests, small beside their pieces, stay as many as they are."""
    plan = planning.plan_requests(spark.createDataFrame([], REQUEST), RES)._jdf.queryExecution().executedPlan().toString()
    assert "transform(" not in plan and "filter(" not in plan and "REPARTITION_BY_NUM" in plan


def test_areas_are_divided_no_further_than_needed(spark):
    """Four parts fit, so a division in eight is not looked for."""
    seed = spark.createDataFrame([(1000, 1681, 10.0, 0.0, 0.0, 10.0)], "__f long, points long, north double, west double, south double, east double")
    [r] = planning.divided(seed, RES, planning.Limits(1000 * 8 * 500, 10**6)).collect()
    assert (tuple(r["__d4"]), r["__p4"]) == ((2, 2), 441) and all(r[f"__d{n}"] is None for n in (8, 16, 32, 64))


def test_months_are_clipped_and_what_cannot_fit_is_an_error(spark):
    import datetime as dt

    one = [(1, ["t"], dt.date(2024, 1, 30), dt.date(2024, 3, 2), [0, 12], 1.1, 0.1, 0.2, 1.0)]
    plan = planning.plan_requests(spark.createDataFrame(one, REQUEST), RES)
    rows = {r["month"]: r for r in planning.checked(plan).collect()}
    assert [rows[m]["days"] for m in (1, 3)] == [[30, 31], [1, 2]] and len(rows[2]["days"]) == 29
    assert (rows[1]["north"], rows[1]["west"], rows[1]["south"], rows[1]["east"]) == (1.25, 0.0, 0.0, 1.0)
    assert rows[1]["chunk_id"] == "1_202401" and rows[1]["hours_mask"] == 1 | 1 << 12
    bad = planning.plan_requests(spark.createDataFrame(one, REQUEST), RES, planning.Limits(10**9, 1))
    assert bad.where("error is not null").count() == bad.count() > 0
    with pytest.raises(ValueError, match="1_202401.*2 fields of 1"):
        planning.checked(bad)
    assert planning.plan_requests(spark.createDataFrame([], REQUEST), RES).count() == 0


def test_plans_need_no_shuffle(spark):
    seeds = spark.createDataFrame([], "seed string, year int, month int, variables array<string>, days array<struct<day:int,mask:int>>, north double, west double, south double, east double")
    assert "Exchange" not in planning.split_to_fit(seeds, RES)._jdf.queryExecution().executedPlan().toString()


def test_pieces_are_made_of_columns_alone(spark):
    """Going through days and divisions is for seeds: nothing does so for a block, a part or a piece, of which there are many more."""
    seeds = spark.createDataFrame([], "seed string, year int, month int, variables array<string>, days array<struct<day:int,mask:int>>, north double, west double, south double, east double")
    plan = planning.split_to_fit(seeds, RES)._jdf.queryExecution().executedPlan().toString()
    each = plan.split("Generate ")[:-1]  # all but the seeds
    assert len(each) == 5 and not any("lambda" in x for x in each[:-1])
    assert "aggregate(" not in each[-1] and "transform(" not in each[-1]  # blocks are picked by their number of parts here


def test_requests_are_planned_by_their_own_days(spark):
    import datetime as dt

    rows = [(1, ["t"], dt.date(2024, 1, 30), dt.date(2024, 2, 1), [0], 1.0, 0.0, 0.0, 1.0), (1, ["u"], dt.date(2024, 1, 2), dt.date(2024, 1, 3), [0], 1.0, 0.0, 0.0, 1.0), (None, ["t"], dt.date(2024, 1, 1), dt.date(2024, 1, 1), [0], 1.0, 0.0, 0.0, 1.0), (2, ["t"], None, dt.date(2024, 1, 1), [0], 1.0, 0.0, 0.0, 1.0)]
    plan = planning.plan_requests(spark.createDataFrame(rows, REQUEST), RES)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # of requests, not of their days
    assert sorted((r["chunk_id"], *r["variables"], r["days"]) for r in plan.collect()) == [("1_202401", "t", [30, 31]), ("1_202401", "u", [2, 3]), ("1_202402", "t", [1])]


def test_what_is_stored_is_not_asked_again(spark):
    import datetime as dt

    asked = spark.createDataFrame([(1, ["a", "b"], dt.date(2024, 1, 1), dt.date(2024, 1, 2), [0, 1], 0.5, 0.0, 0.0, 0.5)], REQUEST)
    stored = [(y / 4, x / 4, dt.date(2024, 1, d), "a", 3) for y in range(3) for x in range(3) for d in (1, 2) if not (y == 1 and x == 2)]
    stored += [(0.25, 0.5, dt.date(2024, 1, 1), "a", 1), (0.25, 0.5, dt.date(2024, 1, 2), "a", 3)]
    stored += [(y / 4, x / 4, dt.date(2024, 1, d), "b", 3) for y in range(3) for x in range(3) for d in (1, 2)]
    masks = spark.createDataFrame(stored, "latitude double, longitude double, date date, variable string, mask int")
    [r] = planning.plan_missing(asked, masks, RES).collect()
    assert (r["variables"], r["days"], r["hours_mask"]) == (["a"], [1], 2)
    assert tuple(r[c] for c in BOX) == (0.375, 0.375, 0.125, 0.625)
    assert planning.plan_missing(asked, masks.unionByName(spark.createDataFrame([(0.25, 0.5, dt.date(2024, 1, 1), "a", 3)], masks.schema)).groupBy("latitude", "longitude", "date", "variable").agg({"mask": "max"}).withColumnRenamed("max(mask)", "mask"), RES).count() == 0
