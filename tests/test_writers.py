"""Merging beside other writers, over files that cannot be read, and with NaN."""

import datetime as dt
import threading
import time
from pathlib import Path

import pytest

from isotherm.operators import claims, storage
from isotherm.sources import tables

SCHEMA = "latitude double, longitude double, date date, hour_utc int, t double, u double"


def grid(spark, hour, t, u=None, days=(1,)):
    return spark.createDataFrame([(y / 10, x / 10, dt.date(2024, 1, d), hour, t, u) for d in days for y in range(3) for x in range(3)], SCHEMA)


def test_two_writers_of_one_day_both_stand(spark, tmp_path):
    path, errors = str(tmp_path / "t"), []

    def work(df):
        try:
            storage.merge_into(spark, path, df)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(grid(spark, h, float(h), days=(1, 2) if h % 2 else (2, 1)),)) for h in (0, 5, 12, 17)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not errors
    rows = tables.scan(spark, path).collect()
    assert len(rows) == 4 * 18 and {(r["hour_utc"], r["t"]) for r in rows} == {(h, float(h)) for h in (0, 5, 12, 17)}
    assert not [p for p in Path(path, "_claims").iterdir() if p.suffix != ".crc"]


def test_claims_wait_run_out_and_are_noticed(spark, tmp_path):
    table = str(tmp_path / "t")
    with claims.claimed(spark, table, ["a", "b"]) as held:
        with pytest.raises(claims.Conflict, match="b has been taken"), claims.claimed(spark, table, ["b"], patience=0.5):
            pass
        held.check()
    with claims.claimed(spark, table, ["a"], lease=0.2) as late:
        time.sleep(0.4)
        with claims.claimed(spark, table, ["a"], patience=5):
            with pytest.raises(claims.Conflict, match="taken by another writer: a"):
                late.check()
            late.release()  # does not give up what is another's
            with pytest.raises(claims.Conflict), claims.claimed(spark, table, ["a"], patience=0.3):
                pass
    with claims.claimed(spark, table, ["a"]):
        pass


def test_unreadable_files_are_set_aside_and_the_day_is_healed(spark, tmp_path):
    path = str(tmp_path / "t")
    storage.merge_into(spark, path, grid(spark, 12, 280.0, days=(1, 2, 3)))
    broken = next(Path(path, "date=2024-01-01").glob("*.parquet"))
    size = broken.stat().st_size
    broken.write_bytes(b"PAR1\0\0not a footer")
    Path(path, "date=2024-01-02", "half.parquet").write_bytes(b"")
    for p in Path(path).glob("date=*/.*.crc"):
        p.unlink()
    storage.merge_into(spark, path, grid(spark, 12, 290.0, days=(1, 2)))
    rows = tables.scan(spark, path).collect()
    assert sorted((r["date"].day, r["t"]) for r in rows) == [(1, 290.0)] * 9 + [(2, 290.0)] * 9 + [(3, 280.0)] * 9
    assert size and len(list(Path(path, "date=2024-01-01").glob("*.parquet"))) == 1
    listed = claims.set_aside_list(spark, path).collect()
    assert sorted(Path(r["path"].removeprefix("file:")).name for r in listed) == sorted([broken.name, "half.parquet"])
    assert all(Path(r["moved"]).exists() for r in listed)
    storage.merge_into(spark, path, grid(spark, 12, 291.0, days=(1,)))
    assert claims.set_aside_list(spark, path).count() == 2


def test_a_table_of_unreadable_files_only(spark, tmp_path):
    day = tmp_path / "t" / "date=2024-01-01"
    day.mkdir(parents=True)
    (day / "x.parquet").write_bytes(b"nothing")
    storage.merge_into(spark, str(tmp_path / "t"), grid(spark, 1, 1.0))
    assert tables.scan(spark, str(tmp_path / "t")).count() == 9


def test_nan_is_no_value(spark, tmp_path):
    path, nan = str(tmp_path / "t"), float("nan")
    storage.merge_into(spark, path, grid(spark, 1, 5.0, nan))
    storage.merge_into(spark, path, grid(spark, 1, nan, 7.0))
    assert {(r["t"], r["u"]) for r in tables.scan(spark, path).collect()} == {(5.0, 7.0)}
    doubled = str(tmp_path / "d")
    tables.write_partitioned(grid(spark, 1, 5.0, 1.0).coalesce(1), doubled)
    tables.write_partitioned(grid(spark, 1, nan, 2.0).coalesce(1), doubled)
    assert storage.collapse(spark, doubled) == {"partitions": 1, "rows_before": 18, "rows_after": 9}
    assert {(r["t"], r["u"]) for r in tables.scan(spark, doubled).collect()} == {(5.0, 2.0)} or {(r["t"], r["u"]) for r in tables.scan(spark, doubled).collect()} == {(5.0, 1.0)}
