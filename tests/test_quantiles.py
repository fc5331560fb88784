"""Exact quantiles and running sums against plain ones, at every size of group."""

import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators.numbering import numbered, running
from isotherm.operators.quantiles import quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def values(seed=1):
    rnd = random.Random(seed)
    rows = [("one", 5.0), (None, 1.0), (None, 2.0), ("none", None), ("infinite", float("-inf")), ("infinite", float("inf")), ("infinite", 0.0)]
    rows += [("same", 7.0)] * 400 + [("many", rnd.gauss(0, 1)) for _ in range(900)] + [("few", float(rnd.randrange(3))) for _ in range(500)]
    rows += [("mixed", 3.0)] * 300 + [("mixed", rnd.choice([-1, 1]) * 10 ** rnd.uniform(-300, 300)) for _ in range(300)] + [("null", None)] * 3
    return rows


def plain(rows):
    out = {}
    for g in {g for g, v in rows if v is not None}:
        own = sorted(v for x, v in rows if x == g and v is not None)
        at = [p * (len(own) - 1) for p in SHARES]
        out[g] = (len(own), *[own[int(a)] if own[int(a)] == own[-int(-a // 1)] else (int(a) + 1 - a) * own[int(a)] + (a - int(a)) * own[int(a) + 1] for a in at])
    return out


@pytest.mark.parametrize(("whole", "sketch"), [(100_000, 2000), (50, 400), (50, 100_000), (0, 10), (0, 10**9)])
def test_quantiles_are_plain_ones(spark, whole, sketch):
    rows = values()
    df = spark.createDataFrame([(g, v, 0, 1) for g, v in rows], "k string, y double, n int, bracket int").repartition(3)
    got = {r["k"]: tuple(r)[1:] for r in quantiles(df, ["k"], "y", SHARES, whole=whole, sketch=min(sketch, 1 << 30)).collect()}
    want = plain(rows)
    assert got.keys() == want.keys()
    for g, row in want.items():
        assert got[g][0] == row[0] and np.allclose(got[g][1:], row[1:], rtol=1e-12, atol=0, equal_nan=True), g


def test_a_sketch_that_is_wrong_changes_nothing(spark, monkeypatch):
    rows = [("a", float(v)) for v in range(1000)]
    df = spark.createDataFrame(rows, "k string, y double")
    monkeypatch.setattr(F, "percentile_approx", lambda c, edges, n: F.array(*[F.lit(-5.0)] * len(edges)))
    [r] = quantiles(df, ["k"], "y", [0.25, 0.5], whole=10).collect()
    assert tuple(r) == ("a", 1000, 249.75, 499.5)


def test_quantiles_without_groups_or_rows(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("y"), F.lit("a").alias("k"))
    assert [tuple(r) for r in quantiles(df, [], "y", [0.5], ["median"]).collect()] == [(101, 50.0)]
    assert [tuple(r) for r in quantiles(df, [], "y", [0.5], ["median"], whole=10).collect()] == [(101, 50.0)]
    assert quantiles(df.limit(0), [], "y", [0.5]).count() == 0 and quantiles(df.limit(0), ["k"], "y", [0.5]).count() == 0


def test_running_sums_and_numbers(spark):
    rows = [(k, v, rnd) for k, n in (("a", 500), ("b", 1), (None, 20)) for v, rnd in ((v, v % 7) for v in range(n))]
    df = spark.createDataFrame(rows, "k string, v int, w int").repartition(5)
    got = {(r["k"], r["v"]): r["t"] for r in running(df, ["k"], "v", "w", "t").collect()}
    assert got == {(k, v): sum(w for x, u, w in rows if x == k and u <= v) for k, v, _ in rows}
    assert [r["number"] for r in numbered(df.where("k = 'a'"), [F.desc("v")], "number").orderBy("v").collect()] == [*range(500, 0, -1)]
    assert numbered(df.limit(0), [F.col("v")]).count() == 0


LARGE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from isotherm.session import get_spark
from isotherm.operators.quantiles import quantiles
n = 10_000_000
spark = get_spark("large", "local[4]", **{{"spark.driver.memory": "600m", "spark.sql.shuffle.partitions": "16", "spark.ui.enabled": "false", "spark.checkpoint.dir": "file://" + {shared!r}}})
df = spark.range(n).select(F.lit("g").alias("k"), (F.pmod(F.col("id") * 7_368_787, F.lit(n)) / 8).alias("y"))
[r] = quantiles(df, ["k"], "y", [0.25, 0.5, 0.75]).collect()
assert tuple(r) == ("g", n, *[p * (n - 1) / 8 for p in (0.25, 0.5, 0.75)]), r
print("found")
"""


def test_ten_million_distinct_values_of_one_group_in_a_small_heap(tmp_path):
    from conftest import ROOT

    done = subprocess.run([sys.executable, "-c", LARGE.format(root=ROOT, shared=str(tmp_path))], capture_output=True, text=True, timeout=600)
    assert "found" in done.stdout, done.stderr[-3000:]
