"""Boxes without boxes, against a raster, with few and with very many."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from isotherm.operators import requests

STEP = 128


def raster(boxes, low, high):
    """Where no box lies, on a lattice: by differences summed up both ways."""
    n = round((high - low) * STEP)
    d = np.zeros((n + 1, n + 1), np.int32)
    k = np.clip(np.round((boxes - low) * STEP).astype(int), 0, n)  # north west south east
    k = k[(k[:, 0] > k[:, 2]) & (k[:, 3] > k[:, 1])]
    for y, x, by in ((2, 1, 1), (2, 3, -1), (0, 1, -1), (0, 3, 1)):
        np.add.at(d, (k[:, y], k[:, x]), by)
    return d.cumsum(0).cumsum(1)[:-1, :-1] == 0


def frame(spark, boxes, key="a"):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(boxes, columns=["north", "west", "south", "east"])).withColumn("key", F.lit(key))


def some(n, seed, size, low=0.0, high=20.0):
    rnd = np.random.default_rng(seed)
    at = np.round(rnd.uniform(low - 1, high + 1, (n, 2)) * STEP) / STEP
    side = np.round(rnd.uniform(0, size, (n, 2)) * STEP) / STEP
    return np.stack([at[:, 0] + side[:, 0], at[:, 1], at[:, 0], at[:, 1] + side[:, 1]], axis=1)


@pytest.mark.parametrize(("n", "size", "most"), [(30, 5.0, 128), (300, 3.0, 128), (300, 3.0, 8), (400, 0.5, 4), (200, 30.0, 2)])
def test_what_is_left_is_that_of_a_raster(spark, n, size, most):
    boxes = some(n, n + most, size)
    if n == 200:  # edges and corners that many share
        boxes[:, 2:] = np.minimum(np.round(boxes[:, 2:] / 5) * 5, 15.0)
    target = frame(spark, np.array([[20.0, 0.0, 0.0, 20.0]]))
    left = requests.residual(target, frame(spark, boxes), "key", most).select("north", "west", "south", "east").toPandas().to_numpy()
    free = raster(boxes, 0.0, 20.0)
    seen = np.zeros(free.shape, int)
    for y1, x0, y0, x1 in np.round(left * STEP).astype(int):
        seen[y0:y1, x0:x1] += 1
    assert (seen == free).all()
    [r] = requests.union_area(frame(spark, boxes), "key", most).collect()
    whole = raster(boxes, -2.0, 60.0)
    assert r["area"] == pytest.approx((~whole).sum() / STEP**2, abs=1e-6)


def test_small_cases_have_the_usual_form(spark):
    target = spark.createDataFrame([("a", 4.0, 0.0, 0.0, 4.0), ("b", 1.0, 0.0, 0.0, 1.0), ("c", 1.0, 0.0, 1.0, 1.0)], "key string, north double, west double, south double, east double")
    holes = spark.createDataFrame([("a", 3.0, 1.0, 1.0, 2.0), ("a", 3.0, 2.0, 1.0, 3.0), ("z", 9.0, 0.0, 0.0, 9.0)], target.schema)
    got = sorted(tuple(r) for r in requests.residual(target, holes, "key").collect())
    assert got == [("a", 1.0, 1.0, 0.0, 3.0), ("a", 4.0, 0.0, 0.0, 1.0), ("a", 4.0, 1.0, 3.0, 3.0), ("a", 4.0, 3.0, 0.0, 4.0), ("b", 1.0, 0.0, 0.0, 1.0)]


def test_two_hundred_thousand_boxes_of_one_key(spark):
    boxes = some(200_000, 3, 0.3, 0.0, 40.0)
    began = time.monotonic()
    [r] = requests.union_area(frame(spark, boxes).repartition(8), "key").collect()
    assert time.monotonic() - began < 300
    assert r["area"] == pytest.approx((~raster(boxes, -2.0, 42.0)).sum() / STEP**2, abs=1e-5)
