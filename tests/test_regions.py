"""Membership of nodes in polygons against a plain ray cast."""

import math
import random

import pytest
from pyspark.sql import functions as F

from isotherm.operators import regions

FINE = (4.0, 1.0, 0.25, 0.0625)
VERTEX = "region string, ring int, n int, lat double, lon double"


def star(rnd, y, x, r, n):
    return [(y + r * rnd.uniform(0.3, 1) * math.sin(2 * math.pi * k / n), x + r * rnd.uniform(0.3, 1) * math.cos(2 * math.pi * k / n)) for k in range(n)]


def shapes():
    rnd = random.Random(5)
    out = {"star": [star(rnd, -10, -50, 6, 40)], "small": [[(0.1, 0.1), (0.1, 0.12), (0.13, 0.11)]], "square": [[(0.0, 0.0), (0.0, 8.0), (8.0, 8.0), (8.0, 0.0)], [(2.0, 2.0), (2.0, 4.0), (4.0, 4.0), (4.0, 2.0)], [(2.5, 2.5), (2.5, 3.5), (3.5, 3.5), (3.5, 2.5)]]}
    out["wide"] = [[(y, x) for y, x in star(rnd, 20, 10, 15, 300)], star(rnd, 20, 10, 2, 9)]
    out["off grid"] = [[(-3.33, 7.77), (-3.33, 12.21), (1.11, 12.21), (1.11, 7.77)]]
    return out


def inside(y, x, rings):
    odd = False
    for ring in rings:
        for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y0 != y1 and (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                odd = not odd
    return odd


@pytest.mark.parametrize("sizes", [regions.SIZES, FINE, (2.0,), (8.0, 0.5)])
def test_membership_is_a_plain_ray_cast(spark, sizes):
    rows = [(name, k, n, y, x) for name, rings in shapes().items() for k, ring in enumerate(rings) for n, (y, x) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, VERTEX)
    rnd = random.Random(6)
    points = {(rnd.uniform(-20, 40), rnd.uniform(-60, 30)) for _ in range(2000)} | {(i / 4, j / 4) for i in range(-20, 40) for j in range(-10, 60)} | {(0.11, 0.11), (8.0, 8.0), (0.0, 0.0)}
    nodes = spark.createDataFrame([("d", y, x) for y, x in points] + [("d", 0.5, 0.5), ("e", 0.5, 0.5), ("d", None, 1.0)], "dataset string, latitude double, longitude double")
    got = [tuple(r) for r in regions.membership(nodes, vertices, sizes).collect()]
    want = {("d", name, y, x) for name, rings in shapes().items() for y, x in points if inside(y, x, rings)} | {("e", "square", 0.5, 0.5)}
    assert len(got) == len(set(got)) and set(got) == want


def test_few_nodes_are_held_against_edges(spark):
    """Nodes on a fine grid: with the border's cells a small share of them is looked at, and meets few edges."""
    ring = [(10 + 9 * math.sin(2 * math.pi * k / 3600), 9 * math.cos(2 * math.pi * k / 3600)) for k in range(3600)]
    vertices = spark.createDataFrame([("disc", 0, n, y, x) for n, (y, x) in enumerate(ring)], VERTEX)
    nodes = spark.range(200 * 200).select(F.lit("d").alias("dataset"), (F.col("id") % 200 / 10).alias("latitude"), (F.floor(F.col("id") / 200) / 10 - 10).alias("longitude"))
    found = regions.candidates(nodes, regions.cover(vertices, FINE), FINE).cache()
    looked_at = found.where("not inside")
    edges = regions.by_rows(regions.edges_of(vertices), FINE[-1])
    assert found.count() < 26_500 and looked_at.count() < 1_000  # of 40,000 nodes, 25,447 of which are inside
    met = looked_at.join(edges, ["region", "i"]).count()
    assert met < 40_000 < 25_447 * 3600 / 18  # each node with the edges of its degree of latitude
    want = 0
    for y in (k / 10 for k in range(200)):
        right = [(x1 - x0) * (y - y0) / (y1 - y0) + x0 for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1], strict=True) if (y0 > y) != (y1 > y)]
        want += sum(sum(k / 10 - 10 < x for x in right) % 2 for k in range(200))
    assert regions.membership(nodes, vertices, FINE).count() == regions.membership(nodes, vertices).count() == want
    found.unpersist()


def test_cells_are_cut_at_their_borders(spark):
    square = spark.createDataFrame([("s", 0, n, y, x) for n, (y, x) in enumerate([(0.0, 0.0), (0.0, 3.0), (3.0, 3.0), (3.0, 0.0)])], VERTEX)
    cells = regions.cover(square, (1.0,)).collect()
    assert [(r["i"], r["j"]) for r in cells if r["inside"]] == [(1, 1)]
    assert {(r["i"], r["j"]) for r in cells if not r["inside"]} == {(i, j) for i in range(4) for j in range(4)} - {(1, 1)}
    assert regions.cover(square.limit(0)).count() == 0
