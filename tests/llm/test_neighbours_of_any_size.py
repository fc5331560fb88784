"""Operator 7 on vectors that squares, or casts to 32 bits, would lose."""

import numpy as np
import pytest


@pytest.mark.parametrize("scale", [1e-320, 1e-200, 1e20, 1e30, 1e200, "mixed", "one large", "one small", "float"])
def test_neighbours_of_any_size(spark, scale):
    from isotherm.llm import lsh

    rng = np.random.default_rng(4)
    x = rng.normal(size=(220, 8))
    by = np.ones(220)
    if scale == "mixed":
        by = 10.0 ** rng.uniform(-150, 150, 220)
    elif scale == "one large":
        by[7] = 1e200
    elif scale == "one small":
        by[7] = 1e-200
    elif scale == "float":
        by[:] = 1e20
    else:
        by[:] = scale
    kind = "float" if scale == "float" else "double"
    own = (x * by[:, None]).astype(np.float32 if kind == "float" else float)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(own)], f"vec_id long, embedding array<{kind}>")
    found: dict = {}
    for r in lsh.search(df).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 220, 20)) and all(len(v) == 20 for v in found.values())
    from fractions import Fraction

    right = 0
    for q, got in found.items():
        exact = [sum(Fraction(float(a)) * Fraction(float(b)) for a, b in zip(own[q], own[k], strict=True)) for k in range(220)]
        want = sorted((k for k in range(220) if k != q), key=lambda k: (-exact[k], k))[:20]
        right += len({k for k, _ in got} & set(want))
        with np.errstate(over="ignore", invalid="ignore"):
            for k, s in got:
                if np.isfinite(s) and abs(s) > 1e-290:
                    size = sum(abs(Fraction(float(a)) * Fraction(float(b))) for a, b in zip(own[q], own[k], strict=True))
                    assert abs(Fraction(s) - exact[k]) <= size * Fraction(1, 10**14)
                else:
                    assert abs(exact[k]) < Fraction(1, 10**289) or abs(exact[k]) > Fraction(10**307)
    assert right >= 0.9 * 20 * len(found)
