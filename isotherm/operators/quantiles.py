"""Exact quantiles of many groups at once, of any size: no buffer holds a group's values.

A group's values are counted; small groups are sorted. For large ones a sketch of fixed size brackets each quantile, and what lies below and
in the bracket is counted exactly, so that the sketch's error changes the work and not the result. The quantile's rank
is then found by running counts over the distinct values of the bracket, dealt to ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isotherm.operators.numbering import running
from isotherm.shared import materialize

#: Values up to which a group is ranked whole, and the sketch's size: its ranks are off by a share of 1 / SKETCH at most.
WHOLE, SKETCH = 100_000, 2_000


def quantiles(df: DataFrame, group: list[str], value: str, shares: list[float], names: list[str] | None = None, whole: int = WHOLE, sketch: int = SKETCH) -> DataFrame:
    """group, n, and a column for each share (q0, q1, ... or names): the quantile, linear between the two nearest values.

    Null values do not count; groups without others have no row. NaN is above all numbers. Null group keys are a group.
    Groups of up to `whole` values are sorted, each in a task; only the others are gone through again.
    """
    names = names or [f"q{i}" for i in range(len(shares))]
    keys = [f"g{i}" for i in range(max(1, len(group)))]
    own = [F.col(g).alias(k) for k, g in zip(keys, group, strict=False)] or [F.lit(0).alias("g0")]
    rows = df.select(*own, F.col(value).cast("double").alias("v")).where("v is not null")
    most = rows.groupBy(*keys).agg(F.count("v").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= whole:
        out = sorted_groups(rows, keys, shares)
    else:
        rows = materialize(rows, "values")
        counts = materialize(rows.groupBy(*keys).agg(F.count("v").alias("n")), "counts")
        large = counts.where(F.col("n") > whole)
        small = rows.alias("r").join(large.select(*keys).alias("l"), same(keys, "r", "l"), "left_anti")
        out = sorted_groups(small, keys, shares).unionByName(large_groups(rows, large, keys, shares, sketch))
    return out.select(*[F.col(k).alias(g) for k, g in zip(keys, group, strict=False)], "n", *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(names)])


def same(keys: list[str], a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def between(at: Column, lower: Column, upper: Column) -> Column:
    """The value at a place, linear between those of the ranks below and above."""
    return F.when(lower == upper, lower).otherwise((F.floor(at) + 1 - at) * lower + (at - F.floor(at)) * upper)


def sorted_groups(rows: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, n and q (an array, by share) of groups small enough to be sorted."""
    held = Window.partitionBy(*keys)
    ranked = rows.withColumns({"n": F.count("v").over(held), "rank": F.row_number().over(held.orderBy("v"))})
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    near = [F.max(F.when(F.col("rank") == f(x) + 1, F.col("v"))).alias(f"{side}{i}") for i, x in enumerate(at) for side, f in (("low", F.floor), ("high", F.ceil))]
    out = ranked.groupBy(*keys, "n").agg(*near)
    return out.select(*keys, "n", F.array(*[between(x, F.col(f"low{i}"), F.col(f"high{i}")) for i, x in enumerate(at)]).alias("q"))


def large_groups(rows: DataFrame, counts: DataFrame, keys: list[str], shares: list[float], sketch: int) -> DataFrame:
    """keys, n and q (an array, by share) of the groups in counts (keys, n), none of whose values are held together."""
    edges = [min(1.0, max(0.0, p + d * 2 / sketch)) for p in shares for d in (-1, 1)]
    sample = rows.alias("r").join(counts.select(*keys).alias("l"), same(keys, "r", "l"), "left_semi")
    at = sample.groupBy(*keys).agg(F.percentile_approx("v", edges, sketch).alias("e"))
    per = F.array(*[F.struct(F.lit(i).alias("bracket"), F.get("e", F.lit(2 * i)).alias("low"), F.get("e", F.lit(2 * i + 1)).alias("high")) for i in range(len(shares))])
    brackets = materialize(at.withColumn("b", per).drop("e"), "brackets")

    def met(brackets: DataFrame) -> DataFrame:
        """keys, bracket, and how often each of its values occurs; what is below it is one row, with a null value."""
        b = brackets.select(*keys, F.explode("b").alias("b")).select(*keys, "b.*")
        pairs = rows.alias("r").join(b.alias("b"), same(keys, "r", "b")).where(F.col("v") <= F.col("high")).select(*[F.col(f"r.{k}") for k in keys], "bracket", F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v"))
        return materialize(pairs.groupBy(*keys, "bracket", "v").agg(F.count("*").alias("times")), "met")

    # a bracket has to hold both ranks of its share
    target = F.explode(F.array(*[F.struct(F.lit(i).alias("bracket"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)]))
    wanted = counts.select(*keys, "n", target.alias("t")).select(*keys, "n", "t.bracket", (F.col("t.p") * (F.col("n") - 1)).alias("at"))
    wanted = wanted.withColumns({"first": F.floor("at") + 1, "last": F.ceil("at") + 1})
    found = met(brackets)
    held = found.groupBy(*keys, "bracket").agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("times"))), F.lit(0)).alias("below"), F.sum("times").alias("through"))
    on = lambda a, b: [*same(keys, a, b), F.col(f"{a}.bracket") == F.col(f"{b}.bracket")]
    missed = wanted.alias("w").join(held.alias("h"), on("w", "h"), "left").where(F.coalesce((F.col("first") <= F.col("below")) | (F.col("last") > F.col("through")), F.lit(True)))
    if not missed.isEmpty():  # the sketch was off by more than it should be: all brackets hold all values
        everything = F.transform(F.sequence(F.lit(0), F.lit(len(shares) - 1)), lambda i: F.struct(i.alias("bracket"), F.lit(float("-inf")).alias("low"), F.lit(float("nan")).alias("high")))
        found = met(counts.withColumn("b", everything))
    through = running(found, [*keys, "bracket"], "v", "times")
    picked = through.where("v is not null").alias("x").join(wanted.alias("w"), on("x", "w")).where((F.col("through") >= F.col("first")) & (F.col("through") - F.col("times") < F.col("last")))
    ends = picked.groupBy(*[F.col(f"w.{k}").alias(k) for k in keys], F.col("w.bracket").alias("share"), "at", "n").agg(F.min("v").alias("lower"), F.max("v").alias("upper"))
    q = between(F.col("at"), F.col("lower"), F.col("upper"))
    return ends.groupBy(*keys, "n").agg(F.array(*[F.max(F.when(F.col("share") == i, q)) for i in range(len(shares))]).alias("q"))
