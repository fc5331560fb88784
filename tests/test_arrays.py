"""Arrays in chunks: no row holds more than a block, and nothing is lost."""

from pyspark.sql import functions as F

from isotherm.sources import arrays

AXES = "file string, time array<int>, lat array<double>, lon array<double>"


def test_a_file_larger_than_a_block_comes_back(spark):
    ny, nx, nt = 60, 70, 5
    axes = spark.createDataFrame([(f, [10 * t for t in range(nt)], [90 - y / 4 for y in range(ny)], [x / 4 for x in range(nx)]) for f in ("a", "b")], AXES)
    n = nt * ny * nx
    p = F.col("id")
    own = spark.range(n).select(F.lit("a").alias("file"), (F.floor(p / (ny * nx)) * 10).cast("int").alias("time"), (90 - F.floor(p % (ny * nx) / nx) / 4).alias("latitude"), (p % nx / 4).alias("longitude"), F.when(p % 7 > 0, p.cast("double")).alias("t"), F.when(p % 1000 == 3, -p.cast("double")).alias("u"))
    chunks = arrays.to_chunks(own.unionByName(own.limit(1).withColumn("latitude", F.lit(89.9))), axes, ["t", "u"], block=1000)
    sizes = chunks.select("variable", "offset", F.size("values").alias("n"), F.array_max("at").alias("most")).collect()
    assert max(r["n"] for r in sizes) <= 1000 and max(r["most"] for r in sizes) < 1000 and len({(r["variable"], r["offset"]) for r in sizes}) == len(sizes) == 42
    back = arrays.flatten_chunks(chunks, axes)
    assert back.count() == n - -(-n // 7) + 21
    want = own.unpivot(["time", "latitude", "longitude"], ["t", "u"], "variable", "value").where("value is not null")
    assert back.select("variable", "time", "latitude", "longitude", "value").exceptAll(want.select("variable", "time", "latitude", "longitude", "value")).count() == 0
    dense = own.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("time", -F.col("latitude"), "longitude", "t"))), lambda c: c["t"]).alias("values"))
    whole = dense.join(axes.where("file = 'a'")).select(F.lit("t").alias("variable"), "time", "lat", "lon", "values")
    assert arrays.sliced(whole, 1000).select(F.max(F.size("values"))).first()[0] == 1000
    assert arrays.flatten(whole, 999).where("value is not null").exceptAll(want.where("variable = 't'").select("variable", "time", "latitude", "longitude", "value")).count() == 0
    assert arrays.flatten(whole.limit(0)).count() == 0


def test_cells_do_not_carry_the_axes(spark):
    axes = spark.createDataFrame([("a", [0], [0.0], [0.0])], AXES)
    chunks = spark.createDataFrame([("a", "t", 0, [1.0])], "file string, variable string, offset long, values array<double>")
    plan = arrays.flatten_chunks(chunks, axes)._jdf.queryExecution().optimizedPlan().toString()
    # of the generator's input, all but the variable is left out
    assert "[1, 2, 3, 4, 5], false, [c#" in plan
