"""Station temperature from the grid around it: gate, features, temporal split, boosted trees, metrics, a table of runs."""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.operators.numbering import numbered
from isotherm.operators.quantiles import quantiles
from isotherm.sources.tables import scan_if_there


def is_stale(spark, cache_path: str, sources: list[DataFrame]) -> bool:
    """Whether a cached result is missing or older than its newest source file."""
    newest = lambda df: df.select(F.max("_metadata.file_modification_time")).first()[0]
    stored = scan_if_there(spark, cache_path)
    made = newest(stored) if stored is not None else None
    return made is None or any((t := newest(s)) is not None and t > made for s in sources)


def cached(spark, cache_dir: str, key: str, sources: list[DataFrame], make) -> DataFrame:
    """make()'s result, kept in cache_dir by a key (say station, days and the query's version) until a source file is newer."""
    path = f"{cache_dir}/{hashlib.sha256(key.encode()).hexdigest()[:32]}"
    if is_stale(spark, path, sources):
        make().write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return spark.read.parquet(path)


def profile(df: DataFrame, names: list[str]) -> DataFrame:
    """A row for each numeric column: values, mean, sample deviation, least, quartiles (linear between values), most."""
    cols = [F.struct(F.lit(c).alias("feature"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")) for c in names]
    rows = df.agg(F.array(*cols).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    quarters = quantiles(df.select(*[F.col(c).cast("double").alias(c) for c in names]).unpivot([], names, "feature", "value"), ["feature"], "value", [0.25, 0.5, 0.75], ["q25", "q50", "q75"]).drop("n")
    return rows.join(quarters, "feature", "left").select("feature", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def gate(df: DataFrame, required: list[str]) -> DataFrame:
    """One row: rows, values of each required column, complete rows. A missing column, or nothing complete, is an error."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    whole = F.when(reduce(and_, [F.col(c).isNotNull() for c in required]), 1)
    out = df.agg(F.count("*").alias("n_rows"), *[F.count(c).alias(f"n_{c}") for c in required], F.count(whole).alias("complete"))
    if not out.first()["complete"]:
        raise ValueError("no complete row")
    return out


def features(df: DataFrame, required: list[str]) -> DataFrame:
    return df.withColumns({"month": F.month("date"), "day_of_year": F.dayofyear("date"), "hour": F.col("hour_utc").cast("int")}).dropna(subset=required)


def temporal_split(df: DataFrame, share: float, order: list[str]) -> DataFrame:
    """is_test for the last floor(n x share) rows, one at least, in the order given (which should be unique).

    Days are counted, a row each; only the rows of the day that the cutoff lies in are numbered, in ranges.
    """
    first = order[0]
    days = df.groupBy(first).agg(F.count("*").alias("n"))
    after = Window.orderBy(F.desc(first)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = days.withColumns({"through": F.sum("n").over(after), "all": F.sum("n").over(Window.partitionBy())}).withColumn("test", F.greatest(F.lit(1), F.floor(F.col("all") * share)))
    cut = summed.select(first, (F.col("test") - F.col("through") + F.col("n")).alias("room"), "n")  # of this day's rows, so many are test rows
    days = df.join(cut, first)
    whole = days.where("room <= 0 or room >= n").withColumn("is_test", F.col("room") > 0)
    ranked = numbered(days.where("room > 0 and room < n"), [F.desc(c) for c in order[1:]] or [F.desc(first)], "rank")
    return whole.unionByName(ranked.withColumn("is_test", F.col("rank") <= F.col("room")).drop("rank")).drop("room", "n")


def train(df: DataFrame, inputs: list[str], label: str, trees: int = 400, depth: int = 6, rate: float = 0.05, seed: int = 42):
    """Gradient-boosted regression trees of Spark ML, inputs assembled; a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    stages = [VectorAssembler(inputCols=inputs, outputCol="features"), GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=0.9, seed=seed)]
    return Pipeline(stages=stages).fit(df)


def predictions(model, df: DataFrame, label: str) -> DataFrame:
    return model.transform(df).withColumn("residual", F.col(label) - F.col("prediction")).drop("features")


def metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: rmse, mae, r2."""
    e = F.col(actual) - F.col(predicted)
    return df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(actual) * F.count(actual))).alias("r2"))


def importances(model, inputs: list[str]) -> list[tuple[str, float]]:
    values = model.stages[-1].featureImportances.toArray()
    return sorted(zip(inputs, map(float, values), strict=True), key=lambda p: -p[1])


def log_run(spark, path: str, name: str, params: dict, scores: dict, seconds: float, notes: str = "") -> None:
    row = [(name, {k: str(v) for k, v in params.items()}, {k: None if v is None else float(v) for k, v in scores.items()}, float(seconds), notes)]
    spark.createDataFrame(row, "name string, params map<string,string>, metrics map<string,double>, seconds double, notes string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)
