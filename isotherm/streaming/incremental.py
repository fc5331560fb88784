"""Incremental ingest: new files of observations are merged by key, and the index of hours with them. Replaying changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isotherm.functions.columns import nan_to_null
from isotherm.model import variables
from isotherm.operators.claims import claimed
from isotherm.operators.coverage import hour_masks, merged
from isotherm.operators.storage import days_of, merge_into, partitions_of
from isotherm.shared import clear, mark, materialize
from isotherm.sources.tables import replace_partitions

#: The column of a batch that orders its rows by their arrival.
ORDER = "__seq"


def merge_batch(spark: SparkSession, batch: DataFrame, data: str, index: str) -> None:
    """One batch into the observations and into the index; both read and rewrite only the days that the batch has rows of.

    ORDER says which rows came later. The batch is evaluated once; new rows and masks are written before they are merged.
    """
    begun = mark()
    batch = materialize(batch, "arrived")
    merge_into(spark, data, batch, order=ORDER)
    own = batch.drop(ORDER)
    new = materialize(hour_masks(nan_to_null(own), variables(own)), "masks")
    with claimed(spark, index, days_of(new)) as claim:
        old = partitions_of(spark, index, new)
        both = materialize(merged(old.select(new.columns), new), "merged") if old is not None else new
        claim.check()
        replace_partitions(both, index)
    clear(spark, begun)


def ingest_new(spark: SparkSession, source: str, schema, data: str, index: str, checkpoint: str):
    """Merge all files of `source` that no run before has seen, then stop."""
    # a row came later if its file is newer, or of files of one time has the larger name, or if it stands behind in its file
    came = F.struct("_metadata.file_modification_time", "_metadata.file_name", "_metadata.row_index")
    stream = spark.readStream.schema(schema).parquet(source).select("*", came.alias(ORDER))
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: merge_batch(spark, batch, data, index)).start()
    query.awaitTermination()
    return query
