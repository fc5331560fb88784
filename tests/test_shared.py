"""Tables between jobs: what is deleted, and what stays."""

import threading

from isotherm import shared


def rows(df):
    return df.sparkSession.read.parquet(df.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_tables_of_others_stay(spark):
    before = shared.materialize(spark.range(3), "before")
    begun = shared.mark()
    first, second = shared.materialize(spark.range(4), "first"), shared.materialize(spark.range(5), "second")
    other = {}

    def work():
        other["early"] = shared.materialize(spark.range(6), "early")
        own = shared.mark()
        other["late"] = shared.materialize(spark.range(7), "late")
        other["gone"] = shared.clear(spark, own)

    thread = threading.Thread(target=work)
    thread.start()
    thread.join()
    assert other["gone"] == 1
    assert shared.clear(spark, begun, keep=1) == 1 and (rows(before), rows(second), rows(other["early"])) == (3, 5, 6)
    # a mark stays good when what stands before it is deleted
    later = shared.mark()
    third = shared.materialize(spark.range(8), "third")
    assert shared.clear(spark, begun, keep=1) == 1
    assert shared.clear(spark, later, keep=1) == 0 and rows(third) == 8 and rows(before) == 3
    assert shared.clear(spark, later) == 1 and first is not None
