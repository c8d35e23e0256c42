import os

from pyspark.sql import functions as F

from regionlab.session import temporary, written



def test_temporary(spark):
    """Tables written inside a scope go at its end, those outside stay."""
    kept = written(spark.range(5))
    with temporary(spark):
        inner = written(kept.where("id > 1"))
        with temporary(spark):
            most = written(inner.agg(F.max("id").alias("m")))
            assert most.first()[0] == 4
            path = most.inputFiles()[0].removeprefix("file://")
            assert os.path.exists(path)
        assert not os.path.exists(path)
        assert inner.count() == 3
        path = inner.inputFiles()[0].removeprefix("file://")
    assert not os.path.exists(path) and kept.count() == 5
