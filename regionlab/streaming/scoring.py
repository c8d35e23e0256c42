"""Scoring of submissions as they arrive. An extension: the engine's batch plan, run on every micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regionlab.plans.pipelines import evaluate


def score_arrivals(spark: SparkSession, folder: str, solution: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Each micro-batch of Parquet files (``image``, ``regions``, ``row_no``) in ``folder`` is a submission; ``sink`` gets its report."""
    arriving = spark.readStream.schema("image string, regions string, row_no bigint").parquet(folder)

    def score(batch: DataFrame, epoch: int) -> None:
        sink(evaluate(solution, batch, strict=False).withColumn("epoch", F.lit(epoch)), epoch)

    w = arriving.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
