"""Incremental runs: new rows are processed once, batch by batch, and never again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.relational import distinct_keep_first


def _state(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def run_available(stream: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], state: str, checkpoint: str, retry_failed: bool = False, order: list[str] | None = None) -> DataFrame:
    """Process what a stream has now and return the state table.

    Each micro-batch drops keys already in the state (with ``retry_failed`` those whose ``failed`` is
    TRUE are taken again), processes the first row of each key (by ``order``, else by all columns) and appends the
    results with the batch's number.  The state has the latest result of each key.  A batch that is run again after a failure first leaves out what its earlier
    attempt wrote, so every key is written once.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        done = _state(batch.sparkSession, state)
        todo = distinct_keep_first(batch.where(F.col(key).isNotNull()), [key], order or sorted(c for c, t in batch.dtypes if not t.startswith("map")))
        if done is not None:
            settled = done.where(~F.coalesce(F.col("failed"), F.lit(False))) if retry_failed and "failed" in done.columns else done
            todo = todo.join(settled.select(key).distinct(), key, "left_anti")
        process(todo).withColumn("run_no", F.lit(number).cast("bigint")).write.mode("append").parquet(state)

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(state)
    return distinct_keep_first(out, [key], [F.desc("run_no")]) if retry_failed else out
