"""Incremental processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is and stop; a later run goes on from the checkpoint."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def _written(spark: SparkSession, path: str, key: str, low, high) -> DataFrame | None:
    """The keys of one table that lie between two values; Parquet's statistics leave out files beyond them."""
    try:
        return spark.read.parquet(path).where(F.col(key).between(low, high)).select(key)
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def resume(stream: DataFrame, key: str, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], failed: str | None = None) -> None:
    """Work on rows whose key is in neither output yet, each micro-batch appended; rows where ``error`` isn't null go to ``failed``.

    Each key is written once, the failed ones too; to try those again, take them out of
    ``failed``. A batch that runs again after a failure, even between its two writes, finds
    its own keys done. Of the outputs only the files in the batch's range of keys are read.
    """

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        rows = rows.dropDuplicates([key])
        low, high = rows.agg(F.min(key), F.max(key)).first()
        for there in [path, *([failed] if failed else [])]:
            done = None if low is None else _written(spark, there, key, low, high)
            rows = rows if done is None else rows.join(done, key, "left_anti")
        made = work(rows).persist()
        try:
            if failed and "error" in made.columns:
                made.where("error IS NOT NULL").sortWithinPartitions(key).write.mode("append").parquet(failed)
                made = made.where("error IS NULL").drop("error")
            made.sortWithinPartitions(key).write.mode("append").parquet(path)
        finally:
            made.unpersist()

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def save_every(stream: DataFrame, key: str, n: int, path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame]) -> None:
    """Results saved in lots of ``n`` updates over all micro-batches: ``save`` is the integer key divided by ``n``.

    A lot that a micro-batch leaves open is completed by later ones. Each batch writes its
    own folders (batch, save); one that runs again writes the same ones anew.
    """

    def batch(rows: DataFrame, number: int) -> None:
        made = work(rows).withColumns({"save": F.floor(F.col(key) / n).cast("long"), "batch": F.lit(number)})
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "save").parquet(path)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def quota(stream: DataFrame, category: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each category over all micro-batches; within one, by ``order``."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)

    def take(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (used,) = state.get if state.exists else (0,)
        # of all parts only the first rows so far are held, never a whole category
        best = None
        for part in parts:
            best = (part if best is None else pd.concat([best, part])).sort_values(order).head(max(0, most - used))
        state.update((used + len(best),))
        yield best

    return stream.groupBy(category).applyInPandasWithState(take, schema, "used long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, by: str, width: str, late: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window; rows later than ``late`` behind the newest are left out of a stream."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, by: str, gap: str) -> DataFrame:
    return events.withWatermark(time, "1 day").groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))


def read_changes(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a few files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
