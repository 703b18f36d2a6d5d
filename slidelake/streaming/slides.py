"""Slides that arrive in a folder, filtered as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.slides import tissue


def arrivals(spark: SparkSession, folder: str, per_trigger: int = 3) -> DataFrame:
    """A stream of the paths of new slides, at most per_trigger at a time: the depth of the read-ahead. Contents are not read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", "*.tif*").option("maxFilesPerTrigger", per_trigger).load(folder).select("path", "length", "modificationTime")


def filter_arrivals(spark: SparkSession, folder: str, out: str, checkpoint: str, per_trigger: int = 3, **how) -> StreamingQuery:
    """Write the tissue patches of each new slide to out, a Parquet folder with a part per batch; ends when all are done.

    A batch that is run again replaces its own part, so each slide's patches are written once.
    """

    def run(batch: DataFrame, number: int) -> None:
        paths = [r.path for r in batch.select("path").collect()]  # per_trigger at most
        if paths:
            tissue(spark, ",".join(p.removeprefix("file:") for p in paths), **how).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arrivals(spark, folder, per_trigger).writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
