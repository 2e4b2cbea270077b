"""The batch rules over a folder that files arrive in; each file is independent, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from leafmill.operators import rules
from leafmill.sources.pdf import tables

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, profiles: tuple[str, ...] = ("2b", "ua1")) -> StreamingQuery:
    """Starts a query that appends the assertions of new files to out, and their status to out/../status."""
    arriving = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", "*.pdf").load(folder)

    def take(batch: DataFrame, number: int) -> None:
        items = tables.parsed(batch).persist()
        views = tables.views(items)
        # One folder for each batch: a batch that runs again replaces what it wrote.
        rules.assertions(views, profiles).write.mode("overwrite").parquet(f"{out}/assertions/batch={number}")
        views["status"].write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        items.unpersist()

    return arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
