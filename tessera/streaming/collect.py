"""The collection as a stream: files in, deduplicated samples out, until there are enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tessera.plans.shared import new_path


def page_stream(spark: SparkSession, folder: str, glob: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Read the Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def distinct_stream(stream: DataFrame, text: str, event_time: str | None = None, lateness: str = "1 day") -> DataFrame:
    """Keep one row of each text.

    State is a hash for each text. With an event time a watermark bounds it, and copies that are
    further apart than ``lateness`` are both kept; without one it grows with the distinct texts.
    """
    marked = stream.withColumn("_h1", F.xxhash64(text)).withColumn("_h2", F.md5(text))
    if event_time is None:
        return marked.dropDuplicates(["_h1", "_h2"]).drop("_h1", "_h2")
    return marked.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["_h1", "_h2"]).drop("_h1", "_h2")


class Progress(StreamingQueryListener):
    """Keeps how far a stream has come: the rows read, by batch."""

    def __init__(self) -> None:
        self.rows: list[int] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        """Do nothing."""

    def onQueryProgress(self, event) -> None:  # noqa: N802
        """Note the rows of a batch."""
        self.rows.append(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        """Do nothing."""

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        """Do nothing."""


def run_to_table(stream: DataFrame, label: str, wanted: int | None = None, folder: str | None = None) -> DataFrame:
    """Run a stream over what there is, write it to the shared folder and return the table.

    With ``wanted``, the query stops with the batch in which that many rows have been written; of that
    batch those rows are kept that come first by hash, so the same input gives the same rows. How many
    there are is read from the table itself: a query started again in ``folder`` goes on where it stopped.
    """
    spark = stream.sparkSession
    folder = folder or new_path(spark, label)
    path, state = f"{folder}/rows", f"{folder}/state"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(path)
    stored = lambda: spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(path)
    enough = {"now": wanted is not None and stored().count() >= wanted}

    def write(batch: DataFrame, number: int) -> None:
        out = f"{path}/batch={number}"
        if wanted is None:
            batch.write.mode("overwrite").parquet(out)
            return
        batch.limit(0).write.mode("overwrite").parquet(out)
        missing = wanted - stored().count()
        if missing <= 0:
            batch.write.format("noop").mode("overwrite").save()  # the state store expects every batch to run
        else:
            by_hash = F.xxhash64(*[F.col(c) for c in batch.columns])
            batch.orderBy(by_hash, *batch.columns).limit(missing).write.mode("overwrite").parquet(out)
            enough["now"] = stored().count() >= wanted

    if not enough["now"]:
        sink = stream.writeStream.foreachBatch(write).option("checkpointLocation", state)
        query: StreamingQuery = sink.trigger(availableNow=True).start()
        try:
            while not query.awaitTermination(1):
                if enough["now"]:
                    query.stop()
        except StreamingQueryException:
            # Stopping may break off the batch after the last one that counts.
            if not enough["now"]:
                raise
    return stored()


def collect_until(stream: DataFrame, text: str, least: int, most: int, wanted: int, clean: Callable | None = None) -> DataFrame:
    """Clean, filter, cut and deduplicate a stream until there are ``wanted`` samples."""
    if clean is not None:
        stream = stream.withColumn(text, clean(F.col(text)))
    kept = stream.filter(F.length(text) > least).withColumn(text, F.substring(text, 1, most))
    return run_to_table(distinct_stream(kept, text), "collected", wanted)
