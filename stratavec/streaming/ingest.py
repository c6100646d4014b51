"""Structured Streaming: files of vectors into the catalog, running clusters and statistics.

State is as large as a model and lives in tables or on the driver; a repeated micro-batch is recognized by its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.kmeans import KMeans
from ..operators.tuning import RunningRadius
from ..sources.catalog import Engine


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """(id, v) of Parquet files that appear in folder."""
    return spark.readStream.schema("id long, v array<double>").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_stream(engine: Engine, dataset: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is a batch of the dataset, its id made of the stream's name and the batch's number."""

    def add(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            engine.ingest(dataset, batch, f"stream-{dataset}-{number:08d}")

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def cluster_stream(model: KMeans, stream: DataFrame, checkpoint: str, radius: RunningRadius | None = None) -> StreamingQuery:
    """Running means of clusters, and of pair distances where asked for. The model lives on the driver: after a restart
    of the driver, start from a saved model."""
    done: set[int] = set()

    def update(batch: DataFrame, number: int) -> None:
        if number in done or batch.isEmpty():
            return
        model.partial_fit(batch)
        if radius is not None:
            radius.update(batch)
        done.add(number)

    return stream.writeStream.foreachBatch(update).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
