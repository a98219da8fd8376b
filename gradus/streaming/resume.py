"""Evaluation of items as they arrive: a file stream whose micro-batches run like ``run_batch``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.evaluation import run_batch
from ..schemas import ITEMS


def item_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Items of JSON Lines files that appear in a folder."""
    return spark.readStream.schema(ITEMS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def evaluate_stream(items: DataFrame, checkpoint: str, model_ids: list[str], template_path: str, *, available_now: bool = True, **options):
    """Starts the query.  A micro-batch that is repeated after a failure skips what the results log already has, so each key gets
    one result although batches are delivered at least once."""

    def each(batch: DataFrame, _: int) -> None:
        run_batch(batch.sparkSession, batch, model_ids, template_path, **options)

    writer = items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
