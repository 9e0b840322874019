"""Restart-safe merge of rating batches that arrive as files, in any order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteworks.sources.rating_store import RATING_SCHEMA, RatingStore, latest_per_id


def stream_upserts(
    spark: SparkSession, landing: str, store_path: str, checkpoint: str, files_per_trigger: int = 100, compact_every: int = 50
) -> None:
    """Merge all JSON files that landed since the last run, then stop.

    A file batch is collapsed to one row per id and written under the stream's own
    name and batch number, so a replay after a crash replaces the same batch and the
    store ends up equal to one merge of all files. The name is the id that Spark keeps in the
    checkpoint: a stream that starts over with a new checkpoint is another writer.
    """
    store = RatingStore(spark, store_path)

    def merge(rows: DataFrame, epoch: int) -> None:
        known = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])
        store.write_batch(latest_per_id(rows, "id", ["batch_completed", "timestamp"]), epoch, f"stream-{known['id']}")
        if (epoch + 1) % compact_every == 0:
            store.compact()

    query = (
        spark.readStream.schema(RATING_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(landing)
        .where(F.col("id").isNotNull())
        .writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
