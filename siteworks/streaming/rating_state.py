"""Changes of the latest rating per id, from a stream that remembers each id.

``stream_upserts`` writes every version that lands and leaves it to readers to find the latest. Here the
stream itself knows the latest version of each id, so a version that is older than one seen before, or a replay of it, goes
no further: what is written is what changed. The state lives in Spark's state store and restarts
with the checkpoint. Ids that were not heard of for ``keep_days`` are forgotten; if an old version of
one arrives after that it is passed on, and the store, which compares versions too, keeps the newer.

A call of Python for each id would cost a frame for each. Ids are dealt into ``GROUPS`` groups by their hash, and a call
follows all ids of a group: each has its own version and its own time in the group's state. A checkpoint
of a stream that kept state by id cannot go on; it starts over with a new one and the same store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siteworks.sources.rating_store import RATING_SCHEMA, RatingStore

KEEP_DAYS = 30
#: Groups of ids that share a row of state; fixed, as a checkpoint is of this number.
GROUPS = 1 << 11
ORDER = ["batch_completed", "timestamp"]
#: Versions are compared by batch and time, then as a whole, as the store does.
COMPARED = [*ORDER, *[f.name for f in RATING_SCHEMA if f.name not in ("id", *ORDER)]]


def _comparable(version: tuple) -> tuple:
    """Null is below everything, as in Spark's order of structs."""
    return tuple((v is not None, v) for v in version)


def newest(versions: Iterator[tuple], known: tuple | None) -> tuple | None:
    """The newest of some versions if it is newer than the known one, else None."""
    best = known
    for version in versions:
        if best is None or _comparable(version) > _comparable(best):
            best = version
    return None if best is known else best


def _versions(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, tuple]]:
    """Ids and their versions as plain values, a frame at a time."""
    whole = COMPARED.index("batch_completed")
    for frame in frames:
        part = frame[["id", *COMPARED]]
        for i, *version in part.astype(object).where(part.notna(), None).itertuples(index=False, name=None):
            if version[whole] is not None:  # next to a null, pandas makes it a float
                version[whole] = int(version[whole])
            yield int(i), tuple(version)


def _follow(keep_ms: int):
    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held = {i: tuple(version) for i, version in zip(*state.get[:2], strict=True)} if state.exists else {}
        heard = dict(zip(state.get[0], state.get[2], strict=True)) if state.exists else {}
        changed = {}
        for i, version in () if state.hasTimedOut else _versions(frames):
            found = newest(iter([version]), held.get(i))
            if found is not None:
                held[i] = changed[i] = found
            heard[i] = now
        if changed:
            rows = pd.DataFrame([[i, *version] for i, version in changed.items()], columns=["id", *COMPARED])
            kinds = {"bigint": "int64", "int": "Int32", "double": "float64"}
            yield rows.astype({f.name: kinds[f.dataType.simpleString()] for f in RATING_SCHEMA})[RATING_SCHEMA.names]
        # Each id has its own time; the group's is that of the id that was heard of longest ago.
        kept = [i for i in held if heard[i] + keep_ms >= now]
        if not kept:
            state.remove()
            return
        state.update((kept, [held[i] for i in kept], [heard[i] for i in kept]))
        state.setTimeoutDuration(max(1, min(heard[i] for i in kept) + keep_ms - now))

    return follow


def latest_changes(versions: DataFrame, keep_days: float = KEEP_DAYS) -> DataFrame:
    """The versions of a stream (RATING_SCHEMA) that are newer than all seen before of their id; at most one per id and trigger.

    Null ids, and id 0, which marks a fall-back row, go. Rows of a group meet in one task, a frame at a time: what is held is one version per id of the group.
    """
    known = versions.where(F.col("id").isNotNull() & (F.col("id") != 0)).select(*RATING_SCHEMA.names)
    kinds = {f.name: f.dataType.simpleString() for f in RATING_SCHEMA}
    version = ", ".join(f"{c}: {kinds[c]}" for c in COMPARED)
    kept = f"ids array<bigint>, versions array<struct<{version}>>, heard array<bigint>"
    return known.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(GROUPS))).groupBy("part").applyInPandasWithState(
        _follow(int(keep_days * 86_400_000)), RATING_SCHEMA, kept, "update", GroupStateTimeout.ProcessingTimeTimeout
    )


def stream_latest(
    spark: SparkSession, landing: str, store_path: str, checkpoint: str, files_per_trigger: int = 100, compact_every: int = 50, keep_days: float = KEEP_DAYS
) -> None:
    """Pass the changes of all JSON files that landed since the last run to a store, then stop.

    A trigger's changes are written under its number, so a replay after a crash replaces the same batch.
    """
    store = RatingStore(spark, store_path)

    def write(rows: DataFrame, epoch: int) -> None:
        known = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])
        store.write_batch(rows, epoch, f"latest-{known['id']}")
        if (epoch + 1) % compact_every == 0:
            store.compact()

    landed = spark.readStream.schema(RATING_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(landing)
    query = latest_changes(landed, keep_days).writeStream.foreachBatch(write).outputMode("update")
    # With timeouts Spark would go on with triggers without data for ever; ids expire with the next data instead.
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, "false")
    try:
        started = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(idle, before)
    started.awaitTermination()
