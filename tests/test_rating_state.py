"""The stream that remembers the latest version of each id."""

import json
import random

import pandas as pd

from siteworks.functions.ratings import RATINGS
from siteworks.sources.rating_store import RATING_SCHEMA, RatingStore, latest_per_id
from siteworks.streaming.rating_state import _follow, newest, stream_latest

NAMES = RATING_SCHEMA.names


def row(i, value, batch, time):
    return (i, *[value] * len(RATINGS), batch, time)


def land(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(NAMES, r))) for r in rows))


def test_reordered_replayed_and_late_files(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    rng = random.Random(6)
    versions = [row(rng.randint(0, 30), float(rng.randint(1, 5)), rng.choice([None, *range(8)]), rng.choice([None, 1.0, 2.0])) for _ in range(240)]
    versions.append((None, *versions[0][1:]))
    seen = []
    for run in range(3):
        for k in range(2):
            part = rng.sample(versions, 50)  # overlaps: many versions land again
            land(landing, f"{run}-{k}.json", part)
            seen += part
        stream_latest(spark, str(landing), str(tmp_path / "store"), str(tmp_path / "state"), 1, compact_every=2)
    stored = RatingStore(spark, str(tmp_path / "store")).read()
    frame = spark.createDataFrame([v for v in seen if v[0]], RATING_SCHEMA)
    want = latest_per_id(frame, "id", ["batch_completed", "timestamp"])
    assert sorted(map(str, stored.select(NAMES).collect())) == sorted(map(str, want.select(NAMES).collect()))


def test_only_changes_are_written(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    run = lambda: stream_latest(spark, str(landing), str(tmp_path / "store"), str(tmp_path / "state"), 1, compact_every=100)
    rows_of = lambda: sum(spark.read.schema(RATING_SCHEMA).parquet(str(p)).count() for p in (tmp_path / "store" / "batches").glob("*/*"))
    land(landing, "a.json", [row(1, 1.0, 5, 1.0), row(2, 1.0, 5, 1.0), row(1, 2.0, 4, 9.0)])
    run()
    assert rows_of() == 2
    land(landing, "b.json", [row(1, 1.0, 5, 1.0), row(2, 3.0, 4, 1.0)])  # a replay and a late version: nothing changes
    run()
    assert rows_of() == 2
    land(landing, "c.json", [row(2, 4.0, 6, 1.0)])
    run()
    assert rows_of() == 3


def test_newest_breaks_ties_as_a_whole():
    assert newest(iter([(1, None, 2.0), (1, 0.0, 1.0)]), None) == (1, 0.0, 1.0)
    assert newest(iter([(1, 0.0, 1.0), (None, 9.0, 9.0)]), (1, 0.0, 1.0)) is None
    assert newest(iter([(1, 0.0, 3.0)]), (1, 0.0, 1.0)) == (1, 0.0, 3.0)


class Held:
    """The state of a group, as Spark hands it over."""

    def __init__(self, value=None, now=0, timed_out=False):
        self.value, self.now, self.hasTimedOut, self.wait = value, now, timed_out, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):  # noqa: N802
        return self.now

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, wait):  # noqa: N802
        self.wait = wait


def test_one_call_follows_many_ids_and_forgets_each_by_itself():
    follow, state = _follow(100), Held(now=1000)
    frame = lambda ids, batch: pd.DataFrame([row(i, 1.0, batch, 1.0) for i in ids], columns=NAMES)
    ids_of = lambda frames: sorted(i for out in frames for i in out["id"])
    assert ids_of(follow((7,), iter([frame(range(1, 500), 5), frame(range(1, 900), 4)]), state)) == list(range(1, 900))
    assert sorted(state.value[0]) == list(range(1, 900)) and state.wait == 100
    state.now = 1060
    assert ids_of(follow((7,), iter([frame([3], 4), frame([4, None], 6).dropna(subset="id")]), state)) == [4]
    state.now, state.hasTimedOut = 1120, True
    assert ids_of(follow((7,), iter([]), state)) == [] and sorted(state.value[0]) == [3, 4] and state.wait == 40
    state.now = 1200
    assert ids_of(follow((7,), iter([]), state)) == [] and not state.exists
