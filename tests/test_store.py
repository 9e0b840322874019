import json

import pytest
from pyspark.sql import functions as F

from siteworks.functions.ratings import RATINGS
from siteworks.session import scratch_path
from siteworks.sources.rating_store import RATING_SCHEMA, RatingStore, upsert
from siteworks.sources.tables import merge_by_priority
from siteworks.streaming.rating_stream import stream_upserts


def rows(spark, *items):
    """(id, rating, batch, time) tuples as rating rows."""
    return spark.createDataFrame([(i, *[float(v)] * len(RATINGS), b, float(t)) for i, v, b, t in items], RATING_SCHEMA)


def state(df):
    return {r.id: (r.rating_coordination, r.batch_completed) for r in df.collect()}


@pytest.fixture
def store(spark):
    return RatingStore(spark, scratch_path(spark, "store"))


def test_empty_store_is_typed(store):
    assert store.read().schema == RATING_SCHEMA and store.progress().first().last_batch == 0


def test_latest_wins_replay_changes_nothing_and_id_zero_is_never_stored(spark, store):
    store.write_batch(rows(spark, (1, 2, 1, 5), (2, 2, 1, 5), (0, 3, 1, 5)), 1)
    store.write_batch(rows(spark, (1, 4, 2, 6)), 2)
    want = {1: (4.0, 2), 2: (2.0, 1)}
    assert state(store.read()) == want
    store.write_batch(rows(spark, (1, 4, 2, 6)), 2)
    assert state(store.read()) == want
    store.compact()
    assert state(store.read()) == want
    store.write_batch(rows(spark, (3, 1, 3, 7), (2, 5, 0, 9)), 3)
    assert state(store.read()) == {**want, 3: (1.0, 3)}


def test_upsert_of_two_frames(spark):
    out = upsert(rows(spark, (1, 1, 1, 1), (2, 1, 3, 1)), rows(spark, (1, 2, 2, 1), (2, 2, 2, 1), (0, 5, 9, 9)))
    assert state(out) == {1: (2.0, 2), 2: (1.0, 3)}


def test_stream_with_restart_equals_one_merge(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()

    def land(name, *items):
        names = RATING_SCHEMA.names
        lines = [json.dumps(dict(zip(names, (i, *[float(v)] * len(RATINGS), b, float(t))))) for i, v, b, t in items]
        (landing / name).write_text("\n".join(lines))

    run = lambda: stream_upserts(spark, str(landing), str(tmp_path / "store"), str(tmp_path / "state"), 1)
    land("b.json", (1, 4, 4, 1), (2, 4, 4, 1))
    land("c.json", (1, 1, 1, 1))
    run()
    run()
    land("a.json", (2, 5, 5, 1), (3, 5, 5, 1), (3, 5, 5, 1))
    run()
    assert state(RatingStore(spark, str(tmp_path / "store")).read()) == {1: (4.0, 4), 2: (5.0, 5), 3: (5.0, 5)}


def test_first_source_that_knows_a_key_wins(spark):
    a = spark.createDataFrame([(1, "a")], "id bigint, v string")
    b = spark.createDataFrame([(1, "b"), (2, "b")], "id bigint, v string")
    assert {r.id: (r.v, r.priority) for r in merge_by_priority([a, b], "id").collect()} == {1: ("a", 0), 2: ("b", 1)}


def test_writers_share_no_numbers_and_nothing_is_lost(spark, store):
    store.write_batch(rows(spark, (1, 1, 1, 1)), 1)
    store.write_batch(rows(spark, (2, 2, 2, 1)), 2)
    store.compact()
    store.write_batch(rows(spark, (3, 3, 0, 1)), 0)
    store.write_batch(rows(spark, (4, 4, 1, 1)), 1, "other")
    want = {1: (1.0, 1), 2: (2.0, 2), 3: (3.0, 0), 4: (4.0, 1)}
    assert state(store.read()) == want
    store.compact()
    assert state(store.read()) == want
    store.write_batch(rows(spark, (1, 1, 1, 1)), 1)  # a late replay, after it was folded
    store.write_batch(rows(spark, (5, 5, 5, 1)), 1, "other")
    assert state(store.read()) == {**want, 5: (5.0, 5)}
    store.compact()
    assert state(store.read()) == {**want, 5: (5.0, 5)}


def test_equal_batch_and_time_have_one_answer(spark, store):
    store.write_batch(rows(spark, (1, 2, 1, 1), (1, 4, 1, 1)).repartition(2), 1)
    store.write_batch(rows(spark, (1, 3, 1, 1)), 2)
    assert state(store.read()) == {1: (4.0, 1)}


def test_new_checkpoint_is_another_writer(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    names = RATING_SCHEMA.names
    for run, (i, value) in enumerate([(1, 1.0), (2, 2.0)]):
        (landing / f"{run}.json").write_text(json.dumps(dict(zip(names, (i, *[value] * len(RATINGS), 1, 1.0)))))
        stream_upserts(spark, str(landing), str(tmp_path / "store"), str(tmp_path / f"state{run}"), 1, compact_every=1)
    assert set(state(RatingStore(spark, str(tmp_path / "store")).read())) == {1, 2}


def test_buckets_split_and_old_files_go(spark, tmp_path):
    """Forty small versions: the current rows are right at every step, and files do not add up."""
    from siteworks.sources import rating_store as module

    store = RatingStore(spark, str(tmp_path / "store"), bucket_rows=8)
    want = {}
    for version in range(1, 20):
        items = [(i, version % 5 + 1, version, 1) for i in range(1 + 7 * (version % 3), 140, 1 + version % 4)] if version < 4 else [(version, 2, version, 1), (1000 + version, 3, version, 1)]
        store.write_batch(rows(spark, *items).coalesce(1), version)
        want |= {i: (float(v), b) for i, v, b, _ in items}
        store.compact()
        if version in (1, 3, 16, 17, 19):
            assert state(store.read()) == want
    kept = store._state()
    assert kept["version"] == 19 and max(len(b) for b in kept["buckets"]) > module.FIRST_BITS and sum(kept["rows"].values()) == len(want)
    assert len(store._versions()) <= module.FULL_EVERY and len(store._names("batches/main")) <= module.KEEP
    live = {p.split("/")[1] for p in kept["buckets"].values()}
    assert len(set(store._names("base")) - live) <= module.KEEP
    store.write_batch(rows(spark, (4, 5, 50, 1)), 1)  # the number of a batch that is folded and gone
    assert state(store.read()) == want | {4: (5.0, 50)}


def test_calls_follow_what_is_not_folded(spark, tmp_path):
    """A thousand batches were written once; a read looks at those not yet folded only."""
    store = RatingStore(spark, str(tmp_path / "store"), keep=0)
    (tmp_path / "store" / "batches" / "main").mkdir(parents=True)
    store.write_batch(rows(spark, (1, 1, 1, 1)).coalesce(1), 1)
    first = tmp_path / "store" / "batches" / "main" / "000000000001-0001"
    import shutil

    for k in range(2, 1001):
        shutil.copytree(first, first.with_name(f"{k:012d}-0001"))
    store.compact()
    assert state(store.read()) == {1: (1.0, 1)} and store._names("batches/main") == []
    store.write_batch(rows(spark, (2, 2, 2001, 1)).coalesce(1), 2001)
    calls = []
    inner = store._names
    store._names = lambda name: calls.append(name) or inner(name)
    store.read()
    assert len(calls) <= 4 and len(store._unfolded(store._state())) == 1


def test_a_second_compaction_of_the_same_version_fails(spark, store):
    store.write_batch(rows(spark, (1, 1, 1, 1)), 1)
    store.compact()
    with pytest.raises(RuntimeError):
        store._publish("000000000001", "{}")
    with pytest.raises(RuntimeError):
        store._publish("000000000001-full", "{}")
    assert state(store.read()) == {1: (1.0, 1)}


def test_empty_batches_are_folded_too(spark, store):
    store.write_batch(rows(spark, (0, 1, 1, 1)), 1)
    store.compact()
    assert state(store.read()) == {} and store._unfolded(store._state()) == []
    store.write_batch(rows(spark, (7, 1, 1, 1)), 2)
    store.compact()
    store.write_batch(rows(spark, (0, 1, 1, 1)), 3)
    store.compact()
    assert state(store.read()) == {7: (1.0, 1)}


def test_attempts_are_numbers(spark, store, tmp_path):
    store.write_batch(rows(spark, (1, 1, 1, 1)), 1)
    one = store._folder("batches/main/000000000001-0001")[0].toString()
    import shutil

    shutil.copytree(one, one[:-4] + "9999")
    store.write_batch(rows(spark, (1, 2, 1, 1)), 1)
    assert store._unfolded(store._state()) == ["batches/main/000000000001-10000"] and state(store.read()) == {1: (2.0, 1)}
