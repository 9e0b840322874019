"""Replies are kept as they come: no batch is asked twice, whatever fails."""

import uuid
from collections import Counter

import pandas as pd
import pytest

from siteworks.operators import replies

SCHEMA = "id bigint, n int"


def counting(calls, fails=()):
    """A scorer that notes each call in a file of its own, and fails on batches with certain ids."""

    def score(frame):
        ids = frame["id"].tolist()
        if set(ids) & set(fails):
            raise ValueError("no reply")
        (calls / uuid.uuid4().hex).write_text(",".join(map(str, ids)))
        return pd.DataFrame({"id": frame["id"], "n": [len(n) if isinstance(n, str) else -1 for n in frame["name"]]})

    return score


@pytest.fixture
def batched(spark):
    rows = [(i, None if i % 7 == 0 else "x" * (i % 5), i // 4) for i in range(40)]
    rows += [(i, "x" * (i % 5), 100) for i in (1, 2, 3)] + [(i, "x" * (i % 5), 101) for i in (1, 2, 3)]  # one batch, twice
    return spark.createDataFrame(rows, "id long, name string, batch int").repartition(3)


def test_called_once_per_batch_over_two_runs(spark, batched, tmp_path):
    calls, log = tmp_path / "calls", str(tmp_path / "log")
    calls.mkdir()
    run = lambda fails=(): replies.enrich_logged(batched, counting(calls, fails), SCHEMA, ["id", "name"], log).collect()
    with pytest.raises(Exception, match="no reply"):
        run(fails=[18])
    before = len(list(calls.iterdir()))
    got = run()
    asked = Counter(f.read_text() for f in calls.iterdir())
    assert 0 < before < len(asked) == 11 and set(asked.values()) == {1}
    want = sorted([(i, -1 if i % 7 == 0 else i % 5) for i in range(40)] + [(i, i % 5) for i in (1, 2, 3)])
    assert sorted((r.id, r.n) for r in got) == want
    replies.fold_replies(spark, log)
    assert sorted((r.id, r.n) for r in run()) == want and sum(1 for _ in calls.iterdir()) == 11
    assert replies.folded_replies(spark, log).count() == 11


def test_another_version_is_another_question(spark, batched):
    one, other = (replies.batch_contents(batched, ["id", "name"], version=v).select("digest") for v in ("a", "b"))
    assert one.count() == 11 and one.intersect(other).count() == 0


def test_nothing_to_ask(spark, batched, tmp_path):
    log = str(tmp_path / "log")
    assert replies.enrich_logged(batched.limit(0), counting(tmp_path), SCHEMA, ["id", "name"], log).collect() == []
    replies.fold_replies(spark, log)


def test_files_grow_with_groups_not_batches(spark, tmp_path):
    """Thousands of batches leave at most a file per group, are asked by all tasks, and an unfinished line or an older file per batch is no loss."""
    calls, log = tmp_path / "calls", tmp_path / "log"
    calls.mkdir()
    many = spark.createDataFrame([(i, "x" * (i % 5), i) for i in range(9000)], "id long, name string, batch int")
    quiet = lambda frame: pd.DataFrame({"id": frame["id"], "n": frame["name"].str.len()})
    ask = lambda scorer: replies.enrich_logged(many, scorer, SCHEMA, ["id", "name"], str(log))
    first = ask(quiet)
    assert first.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert first.count() == 9000
    made = [f for f in (log / "new").rglob("*") if f.is_file() and not f.name.startswith(".")]
    assert 0 < len(made) <= 16**replies.GROUP_DIGITS
    last = made[0].read_text().splitlines()[-1]
    lost, reply = replies.json.loads(last).values()
    made[0].write_text(made[0].read_text()[: -len(last) // 2])
    lone = replies.json.loads(made[1].read_text().splitlines()[-1])
    made[1].write_text("".join(f"{line}\n" for line in made[1].read_text().splitlines()[:-1]))
    (made[1].parent / f"{lone['digest']}.json").write_text(lone["reply"])
    assert ask(counting(calls)).count() == 9000 and len(list(calls.iterdir())) == 1
    replies.fold_replies(spark, str(log))
    folded = {r.digest: r.reply for r in replies.folded_replies(spark, str(log)).collect()}
    assert len(folded) == 9000 and folded[lost] == reply and folded[lone["digest"]] == lone["reply"]
