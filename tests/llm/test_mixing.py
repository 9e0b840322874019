"""The mix against the rules written out in Python, and its native plan."""

import math

from siteworks.llm.mixing import due_at, mix_sources, take_mix
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, n_chars long, target int"


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(3 * sizes[s] for s in full)
        got = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if got[s] > 3 * sizes[s]}
        if not over:
            return got
        full |= over


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), 1) for i, t, s in rows], SCHEMA).repartition(3)


def test_targets_and_takings(spark):
    rows, i = [], 0
    for source, docs, words in (("b", 40, 30), ("a", 2, 5), ("c", 300, 7), (None, 3, 2), ("é", 10, 1), ("z", 1, 900), ("d", 5, 0)):
        for k in range(docs):
            rows.append((i, " \t".join(f"w{j}" for j in range(words + k % 3 if words else 0)) or (None if k % 2 else ""), source))
            i += 1
    got = mix_sources(make(spark, rows)).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12)
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes) and len(got) == len(rows)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and 0 <= places[0] and places[-1] <= 1
    again = mix_sources(make(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    plan = mix_sources(make(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

    mixed = take_mix(make(spark, rows)).collect()
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == {r.doc_id: r.taken for r in got if r.taken}
    assert all(r.n_chars == len(r.text) for r in mixed)


def test_integral_is_inverted(spark):
    frame = spark.range(101).select((F.col("id") / 100).alias("x"), F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0))).alias("r"))
    for x, r, t in frame.select("x", "r", due_at(F.col("x"), F.col("r"))).collect():
        start, rise = 2 / (1 + r), 2 * (r - 1) / (1 + r)
        assert math.isclose(start * t + rise * t * t / 2, x, abs_tol=1e-12)


def test_odd_tables(spark):
    assert mix_sources(make(spark, [])).collect() == []
    got = mix_sources(make(spark, [(None, "a b", None), (1, None, "s"), (1, None, "s"), (2, "", "s")])).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == [("1", 0, 0), ("1", 0, 0), ("2", 0, 0), ("None", 2, 2)]
