"""Registered queries against their SQL, and against whole tables; the pipeline stage by stage."""

import os
import random
import sys
from collections import Counter

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from siteworks.llm.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


def normal(value):
    return f"{value:.9g}" if isinstance(value, float) else None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    rows = sorted((tuple(normal(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=str)
    want = db.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    place = sorted(range(len(names)), key=lambda i: names[i])
    assert rows == sorted((tuple(normal(r[i]) for i in place) for r in want.fetchall()), key=str)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_pass_on_documents(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 500)) for _ in range(n))
    passage = prose(120) + " é"
    near = prose(80)
    rows = [(i, prose(60), f"s{i % 3}") for i in range(20)]
    rows += [(20, passage + " " + prose(30), "s0"), (21, prose(40) + " " + passage, "s1"), (22, near, "s2"), (23, near + " end", "s2"), (24, None, None), (25, "", "s0")]
    docs = documents(spark, rows)
    once = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert once.columns == docs.columns and {r.doc_id for r in once.collect()} == set(range(26)) - {23}
    kept = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, once, SF).collect()}
    assert passage not in kept[20].text and passage not in kept[21].text and kept[20].n_chars == len(kept[20].text)
    assert all(kept[i].text == rows[i][1] for i in [*range(20), 22, 24, 25])
    mixed = corpus_pipeline.mix(spark, once, SF)
    assert mixed.columns == docs.columns
    total = lambda frame: Counter({r.source: 0 for r in frame}) + Counter(w for r in frame for w in [r.source] * len((r.text or "").split()))
    before, after = total(once.collect()), total(mixed.collect())
    assert abs(sum(after.values()) - sum(before.values())) <= 4 and after["s0"] > before["s0"] > 0
    packed = corpus_pipeline.pack(spark, mixed, SF)
    assert packed.count() >= mixed.count()


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    filled = Counter()
    for r in got:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 4096 and sum(filled.values()) >= 0.9 * 4096 * (len(filled) - 1)


def test_stage_drops_near_copies_from_four_fifths(spark):
    """Two scattered words changed: five-word sets of 100, 94 and 93 words have 86/106, 80/100 and 79/99 in common."""
    rows = []
    for k, n in enumerate((100, 94, 93)):
        words = [f"w{k}x{i}" for i in range(n)]
        other = [*words[:30], "changed", *words[31:60], "too", *words[61:]]
        rows += [(2 * k, " ".join(words), "s0"), (2 * k + 1, " ".join(other), "s1")]
    once = corpus_pipeline.drop_near_copies(spark, documents(spark, rows), SF)
    assert {r.doc_id for r in once.collect()} == {0, 2, 4, 5}
