"""Columns that bear the operators' own names pass through every stage untouched; rows may share ids."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from siteworks.llm import jaccard_join, mixing, packing, suffix_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = """row node key keys root n items kept_row kept spans n_bytes n_removed n_spans start end doc whole toxicity score size taken target mix_size mix_id
words digest nth place position bucket base piece length offset ids sequence_id rank of in total word h""".split()


def documents(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 500)) for _ in range(n))
    passage = prose(150)
    rows = [(i, prose(50), f"s{i % 3}") for i in range(12)]
    rows += [(20, passage + " " + prose(30), "s0"), (21, prose(40) + " " + passage, "s1"), (3, rows[3][1], "s0"), (3, prose(30), "s0"), (None, prose(30), None), (None, None, None), (25, "", "s0")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.repartition(3)


def clashing(docs):
    return docs.withColumns({name: F.concat(F.lit(name), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for name in NAMES})


def seen(df, names):
    return sorted(str(tuple(r[c] for c in names)) for r in df.collect())


@pytest.mark.parametrize("stage", ["drop_toxic", "drop_near_copies", "drop_repeated_passages", "mix"])
def test_stages_keep_all_columns(spark, stage):
    docs = documents(spark)
    run = getattr(corpus_pipeline, stage)
    plain, extra = run(spark, docs, SF), run(spark, clashing(docs), SF)
    assert extra.columns == clashing(docs).columns
    assert seen(extra, docs.columns) == seen(plain, docs.columns)
    for r in extra.collect():
        assert all(r[c] == f"{c}-{'none' if r.doc_id is None else r.doc_id}" for c in NAMES)


@pytest.mark.parametrize("operator", [jaccard_join.link_documents, mixing.mix_sources, packing.pack_documents])
def test_operators_do_not_read_them(spark, operator):
    docs = documents(spark)
    plain, extra = operator(docs), operator(clashing(docs))
    assert extra.columns == plain.columns
    assert seen(extra, plain.columns) == seen(plain, plain.columns)


def test_removal_adds_its_columns(spark):
    docs = documents(spark)
    own = ["kept", "spans", "n_bytes", "n_removed", "n_spans"]
    plain, extra = suffix_dedup.remove_repeats(docs), suffix_dedup.remove_repeats(clashing(docs))
    assert set(extra.columns) == set(clashing(docs).columns)
    assert seen(extra, [*docs.columns, *own]) == seen(plain, [*docs.columns, *own])
    assert all(r.row == f"row-{'none' if r.doc_id is None else r.doc_id}" for r in extra.collect())


def test_rows_that_share_an_id_take_their_own_share(spark):
    """Equal rows, and unlike rows of one id, together take what the mix says: no row is taken for another."""
    text = "one two three four five"
    rows = [(1, text, "a")] * 4 + [(1, "six seven eight nine ten", "a")] * 2 + [(2, text, "b")] * 3 + [(None, text, "b")] * 2 + [(i, "x " * 40, "c") for i in range(5, 30)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    plan = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken")).collect()
    mixed = mixing.take_mix(docs).collect()
    for r in plan:
        assert sum(len(m.text.split()) for m in mixed if m.source == r.source) == r.taken
    assert all(m.text == m.text.rstrip() or m.text == "x " * 40 for m in mixed)
