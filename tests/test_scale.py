"""Plan shapes that must hold whatever the size of the data."""

import re

import pytest
from pyspark.sql import functions as F

import siteworks.session as session_module
from siteworks.operators import encode, groups, joins, quantiles, spatial, splits
from siteworks.plans import PLANS
from siteworks.sources.rating_store import latest_per_id
from siteworks.sources.tables import table

SF = "/root/testdata/sf0.001"
CHECKED = ["ward_stats", "geo_outlier", "knn_self", "knn_reference", "neighbor_same_share", "grid_density", "label_encode",
           "stratified_split", "learning_curve_split", "interactions_core", "proba_weighted", "classification_report", "impute_median",
           "scalar_stats_join", "response_normalize", "completeness_audit", "upsert_latest", "pairwise_in_group", "cv_summary"]


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_cross_join_no_row_python_no_unbounded_window(spark, monkeypatch, name):
    """Looks at the plan of the result and of every part that is stored on the way."""
    seen = []
    keep = session_module.materialize

    def watched(df):
        seen.append(physical(df))
        return keep(df)

    import sys

    for module in [m for n, m in list(sys.modules.items()) if n.startswith("siteworks")]:
        if getattr(module, "materialize", None) is keep:
            monkeypatch.setattr(module, "materialize", watched)
    seen.append(physical(PLANS[name](spark, SF)))
    for text in seen:
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "EvalPython" not in text
        for block in re.findall(r"Window \[[^\n]*\n[^\n]*Sort[^\n]*\n[^\n]*Exchange SinglePartition", text):
            assert re.search(r"windowspecdefinition\((slice|band|group_size)#", block), block


def test_scan_reads_only_the_needed_columns_and_pushes_the_filter(spark):
    text = physical(table(spark, SF, "lineitem").where("l_quantity > 10").groupBy("l_returnflag").agg(F.sum("l_tax")))
    assert "GreaterThan(l_quantity,10.0)" in text
    assert "ReadSchema: struct<l_quantity:double,l_tax:double,l_returnflag:string>" in text


def test_rows_at_one_spot_are_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0)], "id bigint, latitude double, longitude double")
    assert "WindowGroupLimit" in physical(spatial._spots(df, 11)) and "Partial" in physical(spatial._spots(df, 11))


def test_latest_row_combines_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id bigint, v int, b int")
    assert "partial_max" in physical(latest_per_id(df, "id", ["b"]))


def test_sides_above_the_bound_are_not_broadcast(spark):
    small = spark.range(50)
    assert "broadcast" in joins.hinted(small, 50, 50)._jdf.queryExecution().analyzed().toString()
    assert joins.hinted(small, 50, 49) is small


def test_few_rows_of_long_text_are_not_broadcast(spark, monkeypatch):
    side = spark.range(10).select("id", F.repeat(F.lit("x"), 1000).alias("text"))
    hint = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString()
    assert hint(joins.measured(side))
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 5000)
    assert not hint(joins.measured(side))


def test_ward_statistics_scan_their_table_twice_at_most(spark, monkeypatch):
    """Once for the statistics, stored with what the median needs, and once for the rows."""
    scans = []
    keep = session_module.materialize

    def watched(df):
        scans.append(physical(df).count("FileScan"))
        return keep(df)

    for module in (groups, joins, session_module):
        if hasattr(module, "materialize"):
            monkeypatch.setattr(module, "materialize", watched)
    rows = table(spark, SF, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("ward"), F.lit(1.0).alias("latitude"), F.lit("functional").alias("status_group"))
    last = groups.add_ward_statistics(rows)
    assert sum(scans) + physical(last).count("FileScan") <= 2


@pytest.mark.parametrize("bound", [0, 10**6])
def test_results_do_not_depend_on_broadcasting(spark, monkeypatch, bound):
    """The same numbers with every measured side shuffled instead of broadcast."""
    monkeypatch.setattr(joins, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(spatial, "LIST_BROADCAST_ROWS", bound)
    n = 300
    df = spark.range(n).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("w"), (F.col("id") % 7).cast("string"))).alias("ward"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") % 17 / 10.0 + 1).alias("latitude"),
        F.when(F.col("id") % 3 == 0, 6.0).otherwise(F.col("id") % 23 / 10.0 + 1).alias("longitude"),
        F.when(F.col("id") % 2 == 0, "functional").otherwise("non functional").alias("status_group"),
    )
    near = spatial.nearest_neighbors(df, 3)
    assert near.count() == 3 * n
    # At the hot spot the neighbours are the smallest other ids, at distance zero.
    assert [(r.nbr_id, r.dist_km) for r in near.where("id = 3").orderBy("rank").collect()] == [(0, 0.0), (6, 0.0), (9, 0.0)]
    wards = groups.add_ward_statistics(df)
    assert wards.where("ward = 'hot'").select("ward_site_count").first()[0] == 100.0
    assert quantiles.exact_median(df, "latitude", ["ward"]).where("ward = 'hot'").first().median == 5.0
    assert encode.label_encode(df, ["ward"]).where("id = 0").first().ward_encoded == 0
    assert splits.stratified_split(df, "id", "status_group", 0.2, 1).where("split = 'validation'").count() == 60
