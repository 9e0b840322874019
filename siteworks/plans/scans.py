"""Scans, keyed tables and exports. File results go below the shared scratch folder."""

from pyspark.sql import functions as F

from siteworks.operators import groups, voting
from siteworks.operators.enrich import reprocess_ids
from siteworks.operators.joins import only_listed
from siteworks.plans.aggregates import CANDIDATES, anova_sql
from siteworks.plans.enrichment import DONE_SQL, STORED_SQL, rating_versions, stored_ratings
from siteworks.plans.evaluation import GRID_SQL, VOTERS, VOTERS_SQL, grid_scores, tally_sql, voters
from siteworks.plans.registry import iso, plan, r6_all
from siteworks.session import scratch_path
from siteworks.sources import rating_store as rs
from siteworks.sources.sites import sites, with_sites
from siteworks.sources.tables import SITE_SCHEMA, first_existing, merge_by_priority, read_csv_typed, table, write_csv


@plan("scan_typed", with_sites("select id, latitude, longitude, gps_height, population, construction_year, strftime(date_recorded, '%Y-%m-%d') as date_recorded, funder, scheme_name, permit from sites"))
def scan_typed(spark, sf):
    """CSV with a header, read back with a declared schema."""
    path = scratch_path(spark, "csv")
    write_csv(sites(spark, sf).select(*SITE_SCHEMA.names), path)
    return read_csv_typed(spark, path, SITE_SCHEMA).withColumn("date_recorded", iso("date_recorded"))


@plan("rating_scan", with_sites(STORED_SQL + "select id, rating_funder_org_type, rating_coordination from st order by id"))
def rating_scan(spark, sf):
    store = rs.RatingStore(spark, scratch_path(spark, "ratings"))
    store.write_batch(rating_versions(spark, sf), 1)
    return store.read().select("id", "rating_funder_org_type", "rating_coordination").orderBy("id")


@plan("distinct_keys", "select distinct o_custkey from orders")
def distinct_keys(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").distinct()


@plan("progress_state", with_sites(STORED_SQL + "select count(*) as rows, max(batch_completed) as last_batch from st"))
def progress_state(spark, sf):
    return rs.progress_state(stored_ratings(spark, sf))


@plan("source_priority_merge", with_sites(STORED_SQL + """, u as (select id, rating_location_type as rating, 0 as p from st where batch_completed > 10 union all select id, rating_scheme_pattern, 1 from st union all select id, 5.0::double, 2 from sites)
  select id, arg_min(rating, p) as rating, cast(min(p) as int) as priority from u group by id"""))
def source_priority_merge(spark, sf):
    """Re-rated rows first, then any stored rating, then the default for every asset."""
    stored = stored_ratings(spark, sf)
    complete = stored.where("batch_completed > 10").select("id", F.col("rating_location_type").alias("rating"))
    progress = stored.select("id", F.col("rating_scheme_pattern").alias("rating"))
    default = sites(spark, sf).select("id", F.lit(5.0).alias("rating"))
    return merge_by_priority([complete, progress, default], "id")


@plan("upsert_latest", with_sites(STORED_SQL + "select * from st where id <> 0"))
def upsert_latest(spark, sf):
    """Two writers with numbers of their own, a replay, a compaction, and a low number after it; one row per id."""
    versions = rating_versions(spark, sf)
    store = rs.RatingStore(spark, scratch_path(spark, "ratings"))
    first, second = versions.where("batch_completed <= 10"), versions.where("batch_completed > 10")
    store.write_batch(first.where("id % 2 = 0"), 1)
    store.write_batch(first.where("id % 2 = 1"), 1, "other")
    store.write_batch(first.where("id % 2 = 0"), 1)
    store.compact()
    store.write_batch(second, 0, "late")
    store.write_batch(first.where("id % 2 = 1"), 1, "other")
    return store.read()


@plan("rating_schema_empty", with_sites("select c.*, 0 as rows_when_empty, (select count(*) from sites where construction_year > 0) as rows_when_filled from ("
    + " union all ".join(f"select '{f.name}' as column_name, '{f.dataType.simpleString()}' as type" for f in rs.RATING_SCHEMA) + ") c"))
def rating_schema_empty(spark, sf):
    """A new store reads as an empty, typed table; filled, it has the same columns and one row per rated id."""
    store = rs.RatingStore(spark, scratch_path(spark, "ratings"))
    empty = store.read()
    n_empty = empty.count()
    store.write_batch(rating_versions(spark, sf), 1)
    filled = store.read()
    both = [f for f in filled.schema if f.name in empty.columns and empty.schema[f.name].dataType == f.dataType]
    names = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in both], "column_name string, type string")
    return names.withColumn("rows_when_empty", F.lit(n_empty)).withColumn("rows_when_filled", F.lit(filled.count()))


def majority(spark, sf):
    return voters(spark, sf).select("id", voting.majority_vote([F.col(v) for v in VOTERS]).alias("status_group"))


MAJORITY_SQL = VOTERS_SQL + f", mj as (select id, {tally_sql([1, 1, 1])} as status_group from vo) "


@plan("prediction_export", with_sites(MAJORITY_SQL + "select id, status_group from mj"))
def prediction_export(spark, sf):
    path = scratch_path(spark, "submission")
    write_csv(majority(spark, sf), path)
    return read_csv_typed(spark, path, "id bigint, status_group string")


@plan("template_fill", with_sites(MAJORITY_SQL + "select c.c_custkey as id, mj.status_group from customer c left join mj on c.c_custkey = mj.id"))
def template_fill(spark, sf):
    """The template's ids in any order; predictions come by key, never by position."""
    template = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    return template.join(majority(spark, sf), "id", "left")


@plan("snapshot_export", with_sites(STORED_SQL + "select batch_completed, count(*) as n from st group by batch_completed"))
def snapshot_export(spark, sf):
    """One folder per batch, so a snapshot adds files and never rewrites earlier ones."""
    path = scratch_path(spark, "snapshot")
    stored_ratings(spark, sf).repartition("batch_completed").write.partitionBy("batch_completed").parquet(path)
    return spark.read.parquet(path).groupBy("batch_completed").agg(F.count("*").alias("n"))


@plan("worklist_export", with_sites(STORED_SQL + f"select id, funder, installer from sites where id not in (select id from st where {DONE_SQL})"))
def worklist_export(spark, sf):
    df = sites(spark, sf)
    todo = reprocess_ids(df, stored_ratings(spark, sf), rs.RATING_COLUMNS)
    path = scratch_path(spark, "worklist")
    only_listed(df, todo).select("id", "funder", "installer").write.parquet(path)
    return spark.read.parquet(path)


@plan("report_export", with_sites(GRID_SQL + "select age_limit, variant, round(val_score, 6) as val_score from gs"))
def report_export(spark, sf):
    path = scratch_path(spark, "report")
    r6_all(grid_scores(spark, sf)).orderBy(F.desc("val_score"), "age_limit", "variant").write.json(path)
    return spark.read.schema("age_limit int, variant int, val_score double").json(path)


@plan("file_inventory")
def file_inventory(spark, sf):
    """Names and sizes of the input files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(sf).select("path", "length")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.round(F.col("length") / 1048576.0, 3).alias("megabytes"))


@plan("importance_export", with_sites(", " + anova_sql("sites", "status_group", CANDIDATES).replace("as f_value", "as importance")))
def importance_export(spark, sf):
    path = scratch_path(spark, "importance")
    scores = groups.anova_f(sites(spark, sf), CANDIDATES, "status_group")
    scores.select("feature", F.round("f_value", 5).alias("importance")).orderBy(F.desc("importance"), "feature").write.parquet(path)
    return spark.read.parquet(path).orderBy(F.desc("importance"), "feature")
