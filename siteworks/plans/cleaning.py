"""Projections, filters, audits and fills."""

from pyspark.sql import functions as F

from siteworks.functions import columns as fx
from siteworks.operators import profile
from siteworks.operators.impute import impute
from siteworks.operators.ordering import sample_rows
from siteworks.plans.registry import plan, r6, r6_all
from siteworks.sources.sites import sites, with_sites
from siteworks.sources.tables import table

ZERO_COLUMNS = ["longitude", "latitude", "gps_height", "population", "construction_year"]
TEXT_COLUMNS = ["funder", "installer", "ward", "scheme_name", "region", "basin", "quantity",
                "water_quality", "management", "extraction_type", "payment", "source"]


@plan("sentinel_to_null", with_sites("select id, " + ", ".join(f"nullif({c}, 0) as {c}" for c in ZERO_COLUMNS) + " from sites"))
def sentinel_to_null(spark, sf):
    return sites(spark, sf).select("id", *[fx.zero_to_null(F.col(c)).alias(c) for c in ZERO_COLUMNS])


@plan("value_repair", with_sites("""select id, case when latitude = -2e-08 then cast(0 as double) else latitude end as latitude,
  case when amount_tsh = -999.99 then cast(0 as double) else amount_tsh end as amount_tsh from sites"""))
def value_repair(spark, sf):
    return sites(spark, sf).select(
        "id",
        fx.repair_value(F.col("latitude"), fx.BAD_LATITUDE, 0.0).alias("latitude"),
        fx.repair_value(F.col("amount_tsh"), -999.99, 0.0).alias("amount_tsh"),
    )


@plan("missing_flags", with_sites("select id, " + ", ".join(
    f"cast(nullif({c}, 0) is null as int) as {c}_is_missing" for c in ZERO_COLUMNS) + ", " + ", ".join(
    f"cast({c} is null as int) as {c}_is_missing" for c in ["funder", "installer", "scheme_name"]) + " from sites"))
def missing_flags(spark, sf):
    return sites(spark, sf).select(
        "id",
        *[fx.missing_flag(fx.zero_to_null(F.col(c))).alias(f"{c}_is_missing") for c in ZERO_COLUMNS],
        *[fx.missing_flag(F.col(c)).alias(f"{c}_is_missing") for c in ["funder", "installer", "scheme_name"]],
    )


@plan("mask_null_or_zero", with_sites("select id, " + ", ".join(
    f"cast(({c} is null or {c} = 0) as int) as {c}_missing, case when {c} <> 0 then {c} end as {c}" for c in ZERO_COLUMNS[:4]) + " from sites"))
def mask_null_or_zero(spark, sf):
    out = ["id"]
    for c in ZERO_COLUMNS[:4]:
        mask = fx.null_or_zero(F.col(c))
        out += [mask.cast("int").alias(f"{c}_missing"), F.when(~mask, F.col(c)).alias(c)]
    return sites(spark, sf).select(*out)


@plan("drop_columns", with_sites("""select id, latitude, longitude, gps_height, population, construction_year, region, ward,
  funder, installer, quantity, management, status_group from sites"""))
def drop_columns(spark, sf):
    return sites(spark, sf).drop(
        "amount_tsh", "date_recorded", "district_code", "scheme_name", "subvillage", "permit", "water_quality",
        "extraction_type", "payment", "source", "basin", "public_meeting", "not_there",
    )


PROFILED = ["id", "region", "ward", "funder", "quantity", "status_group", "construction_year"]


@plan("variance_profile", with_sites(
    ", n as (select count(*) as total from sites), d as (" + " union all ".join(
        f"select '{c}' as column_name, count(distinct {c}) as n_distinct from sites" for c in PROFILED)
    + ") select column_name, cast(n_distinct as bigint) as n_distinct, cast(n_distinct <= 1 as int) as is_constant, "
    "cast(n_distinct = total as int) as is_unique from d, n"))
def variance_profile(spark, sf):
    df = sites(spark, sf)
    total = df.agg(F.count("*").alias("n")).scalar()
    return profile.distinct_per_column(df, PROFILED).select(
        "column_name",
        "n_distinct",
        (F.col("n_distinct") <= 1).cast("int").alias("is_constant"),
        (F.col("n_distinct") == total).cast("int").alias("is_unique"),
    )


@plan("safe_numeric", with_sites("""select id, try_cast(installer as int) as installer_number,
  try_cast(substr(scheme_name, 6) as double) as scheme_number from sites"""))
def safe_numeric(spark, sf):
    return sites(spark, sf).select(
        "id",
        F.col("installer").try_cast("int").alias("installer_number"),
        F.substr(F.col("scheme_name"), F.lit(6)).try_cast("double").alias("scheme_number"),
    )


@plan("recast_categorical", with_sites("select id, cast(district_code as varchar) as district_code from sites"))
def recast_categorical(spark, sf):
    return sites(spark, sf).select("id", F.col("district_code").cast("string").alias("district_code"))


@plan("narrow_types", with_sites("""select id, try_cast(construction_year as smallint) as construction_year,
  try_cast(population as tinyint) as population, try_cast(month(date_recorded) as tinyint) as month_recorded,
  round(cast(cast(amount_tsh as float) as double), 2) as amount_tsh from sites"""))
def narrow_types(spark, sf):
    return sites(spark, sf).select(
        "id",
        F.col("construction_year").try_cast("smallint").alias("construction_year"),
        F.col("population").try_cast("tinyint").alias("population"),
        F.month("date_recorded").try_cast("tinyint").alias("month_recorded"),
        F.round(F.col("amount_tsh").cast("float").cast("double"), 2).alias("amount_tsh"),
    )


@plan("bool_to_int", with_sites("""select id, coalesce(cast(permit as int), 0) as has_permit,
  coalesce(cast(public_meeting as int), 0) as public_meeting_held from sites"""))
def bool_to_int(spark, sf):
    return sites(spark, sf).select(
        "id",
        fx.bool_to_int(F.col("permit")).alias("has_permit"),
        fx.bool_to_int(F.col("public_meeting")).alias("public_meeting_held"),
    )


@plan("agg_flatten_names", with_sites("""select region, round(avg(population), 6) as region_population_mean,
  max(population) as region_population_max, round(avg(gps_height), 6) as region_gps_height_mean,
  max(gps_height) as region_gps_height_max from sites group by region"""))
def agg_flatten_names(spark, sf):
    aggs = []
    for c in ["population", "gps_height"]:
        aggs += [r6(F.avg(c)).alias(f"region_{c}_mean"), F.max(c).alias(f"region_{c}_max")]
    return sites(spark, sf).groupBy("region").agg(*aggs)


WANTED = ["id", "amount_tsh", "lga", "ward", "waterpoint_type", "quantity", "population", "recorded_by"]


@plan("guarded_select", with_sites("select id, amount_tsh, ward, quantity, population from sites"))
def guarded_select(spark, sf):
    df = sites(spark, sf)
    return df.select(*profile.columns_present(df, WANTED))


@plan("select_by_type", with_sites("select id, latitude, longitude, amount_tsh, gps_height, population, construction_year, district_code from sites"))
def select_by_type(spark, sf):
    df = sites(spark, sf)
    return df.select("id", *profile.columns_of_type(df, "double", "int"))


@plan("low_cardinality_select", with_sites("""select id, funder, installer, scheme_name, region, basin, quantity,
  water_quality, management, extraction_type, payment, source from sites"""))
def low_cardinality_select(spark, sf):
    """Only ``ward`` exceeds the limit of 50."""
    df = sites(spark, sf)
    return df.select("id", *profile.low_cardinality_columns(df, TEXT_COLUMNS, 50))


AUDITED = ["permit", "public_meeting", "status_group", "quantity", "management", "region"]


@plan("hidden_boolean_audit", with_sites(", v as (" + " union ".join(
    f"select '{c}' as column_name, cast({c} as varchar) as value from sites where {c} is not null" for c in AUDITED)
    + """) select column_name, count(*) as n_distinct, string_agg(value, '|' order by value) as distinct_values
  from v group by column_name having count(*) <= 3"""))
def hidden_boolean_audit(spark, sf):
    return profile.few_valued_columns(sites(spark, sf), AUDITED)


@plan("column_profile", with_sites(" union all ".join(
    (("" if i else "") + f"select '{c}' as column_name, round(100.0 * count({c}) / count(*), 6) as percent_present, "
     f"count(distinct {c}) as n_distinct, round(cast(min({c}) as double), 6) as min_value, "
     f"round(cast(max({c}) as double), 6) as max_value, round(avg({c}), 6) as mean_value from sites")
    for i, c in enumerate(["latitude", "longitude", "gps_height", "population", "construction_year"]))))
def column_profile(spark, sf):
    df = sites(spark, sf)
    cols = ["latitude", "longitude", "gps_height", "population", "construction_year"]
    stats = [
        F.struct(
            F.lit(c).alias("column_name"),
            r6(F.lit(100.0) * F.count(c) / F.count("*")).alias("percent_present"),
            r6(F.min(F.col(c).cast("double"))).alias("min_value"),
            r6(F.max(F.col(c).cast("double"))).alias("max_value"),
            r6(F.avg(c)).alias("mean_value"),
        )
        for c in cols
    ]
    ranges = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    return profile.distinct_per_column(df, cols).join(ranges, "column_name")


@plan("valid_coords", with_sites("""select region, count(*) as n, cast(sum(case when latitude <> 0 and longitude <> 0 then 1 else 0 end) as bigint) as n_valid,
  round(avg(case when latitude <> 0 and longitude <> 0 then 100.0 else 0.0 end), 6) as percent_valid from sites group by region"""))
def valid_coords(spark, sf):
    ok = fx.has_coordinates(F.col("latitude"), F.col("longitude"))
    return sites(spark, sf).groupBy("region").agg(
        F.count("*").alias("n"),
        F.sum(ok.cast("bigint")).alias("n_valid"),
        r6(F.avg(F.when(ok, 100.0).otherwise(0.0))).alias("percent_valid"),
    )


@plan("annotated_subset", """select d.lang, count(*) as n, count(l.quality) as n_annotated,
  round(100.0 * count(l.quality) / count(*), 6) as coverage from documents d left join labels l on d.doc_id = l.doc_id group by d.lang""")
def annotated_subset(spark, sf):
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(
        table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.count("quality").alias("n_annotated"),
        r6(F.lit(100.0) * F.count("quality") / F.count("*")).alias("coverage"),
    )


NAMES = ["funder", "installer", "scheme_name", "subvillage", "permit"]


@plan("row_complete", with_sites("select id, cast(" + " and ".join(f"{c} is not null" for c in NAMES) + " as int) as is_complete from sites"))
def row_complete(spark, sf):
    return sites(spark, sf).select("id", fx.all_present(NAMES).cast("int").alias("is_complete"))


@plan("text_filter", with_sites("select id, funder, scheme_name from sites where lower(funder) like '%world%' or lower(scheme_name) like '%water%'"))
def text_filter(spark, sf):
    hit = fx.contains_ci(F.col("funder"), "World") | fx.contains_ci(F.col("scheme_name"), "WATER")
    return sites(spark, sf).where(hit).select("id", "funder", "scheme_name")


@plan("fill_constants", with_sites("""select id, coalesce(latitude, -1.0::double) as latitude, coalesce(longitude, -1.0::double) as longitude,
  coalesce(funder, 'missing') as funder, coalesce(installer, 'unknown') as installer, coalesce(subvillage, 'MISSING') as subvillage from sites"""))
def fill_constants(spark, sf):
    df = sites(spark, sf).select("id", "latitude", "longitude", "funder", "installer", "subvillage")
    return df.fillna({"latitude": -1.0, "longitude": -1.0, "funder": "missing", "installer": "unknown", "subvillage": "MISSING"})


FITTED = ["latitude", "longitude", "population"]


@plan("impute_median", with_sites(", m as (select " + ", ".join(f"median(nullif({c}, 0)) as m_{c}" for c in FITTED)
    + " from sites where status_group <> 'functional needs repair') select id, "
    + ", ".join(f"round(coalesce(cast(nullif({c}, 0) as double), m_{c}), 6) as {c}" for c in FITTED) + " from sites, m"))
def impute_median(spark, sf):
    """Fitted on the rows of two classes, applied to all rows."""
    return imputed(spark, sf, "median")


@plan("impute_mean", with_sites(", m as (select " + ", ".join(f"avg(nullif({c}, 0)) as m_{c}" for c in FITTED)
    + " from sites where status_group <> 'functional needs repair') select id, "
    + ", ".join(f"round(coalesce(cast(nullif({c}, 0) as double), m_{c}), 6) as {c}" for c in FITTED) + " from sites, m"))
def impute_mean(spark, sf):
    return imputed(spark, sf, "mean")


def imputed(spark, sf, how):
    df = sites(spark, sf).select("id", "status_group", *[fx.zero_to_null(F.col(c)).alias(c) for c in FITTED])
    fit = df.where("status_group <> 'functional needs repair'")
    return r6_all(impute(df.select("id", *FITTED), FITTED, how, fit))


@plan("safe_ratio", with_sites("""select id, round(cast(population as double) / nullif(gps_height, 0), 6) as people_per_metre,
  round(amount_tsh / nullif(population, 0), 6) as amount_per_person from sites"""))
def safe_ratio(spark, sf):
    return sites(spark, sf).select(
        "id",
        r6(fx.safe_ratio(F.col("population"), F.col("gps_height"))).alias("people_per_metre"),
        r6(fx.safe_ratio(F.col("amount_tsh"), F.col("population"))).alias("amount_per_person"),
    )


@plan("tag_and_split", with_sites("""select dataset, count(*) as n, count(status_group) as n_labelled from (
  select 'train' as dataset, status_group from sites where construction_year > 0
  union all select 'test' as dataset, null as status_group from sites where construction_year = 0) t group by dataset"""))
def tag_and_split(spark, sf):
    df = sites(spark, sf)
    train = df.where("construction_year > 0").withColumn("dataset", F.lit("train"))
    test = df.where("construction_year = 0").drop("status_group").withColumn("dataset", F.lit("test"))
    both = train.unionByName(test, allowMissingColumns=True)
    parts = both.where("dataset = 'train'").unionByName(both.where("dataset = 'test'"))
    return parts.groupBy("dataset").agg(F.count("*").alias("n"), F.count("status_group").alias("n_labelled"))


@plan("distinct_pairs", with_sites("select distinct funder, installer from sites"))
def distinct_pairs(spark, sf):
    return sites(spark, sf).select("funder", "installer").dropDuplicates()


@plan("sample_n", with_sites("select id, ward, status_group from sites order by md5(concat(cast(id as varchar), '-42')), id limit 100"))
def sample_n(spark, sf):
    return sample_rows(sites(spark, sf), "id", 100, 42).select("id", "ward", "status_group")


@plan("drop_null_rows", with_sites("select id, funder, scheme_name from sites where funder is not null and scheme_name is not null"))
def drop_null_rows(spark, sf):
    return sites(spark, sf).na.drop(subset=["funder", "scheme_name"]).select("id", "funder", "scheme_name")
