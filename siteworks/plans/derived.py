"""Date, age, numeric, text and interaction features."""

from pyspark.sql import functions as F

from siteworks.functions import columns as fx
from siteworks.functions import geo, text
from siteworks.functions.ratings import all_ratings
from siteworks.operators import groups, spatial
from siteworks.operators.encode import label_encode
from siteworks.operators.joins import map_back, measured
from siteworks.operators.quantiles import exact_median
from siteworks.plans.ratings_sql import RATED_SQL
from siteworks.plans.registry import plan, r6
from siteworks.sources.sites import sites, with_sites
from siteworks.sources.tables import table


@plan("date_parts", "select l_orderkey, l_linenumber, cast(year(l_shipdate) as int) as recording_year, cast(month(l_shipdate) as int) as recording_month, cast(dayofyear(l_shipdate) as int) as recording_day_of_year from lineitem")
def date_parts(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.year("l_shipdate").alias("recording_year"),
        F.month("l_shipdate").alias("recording_month"), F.dayofyear("l_shipdate").alias("recording_day_of_year"))


@plan("days_since", with_sites("select id, cast(date_diff('day', date_recorded, date '2013-12-03') as int) as days_since_recorded from sites"))
def days_since(spark, sf):
    return sites(spark, sf).select("id", fx.days_since(F.col("date_recorded")).alias("days_since_recorded"))


@plan("season_flags", "select o_orderkey, cast(quarter(o_orderdate) as int) as recording_season, cast(month(o_orderdate) between 6 and 9 as int) as is_dry_season from orders")
def season_flags(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.quarter("o_orderdate").alias("recording_season"), fx.is_dry_season(F.col("o_orderdate")).alias("is_dry_season"))


@plan("asset_age", with_sites("select id, 2013 - construction_year as asset_age, cast(construction_year is null as int) as construction_year_missing from sites"))
def asset_age(spark, sf):
    return sites(spark, sf).select(
        "id", fx.age_at_reference(F.col("construction_year")).alias("asset_age"),
        fx.missing_flag(F.col("construction_year")).alias("construction_year_missing"))


@plan("asset_age_guarded", with_sites("select id, cast(case when year(date_recorded) - nullif(construction_year, 0) >= 0 then year(date_recorded) - nullif(construction_year, 0) end as int) as asset_age from sites"))
def asset_age_guarded(spark, sf):
    return sites(spark, sf).select("id", fx.age_when_recorded(F.col("date_recorded"), F.col("construction_year")).alias("asset_age"))


PAIRS_SQL = ", p as (select installer, funder, count(*) as n from sites where installer is not null and funder is not null group by installer, funder), t as (select max(n) as top from p) "
YEARS_SQL = "cast(greatest(0, least(50, year(date_recorded) - construction_year)) as int)"
BINS_SQL = "case when y <= 5 then 'new' when y <= 15 then 'medium' when y <= 30 then 'old' else 'very_old' end"


@plan("age_bins", with_sites(f", a as (select id, {YEARS_SQL} as y from sites) select id, y as years_in_service, {BINS_SQL} as age_category from a"))
def age_bins(spark, sf):
    years = fx.years_in_service(F.col("date_recorded"), F.col("construction_year"))
    return sites(spark, sf).select("id", years.alias("years_in_service")).withColumn("age_category", fx.age_bin(F.col("years_in_service")))


@plan("age_bins_encoded", with_sites(f", a as (select id, {YEARS_SQL} as y from sites), b as (select id, {BINS_SQL} as c from a), "
    "d as (select c, cast(dense_rank() over (order by c) - 1 as int) as age_category_encoded from (select distinct c from b) t) select b.id, d.age_category_encoded from b join d on b.c = d.c"))
def age_bins_encoded(spark, sf):
    years = fx.years_in_service(F.col("date_recorded"), F.col("construction_year"))
    return label_encode(sites(spark, sf).select("id", fx.age_bin(years).alias("age_category")), ["age_category"])


@plan("age_flags", with_sites("select id, cast(2013 - nullif(construction_year, 0) > 40 as int) as is_very_old, cast(2013 - nullif(construction_year, 0) < 0 as int) as is_future_construction from sites"))
def age_flags(spark, sf):
    age = fx.age_at_reference(fx.zero_to_null(F.col("construction_year")))
    return sites(spark, sf).select("id", (age > 40).cast("int").alias("is_very_old"), (age < 0).cast("int").alias("is_future_construction"))


HAVERSINE_SQL = ("2 * 6371.0::double * asin(sqrt(least(1.0::double, power(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + "
                 "cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * power(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))")


@plan("haversine_km", with_sites(", o as (select -6.0::double as latitude, 35.0::double as longitude) select s.id, round("
    + HAVERSINE_SQL.format(a="s", b="o") + ", 6) as km_from_centre from sites s, o"))
def haversine_km(spark, sf):
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(-6.0), F.lit(35.0))
    return sites(spark, sf).select("id", r6(km).alias("km_from_centre"))


@plan("distance_from_origin", with_sites("select id, round(sqrt(longitude * longitude + latitude * latitude), 6) as distance_from_origin from sites"))
def distance_from_origin(spark, sf):
    d = geo.planar_distance(F.col("latitude"), F.col("longitude"), F.lit(0.0), F.lit(0.0))
    return sites(spark, sf).select("id", r6(d).alias("distance_from_origin"))


@plan("pop_density", with_sites("select id, round(cast(nullif(population, 0) as double) / nullif(coalesce(nullif(gps_height, 0), 1) + 1, 0), 6) as pop_density from sites"))
def pop_density(spark, sf):
    height = F.coalesce(fx.zero_to_null(F.col("gps_height")), F.lit(1)) + 1
    return sites(spark, sf).select("id", r6(fx.safe_ratio(fx.zero_to_null(F.col("population")), height)).alias("pop_density"))


@plan("log_population", with_sites("select id, round(ln(1 + cast(coalesce(nullif(population, 0), 1) as double)), 6) as log_population from sites"))
def log_population(spark, sf):
    return sites(spark, sf).select("id", r6(fx.log_population(F.col("population"))).alias("log_population"))


@plan("pair_strings", with_sites("select id, quantity || '_' || water_quality as quantity_quality, extraction_type || '_' || management as extraction_management, funder || '_' || installer as funder_installer from sites"))
def pair_strings(spark, sf):
    def pair(a, b):
        return F.concat(F.col(a), F.lit("_"), F.col(b))

    return sites(spark, sf).select(
        "id", pair("quantity", "water_quality").alias("quantity_quality"),
        pair("extraction_type", "management").alias("extraction_management"), pair("funder", "installer").alias("funder_installer"))


TEXTS = ["scheme_name", "installer", "funder"]


@plan("text_length", with_sites("select id, " + ", ".join(f"cast(length(coalesce({c}, 'nan')) as int) as {c}_length, cast({c} is null as int) as {c}_is_missing" for c in TEXTS) + " from sites"))
def text_length(spark, sf):
    out = ["id"]
    for c in TEXTS:
        out += [text.text_length(F.col(c)).alias(f"{c}_length"), fx.missing_flag(F.col(c)).alias(f"{c}_is_missing")]
    return sites(spark, sf).select(*out)


TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@plan("text_counts", f"select doc_id, cast(case when {TRIMMED} = '' then 0 else len(regexp_split_to_array({TRIMMED}, '\\s+')) end as int) as word_count, cast(length(text) as int) as char_count from documents")
def text_counts(spark, sf):
    """Whole texts; blanks at both ends and runs of blanks do not count."""
    return table(spark, sf, "documents").select(
        "doc_id", text.word_count(F.col("text")).alias("word_count"), text.text_length(F.col("text")).alias("char_count"))


@plan("text_patterns", "select doc_id, cast(regexp_matches(text, '[0-9]') as int) as has_numbers, cast(regexp_matches(text, '[^a-zA-Z0-9\\s]') as int) as has_special from documents")
def text_patterns(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.has_digits(F.col("text")).alias("has_numbers"), text.has_special(F.col("text")).alias("has_special"))


@plan("keyword_flags", with_sites("select id, " + ", ".join(f"cast(contains(lower(coalesce(scheme_name, 'nan')), '{w}') as int) as scheme_has_{w}" for w in text.SCHEME_KEYWORDS) + " from sites"))
def keyword_flags(spark, sf):
    return sites(spark, sf).select("id", *[text.keyword_flag(F.col("scheme_name"), w).alias(f"scheme_has_{w}") for w in text.SCHEME_KEYWORDS])


@plan("org_type_flags", with_sites("select id, " + ", ".join(
    f"cast(regexp_matches(lower(coalesce({c}, 'nan')), '{'|'.join(words)}') as int) as {c}_is_{kind}"
    for c in ["installer", "funder"] for kind, words in text.ORGANISATION_WORDS.items()) + " from sites"))
def org_type_flags(spark, sf):
    return sites(spark, sf).select("id", *[
        text.any_word_flag(F.col(c), words).alias(f"{c}_is_{kind}")
        for c in ["installer", "funder"] for kind, words in text.ORGANISATION_WORDS.items()])


@plan("name_variants", with_sites("select distinct funder as name from sites where lower(funder) like '%gov%' or lower(funder) like '%council%'"))
def name_variants(spark, sf):
    hit = fx.contains_ci(F.col("funder"), "gov") | fx.contains_ci(F.col("funder"), "council")
    return sites(spark, sf).where(hit).select(F.col("funder").alias("name")).distinct()


@plan("display_text", with_sites("select id, substr(coalesce(funder, 'NaN'), 1, 12) as funder, substr(coalesce(scheme_name, 'NaN'), 1, 12) as scheme from sites"))
def display_text(spark, sf):
    return sites(spark, sf).select(
        "id", text.display_text(F.col("funder"), 12).alias("funder"), text.display_text(F.col("scheme_name"), 12).alias("scheme"))


LOCATED_SQL = "select * from sites where latitude <> 0 and longitude <> 0"


def neighbors_sql(k, queries=LOCATED_SQL, reference=LOCATED_SQL, own=True):
    """CTE ``nn(id, rank, nbr_id, dist_km)`` by comparing every pair."""
    rank = f"row_number() over (partition by a.id order by round({HAVERSINE_SQL.format(a='a', b='b')}, 9), b.id)"
    join = "join kr b on a.id <> b.id" if own else "cross join kr b"
    return (f", kq as ({queries}), kr as ({reference}), nn as (select * from (select a.id, cast({rank} as int) as rank, b.id as nbr_id, "
            f"{HAVERSINE_SQL.format(a='a', b='b')} as dist_km from kq a {join}) t where rank <= {k}) ")


def codes_sql(columns):
    """CTEs ``e_<col>(v, code)`` with alphabetical codes, null as 'nan'."""
    return "".join(
        f", e_{c} as (select v, cast(row_number() over (order by v) - 1 as int) as code from (select distinct coalesce(cast({c} as varchar), 'nan') as v from sites) t)"
        for c in columns)


def code_joins(columns):
    return " ".join(f"join e_{c} on e_{c}.v = coalesce(cast(s.{c} as varchar), 'nan')" for c in columns)


CORE = ["quantity", "water_quality"]
WARD_RATE_SQL = ", w as (select ward, avg(case when status_group = 'functional' then 1.0::double else 0.0::double end) as rate from sites group by ward)"


@plan("interactions_core", with_sites(codes_sql(CORE) + WARD_RATE_SQL + neighbors_sql(10)
    + ", nr as (select nn.id, avg(case when n.status_group = 'functional' then 1.0::double else 0.0::double end) as rate from nn join sites n on n.id = nn.nbr_id group by nn.id)"
    + ", a as (select median(2013 - nullif(construction_year, 0)) as age from sites), d as (select median(date_diff('day', date_recorded, date '2013-12-03')) as days from sites) "
    "select s.id, e_quantity.code * e_water_quality.code as quantity_quality_interact, "
    "round(w.rate * coalesce(2013 - nullif(s.construction_year, 0), a.age), 6) as ward_age_interact, "
    "round(coalesce(nr.rate, 0.5) * coalesce(date_diff('day', s.date_recorded, date '2013-12-03'), d.days), 6) as neighbor_time_interact "
    f"from sites s {code_joins(CORE)} join w on s.ward = w.ward left join nr on nr.id = s.id, a, d"))
def interactions_core(spark, sf):
    """Products of leading features; gaps take the exact median, rows without neighbours the rate 0.5."""
    df = sites(spark, sf).select(
        "id", "ward", "status_group", "latitude", "longitude", *CORE,
        fx.age_at_reference(fx.zero_to_null(F.col("construction_year"))).alias("age"),
        fx.days_since(F.col("date_recorded")).alias("days"))
    rates = groups.group_rates(df, "ward", "status_group", {"rate": groups.POSITIVE})
    age = exact_median(df, "age").select("median").scalar()
    days = exact_median(df, "days").select("median").scalar()
    both = groups.join_back(label_encode(df, CORE, keep=["id", "ward", "age", "days"]), rates, ["ward"])
    near = spatial.neighbor_rate(spatial.nearest_neighbors(df, 10), df, "status_group", groups.POSITIVE, "near_rate")
    return map_back(both, near, "id", {"near_rate": F.lit(0.5)}).select(
        "id",
        (F.col("quantity_encoded") * F.col("water_quality_encoded")).alias("quantity_quality_interact"),
        r6(F.col("rate") * F.coalesce(F.col("age").cast("double"), age)).alias("ward_age_interact"),
        r6(F.col("near_rate") * F.coalesce(F.col("days").cast("double"), days)).alias("neighbor_time_interact"))


RISK = ["extraction_type", "management", "installer", "funder", "payment", "quantity"]


@plan("interactions_risk", with_sites(codes_sql(RISK) + f"""select s.id, (2013 - s.construction_year) * e_extraction_type.code as age_extraction_risk,
  round(cast(s.population as double) / (e_management.code + 1), 6) as population_management_stress,
  cast(e_installer.v = e_funder.v as int) as same_installer_funder,
  round(s.gps_height * ln(1 + cast(s.population as double)), 6) as altitude_population_challenge,
  e_payment.code * e_quantity.code as payment_quantity_sustainability,
  cast(month(s.date_recorded) between 6 and 9 as int) as dry_season_install from sites s {code_joins(RISK)}"""))
def interactions_risk(spark, sf):
    """Same name means same code when both columns share the text, so names are compared."""
    df = sites(spark, sf)
    both = label_encode(df, RISK, keep=["id", "construction_year", "population", "gps_height", "installer", "funder", "date_recorded"])
    return both.select(
        "id",
        (fx.age_at_reference(F.col("construction_year")) * F.col("extraction_type_encoded")).alias("age_extraction_risk"),
        r6(F.col("population").cast("double") / (F.col("management_encoded") + 1)).alias("population_management_stress"),
        (text.as_text(F.col("installer")) == text.as_text(F.col("funder"))).cast("int").alias("same_installer_funder"),
        r6(F.col("gps_height") * F.log1p(F.col("population").cast("double"))).alias("altitude_population_challenge"),
        (F.col("payment_encoded") * F.col("quantity_encoded")).alias("payment_quantity_sustainability"),
        fx.is_dry_season(F.col("date_recorded")).alias("dry_season_install"))


INFRA = ["extraction_type", "water_quality", "source"]


@plan("interactions_infra", with_sites(codes_sql(INFRA) + f"""select s.id, (2013 - s.construction_year) * e_extraction_type.code as age_extraction_interaction,
  round(cast(s.population as double) / (e_water_quality.code + 1), 6) as population_quality_ratio,
  s.gps_height * e_source.code as elevation_source_interaction from sites s {code_joins(INFRA)}"""))
def interactions_infra(spark, sf):
    df = sites(spark, sf)
    both = label_encode(df, INFRA, keep=["id", "construction_year", "population", "gps_height"])
    return both.select(
        "id",
        (fx.age_at_reference(F.col("construction_year")) * F.col("extraction_type_encoded")).alias("age_extraction_interaction"),
        r6(F.col("population").cast("double") / (F.col("water_quality_encoded") + 1)).alias("population_quality_ratio"),
        (F.col("gps_height") * F.col("source_encoded")).alias("elevation_source_interaction"))


FAST = ["quantity", "management"]


@plan("interactions_fast", with_sites(codes_sql(FAST) + f"""select s.id, coalesce(2013 - nullif(s.construction_year, 0), 0) * e_quantity.code as age_quantity_interaction,
  round(ln(1 + cast(coalesce(nullif(s.population, 0), 1) as double)) * e_management.code, 6) as pop_mgmt_interaction,
  round(cast(s.population as double) / (e_management.code + 1), 6) as pop_mgmt_stress from sites s {code_joins(FAST)}"""))
def interactions_fast(spark, sf):
    df = sites(spark, sf)
    both = label_encode(df, FAST, keep=["id", "construction_year", "population"])
    age = F.coalesce(fx.age_at_reference(fx.zero_to_null(F.col("construction_year"))), F.lit(0))
    return both.select(
        "id",
        (age * F.col("quantity_encoded")).alias("age_quantity_interaction"),
        r6(fx.log_population(F.col("population")) * F.col("management_encoded")).alias("pop_mgmt_interaction"),
        r6(F.col("population").cast("double") / (F.col("management_encoded") + 1)).alias("pop_mgmt_stress"))


@plan("interactions_rating", with_sites(RATED_SQL + WARD_RATE_SQL + ", a as (select median(2013 - nullif(construction_year, 0)) as age from sites) "
    "select s.id, round(r.installer_quality * coalesce(2013 - nullif(s.construction_year, 0), a.age), 6) as installer_age_interact, "
    "round(r.coordination * w.rate, 6) as coord_ward_interact from sites s join rated r on s.id = r.id join w on s.ward = w.ward, a"))
def interactions_rating(spark, sf):
    df = sites(spark, sf)
    rates = groups.group_rates(df, "ward", "status_group", {"rate": groups.POSITIVE})
    age = fx.age_at_reference(fx.zero_to_null(F.col("construction_year")))
    rows = df.select("id", "ward", age.alias("age"), *all_ratings())
    middle = exact_median(rows, "age").select("median").scalar()
    return groups.join_back(rows, rates, ["ward"]).select(
        "id",
        r6(F.col("installer_quality") * F.coalesce(F.col("age").cast("double"), middle)).alias("installer_age_interact"),
        r6(F.col("coordination") * F.col("rate")).alias("coord_ward_interact"))


@plan("recency_weight", with_sites(", d as (select id, date_diff('day', date_recorded, date '2013-12-03') as days from sites), m as (select min(days) as lo, max(days) as hi from d) "
    "select id, round(exp(1 - cast(days - lo as double) / (hi - lo)) / exp(1), 6) as recency_weight from d, m"))
def recency_weight(spark, sf):
    df = sites(spark, sf).select("id", fx.days_since(F.col("date_recorded")).alias("days"))
    ends = df.agg(F.struct(F.min("days").alias("lo"), F.max("days").alias("hi")).alias("s")).scalar()
    return df.select("id", r6(fx.recency_weight(F.col("days"), ends["lo"], ends["hi"])).alias("recency_weight"))


@plan("class_weight", with_sites(", c as (select status_group, count(*) as n from sites group by status_group), t as (select sum(n) as total, count(*) as k from c) "
    "select status_group, c.n, round(cast(total as double) / (k * n), 6) as class_weight from c, t"))
def class_weight(spark, sf):
    counts = measured(sites(spark, sf).groupBy("status_group").agg(F.count("*").alias("n")))
    total = counts.agg(F.struct(F.sum("n").alias("total"), F.count("*").alias("k")).alias("s")).scalar()
    return counts.select("status_group", "n", r6(total["total"].cast("double") / (total["k"] * F.col("n"))).alias("class_weight"))


@plan("minmax_scale", with_sites(", m as (select min(population) as lo, max(population) as hi from sites) select id, round(cast(population - lo as double) / (hi - lo), 6) as population_scaled from sites, m"))
def minmax_scale(spark, sf):
    df = sites(spark, sf).select("id", "population")
    ends = df.agg(F.struct(F.min("population").alias("lo"), F.max("population").alias("hi")).alias("s")).scalar()
    return df.select("id", r6(fx.minmax(F.col("population"), ends["lo"], ends["hi"])).alias("population_scaled"))
