"""Group statistics, quantiles, counts and composite group features."""

from pyspark.sql import functions as F

from siteworks.functions.ratings import RATINGS, all_ratings
from siteworks.operators import groups, profile
from siteworks.operators.quantiles import exact_medians, exact_quantiles
from siteworks.operators.voting import health_score
from siteworks.plans.derived import PAIRS_SQL
from siteworks.plans.ratings_sql import RATED_SQL
from siteworks.plans.registry import plan, r6, r6_all
from siteworks.sources.sites import sites, with_sites
from siteworks.sources.tables import table

RATE = "avg(case when {c} = '{v}' then 1.0::double else 0.0::double end)"
FUNCTIONAL = RATE.format(c="status_group", v="functional")
REPAIR = RATE.format(c="status_group", v="functional needs repair")


@plan("group_count_nonnull", with_sites("select ward, count(latitude) as site_count, count(*) as n from sites group by ward"))
def group_count_nonnull(spark, sf):
    return sites(spark, sf).groupBy("ward").agg(F.count("latitude").alias("site_count"), F.count("*").alias("n"))


@plan("group_rate", f"select o_custkey, round({RATE.format(c='o_orderstatus', v='F')}, 6) as f_rate from orders group by o_custkey")
def group_rate(spark, sf):
    return r6_all(groups.group_rates(table(spark, sf, "orders"), "o_custkey", "o_orderstatus", {"f_rate": "F"}))


@plan("group_multi_rate", with_sites(f"select region, round({FUNCTIONAL}, 6) as functional_rate, round({REPAIR}, 6) as repair_rate from sites group by region"))
def group_multi_rate(spark, sf):
    return r6_all(groups.group_rates(sites(spark, sf), "region", "status_group", {"functional_rate": groups.POSITIVE, "repair_rate": groups.REPAIR}))


MEASURES = ["amount_tsh", "gps_height", "population"]


def mean_std_sql(columns, prefix):
    return ", ".join(f"round(avg({c}), 6) as {prefix}_{c}_mean, round(stddev_samp({c}), 6) as {prefix}_{c}_std" for c in columns)


@plan("group_mean_std", "select p.p_brand, " + mean_std_sql(["p_size", "p_retailprice"], "brand") + " from part p group by p.p_brand")
def group_mean_std(spark, sf):
    return r6_all(groups.mean_and_std(table(spark, sf, "part"), "p_brand", ["p_size", "p_retailprice"], "brand"))


@plan("region_stats", with_sites(", r as (select region, " + mean_std_sql(MEASURES, "region") + " from sites group by region) select s.id, r.* exclude (region) from sites s join r on s.region = r.region"))
def region_stats(spark, sf):
    """Raw values, zeros included."""
    df = sites(spark, sf)
    stats = r6_all(groups.mean_and_std(df, "region", MEASURES, "region"))
    return groups.join_back(df.select("id", "region"), stats, ["region"]).drop("region")


@plan("group_mean_std_max", "select l_returnflag, l_linestatus, round(avg(l_quantity), 6) as mean_quantity, round(stddev_samp(l_quantity), 6) as std_quantity, max(l_quantity) as max_quantity from lineitem group by l_returnflag, l_linestatus")
def group_mean_std_max(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        r6(F.avg("l_quantity")).alias("mean_quantity"), r6(F.stddev_samp("l_quantity")).alias("std_quantity"),
        F.max("l_quantity").alias("max_quantity"))


@plan("group_first", with_sites("select installer, arg_min(ward, id) as ward from sites where installer is not null group by installer"))
def group_first(spark, sf):
    return groups.first_per_key(sites(spark, sf), "installer", "ward", "id")


@plan("pair_size_norm", with_sites(PAIRS_SQL + "select p.installer, p.funder, p.n as pair_rows, round(cast(p.n as double) / t.top, 6) as share_of_largest from p, t"))
def pair_size_norm(spark, sf):
    return r6_all(groups.pair_shares(sites(spark, sf), "installer", "funder", "share_of_largest"))


@plan("coordination_score", with_sites(PAIRS_SQL + "select s.id, round(coalesce(cast(p.n as double) / t.top, 0), 6) as coordination_score from sites s left join p on s.installer = p.installer and s.funder = p.funder, t"))
def coordination_score(spark, sf):
    df = sites(spark, sf).select("id", "installer", "funder")
    pairs = groups.pair_shares(df, "installer", "funder", "coordination_score").drop("pair_rows")
    out = groups.join_back(df, pairs, ["installer", "funder"])
    return out.select("id", r6(F.coalesce("coordination_score", F.lit(0.0))).alias("coordination_score"))


@plan("median_global", "select round(median(l_extendedprice), 6) as median_price, round(median(l_quantity), 6) as median_quantity from lineitem")
def median_global(spark, sf):
    out = exact_medians(table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"])
    return out.select(r6("l_extendedprice").alias("median_price"), r6("l_quantity").alias("median_quantity"))


@plan("median_group", with_sites("select ward, round(median(latitude), 6) as median_lat from sites where latitude is not null group by ward"))
def median_group(spark, sf):
    return r6_all(exact_quantiles(sites(spark, sf), "latitude", {"median_lat": 0.5}, ["ward"]))


@plan("quantile99", "select l_returnflag, round(quantile_cont(l_extendedprice, 0.99), 6) as q99, round(quantile_cont(l_extendedprice, 0.5), 6) as q50 from lineitem group by l_returnflag")
def quantile99(spark, sf):
    """Three groups share all rows; none of them is sorted in one task."""
    return r6_all(exact_quantiles(table(spark, sf, "lineitem"), "l_extendedprice", {"q99": 0.99, "q50": 0.5}, ["l_returnflag"]))


@plan("value_counts", "select event_type, count(*) as n, round(cast(count(*) as double) / (select count(*) from events), 6) as share from events group by event_type")
def value_counts(spark, sf):
    return r6_all(groups.value_counts(table(spark, sf, "events"), "event_type"))


@plan("nunique", "select l_returnflag, count(distinct l_partkey) as n_l_partkey, count(distinct l_suppkey) as n_l_suppkey from lineitem group by l_returnflag")
def nunique(spark, sf):
    return groups.distinct_counts(table(spark, sf, "lineitem"), ["l_returnflag"], ["l_partkey", "l_suppkey"])


@plan("crosstab", with_sites("select region, " + ", ".join(
    f"cast(count(*) filter (where status_group = '{v}') as bigint) as {n}" for v, n in [("functional", "functional"), ("functional needs repair", "needs_repair"), ("non functional", "non_functional")]) + " from sites group by region"))
def crosstab(spark, sf):
    """Classes are declared, so no extra job has to find them."""
    wide = sites(spark, sf).groupBy("region").pivot("status_group", ["functional", "functional needs repair", "non functional"]).count()
    return wide.fillna(0).withColumnsRenamed({"functional needs repair": "needs_repair", "non functional": "non_functional"})


NUMBERS = ["amount_tsh", "gps_height", "population"]


@plan("numeric_summary", with_sites(" union all ".join(
    f"select '{c}' as column_name, round(cast(min({c}) as double), 6) as min_value, round(cast(max({c}) as double), 6) as max_value, round(avg({c}), 6) as mean_value, round(stddev_samp({c}), 6) as std_value from sites" for c in NUMBERS)))
def numeric_summary(spark, sf):
    return r6_all(groups.numeric_summary(sites(spark, sf), NUMBERS))


@plan("scale_histogram", with_sites(RATED_SQL + "select s.rating, cast(s.score as int) as score, count(v.score) as n, round(100.0::double * count(v.score) / (select count(*) from sites), 6) as percent "
    "from (select rating, score from (select unnest([" + ", ".join(f"'{r}'" for r in RATINGS) + "]) as rating) a, (select unnest([1, 2, 3, 4, 5]) as score) b) s left join ("
    + " union all ".join(f"select '{r}' as rating, {r} as score from rated" for r in RATINGS) + ") v on s.rating = v.rating and s.score = v.score group by s.rating, s.score"))
def scale_histogram(spark, sf):
    """All five values of every scale in one pass, unused ones with zero."""
    rated = sites(spark, sf).select(*all_ratings())
    cells = [
        F.struct(F.lit(r).alias("rating"), F.lit(v).alias("score"), F.sum((F.col(r) == v).cast("bigint")).alias("n"),
                 r6(F.lit(100.0) * F.sum((F.col(r) == v).cast("bigint")) / F.count("*")).alias("percent"))
        for r in RATINGS for v in range(1, 6)
    ]
    return rated.agg(F.array(*cells).alias("h")).select(F.inline("h"))


@plan("rating_label_corr", with_sites(RATED_SQL + ", o as (select r.*, case s.status_group when 'functional' then 2 when 'functional needs repair' then 1 else 0 end as y from rated r join sites s on r.id = s.id) "
    + " union all ".join(f"select '{r}' as rating, round(corr({r}, y), 6) as correlation from o" for r in RATINGS)))
def rating_label_corr(spark, sf):
    rated = sites(spark, sf).select(health_score(F.col("status_group")).alias("y"), *all_ratings())
    cells = [F.struct(F.lit(r).alias("rating"), r6(F.corr(r, "y")).alias("correlation")) for r in RATINGS]
    return rated.agg(F.array(*cells).alias("c")).select(F.inline("c"))


@plan("group_mean_topn", with_sites(RATED_SQL + "select s.ward, round(avg(r.text_language), 6) as mean_language from rated r join sites s on r.id = s.id group by s.ward order by round(avg(r.text_language), 6) desc, s.ward limit 10"))
def group_mean_topn(spark, sf):
    rated = sites(spark, sf).select("ward", *all_ratings())
    means = rated.groupBy("ward").agg(r6(F.avg("text_language")).alias("mean_language"))
    return means.orderBy(F.desc("mean_language"), "ward").limit(10)


GAPS = ["funder", "installer", "scheme_name", "subvillage", "permit", "latitude"]


@plan("completeness_by_column", with_sites(" union all ".join(
    f"select '{c}' as column_name, count({c}) as present, count(*) - count({c}) as missing from sites" for c in GAPS)))
def completeness_by_column(spark, sf):
    return profile.completeness(sites(spark, sf), GAPS)


FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def anova_sql(source, label, features):
    long = " union all ".join(f"select '{f}' as feature, {label} as y, cast({f} as double) as v from {source}" for f in features)
    return f"""x as ({long}), c as (select feature, y, count(*) as n, avg(v) as m, var_pop(v) as s from x where v is not null and y is not null group by feature, y),
  g as (select feature, sum(n * m) / sum(n) as m, sum(n) as n, count(*) as k from c group by feature)
  select c.feature, round((sum(c.n * (c.m - g.m) * (c.m - g.m)) / (max(g.k) - 1)) / (sum(c.n * c.s) / (max(g.n) - max(g.k))), 5) as f_value from c join g on c.feature = g.feature group by c.feature"""


@plan("anova_f", "with " + anova_sql("lineitem", "l_returnflag", FEATURES))
def anova_f(spark, sf):
    out = groups.anova_f(table(spark, sf, "lineitem"), FEATURES, "l_returnflag")
    return out.select("feature", F.round("f_value", 5).alias("f_value"))


CANDIDATES = ["amount_tsh", "gps_height", "population", "construction_year", "district_code", "latitude", "longitude"]


@plan("select_k_best", with_sites(", " + anova_sql("sites", "status_group", CANDIDATES) + " order by f_value desc, feature limit 4"))
def select_k_best(spark, sf):
    scores = groups.anova_f(sites(spark, sf), CANDIDATES, "status_group")
    return scores.select("feature", F.round("f_value", 5).alias("f_value")).orderBy(F.desc("f_value"), "feature").limit(4)


WARDS = ", w as (select ward, count(latitude) as n, " + FUNCTIONAL + " as rate from sites group by ward)"


@plan("ward_stats", with_sites(WARDS + ", j as (select s.id, w.n, w.rate from sites s left join w on s.ward = w.ward), m as (select median(n) as middle from j) "
    "select id, round(coalesce(cast(n as double), middle), 6) as ward_site_count, round(coalesce(rate, 0.5), 6) as ward_functional_ratio from j, m"))
def ward_stats(spark, sf):
    out = groups.add_ward_statistics(sites(spark, sf).select("id", "ward", "latitude", "status_group"))
    return r6_all(out.select("id", "ward_site_count", "ward_functional_ratio"))


@plan("ward_rate_without_self", with_sites("select id, round(cast(sum(cast(status_group = 'functional' as int)) over (partition by ward) - cast(status_group = 'functional' as int) as double) / nullif(count(*) over (partition by ward) - 1, 0), 6) as ward_functional_ratio from sites"))
def ward_rate_without_self(spark, sf):
    """The ward rate without the row's own label."""
    df = sites(spark, sf).select("id", "ward", "status_group")
    out = groups.own_row_excluded_rate(df, "ward", "status_group", groups.POSITIVE, "ward_functional_ratio")
    return r6_all(out.select("id", "ward_functional_ratio"))


@plan("installer_reliability", with_sites(f", r as (select installer, {FUNCTIONAL} as rate from sites where installer is not null group by installer) select s.id, round(r.rate, 6) as installer_reliability from sites s left join r on s.installer = r.installer"))
def installer_reliability(spark, sf):
    df = sites(spark, sf).select("id", "installer", "status_group")
    rates = groups.group_rates(df, "installer", "status_group", {"installer_reliability": groups.POSITIVE})
    return r6_all(groups.join_back(df, rates, ["installer"]).select("id", "installer_reliability"))


@plan("region_rates", with_sites(f", r as (select region, {FUNCTIONAL} as f, {REPAIR} as p from sites group by region) select s.id, round(coalesce(r.f, 0.5), 6) as region_functional_rate, round(coalesce(r.p, 0.5), 6) as region_repair_rate from sites s left join r on s.region = r.region"))
def region_rates(spark, sf):
    df = sites(spark, sf).select("id", "region", "status_group")
    rates = groups.group_rates(df, "region", "status_group", {"region_functional_rate": groups.POSITIVE, "region_repair_rate": groups.REPAIR})
    names = ["region_functional_rate", "region_repair_rate"]
    return groups.join_back(df, rates, ["region"]).select("id", *[r6(F.coalesce(n, F.lit(0.5))).alias(n) for n in names])


@plan("geo_outlier", with_sites(", m as (select ward, median(latitude) as la, median(longitude) as lo from sites group by ward), "
    "d as (select s.id, s.ward, sqrt((s.latitude - la) * (s.latitude - la) + (s.longitude - lo) * (s.longitude - lo)) as d from sites s join m on s.ward = m.ward), "
    "l as (select ward, avg(d) + 2 * stddev_samp(d) as lim from d group by ward) select d.id, cast(coalesce(d.d > l.lim, false) as int) as is_geographic_outlier from d join l on d.ward = l.ward"))
def geo_outlier(spark, sf):
    df = sites(spark, sf).select("id", "ward", "latitude", "longitude")
    return groups.geographic_outliers(df, "ward").select("id", "is_geographic_outlier")


@plan("population_outlier", with_sites(", q as (select quantile_cont(population, 0.99) as lim from sites) select id, cast(population > lim as int) as is_high_population_outlier from sites, q"))
def population_outlier(spark, sf):
    return groups.above_quantile_flag(sites(spark, sf).select("id", "population"), "population", 0.99, "is_high_population_outlier").drop("population")
