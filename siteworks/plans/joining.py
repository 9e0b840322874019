"""Joins, set operations, fallbacks and work lists."""

from pyspark.sql import functions as F

from siteworks.functions import columns as fx
from siteworks.operators import groups, id_sets, joins
from siteworks.plans.derived import PAIRS_SQL
from siteworks.plans.registry import plan, r6, r6_all
from siteworks.sources.sites import sites, with_sites
from siteworks.sources.tables import table


@plan("inner_join_labels", "select d.doc_id, d.lang, d.n_chars, l.quality, l.toxic from documents d join labels l on d.doc_id = l.doc_id")
def inner_join_labels(spark, sf):
    features = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return features.join(table(spark, sf, "labels"), "doc_id")


@plan("natural_join", "select doc_id, quality, toxic, lang, source from labels natural join (select doc_id, lang, source from documents) d")
def natural_join(spark, sf):
    return joins.natural_join(table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang", "source"))


@plan("left_enrich", "select o.o_orderkey, o.o_custkey, c.c_mktsegment, c.c_acctbal from orders o left join customer c on o.o_custkey = c.c_custkey")
def left_enrich(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey", "left")


WARD_STATS = """, w as (select ward, count(latitude) as n, avg(case when status_group = 'functional' then 1.0::double else 0.0::double end) as rate
  from sites where ward is not null group by ward)"""


@plan("group_stats_joinback", with_sites(WARD_STATS + "select s.id, s.ward, w.n as ward_site_count, round(w.rate, 6) as ward_functional_ratio from sites s left join w on s.ward = w.ward"))
def group_stats_joinback(spark, sf):
    df = sites(spark, sf).select("id", "ward", "latitude", "status_group")
    joined = groups.join_back(df, groups.ward_statistics(df), ["ward"])
    return joined.select("id", "ward", "ward_site_count", r6("ward_functional_ratio").alias("ward_functional_ratio"))


@plan("group_stats_reference", with_sites(WARD_STATS.replace("where ward is not null", "where construction_year > 0")
    + """, m as (select median(n) as middle from w) select s.id, round(coalesce(cast(w.n as double), middle), 6) as ward_site_count,
  round(coalesce(w.rate, 0.5), 6) as ward_functional_ratio from sites s left join w on s.ward = w.ward, m where s.construction_year = 0"""))
def group_stats_reference(spark, sf):
    """Assets of unknown age, against the statistics of those with a known year."""
    df = sites(spark, sf)
    rows = df.where("construction_year = 0").select("id", "ward")
    out = groups.add_ward_statistics(rows, df.where("construction_year > 0"))
    return r6_all(out.select("id", "ward_site_count", "ward_functional_ratio"))


RELIABILITY = ", r as (select installer, avg(case when status_group = 'functional' then 1.0::double else 0.0::double end) as rate from sites where installer is not null and construction_year > 0 group by installer)"


@plan("lookup_carryover", with_sites(RELIABILITY + "select s.id, s.installer, round(r.rate, 6) as installer_reliability from sites s left join r on s.installer = r.installer where s.construction_year = 0"))
def lookup_carryover(spark, sf):
    """Rates computed on labelled rows, one value per key, carried over to the others."""
    df = sites(spark, sf)
    known = df.where("construction_year > 0")
    rates = groups.group_rates(known, "installer", "status_group", {"installer_reliability": groups.POSITIVE})
    rows = df.where("construction_year = 0").select("id", "installer")
    return r6_all(groups.join_back(rows, rates, ["installer"]))


@plan("map_lookup_default", with_sites(", m as (select region, avg(case when status_group = 'functional' then 1.0::double else 0.0::double end) as rate from sites where region not in ('AFRICA', 'ASIA') group by region) "
    "select s.id, s.region, round(coalesce(m.rate, 0.5), 6) as region_rate from sites s left join m on s.region = m.region"))
def map_lookup_default(spark, sf):
    df = sites(spark, sf)
    known = df.where(~F.col("region").isin("AFRICA", "ASIA"))
    rates = known.groupBy("region").agg(groups.share_of(F.col("status_group"), groups.POSITIVE).alias("region_rate"))
    return r6_all(joins.lookup(df.select("id", "region"), rates, ["region"], "region_rate", 0.5))


@plan("pair_lookup", with_sites(PAIRS_SQL + "select s.id, round(coalesce(cast(p.n as double) / t.top, 0), 6) as installer_funder_coordination from sites s left join p on s.installer = p.installer and s.funder = p.funder, t"))
def pair_lookup(spark, sf):
    df = sites(spark, sf).select("id", "installer", "funder")
    pairs = groups.pair_shares(df, "installer", "funder", "installer_funder_coordination")
    out = joins.lookup(df, pairs, ["installer", "funder"], "installer_funder_coordination", 0.0)
    return r6_all(out.select("id", "installer_funder_coordination"))


@plan("missing_ids", "select d.doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_ids(spark, sf):
    return joins.not_yet_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@plan("semi_filter", "select d.doc_id, d.source, d.n_chars from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1)")
def semi_filter(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1")
    return joins.only_listed(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), good, "doc_id")


@plan("centroid_distance", with_sites(", c as (select ward, avg(latitude) as lat, avg(longitude) as lon from sites group by ward) "
    "select s.id, round(sqrt((s.latitude - c.lat) * (s.latitude - c.lat) + (s.longitude - c.lon) * (s.longitude - c.lon)), 6) as ward_centroid_distance from sites s left join c on s.ward = c.ward"))
def centroid_distance(spark, sf):
    df = sites(spark, sf).select("id", "ward", "latitude", "longitude")
    return r6_all(groups.centroid_distance(df, "ward").select("id", "ward_centroid_distance"))


@plan("scalar_stats_join", with_sites(", m as (select min(population) as lo, max(population) as hi, median(population) as mid, quantile_cont(population, 0.99) as q99 from sites) "
    "select id, population - lo as above_min, hi - population as below_max, round(population - mid, 6) as from_median, cast(population > q99 as int) as is_top from sites, m"))
def scalar_stats_join(spark, sf):
    from siteworks.operators.quantiles import exact_quantiles

    df = sites(spark, sf).select("id", "population")
    ends = df.agg(F.struct(F.min("population").alias("lo"), F.max("population").alias("hi")).alias("s")).scalar()
    marks = exact_quantiles(df, "population", {"mid": 0.5, "q99": 0.99}).select(F.struct("mid", "q99").alias("s")).scalar()
    return df.select(
        "id",
        (F.col("population") - ends["lo"]).alias("above_min"),
        (ends["hi"] - F.col("population")).alias("below_max"),
        r6(F.col("population") - marks["mid"]).alias("from_median"),
        (F.col("population") > marks["q99"]).cast("int").alias("is_top"),
    )


@plan("subset_mapback", with_sites(", v as (select id, sqrt(latitude * latitude + longitude * longitude) as d from sites where latitude <> 0 and longitude <> 0), "
    "m as (select median(d) as middle from v) select s.id, round(coalesce(v.d, middle), 6) as distance from sites s left join v on s.id = v.id, m"))
def subset_mapback(spark, sf):
    df = sites(spark, sf).select("id", "latitude", "longitude")
    some = df.where(fx.has_coordinates(F.col("latitude"), F.col("longitude"))).select(
        "id", F.sqrt(F.col("latitude") * F.col("latitude") + F.col("longitude") * F.col("longitude")).alias("distance"))
    middle = groups.exact_median(some, "distance").select("median").scalar()
    return r6_all(joins.map_back(df.select("id"), some, "id", {"distance": middle}))


@plan("union_train_test", with_sites("""select id, status_group, dataset from (
  select id, status_group, 'train' as dataset from sites where construction_year > 0
  union all select id, null as status_group, 'test' as dataset from sites where construction_year = 0) t"""))
def union_train_test(spark, sf):
    df = sites(spark, sf)
    train = df.where("construction_year > 0").select("id", "status_group", F.lit("train").alias("dataset"))
    test = df.where("construction_year = 0").select("id", F.lit("test").alias("dataset"))
    return train.unionByName(test, allowMissingColumns=True)


@plan("id_except", "select doc_id from documents except select doc_id from labels")
def id_except(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


@plan("id_union", with_sites("select id from sites where funder is null union select id from sites where scheme_name is null or installer is null"))
def id_union(spark, sf):
    df = sites(spark, sf)
    return df.where("funder is null").select("id").union(df.where("scheme_name is null or installer is null").select("id")).distinct()


@plan("id_intersect", """select (select count(*) from documents) as n_source, (select count(*) from labels) as n_done,
  (select count(*) from (select doc_id from documents intersect select doc_id from labels) t) as n_overlap""")
def id_intersect(spark, sf):
    source, done = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    overlap = source.intersect(done).agg(F.count("*").alias("n")).scalar()
    return source.agg(F.count("*").alias("n_source")).select(
        "n_source", done.agg(F.count("*").alias("n")).scalar().alias("n_done"), overlap.alias("n_overlap"))


@plan("unseen_values", with_sites("select distinct ward from sites where construction_year = 0 and ward not in (select ward from sites where construction_year > 2013)"))
def unseen_values(spark, sf):
    df = sites(spark, sf)
    return df.where("construction_year = 0").select("ward").subtract(df.where("construction_year > 2013").select("ward"))


@plan("distinct_keys_bitmap", "select distinct o_custkey from orders")
def distinct_keys_bitmap(spark, sf):
    """Distinct keys as bitmaps: a small row for 32,768 of them is shuffled."""
    return id_sets.ids_of(id_sets.bitmaps(table(spark, sf, "orders"), "o_custkey"), "o_custkey")


@plan("id_difference_bitmap", "select doc_id from documents except select doc_id from labels")
def id_difference_bitmap(spark, sf):
    done = id_sets.bitmaps(table(spark, sf, "labels"), "doc_id")
    return id_sets.difference(id_sets.bitmaps(table(spark, sf, "documents"), "doc_id"), done, "doc_id")


@plan("id_union_bitmap", with_sites("select id from sites where funder is null union select id from sites where scheme_name is null or installer is null"))
def id_union_bitmap(spark, sf):
    df = sites(spark, sf)
    first, second = (id_sets.bitmaps(df.where(w), "id") for w in ("funder is null", "scheme_name is null or installer is null"))
    return id_sets.ids_of(id_sets.merged(first, second), "id")


@plan("id_overlap_bitmap", """select (select count(distinct doc_id) from documents) as n_left, (select count(distinct doc_id) from labels) as n_right,
  (select count(*) from (select doc_id from documents intersect select doc_id from labels) t) as n_both""")
def id_overlap_bitmap(spark, sf):
    return id_sets.overlap(*(id_sets.bitmaps(table(spark, sf, t), "doc_id") for t in ("documents", "labels")))


@plan("resume_ids_bitmap", "select c_custkey from customer except select o_custkey from orders")
def resume_ids_bitmap(spark, sf):
    """Customers without an order yet, as a work list."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return id_sets.missing_ids(table(spark, sf, "customer"), orders, "c_custkey")
