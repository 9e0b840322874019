"""Nearest-neighbour and cluster features."""

from pyspark.sql import functions as F

from siteworks.operators import spatial as sp
from siteworks.operators.joins import map_back
from siteworks.operators.quantiles import exact_medians
from siteworks.plans.derived import HAVERSINE_SQL, LOCATED_SQL, neighbors_sql
from siteworks.plans.registry import plan, r6, r6_all
from siteworks.sources.sites import sites, with_sites

KNOWN_SQL = "select * from sites where latitude <> 0 and longitude <> 0 and construction_year > 0"
UNKNOWN_SQL = "select * from sites where latitude <> 0 and longitude <> 0 and construction_year = 0"


def two_tables(spark, sf):
    """Assets of unknown building year are asked; the others are the reference."""
    df = sites(spark, sf)
    return df.where("construction_year = 0"), df.where("construction_year > 0")


@plan("knn_self", with_sites(neighbors_sql(10) + "select id, rank, nbr_id, round(dist_km, 6) as dist_km from nn"))
def knn_self(spark, sf):
    return r6_all(sp.nearest_neighbors(sites(spark, sf), 10))


@plan("knn_reference", with_sites(neighbors_sql(10, UNKNOWN_SQL, KNOWN_SQL, own=False) + "select id, rank, nbr_id, round(dist_km, 6) as dist_km from nn"))
def knn_reference(spark, sf):
    asked, known = two_tables(spark, sf)
    return r6_all(sp.nearest_neighbors(asked, 10, known))


@plan("neighbor_gather", with_sites(neighbors_sql(10) + "select nn.id, nn.rank, nn.nbr_id, s.status_group as nbr_status_group, s.gps_height as nbr_gps_height from nn join sites s on s.id = nn.nbr_id"))
def neighbor_gather(spark, sf):
    df = sites(spark, sf)
    return sp.gather(sp.nearest_neighbors(df, 10), df, ["status_group", "gps_height"]).drop("dist_km")


RATIO_SQL = "avg(case when s.status_group = 'functional' then 1.0::double else 0.0::double end)"


@plan("neighbor_rate_self", with_sites(neighbors_sql(10) + f", r as (select nn.id, {RATIO_SQL} as rate from nn join sites s on s.id = nn.nbr_id group by nn.id) "
    "select s.id, round(coalesce(r.rate, 0.5), 6) as neighbor_functional_ratio from sites s left join r on s.id = r.id"))
def neighbor_rate_self(spark, sf):
    df = sites(spark, sf)
    rate = sp.neighbor_rate(sp.nearest_neighbors(df, 10), df, "status_group", "functional", "neighbor_functional_ratio")
    return r6_all(map_back(df.select("id"), rate, "id", {"neighbor_functional_ratio": F.lit(0.5)}))


@plan("neighbor_rate_reference", with_sites(neighbors_sql(10, UNKNOWN_SQL, KNOWN_SQL, own=False) + f", r as (select nn.id, {RATIO_SQL} as rate from nn join sites s on s.id = nn.nbr_id group by nn.id) "
    "select s.id, round(coalesce(r.rate, 0.5), 6) as neighbor_functional_ratio from sites s left join r on s.id = r.id where s.construction_year = 0"))
def neighbor_rate_reference(spark, sf):
    asked, known = two_tables(spark, sf)
    rate = sp.neighbor_rate(sp.nearest_neighbors(asked, 10, known), known, "status_group", "functional", "neighbor_functional_ratio")
    return r6_all(map_back(asked.select("id"), rate, "id", {"neighbor_functional_ratio": F.lit(0.5)}))


@plan("neighbor_distances", with_sites(neighbors_sql(10) + "select id, round(min(dist_km), 6) as nearest_distance, round(avg(dist_km) filter (where rank <= 5), 6) as mean_distance_5, "
    "round(avg(dist_km), 6) as mean_distance, round(1.0::double / (avg(dist_km) + 0.1::double), 6) as neighbor_density from nn group by id"))
def neighbor_distances(spark, sf):
    return r6_all(sp.neighbor_distances(sp.nearest_neighbors(sites(spark, sf), 10)))


@plan("neighbor_same_share", with_sites(neighbors_sql(10) + "select nn.id, " + ", ".join(
    f"round(avg(case when coalesce(b.{c}, 'unknown') = coalesce(a.{c}, 'unknown') then 1.0::double else 0.0::double end), 6) as {c}_neighbor_share" for c in ["installer", "funder"])
    + " from nn join sites a on a.id = nn.id join sites b on b.id = nn.nbr_id group by nn.id"))
def neighbor_same_share(spark, sf):
    df = sites(spark, sf)
    return r6_all(sp.neighbor_same_share(sp.nearest_neighbors(df, 10), df, ["installer", "funder"]))


@plan("neighbor_elevation", with_sites(neighbors_sql(10) + "select nn.id, round(avg(abs(b.gps_height - a.gps_height)), 6) as neighbor_elevation_diff, round(stddev_pop(b.gps_height), 6) as neighbor_elevation_std "
    "from nn join sites a on a.id = nn.id join sites b on b.id = nn.nbr_id group by nn.id"))
def neighbor_elevation(spark, sf):
    df = sites(spark, sf)
    return r6_all(sp.neighbor_elevation(sp.nearest_neighbors(df, 10), df))


@plan("neighbor_features", with_sites(neighbors_sql(10) + "select nn.id, round(avg(case when b.status_group = 'functional' then 1.0::double else 0.0::double end), 6) as neighbor_functional_ratio, "
    "round(min(dist_km), 6) as nearest_distance, round(avg(dist_km) filter (where rank <= 5), 6) as mean_distance_5, round(avg(dist_km), 6) as mean_distance, round(1.0::double / (avg(dist_km) + 0.1::double), 6) as neighbor_density, "
    + ", ".join(f"round(avg(case when coalesce(b.{c}, 'unknown') = coalesce(a.{c}, 'unknown') then 1.0::double else 0.0::double end), 6) as {c}_neighbor_share" for c in ["installer", "funder"])
    + ", round(avg(abs(b.gps_height - a.gps_height)), 6) as neighbor_elevation_diff, round(stddev_pop(b.gps_height), 6) as neighbor_elevation_std from nn join sites a on a.id = nn.id join sites b on b.id = nn.nbr_id group by nn.id"))
def neighbor_features(spark, sf):
    """All neighbour features from one search."""
    df = sites(spark, sf)
    return r6_all(sp.neighbor_features(sp.nearest_neighbors(df, 10), df))


LIGHT = ["nearest_distance", "mean_distance", "neighbor_density"]


@plan("neighbor_light", with_sites(neighbors_sql(5) + ", f as (select id, min(dist_km) as nearest_distance, avg(dist_km) as mean_distance, 1.0::double / (avg(dist_km) + 0.1::double) as neighbor_density from nn group by id), "
    "m as (select " + ", ".join(f"median({c}) as m_{c}" for c in LIGHT) + " from f) select s.id, " + ", ".join(f"round(coalesce(f.{c}, m_{c}), 6) as {c}" for c in LIGHT) + " from sites s left join f on s.id = f.id, m"))
def neighbor_light(spark, sf):
    df = sites(spark, sf)
    near = sp.materialize(sp.neighbor_distances(sp.nearest_neighbors(df, 5)).drop("mean_distance_5"))
    middles = exact_medians(near, LIGHT).select(F.struct(*LIGHT).alias("m")).scalar()
    return r6_all(map_back(df.select("id"), near, "id", {c: middles[c] for c in LIGHT}))


@plan("knn_small_n", with_sites(", r as (select id, status_group, latitude, longitude from sites where latitude <> 0 and longitude <> 0 and gps_height = 0 and population = 0 and quantity = 'dry' and permit is null and construction_year > 2014)"
    ", c as (select count(*) as n from r) select s.id, cast(c.n as bigint) as n_reference, cast(least(10, c.n) as bigint) as n_neighbors from sites s, c where s.latitude <> 0 and s.longitude <> 0"))
def knn_small_n(spark, sf):
    """A thin reference set: every row gets as many neighbours as there are, not ten."""
    df = sites(spark, sf)
    thin = df.where("latitude <> 0 and longitude <> 0 and gps_height = 0 and population = 0 and quantity = 'dry' and permit is null and construction_year > 2014")
    found = sp.nearest_neighbors(df, 10, thin).groupBy("id").agg(F.count("*").alias("n_neighbors"))
    n = thin.agg(F.count("*").alias("n")).scalar()
    rows = sp.located(df).select("id", n.alias("n_reference"))
    return map_back(rows, found, "id", {"n_neighbors": F.lit(0).cast("bigint")})


GRID_SQL = (", v as (" + LOCATED_SQL + "), c as (select min(latitude) as la, min(longitude) as lo from v), "
            "g as (select id, cast(floor((latitude - la) / 0.05::double) as bigint) as cy, cast(floor((longitude - lo) / 0.05::double) as bigint) as cx from v, c) ")


@plan("grid_cluster", with_sites(GRID_SQL + "select id, dense_rank() over (order by cy, cx) - 1 as geographic_cluster from g"))
def grid_cluster(spark, sf):
    return sp.grid_clusters(sites(spark, sf), 0.05).select("id", "geographic_cluster")


@plan("grid_density", with_sites(GRID_SQL + "select id, count(*) over (partition by cy, cx) as cluster_size, round(1e6::double * count(*) over (partition by cy, cx) / (power(0.05::double, 2) * 12321000000.0::double), 6) as density_per_mm from g"))
def grid_density(spark, sf):
    out = sp.grid_clusters(sites(spark, sf), 0.05)
    return out.select("id", "cluster_size", r6(F.lit(1e6) * F.col("cluster_density")).alias("density_per_mm"))


@plan("dense_ids", with_sites("select ward, cast(dense_rank() over (order by ward) - 1 as bigint) as ward_id from (select distinct ward from sites) t"))
def dense_ids(spark, sf):
    from siteworks.operators.ordering import ordered_positions

    wards = ordered_positions(sites(spark, sf).select("ward").distinct(), ["ward"])
    return wards.select("ward", (F.col("position") - 1).alias("ward_id"))


@plan("cluster_size", with_sites(GRID_SQL + "select id, count(*) over (partition by cy, cx) as cluster_size from g"))
def cluster_size(spark, sf):
    return sp.grid_clusters(sites(spark, sf), 0.05).select("id", "cluster_size")


@plan("kmeans_cluster", with_sites(f", n as (select count(*) as n from ({LOCATED_SQL}) t) select n as n_rows, true as within_k, n as n_nearest from n"))
def kmeans_cluster(spark, sf):
    """Clusters of all located rows: no more than k of them, and every row in the one whose centre is nearest."""
    from siteworks.operators.models import spatial_kmeans

    rows = spatial_kmeans(sites(spark, sf))
    k = F.greatest(F.lit(2), F.least(F.lit(50), F.floor(F.count("*") / 10)))
    return rows.agg(F.count("*").alias("n_rows"), (F.count_distinct("geographic_cluster") <= k).alias("within_k"), F.count_if(F.col("is_nearest")).alias("n_nearest"))


DIRECTIONS = 32
#: The same sums of shadows, ranked by a window for each ward and direction.
PAIRS_SQL = (f", pp as ({LOCATED_SQL}), pc as (select ward, avg(latitude) as cy, avg(longitude) as cx, count(*) as n from pp where ward is not null group by ward), "
    f"sh as (select pp.id, pp.ward, pc.n, d.i, (pp.longitude - cx) * cos(pi() * d.i / {DIRECTIONS}) + (pp.latitude - cy) * sin(pi() * d.i / {DIRECTIONS}) as shadow from pp join pc on pp.ward = pc.ward, range({DIRECTIONS}) d(i)), "
    "rk as (select *, row_number() over (partition by ward, i order by shadow, id) as rn from sh), "
    f"md as (select ward, n, coalesce(pi() / 2 * sum((2 * rn - n - 1) * shadow) / {DIRECTIONS} / nullif(n * (n - 1) / 2.0::double, 0), 0) as d from rk group by ward, n) ")


@plan("pairwise_in_group", with_sites(PAIRS_SQL + "select ward, n as n_points, round(d, 6) as mean_pair_distance from md"))
def pairwise_in_group(spark, sf):
    """Mean pairwise distance per ward without forming pairs; within 0.1% (see the operator)."""
    return r6_all(sp.mean_pair_distance(sp.located(sites(spark, sf)), "ward", DIRECTIONS))


@plan("cluster_density", with_sites(PAIRS_SQL + "select pp.id, n as cluster_size, round(case when n > 1 then 1 / (d + 0.1::double) else 0 end, 6) as cluster_density from pp join md on pp.ward = md.ward"))
def cluster_density(spark, sf):
    return r6_all(sp.cluster_density(sp.located(sites(spark, sf)), "ward").select("id", "cluster_size", "cluster_density"))


@plan("cluster_density_geographic", with_sites(f", n as (select count(*) as n from ({LOCATED_SQL}) t) select n as n_rows, n as sum_of_sizes, n as n_equal from n"))
def cluster_density_geographic(spark, sf):
    """Size and density per k-means cluster of the coordinates; SQL on the stored labels ranks the shadows of every row and agrees on all rows."""
    from siteworks.operators.models import spatial_kmeans

    rows = sp.materialize(spatial_kmeans(sites(spark, sf)).select("id", "latitude", "longitude", "geographic_cluster"))
    density = sp.cluster_density(rows, "geographic_cluster")
    same = spark.sql(
        f"""
        with pc as (select geographic_cluster as g, avg(latitude) as cy, avg(longitude) as cx, count(*) as n from {{rows}} group by 1),
        sh as (select id, g, n, i, (longitude - cx) * cos(pi() * i / {DIRECTIONS}) + (latitude - cy) * sin(pi() * i / {DIRECTIONS}) as shadow
               from {{rows}} join pc on geographic_cluster = g lateral view explode(sequence(0, {DIRECTIONS - 1})) d as i),
        rk as (select *, row_number() over (partition by g, i order by shadow, id) as rn from sh),
        md as (select g, n, coalesce(pi() / 2 * sum((2 * rn - n - 1) * shadow) / {DIRECTIONS} / nullif(n * (n - 1) / 2.0D, 0), 0) as d from rk group by g, n)
        select g, n, if(n > 1, 1 / (d + 0.1D), 0) as want from md
        """,
        rows=rows,
    )
    near = (F.abs(F.col("cluster_density") - F.col("want")) < 1e-6) & (F.col("cluster_size") == F.col("n"))
    sizes = density.groupBy("geographic_cluster").agg(F.max("cluster_size").alias("size")).agg(F.sum("size")).scalar()
    both = density.join(same, density["geographic_cluster"] == same["g"])
    return both.agg(F.count("*").alias("n_rows"), F.any_value(sizes).alias("sum_of_sizes"), F.count_if(near).alias("n_equal"))
