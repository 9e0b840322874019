"""Top-n, head and batch numbering."""

from pyspark.sql import functions as F

from siteworks.operators.enrich import assign_batches
from siteworks.operators.joins import not_yet_done
from siteworks.plans.registry import plan
from siteworks.sources.sites import sites, with_sites
from siteworks.sources.tables import table


@plan("nlargest", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 5")
def nlargest(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(5)


@plan("top_values", "select p_type, count(*) as n from part group by p_type order by count(*) desc, p_type limit 20")
def top_values(spark, sf):
    return table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(20)


@plan("head_n", with_sites("select id, ward, quantity from sites order by id limit 100"))
def head_n(spark, sf):
    return sites(spark, sf).select("id", "ward", "quantity").orderBy("id").limit(100)


@plan("missing_ids_head", "select doc_id from documents where doc_id not in (select doc_id from labels) order by doc_id limit 10")
def missing_ids_head(spark, sf):
    return not_yet_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id").orderBy("doc_id").limit(10)


@plan("batch_assign", "select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 20) + 1 as bigint) as batch, cast((row_number() over (order by o_orderkey) - 1) % 20 + 1 as int) as pos from orders")
def batch_assign(spark, sf):
    return assign_batches(table(spark, sf, "orders").select("o_orderkey"), 20, "o_orderkey")
