"""The ``sites`` view: asset rows with coordinates, names, categories and a label.

The driver's customers, nations and regions carry no coordinates, gaps or
labels; the text below derives them row by row and reads the same in Spark SQL
and in ANSI SQL, so every query on it has an exact cross-check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteworks.sources.tables import table

SITES_TEMPLATE = """
select cast(c.c_custkey as bigint) as id,
  case when c.c_custkey % 33 = 0 then cast(0 as double) when c.c_custkey % 97 = 0 then null
       else cast(-11.0 as double) + cast((c.c_custkey * 7919) % 10000 as double) / cast(1000 as double) end as latitude,
  case when c.c_custkey % 33 = 0 then cast(0 as double) when c.c_custkey % 97 = 0 then null
       else cast(29.5 as double) + cast((c.c_custkey * 104729) % 11000 as double) / cast(1000 as double) end as longitude,
  cast(case when c.c_custkey % 5 = 0 then 0 else (c.c_custkey * 31) % 2000 end as int) as gps_height,
  cast(case when c.c_custkey % 4 = 0 then 0 else (c.c_custkey * 17) % 500 end as int) as population,
  cast(case when c.c_custkey % 3 = 0 then 0 else 1960 + c.c_custkey % 56 end as int) as construction_year,
  c.c_acctbal as amount_tsh,
  cast(date '2011-01-01' + cast((c.c_custkey * 13) % 1060 as int) as date) as date_recorded,
  r.r_name as region,
  concat(n.n_name, '_W', cast(c.c_custkey % 4 as varchar(20))) as ward,
  cast(c.c_nationkey % 12 as int) as district_code,
  case c.c_custkey % 13 when 0 then null when 1 then '0' when 2 then 'Government Of Tanzania' when 3 then 'District Council'
    when 4 then 'World Bank' when 5 then 'Unicef' when 6 then 'Danida' when 7 then 'World Vision' when 8 then 'Foundation Trust'
    when 9 then 'Kkkt Church' when 10 then 'Mission' when 11 then 'Private Individual' else 'Company Ltd 7' end as funder,
  case c.c_custkey % 9 when 0 then null when 1 then '0' when 2 then 'DWE' when 3 then 'RWE' when 4 then 'Commu' when 5 then 'DANIDA'
    when 6 then 'District Council' when 7 then 'World Vision' else 'X' end as installer,
  case c.c_custkey % 7 when 0 then null when 1 then 'K' when 2 then 'BL Kikafu' when 3 then 'Chal-2' when 4 then 'Maji water pipe'
    when 5 then 'Gravity spring scheme' else 'Bore well pump 12' end as scheme_name,
  case c.c_custkey % 8 when 0 then null when 1 then 'Shule ya Msingi' when 2 then 'Kanisani' when 3 then 'Dispensary'
    when 4 then 'Hospital Area' when 5 then 'School' else concat('Village ', cast(c.c_custkey % 50 as varchar(20))) end as subvillage,
  case c.c_custkey % 10 when 0 then null when 1 then false else true end as permit,
  case c.c_custkey % 5 when 0 then 'dry' when 1 then 'enough' when 2 then 'insufficient' when 3 then 'seasonal' else 'unknown' end as quantity,
  case (c.c_custkey * 3) % 4 when 0 then 'soft' when 1 then 'salty' when 2 then 'milky' else 'unknown' end as water_quality,
  c.c_mktsegment as management,
  case c.c_custkey % 6 when 0 then 'gravity' when 1 then 'nira/tanira' when 2 then 'submersible' when 3 then 'swn 80' when 4 then 'mono' else 'other' end as extraction_type,
  case (c.c_custkey * 5) % 7 when 0 then 'never pay' when 1 then 'pay monthly' when 2 then 'pay per bucket' when 3 then 'pay annually' else 'unknown' end as payment,
  case (c.c_custkey * 11) % 6 when 0 then 'spring' when 1 then 'river' when 2 then 'dam' when 3 then 'machine dbh' else 'shallow well' end as source,
  concat('BASIN_', cast(c.c_nationkey % 9 as varchar(20))) as basin,
  case c.c_custkey % 11 when 0 then null when 1 then false else true end as public_meeting,
  case when (c.c_custkey * 7) % 20 < 11 then 'functional' when (c.c_custkey * 7) % 20 < 13 then 'functional needs repair' else 'non functional' end as status_group
from {customer} c join {nation} n on c.c_nationkey = n.n_nationkey join {region} r on n.n_regionkey = r.r_regionkey
"""

SITES_SQL = SITES_TEMPLATE.format(customer="customer", nation="nation", region="region").strip()


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        SITES_TEMPLATE,
        customer=table(spark, sf_dir, "customer"),
        nation=table(spark, sf_dir, "nation"),
        region=table(spark, sf_dir, "region"),
    )


def with_sites(body: str) -> str:
    """Prefix a SELECT, or further CTEs starting with ``, name as (``, with the view."""
    glue = "" if body.lstrip().startswith(",") else "\n"
    return f"with sites as (\n{SITES_SQL}\n){glue}{body}"
