"""Category codes, scaling, feature sets and splits."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from siteworks.functions import columns as fx
from siteworks.operators import encode, splits
from siteworks.operators.features import feature_set
from siteworks.operators.models import assembler, feature_frame
from siteworks.plans.derived import code_joins, codes_sql
from siteworks.plans.registry import plan, r6_all
from siteworks.sources.sites import sites, with_sites

ALL_CATEGORIES = ["quantity", "water_quality", "management", "extraction_type", "payment", "source", "basin",
                  "region", "ward", "district_code", "permit", "public_meeting", "funder", "installer"]
# SQL text of a category: booleans in the capitalised form, null as 'nan'.
CAP = "coalesce(case {c} when true then 'True' when false then 'False' end, 'nan')"


def cat_sql(c):
    return CAP.format(c=c) if c in ("permit", "public_meeting") else f"coalesce(cast({c} as varchar), 'nan')"


@plan("label_encode", with_sites("select id, " + ", ".join(f"cast(dense_rank() over (order by {cat_sql(c)}) - 1 as int) as {c}_encoded" for c in ALL_CATEGORIES) + " from sites"))
def label_encode(spark, sf):
    """Fourteen columns, one dictionary, one pass over the distinct values."""
    return encode.label_encode(sites(spark, sf), ALL_CATEGORIES)


def train_test(spark, sf, column):
    df = encode.as_category(sites(spark, sf).select("id", "construction_year", column), [column], "missing")
    return df.where("construction_year > 2010").drop("construction_year"), df.drop("construction_year")


def known_sql(column, where="where construction_year > 2010"):
    return (f", d as (select v, cast(row_number() over (order by v) - 1 as int) as code from (select distinct coalesce({column}, 'missing') as v from sites {where}) t) ")


@plan("encode_unknown_minus1", with_sites(known_sql("ward") + "select s.id, coalesce(d.code, -1) as ward_encoded from sites s left join d on d.v = coalesce(s.ward, 'missing')"))
def encode_unknown_minus1(spark, sf):
    train, rows = train_test(spark, sf, "ward")
    dictionary = encode.fit_dictionary(train, ["ward"])
    return encode.apply_dictionary(rows, dictionary, {"ward": "ward_encoded"}, unseen=-1).select("id", "ward_encoded")


@plan("encode_unknown_first", with_sites(known_sql("ward") + "select s.id, coalesce(d.code, 0) as ward_encoded from sites s left join d on d.v = coalesce(s.ward, 'missing')"))
def encode_unknown_first(spark, sf):
    train, rows = train_test(spark, sf, "ward")
    dictionary = encode.fit_dictionary(train, ["ward"])
    return encode.apply_dictionary(rows, dictionary, {"ward": "ward_encoded"}, unseen=0).select("id", "ward_encoded")


@plan("encode_unknown_literal", with_sites(", d as (select v, cast(row_number() over (order by v) - 1 as int) as code from (select distinct quantity as v from sites where quantity in ('dry', 'unknown') union select distinct quantity from sites where quantity = 'enough') t) "
    "select s.id, coalesce(d.code, (select code from d where v = 'unknown'), -1) as quantity_encoded from sites s left join d on d.v = s.quantity"))
def encode_unknown_literal(spark, sf):
    rows = encode.as_category(sites(spark, sf).select("id", "quantity"), ["quantity"])
    dictionary = encode.fit_dictionary(rows.where("quantity in ('dry', 'unknown', 'enough')"), ["quantity"])
    return encode.apply_with_literal(rows, dictionary, "quantity", "quantity_encoded").select("id", "quantity_encoded")


@plan("encode_extend", with_sites(known_sql("ward") + ", u as (select distinct ward as v from sites where ward not in (select v from d)), "
    "x as (select v, code from d union all select v, cast((select max(code) from d) + row_number() over (order by v) as int) as code from u) select s.id, x.code as ward_encoded from sites s join x on x.v = s.ward"))
def encode_extend(spark, sf):
    train, rows = train_test(spark, sf, "ward")
    dictionary = encode.extend_dictionary(encode.fit_dictionary(train, ["ward"]), rows, "ward")
    return encode.apply_dictionary(rows, dictionary, {"ward": "ward_encoded"}).select("id", "ward_encoded")


@plan("label_roundtrip", with_sites("select id, status_group, cast(dense_rank() over (order by status_group) - 1 as int) as status_code, status_group as decoded from sites"))
def label_roundtrip(spark, sf):
    rows = encode.as_category(sites(spark, sf).select("id", "status_group"), ["status_group"])
    dictionary = encode.fit_dictionary(rows, ["status_group"])
    coded = encode.apply_dictionary(rows, dictionary, {"status_group": "status_code"})
    return encode.decode(coded, dictionary, "status_group", "status_code", "decoded").select("id", "status_group", "status_code", "decoded")


SCALED = ["population", "gps_height", "amount_tsh"]


@plan("standardize", with_sites(", m as (select " + ", ".join(f"avg({c}) as a_{c}, stddev_pop({c}) as s_{c}" for c in SCALED) + " from sites where construction_year > 0) select id, "
    + ", ".join(f"round(({c} - a_{c}) / s_{c}, 6) as {c}_scaled" for c in SCALED) + " from sites, m"))
def standardize(spark, sf):
    df = sites(spark, sf)
    out = encode.standardize(df.select("id", *SCALED), SCALED, df.where("construction_year > 0"))
    return r6_all(out.drop(*SCALED))


ASSEMBLED = ["amount_tsh", "gps_height", "population", "latitude", "longitude"]


@plan("assemble_vector", with_sites("select id, " + ", ".join(f"coalesce({c}::double, -1) as x{i}" for i, c in enumerate(ASSEMBLED)) + " from sites"))
def assemble_vector(spark, sf):
    """The vector's elements, in the order of the list."""
    made = assembler(ASSEMBLED).transform(feature_frame(sites(spark, sf), ASSEMBLED, ["id"]))
    elements = vector_to_array("features")
    return made.select("id", *[elements[i].alias(f"x{i}") for i in range(len(ASSEMBLED))])


def feature_set_sql(holes, kept):
    numbers = [f"coalesce(nullif(s.{c}, 0), -1{'.0::double' if c in ('longitude', 'latitude') else ''}) as {c}" if c in holes else f"s.{c}"
               for c in ["amount_tsh", "longitude", "latitude", "gps_height", "population"]]
    flags = [f"cast(nullif(s.{c}, 0) is null as int) as {c}_missing" for c in holes]
    codes = [f"e_{c}.code as {c}_encoded" for c in kept]
    dates = ["cast(year(s.date_recorded) as int) as year_recorded", "cast(date_diff('day', s.date_recorded, date '2013-12-03') as int) as days_since_recorded", "2013 - s.construction_year as asset_age"]
    return with_sites(codes_sql(kept) + "select s.id, " + ", ".join([*numbers, *flags, *dates, *codes]) + f" from sites s {code_joins(kept)}")


@plan("feature_set_fast", feature_set_sql(["longitude", "latitude", "gps_height", "population"], ["quantity", "extraction_type", "management", "payment", "water_quality"]))
def feature_set_fast(spark, sf):
    return feature_set(sites(spark, sf), "fast")


@plan("feature_set_lean", feature_set_sql(["longitude", "latitude", "gps_height"], ["quantity", "payment", "water_quality", "extraction_type"]))
def feature_set_lean(spark, sf):
    return feature_set(sites(spark, sf), "lean")


def split_sql(fraction, seed):
    """CTE ``sp(id, status_group, split)``."""
    return (f", sp as (select id, status_group, case when row_number() over (partition by status_group order by md5(concat(cast(id as varchar), '-{seed}'))) <= round(count(*) over (partition by status_group) * {fraction}::double) "
            "then 'validation' else 'train' end as split from sites) ")


def folds_sql(folds, seed):
    """CTE ``fo(id, status_group, fold)``."""
    tests = " + ".join(f"cast(floor(n * {i} / {folds}.0::double) < rn as int)" for i in range(1, folds))
    return (f", fr as (select *, row_number() over (partition by status_group order by md5(concat(cast(id as varchar), '-{seed}'))) as rn, count(*) over (partition by status_group) as n from sites), "
            f"fo as (select *, {tests} as fold from fr) ")


@plan("stratified_split", with_sites(split_sql(0.2, 42) + "select id, status_group, split from sp"))
def stratified_split(spark, sf):
    return splits.stratified_split(sites(spark, sf).select("id", "status_group"), "id", "status_group", 0.2, 42)


@plan("stratified_kfold", with_sites(folds_sql(5, 42) + "select id, status_group, fold from fo"))
def stratified_kfold(spark, sf):
    return splits.stratified_folds(sites(spark, sf).select("id", "status_group"), "id", "status_group", 5, 42)


# Shares and seeds of the learning curve.
SIZES, SEEDS = [0.01, 0.02, 0.05, 0.1, 0.2], list(range(10))


def samples_sql():
    """CTE ``ls(id, status_group, seed, size)``."""
    size = "case " + " ".join(f"when rn <= round(n * {s}::double) then {s}::double" for s in SIZES) + " end"
    return (", lr as (select s.id, s.status_group, z.seed, row_number() over (partition by z.seed, s.status_group order by md5(concat(cast(s.id as varchar), '-', cast(z.seed as varchar)))) as rn, "
            f"count(*) over (partition by z.seed, s.status_group) as n from sites s, (select unnest([{', '.join(map(str, SEEDS))}]) as seed) z), "
            f"ls as (select id, status_group, seed, {size} as size from lr where {size} is not null) ")


@plan("learning_curve_split", with_sites(samples_sql() + "select id, status_group, seed, size from ls"))
def learning_curve_split(spark, sf):
    return splits.learning_curve_samples(sites(spark, sf), "id", "status_group", SIZES, SEEDS)


@plan("split_balance", with_sites(split_sql(0.2, 42) + "select split, status_group, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (partition by split), 6) as share from sp group by split, status_group"))
def split_balance(spark, sf):
    split = splits.stratified_split(sites(spark, sf).select("id", "status_group"), "id", "status_group", 0.2, 42)
    return r6_all(splits.split_balance(split, "status_group"))


@plan("align_on_split", with_sites(split_sql(0.2, 42) + codes_sql(["quantity"]) + "select sp.id, sp.split, s.population, e_quantity.code as quantity_encoded, 2013 - s.construction_year as asset_age "
    f"from sp join sites s on s.id = sp.id {code_joins(['quantity'])}"))
def align_on_split(spark, sf):
    """Several feature sets on one split table, matched by id and never by position."""
    df = sites(spark, sf)
    split = splits.stratified_split(df.select("id", "status_group"), "id", "status_group", 0.2, 42).drop("status_group")
    first = df.select("id", "population")
    second = encode.label_encode(df, ["quantity"])
    third = df.select("id", fx.age_at_reference(F.col("construction_year")).alias("asset_age"))
    return split.join(first, "id").join(second, "id").join(third, "id")
