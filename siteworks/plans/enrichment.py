"""Rule ratings, prompts, response parsing, audits and resume."""

import pandas as pd
from pyspark.sql import functions as F

from siteworks.functions import ratings as rt
from siteworks.operators import enrich, groups
from siteworks.operators.impute import impute
from siteworks.plans.ratings_sql import COORDINATION_SQL, LANGUAGE_SQL, LOCATION_SQL, ORG_SQL, QUALITY_SQL, RATED_SQL, SCHEME_SQL
from siteworks.plans.registry import plan, r6, r6_all
from siteworks.session import materialize, scratch_path
from siteworks.sources.rating_store import RATING_COLUMNS, RatingStore
from siteworks.sources.sites import sites, with_sites
from siteworks.sources.tables import table
from siteworks.streaming.rating_stream import stream_upserts

RATINGS = rt.RATINGS


def one_rating(name, sql, build):
    @plan(name, with_sites(f"select id, cast({sql} as int) as rating from sites"))
    def run(spark, sf):
        return sites(spark, sf).select("id", build().cast("int").alias("rating"))


one_rating("rate_org_type", ORG_SQL, lambda: rt.rate_org_type(F.col("funder")))
one_rating("rate_name_quality", QUALITY_SQL, lambda: rt.rate_name_quality(F.col("installer")))
one_rating("rate_location", LOCATION_SQL, lambda: rt.rate_location(F.col("subvillage")))
one_rating("rate_scheme", SCHEME_SQL, lambda: rt.rate_scheme(F.col("scheme_name")))
one_rating("rate_language", LANGUAGE_SQL, lambda: rt.rate_language(F.col("funder"), F.col("ward"), F.col("subvillage")))
one_rating("rate_coordination", COORDINATION_SQL, lambda: rt.rate_coordination(F.col("funder"), F.col("installer")))


@plan("rating_labels", with_sites(RATED_SQL + " union all ".join(
    f"select id, '{r}' as rating, {r} as score, case {r} " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(rt.RATING_SCALES[r], 1)) + " end as description from rated" for r in RATINGS)))
def rating_labels(spark, sf):
    scale = spark.createDataFrame(
        [(r, i, n) for r in RATINGS for i, n in enumerate(rt.RATING_SCALES[r], 1)], "rating string, score int, description string")
    rated = sites(spark, sf).select("id", *rt.all_ratings()).unpivot(["id"], RATINGS, "rating", "score")
    # The scale table has thirty rows.
    return rated.join(F.broadcast(scale), ["rating", "score"])


# --- prompts ---------------------------------------------------------------

BATCH_SQL = ", bt as (select *, cast(floor((row_number() over (order by id) - 1) / {n}) + 1 as bigint) as batch, cast((row_number() over (order by id) - 1) % {n} + 1 as int) as pos from sites) "


def named(spark, sf, *more):
    """Only the columns a prompt shows: numbering the rows stores them once."""
    return sites(spark, sf).select("id", *enrich.PROMPT_FIELDS, *more)


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


VERTICAL_LINE = "concat(pos, '. ID: ', id" + "".join(f", chr(10), '   {enrich.FIELD_TITLES[f]}: ', coalesce({f}, 'MISSING')" for f in enrich.PROMPT_FIELDS) + ")"


@plan("prompt_vertical", with_sites(BATCH_SQL.format(n=5) + f"select batch, count(*) as n_rows, concat({quoted(enrich.vertical_header())}, chr(10), string_agg({VERTICAL_LINE}, chr(10) order by pos), chr(10), {quoted(enrich.vertical_footer())}) as prompt from bt group by batch"))
def prompt_vertical(spark, sf):
    return enrich.vertical_prompts(enrich.assign_batches(named(spark, sf), 5))


def line_sql(rating):
    parts = []
    for i, f in enumerate(enrich.RATING_FIELDS[rating]):
        parts.append(f"'{', ' if i else ''}{enrich.FIELD_TITLES[f]}: ', coalesce({f}, 'nan')")
    return ", ".join(parts)


@plan("prompt_horizontal", with_sites(BATCH_SQL.format(n=20) + " union all ".join(
    f"select batch, '{r}' as rating, count(*) as n_rows, concat('Rate {r} ({enrich.scale_text(r)}):', chr(10), chr(10), string_agg(concat(pos, '. ', {line_sql(r)}), chr(10) order by pos), chr(10), chr(10), 'Output only numbers 1-5, one per line.') as prompt from bt group by batch" for r in RATINGS)))
def prompt_horizontal(spark, sf):
    return enrich.horizontal_prompts(enrich.assign_batches(named(spark, sf), 20))


@plan("prompt_single", with_sites(" union all ".join(
    f"select id, '{r}' as rating, concat('Rate {r} ({enrich.scale_text(r)}):', chr(10), {line_sql(r)}, chr(10), 'Output only a number 1-5.') as prompt from sites" for r in RATINGS)))
def prompt_single(spark, sf):
    return enrich.single_prompts(sites(spark, sf))


TOKENS_SQL = "ceil((" + " + ".join(f"length(coalesce({f}, 'MISSING'))" for f in enrich.PROMPT_FIELDS) + ") / 4.0::double)"


@plan("request_plan", with_sites(f""", t as (select count(*) as n, sum({TOKENS_SQL}) as tk from sites),
  l as (select 'single' as layout, n * 6 as requests, n * 6 * 60 + tk * 6 as i, n * 12 as o from t
    union all select 'horizontal', ceil(n / 20.0::double) * 6, ceil(n / 20.0::double) * 6 * 60 + tk * 6, n * 12 from t
    union all select 'vertical', ceil(n / 5.0::double), ceil(n / 5.0::double) * 600 + tk, n * 12 from t)
  select layout, cast(requests as bigint) as requests, cast(i as bigint) as input_tokens, cast(o as bigint) as output_tokens, round((i * 0.4::double + o * 1.6::double) / 1e6::double, 6) as cost,
  round(greatest(requests / 500.0::double, (i + o) / 200000.0::double), 6) as minutes, case when requests / 500.0::double > (i + o) / 200000.0::double then 'requests' else 'tokens' end as bottleneck from l"""))
def request_plan(spark, sf):
    return r6_all(enrich.request_plan(sites(spark, sf), enrich.PROMPT_FIELDS, 5, 20))


# --- responses -------------------------------------------------------------

def answer_item():
    """The answer a faulty service could give for a row; faults follow the row's own gaps."""
    org = F.when(F.col("quantity") == "dry", "0").when(F.col("quantity") == "enough", "9").otherwise(rt.rate_org_type(F.col("funder")).cast("string"))
    quality = F.when(F.col("installer").isNull(), '"unclear"').when(F.col("quantity") == "dry", '"NaN"').when(
        F.col("quantity") == "enough", '"Infinity"').otherwise(rt.rate_name_quality(F.col("installer")).cast("string"))
    coordination = F.when(F.col("permit").isNull(), "").otherwise(
        F.concat(F.lit(', "coordination": '), rt.rate_coordination(F.col("funder"), F.col("installer")).cast("string")))
    item = F.concat(
        F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "funder_org_type": '), org, F.lit(', "installer_quality": '), quality,
        F.lit(', "location_type": '), rt.rate_location(F.col("subvillage")).cast("string"),
        F.lit(', "scheme_pattern": '), rt.rate_scheme(F.col("scheme_name")).cast("string"), F.lit(', "text_language": 2'), coordination, F.lit("}"))
    twice = F.concat(item, F.lit(', {"id": '), F.col("id").cast("string"), F.lit(', "funder_org_type": 1, "scheme_pattern": 1}'))
    return F.when(F.col("funder").isNull(), "").when(F.col("scheme_name").isNull(), twice).otherwise(item)


SHAPES = 5


def answers(batched):
    """One response per batch; the batch number picks its shape.

    0 ``results`` list, 1 other single key, 2 bare list, 3 cut off after the last
    record's ``"coordination":``, 4 not JSON. Every list ends with a record nobody asked for.
    Every other batch of shape 4 was asked again and then got a ``results`` list, and every
    tenth batch got its bare list twice, the second time without its first record.
    """
    cut = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "funder_org_type": 2, "coordination":'))
    items = batched.select("batch", "pos", "id", answer_item().alias("item"), cut.alias("cut"))
    listed = items.groupBy("batch").agg(
        F.filter(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), lambda x: x != "").alias("items"),
        F.max_by("cut", "pos").alias("cut"))
    body = F.array_join(F.concat(F.col("items"), F.array(F.lit('{"id": 999999999999, "coordination": 1}'))), ", ")
    shape = F.pmod("batch", F.lit(SHAPES))
    whole = F.concat(F.lit('{"results": ['), body, F.lit("]}"))
    text = (
        F.when(shape == 0, whole)
        .when(shape == 1, F.concat(F.lit('{"ratings": ['), body, F.lit("]}")))
        .when(shape == 2, F.concat(F.lit("["), body, F.lit("]")))
        .when(shape == 3, F.concat(F.lit('{"results": ['), F.array_join("items", ", "), F.when(F.size("items") > 0, ", ").otherwise(""), F.col("cut")))
        .otherwise("Service unavailable"))
    shorter = F.concat(F.lit("["), F.array_join(F.slice("items", 2, 1000), ", "), F.lit("]"))
    tenth = F.pmod("batch", F.lit(2 * SHAPES))
    replies = F.when(tenth == 4, F.array(text, whole)).when(tenth == 2, F.array(text, shorter)).otherwise(F.array(text))
    return listed.select("batch", F.explode(replies).alias("response"))


# The same rows by rule: r_<name> is what a correct reader finds, null where the default applies.
_GIVEN = "funder is not null and shape in (0, 1, 2, 3)"
_CUT = "shape = 3 and pos = last_pos and funder is null"
_DEFAULT = rt.RATING_DEFAULTS


def found_sql(name, value):
    return f"cast(case when {_GIVEN} then coalesce({value}, {_DEFAULT[name]}) when {_CUT} then {2 if name == 'funder_org_type' else _DEFAULT[name]} else {_DEFAULT[name]} end as double) as {name}"


NORMAL_SQL = (BATCH_SQL.format(n=5) + ", sh as (select *, case when batch % 10 = 4 then 0 else batch % 5 end as shape, max(pos) over (partition by batch) as last_pos from bt), nm as (select batch, id, " + ", ".join([
    found_sql("funder_org_type", f"case quantity when 'dry' then 1 when 'enough' then 5 else {ORG_SQL} end"),
    found_sql("installer_quality", f"case when installer is not null and quantity not in ('dry', 'enough') then {QUALITY_SQL} end"),
    found_sql("location_type", LOCATION_SQL), found_sql("scheme_pattern", SCHEME_SQL), found_sql("text_language", "2"),
    found_sql("coordination", f"case when permit is not null then {COORDINATION_SQL} end")])
    + f", case when shape = 4 then 'failed' when not ({_GIVEN}) and not ({_CUT}) then 'absent' when shape = 3 then 'repaired' else 'ok' end as status from sh) ")


def normalized(spark, sf):
    batched = materialize(enrich.assign_batches(named(spark, sf, "quantity", "permit"), 5))
    return enrich.normalize_responses(batched, answers(batched))


@plan("response_normalize", with_sites(NORMAL_SQL + "select * from nm"))
def response_normalize(spark, sf):
    return normalized(spark, sf)


@plan("response_pad", with_sites(NORMAL_SQL + "select batch, count(*) as n_expected, cast(sum(cast(status in ('ok', 'repaired') as int)) as bigint) as n_returned, cast(sum(cast(status in ('absent', 'failed') as int)) as bigint) as n_padded from nm group by batch"))
def response_pad(spark, sf):
    got = F.col("status").isin("ok", "repaired")
    return normalized(spark, sf).groupBy("batch").agg(
        F.count("*").alias("n_expected"), F.sum(got.cast("bigint")).alias("n_returned"), F.sum((~got).cast("bigint")).alias("n_padded"))


@plan("response_fallback", with_sites(NORMAL_SQL + "select id, status, concat_ws(',', " + ", ".join(f"cast(cast({r} as int) as varchar)" for r in RATINGS) + ") as ratings from nm where status in ('absent', 'failed')"))
def response_fallback(spark, sf):
    return normalized(spark, sf).where("status in ('absent', 'failed')").select(
        "id", "status", F.concat_ws(",", *[F.col(r).cast("int").cast("string") for r in RATINGS]).alias("ratings"))


@plan("json_unwrap", with_sites(f"select id, id as item_id, cast({ORG_SQL} as varchar) as org from sites"))
def json_unwrap(spark, sf):
    """Three accepted shapes, chosen by the row's water quality, read by one expression."""
    org = rt.rate_org_type(F.col("funder")).cast("string")
    item = F.concat(F.lit('{"id": '), F.col("id").cast("string"), F.lit(', "org": '), org, F.lit("}"))
    text = (
        F.when(F.col("water_quality") == "soft", F.concat(F.lit('{"results": ['), item, F.lit("]}")))
        .when(F.col("water_quality") == "salty", F.concat(F.lit('{"answer": ['), item, F.lit("]}")))
        .when(F.col("water_quality") == "milky", F.concat(F.lit("["), item, F.lit("]")))
        .otherwise(item))
    read = sites(spark, sf).select("id", F.explode(enrich.response_items(text)).alias("item"))
    return read.select("id", F.col("item")["id"].try_cast("bigint").alias("item_id"), F.col("item")["org"].alias("org"))


@plan("clamp_default", "select event_id, cast(greatest(1, least(5, coalesce(try_cast(json_extract_string(props, '$.k') as double) / 10 - 2, 3))) as double) as rating from events")
def clamp_default(spark, sf):
    number = F.get_json_object("props", "$.k").try_cast("double") / 10 - 2
    return table(spark, sf, "events").select("event_id", enrich.clamp_rating(number, 3).alias("rating"))


@plan("json_repair", with_sites("""select id, concat('{"results": [{"id": ', id, ', "coordination": ', case when permit is null then '3' when permit then '4' else '3' end, '}]}') as repaired from sites"""))
def json_repair(spark, sf):
    """Cut at three places, by the row's permit: inside the value, after a blank, before the end."""
    head = F.concat(F.lit('{"results": [{"id": '), F.col("id").cast("string"), F.lit(', "coordination":'))
    text = F.when(F.col("permit").isNull(), head).when(F.col("permit"), F.concat(head, F.lit(" 4"))).otherwise(F.concat(head, F.lit("  ")))
    return sites(spark, sf).select("id", enrich.repair_json(text).alias("repaired"))


@plan("lines_parse", with_sites(BATCH_SQL.format(n=20) + "select batch, pos, id, cast(case when pos > 18 then 3 when installer is null then 3 when quantity = 'dry' then 3 else " + QUALITY_SQL + " end as int) as rating from bt"))
def lines_parse(spark, sf):
    """Answers with words, out-of-range values, and the last two lines missing."""
    batched = materialize(enrich.assign_batches(named(spark, sf, "quantity"), 20))
    line = (
        F.when(F.col("installer").isNull(), "unclear").when(F.col("quantity") == "dry", "7")
        .otherwise(F.concat(F.lit(" "), rt.rate_name_quality(F.col("installer")).cast("string"))))
    texts = batched.where("pos <= 18").select("batch", "pos", line.alias("line")).groupBy("batch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("response"))
    return enrich.parse_rating_lines(batched, texts)


@plan("digit_parse", "select p_partkey, case when p_size between 1 and 5 then p_size else 3 end as rating, cast(not (p_size between 1 and 5) as int) as was_invalid from part")
def digit_parse(spark, sf):
    text = F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" "))
    return table(spark, sf, "part").select(
        "p_partkey", enrich.parse_digit(text).alias("rating"), (~enrich.is_valid_digit(text)).cast("int").alias("was_invalid"))


# --- stored ratings --------------------------------------------------------

def rating_versions(spark, sf):
    """Rating rows as runs left them.

    Assets without a building year were never rated, those without a permit have a
    gap, and those without a scheme name were rated twice, the second time inverted.
    """
    rated = sites(spark, sf).where("construction_year > 0").select(
        "id", "scheme_name", "permit", F.year("date_recorded").alias("y"), F.dayofyear("date_recorded").alias("d"), *rt.all_ratings())
    first = [F.col(r).cast("double").alias(f"rating_{r}") for r in RATINGS[:-1]]
    gap = F.when(F.col("permit").isNotNull(), F.col("coordination").cast("double")).alias("rating_coordination")
    batch = (F.col("y") - 2010).cast("int")
    one = rated.select("id", *first, gap, batch.alias("batch_completed"), F.col("d").cast("double").alias("timestamp"))
    again = [(F.lit(6.0) - F.col(r)).alias(f"rating_{r}") for r in RATINGS]
    two = rated.where("scheme_name is null").select("id", *again, (batch + 10).alias("batch_completed"), F.col("d").cast("double").alias("timestamp"))
    return one.unionByName(two)


STORED_SQL = RATED_SQL + (", st as (select s.id, " + ", ".join(f"cast(case when s.scheme_name is null then 6 - r.{r} else r.{r} end as double) as rating_{r}" for r in RATINGS[:-1])
    + ", cast(case when s.scheme_name is null then 6 - r.coordination when s.permit is not null then r.coordination end as double) as rating_coordination, "
    "cast(case when s.scheme_name is null then 10 else 0 end + year(s.date_recorded) - 2010 as int) as batch_completed, cast(dayofyear(s.date_recorded) as double) as timestamp from sites s join rated r on s.id = r.id where s.construction_year > 0) ")


def stored_ratings(spark, sf):
    from siteworks.sources.rating_store import latest_per_id

    return latest_per_id(rating_versions(spark, sf), "id", ["batch_completed", "timestamp"])


DONE_SQL = " and ".join(f"rating_{r} is not null" for r in RATINGS)


@plan("completeness_audit", with_sites(STORED_SQL + f""", a as (select (select count(*) from sites) as total, (select count(*) from st) as stored, (select count(*) from st where {DONE_SQL}) as complete)
  select total, complete, total - stored as missing, stored - complete as incomplete, total - complete as to_process, round(100.0::double * complete / total, 6) as percent_done,
  cast(ceil((total - complete) / 5.0::double) as bigint) as remaining_batches, round(ceil((total - complete) / 5.0::double) * 0.0001::double, 6) as estimated_cost, round(ceil((total - complete) / 5.0::double) / 100, 6) as estimated_minutes from a"""))
def completeness_audit(spark, sf):
    return r6_all(enrich.completeness_audit(sites(spark, sf), stored_ratings(spark, sf), RATING_COLUMNS))


@plan("resume_plan", with_sites(STORED_SQL + f", td as (select id from sites where id not in (select id from st where {DONE_SQL})) select id, cast(floor((row_number() over (order by id) - 1) / 5) + 1 as bigint) as batch, cast((row_number() over (order by id) - 1) % 5 + 1 as int) as pos from td"))
def resume_plan(spark, sf):
    todo = enrich.reprocess_ids(sites(spark, sf), stored_ratings(spark, sf), RATING_COLUMNS)
    return enrich.assign_batches(todo, 5)


# Text pattern and the organisation type it should get.
SPOT_CHECKS = [("government", 1), ("world", 2), ("vision", 3), ("church", 4), ("private", 5)]


@plan("rating_spot_check", with_sites(RATED_SQL + ", j as (select s.funder, r.funder_org_type as rating from sites s join rated r on s.id = r.id) " + " union all ".join(
    f"select '{p}' as pattern, {v} as expected, count(*) filter (where lower(funder) like '%{p}%') as n, round(avg(case when rating = {v} then 1.0::double else 0.0::double end) filter (where lower(funder) like '%{p}%'), 6) as agreement from j" for p, v in SPOT_CHECKS)))
def rating_spot_check(spark, sf):
    rated = sites(spark, sf).select("funder", *rt.all_ratings())
    return r6_all(enrich.spot_check(rated, "funder", "funder_org_type", SPOT_CHECKS))


# Recorded minimum, maximum and mean per rating.
RECORDED = {"funder_org_type": (1, 5, 2.60), "installer_quality": (1, 5, 2.86), "location_type": (2, 5, 4.91),
            "scheme_pattern": (1, 5, 2.35), "text_language": (1, 5, 2.15), "coordination": (1, 5, 3.06)}


@plan("rating_drift", with_sites(RATED_SQL + " union all ".join(
    f"select '{r}' as rating, round(avg({r}), 6) as mean_value, round(avg({r}) - {m}::double, 6) as drift, cast(min({r}) >= {lo} and max({r}) <= {hi} as int) as in_range from rated" for r, (lo, hi, m) in RECORDED.items())))
def rating_drift(spark, sf):
    stats = groups.numeric_summary(sites(spark, sf).select(*rt.all_ratings()), RATINGS)
    recorded = spark.createDataFrame([(r, float(lo), float(hi), m) for r, (lo, hi, m) in RECORDED.items()], "column_name string, low double, high double, recorded double")
    return stats.join(F.broadcast(recorded), "column_name").select(
        F.col("column_name").alias("rating"), r6("mean_value").alias("mean_value"), r6(F.col("mean_value") - F.col("recorded")).alias("drift"),
        ((F.col("min_value") >= F.col("low")) & (F.col("max_value") <= F.col("high"))).cast("int").alias("in_range"))


@plan("rating_median_fill", with_sites(STORED_SQL + ", m as (select " + ", ".join(f"median(rating_{r}) as m_{r}" for r in RATINGS[:2]) + " from st) select s.id, " + ", ".join(f"round(coalesce(st.rating_{r}, m_{r}), 6) as rating_{r}" for r in RATINGS[:2]) + " from sites s left join st on s.id = st.id, m"))
def rating_median_fill(spark, sf):
    known = materialize(stored_ratings(spark, sf))
    names = RATING_COLUMNS[:2]
    rows = sites(spark, sf).select("id").join(known.select("id", *names), "id", "left")
    return r6_all(impute(rows, names, "median", known))


@plan("rating_reuse", with_sites(STORED_SQL + "select s.id, coalesce(st.rating_funder_org_type, cast(" + ORG_SQL.replace("funder", "s.funder") + " as double)) as funder_org_type, cast(st.rating_funder_org_type is not null as int) as reused from sites s left join st on s.id = st.id"))
def rating_reuse(spark, sf):
    """A stored rating is taken as it is; only missing ones are rated."""
    stored = stored_ratings(spark, sf).select("id", "rating_funder_org_type")
    joined = sites(spark, sf).select("id", "funder").join(stored, "id", "left")
    have = F.col("rating_funder_org_type")
    return joined.select(
        "id", F.coalesce(have, rt.rate_org_type(F.col("funder")).cast("double")).alias("funder_org_type"), have.isNotNull().cast("int").alias("reused"))


def length_scorer(frame: pd.DataFrame) -> pd.DataFrame:
    """A user's scorer on one Arrow batch: installer name quality by length."""
    name = frame["installer"].fillna("nan")
    size = name.str.len()
    score = pd.Series(4, index=frame.index).mask(size <= 10, 3).mask(size <= 3, 2).mask((size <= 1) | name.isin(["0", "nan"]), 1)
    return pd.DataFrame({"id": frame["id"], "installer_quality": score.astype("int32")})


@plan("enrich_with_scorer", with_sites(f"select id, cast({QUALITY_SQL} as int) as installer_quality from sites"))
def enrich_with_scorer(spark, sf):
    return enrich.enrich_with(sites(spark, sf), length_scorer, "id bigint, installer_quality int", ["id", "installer"])


@plan("stream_upsert", with_sites(STORED_SQL + "select * from st"))
def stream_upsert(spark, sf):
    """Versions land as JSON files in no useful order and are merged by the stream."""
    root = scratch_path(spark, "stream")
    landing = f"{root}/landing"
    rating_versions(spark, sf).repartition(3, "rating_location_type", "id").write.json(landing)
    stream_upserts(spark, landing, f"{root}/store", f"{root}/state", files_per_trigger=2)
    return RatingStore(spark, f"{root}/store").read()


@plan("stream_latest", with_sites(STORED_SQL + "select * from st"))
def stream_latest(spark, sf):
    """The same files through a stream that remembers the latest version of every id and passes on changes only."""
    from siteworks.streaming.rating_state import stream_latest as run

    root = scratch_path(spark, "stream-latest")
    landing = f"{root}/landing"
    rating_versions(spark, sf).repartition(3, "rating_location_type", "id").write.json(landing)
    run(spark, landing, f"{root}/store", f"{root}/state", files_per_trigger=2)
    return RatingStore(spark, f"{root}/store").read()


@plan("enrich_logged", with_sites(f"select id, cast({QUALITY_SQL} as int) as installer_quality from sites"))
def enrich_logged(spark, sf):
    """Batches of five, a third of them asked before and gathered, the rest now; every asset gets its reply."""
    from siteworks.operators import replies

    log = scratch_path(spark, "replies")
    batched = enrich.assign_batches(sites(spark, sf).select("id"), 5).join(sites(spark, sf).select("id", "installer"), "id").select("id", "installer", "batch")
    ask = lambda rows: replies.enrich_logged(rows, length_scorer, "id bigint, installer_quality int", ["id", "installer"], log)
    ask(batched.where("batch % 3 = 0")).write.format("noop").mode("overwrite").save()
    replies.fold_replies(spark, log)
    return ask(batched)
