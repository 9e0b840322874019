"""Votes, scores, reports and comparisons, on rule voters that read the whole table."""

from pyspark.sql import functions as F

from siteworks.functions import columns as fx
from siteworks.operators import groups, metrics, splits, voting
from siteworks.operators.joins import measured
from siteworks.operators.ordering import running_totals
from siteworks.plans.aggregates import CANDIDATES, anova_sql
from siteworks.plans.encoding import SEEDS, SIZES, folds_sql, samples_sql, split_sql
from siteworks.plans.registry import plan, r6, r6_all
from siteworks.session import materialize
from siteworks.sources.sites import sites, with_sites
from siteworks.sources.tables import table

VOTERS = ["v_quantity", "v_ward", "v_age"]
OK, FIX, BAD = voting.CLASSES

VOTERS_SQL = (", wr as (select ward, avg(case when status_group = 'functional' then 1.0::double else 0.0::double end) as rate from sites group by ward), "
    f"vo as (select s.id, s.ward, s.region, s.status_group, case when s.quantity = 'dry' then '{BAD}' when s.quantity in ('insufficient', 'seasonal') then '{FIX}' else '{OK}' end as v_quantity, "
    f"case when wr.rate >= 0.5 then '{OK}' else '{BAD}' end as v_ward, "
    f"case when s.construction_year = 0 then '{FIX}' when 2013 - s.construction_year > 30 then '{BAD}' else '{OK}' end as v_age from sites s join wr on s.ward = wr.ward) ")


def voters(spark, sf):
    """Rows with three rule votes."""
    df = sites(spark, sf).select("id", "ward", "region", "status_group", "quantity", "construction_year")
    rates = groups.group_rates(df, "ward", "status_group", {"rate": groups.POSITIVE})
    age = fx.age_at_reference(F.col("construction_year"))
    q = F.col("quantity")
    return groups.join_back(df, rates, ["ward"]).select(
        "id", "ward", "region", "status_group",
        F.when(q == "dry", BAD).when(q.isin("insufficient", "seasonal"), FIX).otherwise(OK).alias("v_quantity"),
        F.when(F.col("rate") >= 0.5, OK).otherwise(BAD).alias("v_ward"),
        F.when(F.col("construction_year") == 0, FIX).when(age > 30, BAD).otherwise(OK).alias("v_age"))


def acc_sql(v):
    return f"avg(case when status_group = {v} then 1.0::double else 0.0::double end)"


def scores_sql(source, by=""):
    """SELECT of one row per voter: ``[by,] voter, score``."""
    lead = f"{by}, " if by else ""
    tail = f" group by {by}" if by else ""
    return " union all ".join(f"select {lead}'{v}' as voter, {acc_sql(v)} as score from {source}{tail}" for v in VOTERS)


CLASS_SQL = ", ".join(f"'{c}'" for c in voting.CLASSES)


@plan("classification_report", with_sites(VOTERS_SQL + f""", cl as (select unnest([{CLASS_SQL}]) as class),
  cm as (select class, sum(cast(v_quantity = class and status_group = class as int)) as h, sum(cast(status_group = class as int)) as s, sum(cast(v_quantity = class as int)) as p from vo, cl group by class),
  pr as (select class, h, s, coalesce(h / nullif(cast(p as double), 0), 0) as precision, coalesce(h / nullif(cast(s as double), 0), 0) as recall from cm),
  f as (select *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) as f1 from pr),
  al as (select class, precision, recall, f1, s as support from f
    union all select 'accuracy', sum(h) / cast(sum(s) as double), sum(h) / cast(sum(s) as double), sum(h) / cast(sum(s) as double), sum(s) from f
    union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(s) from f
    union all select 'weighted avg', sum(precision * s) / sum(s), sum(recall * s) / sum(s), sum(f1 * s) / sum(s), sum(s) from f)
  select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from al"""))
def classification_report(spark, sf):
    return r6_all(metrics.classification_report(voters(spark, sf), "status_group", "v_quantity"))


@plan("accuracy", with_sites(VOTERS_SQL + "select voter, round(score, 6) as score from (" + scores_sql("vo") + ") t"))
def accuracy(spark, sf):
    return r6_all(metrics.accuracy_table(voters(spark, sf), "status_group", VOTERS))


FAMILIES = {"location": "^(latitude|longitude|gps_height|district_code)$", "people": "population|amount"}
FAMILY_SQL = "case " + " ".join(f"when regexp_matches(feature, '{p}') then '{n}'" for n, p in FAMILIES.items()) + " else 'other' end"


@plan("importance_by_family", with_sites(", " + anova_sql("sites", "status_group", CANDIDATES).replace("select c.feature, round(", ", fv as (select c.feature, round(", 1)
    + f") select {FAMILY_SQL} as family, count(*) as n_features, round(sum(f_value), 4) as total from fv group by 1"))
def importance_by_family(spark, sf):
    """Sums by name pattern; what matches none is the remainder."""
    scores = groups.anova_f(sites(spark, sf), CANDIDATES, "status_group").select("feature", F.round("f_value", 5).alias("f_value"))
    family = None
    for name, pattern in FAMILIES.items():
        hit = F.col("feature").rlike(pattern)
        family = F.when(hit, name) if family is None else family.when(hit, name)
    return scores.groupBy(family.otherwise("other").alias("family")).agg(
        F.count("*").alias("n_features"), F.round(F.sum("f_value"), 4).alias("total"))


FOLD_SCORES_SQL = VOTERS_SQL + folds_sql(5, 42) + ", fv as (select vo.*, fo.fold from vo join fo on vo.id = fo.id), fs as (" + scores_sql("fv", "fold") + ") "


def fold_scores(spark, sf):
    folded = splits.stratified_folds(voters(spark, sf), "id", "status_group", 5, 42)
    return metrics.accuracy_table(folded, "status_group", VOTERS, ["fold"])


@plan("cv_summary", with_sites(FOLD_SCORES_SQL + "select voter, round(avg(score), 6) as mean_score, round(stddev_pop(score), 6) as std_score, round(2 * stddev_pop(score), 6) as two_std, round(min(score), 6) as min_score, round(max(score), 6) as max_score from fs group by voter"))
def cv_summary(spark, sf):
    s = F.col("score")
    return fold_scores(spark, sf).groupBy("voter").agg(
        r6(F.avg(s)).alias("mean_score"), r6(F.stddev_pop(s)).alias("std_score"), r6(F.stddev_pop(s) * 2).alias("two_std"),
        r6(F.min(s)).alias("min_score"), r6(F.max(s)).alias("max_score"))


@plan("argmin_group", with_sites(FOLD_SCORES_SQL + ", sd as (select voter, round(stddev_samp(score), 9) as s from fs group by voter) select arg_min(voter, s) as most_stable, round(min(s), 6) as std_score from sd"))
def argmin_group(spark, sf):
    spread = fold_scores(spark, sf).groupBy("voter").agg(F.round(F.stddev_samp("score"), 9).alias("s"))
    return spread.agg(F.min_by("voter", "s").alias("most_stable"), r6(F.min("s")).alias("std_score"))


def tally_sql(weights):
    """Weighted vote of the three voters, ties to the earliest, by plain arithmetic."""
    total = {v: " + ".join(f"case when {o} = {v} then {w}.0 else 0.0 end" for o, w in zip(VOTERS, weights)) for v in VOTERS}
    a, b, c = (f"({total[v]})" for v in VOTERS)
    return f"case when {a} >= {b} and {a} >= {c} then v_quantity when {b} >= {c} then v_ward else v_age end"


@plan("vote_majority", with_sites(VOTERS_SQL + f"select id, {tally_sql([1, 1, 1])} as vote from vo"))
def vote_majority(spark, sf):
    return voters(spark, sf).select("id", voting.majority_vote([F.col(v) for v in VOTERS]).alias("vote"))


@plan("vote_weighted", with_sites(VOTERS_SQL + f"select id, {tally_sql(voting.LABEL_WEIGHTS)} as vote from vo"))
def vote_weighted(spark, sf):
    return voters(spark, sf).select("id", voting.weighted_vote([F.col(v) for v in VOTERS], voting.LABEL_WEIGHTS).alias("vote"))


def code_sql(v):
    return f"case {v} when '{OK}' then 0 when '{FIX}' then 1 else 2 end"


@plan("vote_ordinal_avg", with_sites(VOTERS_SQL + ", sc as (" + scores_sql("vo") + "), w as (select "
    + ", ".join(f"max(score) filter (where voter = '{v}') as w_{v}" for v in VOTERS) + " from sc) select id, case cast(round_even(round(("
    + " + ".join(f"({code_sql(v)}) * w_{v}" for v in VOTERS) + ") / (" + " + ".join(f"w_{v}" for v in VOTERS) + f"), 12), 0) as int) when 0 then '{OK}' when 1 then '{FIX}' else '{BAD}' end as vote from vo, w"))
def vote_ordinal_avg(spark, sf):
    """Voters weighted by their accuracy on the whole table."""
    df = voters(spark, sf)
    scores = df.agg(F.struct(*[metrics.accuracy_of(F.col("status_group"), F.col(v)).alias(v) for v in VOTERS]).alias("w")).scalar()
    return df.select("id", voting.ordinal_average([F.col(v) for v in VOTERS], [scores[v] for v in VOTERS]).alias("vote"))


@plan("voter_weights", with_sites(VOTERS_SQL + ", sc as (" + scores_sql("vo") + ") select voter, round(score, 6) as score, round(score / (select sum(score) from sc), 6) as weight from sc"))
def voter_weights(spark, sf):
    scores = materialize(metrics.accuracy_table(voters(spark, sf), "status_group", VOTERS))
    return r6_all(voting.voter_weights(scores))


PROBA_KEYS = ["quantity", "ward", "management"]
P_SQL = "".join(
    f", p_{k} as (select {k}, " + ", ".join(f"(sum(case when status_group = '{c}' then 1 else 0 end) + 1.0::double) / (count(*) + 3.0::double) as {k}_{i}" for i, c in enumerate(voting.CLASSES))
    + f" from sites group by {k})" for k in PROBA_KEYS)


def blend_sql(weights):
    sums = [" + ".join(f"{w}::double * {k}_{i}" for k, w in zip(PROBA_KEYS, weights)) for i in range(3)]
    return (P_SQL + ", b as (select s.id, " + ", ".join(f"round({s}, 9) as p{i}" for i, s in enumerate(sums)) + " from sites s " + " ".join(f"join p_{k} on s.{k} = p_{k}.{k}" for k in PROBA_KEYS)
            + f") select id, round(p0, 6) as p_functional, round(p1, 6) as p_repair, round(p2, 6) as p_non_functional, case when p0 >= p1 and p0 >= p2 then '{OK}' when p1 >= p2 then '{FIX}' else '{BAD}' end as vote from b")


def smoothed_rates(df, key):
    """Class probabilities per key value with one added count per class."""
    share = [((F.sum((F.col("status_group") == c).cast("int")) + 1.0) / (F.count("*") + 3.0)).alias(f"{key}_{i}") for i, c in enumerate(voting.CLASSES)]
    return df.groupBy(key).agg(*share)


def blended(spark, sf, weights):
    df = sites(spark, sf).select("id", "status_group", *PROBA_KEYS)
    rows = df
    for key in PROBA_KEYS:
        rows = groups.join_back(rows, smoothed_rates(df, key), [key])
    p = voting.blend([[F.col(f"{k}_{i}") for i in range(3)] for k in PROBA_KEYS], weights)
    return rows.select(
        "id", r6(F.round(p[0], 9)).alias("p_functional"), r6(F.round(p[1], 9)).alias("p_repair"),
        r6(F.round(p[2], 9)).alias("p_non_functional"), voting.best_class(p).alias("vote"))


@plan("proba_average", with_sites(blend_sql([1 / 3] * 3)))
def proba_average(spark, sf):
    return blended(spark, sf, [1 / 3] * 3)


@plan("proba_weighted", with_sites(blend_sql(voting.SOFT_WEIGHTS_3)))
def proba_weighted(spark, sf):
    return blended(spark, sf, voting.SOFT_WEIGHTS_3)


@plan("overfit_gap", with_sites(VOTERS_SQL + split_sql(0.2, 42) + ", j as (select vo.*, sp.split from vo join sp on vo.id = sp.id), a as (" + scores_sql("j", "split")
    + ") select voter, round(max(score) filter (where split = 'train'), 6) as train_score, round(max(score) filter (where split = 'validation'), 6) as val_score, "
    "round(max(score) filter (where split = 'train') - max(score) filter (where split = 'validation'), 6) as gap from a group by voter"))
def overfit_gap(spark, sf):
    split = splits.stratified_split(voters(spark, sf), "id", "status_group", 0.2, 42)
    scores = metrics.accuracy_table(split, "status_group", VOTERS, ["split"])
    wide = scores.groupBy("voter").pivot("split", ["train", "validation"]).agg(F.max("score"))
    return wide.select("voter", r6("train").alias("train_score"), r6("validation").alias("val_score"), r6(F.col("train") - F.col("validation")).alias("gap"))


REGION_SCORES_SQL = VOTERS_SQL + ", sc as (" + scores_sql("vo", "region") + ") "


@plan("leaderboard", with_sites(REGION_SCORES_SQL + "select region, voter, round(score, 6) as score, cast(rank() over (order by round(score, 6) desc) as int) as place from sc"))
def leaderboard(spark, sf):
    return metrics.leaderboard(r6_all(metrics.accuracy_table(voters(spark, sf), "status_group", VOTERS, ["region"])))


@plan("improvement_vs_baseline", with_sites(VOTERS_SQL + ", sc as (" + scores_sql("vo") + "), b as (select score as base from sc where voter = 'v_quantity') select voter, round(score, 6) as score, round(score - base, 6) as gain, round((score - base) / base * 100, 6) as gain_pct from sc, b"))
def improvement_vs_baseline(spark, sf):
    scores = materialize(metrics.accuracy_table(voters(spark, sf), "status_group", VOTERS))
    return r6_all(metrics.against_baseline(scores, "voter", "v_quantity"))


# Gains above which a change is accepted, and the verdicts.
GATES = [(0.01, "adopt"), (0.005, "moderate"), (0.002, "small"), (0.001, "weak")]


@plan("gate_verdict", with_sites(REGION_SCORES_SQL + ", b as (select region, score as base from sc where voter = 'v_quantity') select sc.region, sc.voter, round(score - base, 6) as gain, case "
    + " ".join(f"when round(score - base, 6) > {l} then '{t}'" for l, t in GATES) + " else 'keep baseline' end as verdict from sc join b on sc.region = b.region"))
def gate_verdict(spark, sf):
    """Accept or reject each voter per region against the first one."""
    scores = materialize(metrics.accuracy_table(voters(spark, sf), "status_group", VOTERS, ["region"]))
    base = scores.where("voter = 'v_quantity'").select("region", F.col("score").alias("base"))
    gains = scores.join(measured(base), "region").select("region", "voter", r6(F.col("score") - F.col("base")).alias("gain"))
    return gains.withColumn("verdict", metrics.verdict(F.col("gain"), GATES, "keep baseline"))


@plan("prediction_distribution", with_sites(VOTERS_SQL + f", m as (select {tally_sql([1, 1, 1])} as vote from vo) select vote, count(*) as n, round(100.0::double * count(*) / sum(count(*)) over (), 6) as percent from m group by vote"))
def prediction_distribution(spark, sf):
    votes = voters(spark, sf).select(voting.majority_vote([F.col(v) for v in VOTERS]).alias("vote"))
    out = groups.value_counts(votes, "vote")
    return out.select("vote", "n", r6(F.col("share") * 100).alias("percent"))


AGE_LIMITS, VARIANTS = [10, 20, 30, 40], [["none"], ["dry"], ["dry", "unknown"], ["dry", "unknown", "seasonal"]]
GRID_SQL = ", gs as (" + " union all ".join(
    f"select {a} as age_limit, {i} as variant, avg(case when status_group = (case when quantity in ({', '.join(repr(q) for q in v)}) then '{BAD}' when 2013 - nullif(construction_year, 0) > {a} then '{FIX}' else '{OK}' end) then 1.0::double else 0.0::double end) as val_score from sites"
    for a in AGE_LIMITS for i, v in enumerate(VARIANTS)) + ") "


def grid_scores(spark, sf):
    """Accuracy of a two-parameter rule for all 16 settings, in one pass."""
    age = fx.age_at_reference(fx.zero_to_null(F.col("construction_year")))
    cells = []
    for limit in AGE_LIMITS:
        for i, dry in enumerate(VARIANTS):
            guess = F.when(F.col("quantity").isin(dry), BAD).when(age > limit, FIX).otherwise(OK)
            cells.append(F.struct(F.lit(limit).alias("age_limit"), F.lit(i).alias("variant"), metrics.accuracy_of(F.col("status_group"), guess).alias("val_score")))
    return sites(spark, sf).agg(F.array(*cells).alias("g")).select(F.inline("g"))


@plan("topn_sorted", with_sites(GRID_SQL + "select age_limit, variant, round(val_score, 6) as val_score from gs order by round(val_score, 6) desc, age_limit, variant limit 3"))
def topn_sorted(spark, sf):
    return r6_all(grid_scores(spark, sf)).orderBy(F.desc("val_score"), "age_limit", "variant").limit(3)


@plan("heatmap_pivot", with_sites(GRID_SQL + "select variant, " + ", ".join(f"round(max(val_score) filter (where age_limit = {a}), 6) as age_{a}" for a in AGE_LIMITS) + " from gs group by variant"))
def heatmap_pivot(spark, sf):
    wide = grid_scores(spark, sf).groupBy("variant").pivot("age_limit", AGE_LIMITS).agg(F.max("val_score"))
    return wide.select("variant", *[r6(F.col(str(a))).alias(f"age_{a}") for a in AGE_LIMITS])


@plan("grid_stability", with_sites(GRID_SQL + "select round(min(val_score), 6) as min_score, round(max(val_score), 6) as max_score, round(stddev_samp(val_score), 6) as std_score, round(100 * (max(val_score) - avg(val_score)), 6) as best_over_mean_pp, "
    "case when stddev_samp(val_score) < 0.001 then 'stable' else 'tune' end as verdict from gs"))
def grid_stability(spark, sf):
    s = F.col("val_score")
    return grid_scores(spark, sf).agg(
        r6(F.min(s)).alias("min_score"), r6(F.max(s)).alias("max_score"), r6(F.stddev_samp(s)).alias("std_score"),
        r6((F.max(s) - F.avg(s)) * 100).alias("best_over_mean_pp"),
        F.when(F.stddev_samp(s) < 0.001, "stable").otherwise("tune").alias("verdict"))


CURVE_SQL = (VOTERS_SQL + samples_sql() + f", sz as (select unnest([{', '.join(f'{s}::double' for s in SIZES)}]) as size), "
    "cv as (select sz.size, ls.seed, count(*) as n, avg(case when vo.status_group = vo.v_quantity then 1.0::double else 0.0::double end) as base_score, "
    "avg(case when vo.status_group = vo.v_ward then 1.0::double else 0.0::double end) as rich_score from ls join vo on vo.id = ls.id join sz on ls.size <= sz.size group by sz.size, ls.seed) ")


def curve_scores(spark, sf):
    """``size, seed, n, base_score, rich_score`` over nested sub-samples.

    A row belongs to every size from its own upward: sums per (own size, seed) are
    formed first, and only those few rows are expanded.
    """
    df = voters(spark, sf)
    sampled = splits.learning_curve_samples(df, "id", "status_group", SIZES, SEEDS).drop("status_group")
    hits = [F.sum((F.col("status_group") == F.col(v)).cast("bigint")).alias(v) for v in ("v_quantity", "v_ward")]
    own = sampled.join(df, "id").groupBy("size", "seed").agg(F.count("*").alias("n"), *hits)
    sizes = F.array(*[F.lit(s) for s in SIZES])
    wider = own.withColumn("size", F.explode(F.filter(sizes, lambda s: s >= F.col("size"))))
    return wider.groupBy("size", "seed").agg(
        F.sum("n").alias("n"),
        (F.sum("v_quantity").cast("double") / F.sum("n")).alias("base_score"),
        (F.sum("v_ward").cast("double") / F.sum("n")).alias("rich_score"))


@plan("learning_curve_summary", with_sites(CURVE_SQL + "select size, round(avg(base_score), 6) as base_score, round(avg(rich_score), 6) as rich_score, round(avg(rich_score - base_score), 6) as improvement, "
    "round(stddev_pop(rich_score - base_score), 6) as improvement_std, case when round(avg(rich_score - base_score), 6) > 0.003 then 'strong' when round(avg(rich_score - base_score), 6) > 0.001 then 'weak' else 'none' end as verdict from cv group by size"))
def learning_curve_summary(spark, sf):
    gain = F.col("rich_score") - F.col("base_score")
    out = curve_scores(spark, sf).groupBy("size").agg(
        r6(F.avg("base_score")).alias("base_score"), r6(F.avg("rich_score")).alias("rich_score"),
        r6(F.avg(gain)).alias("improvement"), r6(F.stddev_pop(gain)).alias("improvement_std"))
    return out.withColumn("verdict", metrics.verdict(F.col("improvement"), [(0.003, "strong"), (0.001, "weak")], "none"))


@plan("data_efficiency", with_sites(CURVE_SQL + ", m as (select max(rich_score) as best from cv) select round(max(base_score), 6) as best_base, round(max(rich_score), 6) as best_rich, "
    "min(size) filter (where base_score > (select best from m)) as size_needed from cv"))
def data_efficiency(spark, sf):
    """Smallest size at which the plain rule beats the best enriched score; null if never."""
    scores = materialize(curve_scores(spark, sf))
    best = scores.agg(F.max("rich_score").alias("best")).scalar()
    flagged = scores.withColumn("needed", F.when(F.col("base_score") > best, F.col("size")))
    return flagged.agg(r6(F.max("base_score")).alias("best_base"), r6(F.max("rich_score")).alias("best_rich"), F.min("needed").alias("size_needed"))


@plan("runtime_projection", """with r as (select event_type, count(*) as n, cast(date_diff('second', min(ts), max(ts)) as bigint) as seconds from events group by event_type), t as (select count(*) as total from events)
  select event_type, n, seconds, round(cast(n as double) / nullif(seconds, 0), 6) as rows_per_second, round(total / (cast(n as double) / nullif(seconds, 0)) / 60, 4) as projected_minutes from r, t""")
def runtime_projection(spark, sf):
    """Time all rows would take at the pace seen per event type."""
    events = table(spark, sf, "events")
    total = events.agg(F.count("*").alias("n")).scalar()
    pace = events.groupBy("event_type").agg(
        F.count("*").alias("n"),
        (F.unix_timestamp(F.max(F.date_trunc("second", "ts"))) - F.unix_timestamp(F.min(F.date_trunc("second", "ts")))).alias("seconds"))
    rate = F.try_divide(F.col("n").cast("double"), F.col("seconds").cast("double"))
    return pace.select("event_type", "n", "seconds", r6(rate).alias("rows_per_second"), F.round(total / rate / 60, 4).alias("projected_minutes"))


@plan("progress_curve", """with h as (select date_trunc('hour', ts) as hour, count(*) as n from events group by 1),
  c as (select hour, n, cast(sum(n) over (order by hour rows unbounded preceding) as bigint) as done, row_number() over (order by hour) as batches from h), t as (select count(*) as total from events)
  select strftime(hour, '%Y-%m-%d %H') as batch_hour, n, done, round(100.0::double * done / total, 6) as percent_done, round(cast(done as double) / batches, 6) as rows_per_batch, round((total - done) / (cast(done as double) / batches), 6) as batches_left from c, t""")
def progress_curve(spark, sf):
    """Completed rows after each hourly batch, with pace and batches left."""
    events = table(spark, sf, "events")
    hourly = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    total = events.agg(F.count("*").alias("n")).scalar()
    run = running_totals(hourly, ["hour"], {"done": "n", "batches": "one"})
    pace = F.col("done").cast("double") / F.col("batches")
    return run.select(
        F.date_format("hour", "yyyy-MM-dd HH").alias("batch_hour"), "n", "done",
        r6(F.lit(100.0) * F.col("done") / total).alias("percent_done"),
        r6(pace).alias("rows_per_batch"), r6((total - F.col("done")) / pace).alias("batches_left"))
