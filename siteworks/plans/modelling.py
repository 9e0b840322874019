"""MLlib fits and experiment tables."""

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from siteworks.functions import columns as fx
from siteworks.operators import features as ft
from siteworks.operators import groups, models, splits, voting
from siteworks.operators import out_of_fold as oof
from siteworks.operators.joins import map_back, measured
from siteworks.plans.derived import BINS_SQL, HAVERSINE_SQL, PAIRS_SQL, YEARS_SQL
from siteworks.plans.encoding import SEEDS, SIZES, folds_sql, samples_sql, split_sql
from siteworks.plans.registry import plan, r6_all
from siteworks.session import materialize, scratch_path
from siteworks.sources.sites import sites, with_sites
from siteworks.sources.tables import read_csv_typed, write_csv

KEEP = ["id", "status_group"]
SMALL = ["amount_tsh", "population", "latitude", "longitude", "asset_age", "quantity_encoded", "ward_encoded"]


def split_of(df):
    return splits.stratified_split(df.select("id", "status_group"), "id", "status_group", 0.2, 42).drop("status_group")


def prepared(spark, sf, names, geo=False, train_only=False):
    """Feature columns and split, stored once.

    By default statistics come from all rows, as the reported scores do. With ``train_only`` the
    statistics, codes and neighbours of held-out rows come from the training rows alone. The rows are
    spread first: a compact table is read by few tasks, which would compute all features of all rows.
    """
    df = models.training_rows(sites(spark, sf))
    split = materialize(split_of(df))
    if train_only:
        rows = materialize(df.join(split, "id"))
        train, held = (rows.where(F.col("split") == part).drop("split") for part in ("train", "validation"))
        full = ft.full_features(train).unionByName(ft.full_features(held, train))
    else:
        full = ft.full_features(df) if geo else ft.add_codes(ft.add_columns(df))
    return models.training_rows(models.feature_frame(full, names, KEEP).join(split, "id"))


def fitted(data, names, estimator):
    """Predictions for all rows, with their split."""
    model = models.fit_model(data.where("split = 'train'"), names, estimator)
    return models.predict(model, data, [*KEEP, "split"])


#: What can be said of predictions without the model: every held-out row has one, it is a class, and the model knows more than which class is most frequent.
HELD_SQL = with_sites(split_sql(0.2, 42) + "select status_group, count(*) as n_rows, count(distinct id) as n_ids, count(*) as n_in_classes, "
    "round(cast(max(count(*)) over () as double) / sum(count(*)) over (), 6) as majority_share, true as beats_majority from sp where split = 'validation' group by status_group")

#: Held-out rows from which their score says something: with fewer, chance may put any model below the most frequent class.
ENOUGH = 100


def beats(score, majority, n=None):
    """Whether a score is above that of the most frequent class; ``n`` rows below ``ENOUGH`` say nothing."""
    above = F.coalesce(score > majority, F.lit(False))
    return above if n is None else above | (n < ENOUGH)


def held_rows(predictions, knows=None):
    """Rows, ids and predicted classes of the held-out part, per true class.

    ``beats_majority``: on the training rows, and on the held-out ones if they are enough, more
    predictions are right than if the most frequent class were always answered. ``knows`` replaces that test.
    """
    rows = materialize(predictions.withColumn("right", (F.col("prediction_label") == F.col("status_group")).cast("int")))
    classes = rows.groupBy("split", "status_group").agg(F.count("*").alias("n"), F.sum("right").alias("right"))
    parts = classes.groupBy("split").agg(F.sum("n").alias("n"), (F.sum("right") / F.sum("n")).alias("score"), (F.max("n") / F.sum("n")).alias("majority"))
    one = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    better = beats(one("train", "score"), one("train", "majority")) & beats(one("validation", "score"), one("validation", "majority"), one("validation", "n"))
    summary = parts.agg(F.struct(F.round(one("validation", "majority"), 6).alias("majority"), better.alias("better")).alias("s")).scalar()
    known = F.col("prediction_label").isin(*voting.CLASSES)
    held = rows.where("split = 'validation'").groupBy("status_group").agg(
        F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_if(known).alias("n_in_classes"))
    return held.withColumns({"majority_share": summary["majority"], "beats_majority": summary["better"] if knows is None else F.lit(knows)})


@plan("rf_predict", HELD_SQL)
def rf_predict(spark, sf):
    names = [*ft.BASE, *ft.GEO, *ft.INTERACTIONS]
    return held_rows(fitted(prepared(spark, sf, names, geo=True), names, models.random_forest(**models.FOREST_SETTINGS["base"])))


@plan("rf_predict_train_only", HELD_SQL)
def rf_predict_train_only(spark, sf):
    """The same, no label of a held-out row being in any feature."""
    names = [*ft.BASE, *ft.GEO, *ft.INTERACTIONS]
    return held_rows(fitted(prepared(spark, sf, names, train_only=True), names, models.random_forest()))


@plan("gbt_ovr_predict", HELD_SQL)
def gbt_ovr_predict(spark, sf):
    return held_rows(fitted(prepared(spark, sf, SMALL), SMALL, models.boosted_trees()))


@plan("logreg_predict", HELD_SQL)
def logreg_predict(spark, sf):
    """Category codes are not in any order a straight line could use, so scores say little: the test is that the training rows' mean log
    likelihood is above what the class shares alone give, and that mean probabilities equal the class shares, as they do at the optimum."""
    data = prepared(spark, sf, ft.BASE)
    train = data.where("split = 'train'")
    model = models.fit_model(train, ft.BASE, models.logistic_regression())
    shares = models.predict_probabilities(model, train, KEEP)
    own = F.element_at(F.array("p_0", "p_1", "p_2"), F.array_position(F.array(*[F.lit(c) for c in sorted(voting.CLASSES)]), F.col("status_group")).cast("int"))
    n = lambda c: F.count_if(F.col("status_group") == c) / F.count("*")
    got = shares.agg(
        F.avg(F.log(own)).alias("likelihood"),
        *[n(c).alias(f"n_{i}") for i, c in enumerate(sorted(voting.CLASSES))],
        *[F.avg(f"p_{i}").alias(f"m_{i}") for i in range(3)],
    ).first()
    entropy = sum(got[f"n_{i}"] * math.log(got[f"n_{i}"]) for i in range(3) if got[f"n_{i}"])
    knows = got.likelihood > entropy + 1e-6 and all(abs(got[f"n_{i}"] - got[f"m_{i}"]) < 1e-3 for i in range(3))
    return held_rows(models.predict(model, data, [*KEEP, "split"]), knows)


@plan("mlp_predict", HELD_SQL)
def mlp_predict(spark, sf):
    return held_rows(fitted(prepared(spark, sf, ft.BASE), ft.BASE, models.neural_net(len(ft.BASE))))


def extra_trees(trees=150):
    return models.random_forest(trees, bootstrap=False, featureSubsetStrategy="sqrt")


@plan("rf_nobootstrap", HELD_SQL)
def rf_nobootstrap(spark, sf):
    return held_rows(fitted(prepared(spark, sf, SMALL), SMALL, extra_trees()))


@plan("rf_weighted", HELD_SQL)
def rf_weighted(spark, sf):
    """Newer rows weigh more."""
    data = prepared(spark, sf, [*SMALL, "days_since_recorded"])
    ends = data.agg(F.struct(F.min("days_since_recorded").alias("lo"), F.max("days_since_recorded").alias("hi")).alias("s")).first().s
    weighted = data.withColumn("weight", fx.recency_weight(F.col("days_since_recorded"), F.lit(ends.lo), F.lit(ends.hi)))
    return held_rows(fitted(weighted, SMALL, models.random_forest(**models.FOREST_SETTINGS["tuned"], weight="weight")))


@plan("rf_balanced", HELD_SQL)
def rf_balanced(spark, sf):
    """Each class weighs the same in total."""
    data = prepared(spark, sf, SMALL)
    train = data.where("split = 'train'")
    counts = measured(train.groupBy("status_group").agg(F.count("*").alias("n_class")))
    total = train.count()
    weights = counts.withColumn("weight", F.lit(float(total)) / (F.lit(3) * F.col("n_class")))
    model = models.fit_model(train.join(weights, "status_group"), SMALL, models.random_forest(weight="weight"))
    return held_rows(models.predict(model, data, [*KEEP, "split"]))


# --- ensembles of fitted models

#: Probability columns of voter n, by class index (classes in alphabetic order).
def _p(n):
    return [F.col(f"v{n}_p{i}") for i in range(3)]


def fitted_voters(spark, sf):
    """Labels and class probabilities of four fitted models on the held-out rows, stored."""
    data = prepared(spark, sf, SMALL)
    train, held = data.where("split = 'train'"), data.where("split = 'validation'")
    estimators = [models.random_forest(), extra_trees(), models.logistic_regression(), models.neural_net(len(SMALL))]
    out = held.select(*KEEP)
    for n, model in enumerate(models.in_parallel(lambda e: models.fit_model(train, SMALL, e), estimators)):
        label = models.predict(model, held, ["id"], f"v{n}")
        shares = models.predict_probabilities(model, held, ["id"]).withColumnsRenamed({f"p_{i}": f"v{n}_p{i}" for i in range(3)})
        out = out.join(label, "id").join(shares, "id")
    return materialize(out)


def tally(column, weights):
    """SQL: weight of the voters that agree with a voter's column."""
    return " + ".join(f"if(v{n} = {column}, {w}, 0)" for n, w in enumerate(weights))


def vote_text(weights):
    """SQL: the label with most weight, the earliest voter first among equals."""
    sums = [tally(f"v{n}", weights) for n in range(len(weights))]
    best = f"greatest({', '.join(sums)})"
    return "case " + " ".join(f"when {s} = {best} then v{n}" for n, s in enumerate(sums)) + " end"


def blend_text(weights):
    """SQL: the class with the largest weighted probability, the first class first among equals."""
    sums = ["round(" + " + ".join(f"{w}D * v{n}_p{i}" for n, w in enumerate(weights)) + ", 9)" for i in range(3)]
    best = f"greatest({', '.join(sums)})"
    return "case " + " ".join(f"when {s} = {best} then '{c}'" for s, c in zip(sums, voting.CLASSES)) + " end"


@plan("fitted_ensembles", with_sites(split_sql(0.2, 42) + "select status_group, count(*) as n_rows, count(*) as n_majority, count(*) as n_weighted, count(*) as n_average, count(*) as n_soft_3, count(*) as n_soft_4 "
    "from sp where split = 'validation' group by status_group"))
def fitted_ensembles(spark, sf):
    """Votes and blends of fitted models; each count says how many rows SQL on the stored columns agrees on."""
    v = fitted_voters(spark, sf)
    three = [F.col(f"v{n}") for n in range(3)]
    columns = {
        "n_majority": (voting.majority_vote(three), vote_text([1, 1, 1])),
        "n_weighted": (voting.weighted_vote(three, voting.LABEL_WEIGHTS), vote_text(voting.LABEL_WEIGHTS)),
        "n_average": (voting.best_class(voting.blend([_p(n) for n in range(3)], [1.0, 1.0, 1.0])), blend_text([1.0, 1.0, 1.0])),
        "n_soft_3": (voting.best_class(voting.blend([_p(n) for n in range(3)], voting.SOFT_WEIGHTS_3)), blend_text(voting.SOFT_WEIGHTS_3)),
        "n_soft_4": (voting.best_class(voting.blend([_p(n) for n in range(4)], voting.SOFT_WEIGHTS_4)), blend_text(voting.SOFT_WEIGHTS_4)),
    }
    return v.groupBy("status_group").agg(F.count("*").alias("n_rows"), *[F.count_if(made == F.expr(text)).alias(name) for name, (made, text) in columns.items()])


@plan("fitted_prediction_export", with_sites(split_sql(0.2, 42) + "select id, true as is_class from sp where split = 'validation'"))
def fitted_prediction_export(spark, sf):
    """The majority of the fitted models as an ``id, label`` CSV, read back."""
    path = scratch_path(spark, "fitted-submission")
    three = [F.col(f"v{n}") for n in range(3)]
    write_csv(fitted_voters(spark, sf).select("id", voting.majority_vote(three).alias("status_group")), path)
    return read_csv_typed(spark, path, "id bigint, status_group string").select("id", F.col("status_group").isin(*voting.CLASSES).alias("is_class"))


# --- importances

FEATURES_SQL = "(select unnest([" + ", ".join(f"'{f}'" for f in ft.BASE) + "]) as feature)"


def forest_importances(spark, sf):
    data = prepared(spark, sf, ft.BASE)
    return models.importances(models.fit_model(data.where("split = 'train'"), ft.BASE, models.random_forest()), ft.BASE)


#: Three columns that a forest can use and one that is the same in every row: its share is nothing.
KNOWN_SHARES = ["quantity_encoded", "water_quality_encoded", "ward_encoded", "constant"]


@plan("fitted_importance_export", with_sites("select unnest([1, 2, 3, 4]) as place, true as is_sorted, true as is_share, 1.0::double as total, true as constant_is_last from (select count(*) as n from sites) t where n > 0"))
def fitted_importance_export(spark, sf):
    """Shares of a fitted forest, written as CSV in descending order and read back by position."""
    names = KNOWN_SHARES[:3]
    data = prepared(spark, sf, names).withColumn("constant", F.lit(1.0))
    model = models.fit_model(data.where("split = 'train'"), KNOWN_SHARES, models.random_forest())
    path = scratch_path(spark, "fitted-importance")
    write_csv(models.importances(model, KNOWN_SHARES).orderBy(F.desc("importance"), "feature").coalesce(1), path)
    rows = read_csv_typed(spark, path, "feature string, importance double").withColumn("place", (F.monotonically_increasing_id() + 1).cast("int"))
    rows = materialize(rows)
    total = rows.agg(F.round(F.sum("importance"), 6)).scalar()
    # As many rows as a model has features.
    before = F.coalesce(F.lag("importance").over(Window.orderBy("place")), F.lit(1.0))
    last = (F.col("place") < 4) | ((F.col("feature") == "constant") & (F.col("importance") == 0))
    return rows.select("place", (F.col("importance") <= before).alias("is_sorted"), F.col("importance").between(0, 1).alias("is_share"), total.alias("total"), last.alias("constant_is_last"))


@plan("rf_importances", with_sites(f"select feature, true as is_share, 1.0::double as total, (select count(*) from sites) > 0 as has_rows from {FEATURES_SQL} f"))
def rf_importances(spark, sf):
    """Every feature with its share of the fitted forest; the shares add up to one."""
    path = scratch_path(spark, "forest-importance")
    write_csv(forest_importances(spark, sf).orderBy(F.desc("importance"), "feature"), path)
    rows = read_csv_typed(spark, path, "feature string, importance double")
    total = rows.agg(F.round(F.sum("importance"), 6)).scalar()
    return rows.select("feature", F.col("importance").between(0, 1).alias("is_share"), total.alias("total"), F.lit(True).alias("has_rows"))


PLACE = "^(latitude|longitude|gps_height)"


@plan("rf_importance_by_family", with_sites(f"select case when regexp_matches(feature, '{PLACE}') then 'location' when feature like '%encoded' then 'category' else 'other' end as family, "
    f"count(*) as n_features, 1.0::double as total from {FEATURES_SQL} f, (select count(*) as n from sites) t where n > 0 group by 1"))
def rf_importance_by_family(spark, sf):
    """Fitted shares summed by name pattern; ``total`` is the sum over all families."""
    family = F.when(F.col("feature").rlike(PLACE), "location").when(F.col("feature").endswith("encoded"), "category").otherwise("other")
    sums = materialize(forest_importances(spark, sf).groupBy(family.alias("family")).agg(F.count("*").alias("n_features"), F.sum("importance").alias("share")))
    return sums.select("family", "n_features", sums.agg(F.round(F.sum("share"), 6)).scalar().alias("total"))


# --- experiments: every cell is fitted, and SQL knows the rows that it was fitted and scored on

FOLDS = 5
#: Features that depend on labels or neighbours: one column for each fold that may be held out.
BY_FOLD = [*ft.GEO, "ward_age_interact", "neighbor_time_interact"]
PLAIN = [*ft.BASE, "quantity_quality_interact"]


def fold_lists(spark, sf):
    """Rows with their fold and, as lists by held-out fold, the statistics of wards and neighbours outside it."""
    folded = materialize(splits.stratified_folds(sites(spark, sf), "id", "status_group", FOLDS, 42))
    wards = oof.out_of_fold_ward_statistics(folded, "fold", FOLDS)
    rates = oof.out_of_fold_neighbor_rate(folded, "fold", FOLDS)
    return map_back(wards, rates, "id", {"neighbor_functional_ratio": F.array_repeat(F.lit(0.5), FOLDS)})


def by_fold(lists, columns):
    """A row for each row and held-out fold."""
    each = lists.select("id", F.posexplode(F.arrays_zip(*columns)).alias("fold", "v"))
    return r6_all(each.select("id", "fold", *[F.col(f"v.{c}").alias(c) for c in columns]))


def per_fold(body):
    """SQL: the same text for the rows outside each fold, as ``kn``, united."""
    return " union all ".join("(" + body.replace("{f}", str(f)) + ")" for f in range(FOLDS))


@plan("out_of_fold_wards", with_sites(folds_sql(FOLDS, 42) + ", sf as (select s.*, fo.fold from sites s join fo on fo.id = s.id) " + per_fold(
    "with kn as (select * from sf where fold <> {f}), w as (select ward, count(latitude) as n, avg(case when status_group = 'functional' then 1.0::double else 0.0::double end) as rate from kn where ward is not null group by ward), "
    "m as (select median(n) as middle from w) select s.id, {f} as fold, round(coalesce(cast(w.n as double), middle), 6) as ward_site_count, round(coalesce(w.rate, 0.5), 6) as ward_functional_ratio "
    "from sf s left join w on s.ward = w.ward, m")))
def out_of_fold_wards(spark, sf):
    """Ward statistics of the rows outside each fold, from one aggregation."""
    folded = materialize(splits.stratified_folds(sites(spark, sf), "id", "status_group", FOLDS, 42))
    return by_fold(oof.out_of_fold_ward_statistics(folded, "fold", FOLDS), ["ward_site_count", "ward_functional_ratio"])


@plan("out_of_fold_neighbors", with_sites(folds_sql(FOLDS, 42) + ", sf as (select s.*, fo.fold from sites s join fo on fo.id = s.id), kq as (select * from sf where latitude <> 0 and longitude <> 0), " + (
    f"pr as (select a.id, b.fold, b.status_group, round({HAVERSINE_SQL.format(a='a', b='b')}, 9) as d, b.id as nbr_id from kq a join kq b on a.id <> b.id), "
    "c as (select *, row_number() over (partition by id order by d, nbr_id) as rn from pr), near as (select * from c where rn <= 60), ") + "r as (" + per_fold(
    "select id, {f} as fold, avg(case when status_group = 'functional' then 1.0::double else 0.0::double end) as rate from "
    "(select *, row_number() over (partition by id order by d, nbr_id) as rk from near where fold <> {f}) t where rk <= 10 group by id") + ") "
    "select s.id, z.f as fold, round(coalesce(r.rate, 0.5), 6) as neighbor_functional_ratio from sites s cross join (select unnest([0, 1, 2, 3, 4]) as f) z left join r on r.id = s.id and r.fold = z.f"))
def out_of_fold_neighbors(spark, sf):
    """Share of functional rows among the ten nearest outside each fold, from one search."""
    folded = materialize(splits.stratified_folds(sites(spark, sf), "id", "status_group", FOLDS, 42))
    rates = oof.out_of_fold_neighbor_rate(folded, "fold", FOLDS)
    lists = map_back(folded.select("id"), rates, "id", {"neighbor_functional_ratio": F.array_repeat(F.lit(0.5), FOLDS)})
    return by_fold(lists, ["neighbor_functional_ratio"])


@plan("rf_cv", with_sites(folds_sql(FOLDS, 42) + ", fc as (select fold, status_group, count(*) as n from fo group by fold, status_group) "
    "select fold, cast(sum(n) as bigint) as n_rows, round(cast(max(n) as double) / sum(n), 6) as majority_share, true as beats_majority from fc group by fold"))
def rf_cv(spark, sf):
    """The full feature list; no statistic of wards or neighbours sees the fold that is held out."""
    rows = ft.add_codes(ft.add_columns(fold_lists(spark, sf)))
    rows = rows.withColumn("quantity_quality_interact", F.col("quantity_encoded") * F.col("water_quality_encoded"))
    spread = {}
    for f in range(FOLDS):
        own = {c: F.col(c)[f] for c in ft.GEO}
        own |= {"ward_age_interact": own["ward_functional_ratio"] * F.col("asset_age"), "neighbor_time_interact": own["neighbor_functional_ratio"] * F.col("days_since_recorded")}
        spread |= {f"{c}_{f}": own[c] for c in BY_FOLD}
    names = [*PLAIN, *spread]
    table = models.ExperimentTable(models.feature_frame(rows.withColumns(spread), names, [*KEEP, "fold"]), names)
    scores = models.cross_validate(table, lambda f: [*PLAIN, *[f"{c}_{f}" for c in BY_FOLD]], models.random_forest(), FOLDS)
    better = beats(F.col("train_score"), F.col("train_majority")) & beats(F.col("score"), F.col("majority"), F.col("n_rows"))
    return scores.select("fold", "n_rows", F.round("majority", 6).alias("majority_share"), better.alias("beats_majority"))


SETS = {
    "base": ft.BASE,
    "base+geo": [*ft.BASE, *ft.GEO],
    "base+ratings": [*ft.BASE, *ft.RATED],
    "all": [*ft.BASE, *ft.GEO, *ft.INTERACTIONS, *ft.RATED],
}


def sets_sql(sets, least=0):
    listed = " union all ".join(f"select '{n}' as config, {len(f)} as n_features" for n, f in sets.items())
    enough = f"(select count(*) from sp where split = 'train') >= {least}"
    majority = "(select round(cast(max(n) as double) / sum(n), 6) from (select count(*) as n from sp where split = 'train' group by status_group) t)"
    return with_sites(split_sql(0.2, 42) + f"select config, n_features, case when {enough} then 'fitted' else 'too few rows' end as outcome, case when {enough} then true end as is_gap, "
        f"case when {enough} then {majority} end as majority_share, case when {enough} then true end as beats_majority from ({listed}) c")


def outcomes(scores):
    gap = F.abs(F.col("train_score") - F.col("val_score") - F.col("gap")) < 1e-12
    fitted_one = F.col("outcome") == "fitted"
    return scores.select(
        "config", "n_features", "outcome", (gap & F.col("val_score").between(0, 1) & F.col("train_score").between(0, 1)).alias("is_gap"),
        F.round("train_majority", 6).alias("majority_share"), F.when(fitted_one, beats(F.col("train_score"), F.col("train_majority"))).alias("beats_majority"))


def on_split(spark, sf, names, geo=False):
    """All rows of an experiment on the 80/20 split, and the conditions that select its two parts."""
    df = models.training_rows(sites(spark, sf))
    full = ft.full_features(df) if geo else ft.add_codes(ft.add_columns(df))
    table = models.ExperimentTable(models.feature_frame(full, names, KEEP).join(split_of(df), "id"), names)
    return table, F.col("split") == "train", F.col("split") == "validation"


@plan("ablation_grid", sets_sql(SETS))
def ablation_grid(spark, sf):
    """Feature families on and off, on one split."""
    table, train, held = on_split(spark, sf, SETS["all"], geo=True)
    return outcomes(models.evaluate_sets(table, SETS, models.random_forest(), train, held))


#: The recorded grid.
GRID_TREES, GRID_SEEDS = [50, 100, 200, 300], [42, 43, 456, 789]


@plan("param_grid", with_sites(split_sql(0.2, 42) + f", g as (select n_trees, unnest({GRID_SEEDS}) as seed from (select unnest({GRID_TREES}) as n_trees) t) "
    "select n_trees, seed, (select count(*) from sp where split = 'validation') as n_rows, (select round(cast(max(n) as double) / sum(n), 6) from (select count(*) as n from sp where split = 'validation' group by status_group) t) as majority_share, "
    "true as beats_majority from g"))
def param_grid(spark, sf):
    """The recorded grid on the full feature list; every cell reads the same stored table."""
    names = [*ft.BASE, *ft.GEO, *ft.INTERACTIONS]
    table, train, held = on_split(spark, sf, names, geo=True)

    def cell(at):
        got = table.scores(table.fit(train, names, models.random_forest(at[0], seed=at[1])), train=train, held=held)
        return (*at, *got["train"][1:], *got["held"])

    cells = models.in_parallel(cell, [(trees, seed) for trees in GRID_TREES for seed in GRID_SEEDS], table.at_once(models.random_forest()))
    rows = spark.createDataFrame(cells, "n_trees int, seed int, train_score double, train_majority double, n_rows bigint, score double, majority double")
    better = beats(F.col("train_score"), F.col("train_majority")) & beats(F.col("score"), F.col("majority"), F.col("n_rows"))
    return rows.select("n_trees", "seed", "n_rows", F.round("majority", 6).alias("majority_share"), better.alias("beats_majority"))


#: The recorded forests of these two experiments; MLlib's trees are at most 30 deep.
SINGLE_SETTINGS = {"trees": 300, "seed": 456}
CURVE_SETTINGS = {"trees": 100, "depth": 30}
SINGLE = {"base": SMALL, **{name: [*SMALL, name] for name in ft.RATED}}


@plan("single_feature_eval", sets_sql(SINGLE, 1000))
def single_feature_eval(spark, sf):
    """Each rating alone beside the base list; with fewer than 1,000 training rows nothing is fitted, and the row says so."""
    table, train, held = on_split(spark, sf, [*SMALL, *ft.RATED])
    return outcomes(models.evaluate_sets(table, SINGLE, models.random_forest(**SINGLE_SETTINGS), train, held, min_rows=1000))


@plan("learning_curve", with_sites(samples_sql() + f", z as (select size, unnest({SEEDS}) as seed from (select unnest([{', '.join(f'{x}::double' for x in SIZES)}]) as size) t), "
    "o as (select seed, (select count(*) from sites) - count(*) as n_held from ls group by seed) "
    "select z.size, z.seed, (select count(*) from ls where ls.seed = z.seed and ls.size <= z.size) as n_train, o.n_held, true as beats_majority from z join o on o.seed = z.seed"))
def learning_curve(spark, sf):
    """Plain and enriched forests on growing sub-samples, scored on the rows outside all of a seed's samples.

    A cell's sample is a condition on one stored table: no sample is copied. A sample without one of the classes is not fitted.
    """
    names = [*SMALL, *ft.RATED]
    full = ft.add_codes(ft.add_columns(models.training_rows(sites(spark, sf))))
    sampled = splits.learning_curve_samples(full.select(*KEEP), "id", "status_group", SIZES, SEEDS)
    by_seed = sampled.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("seed", "size"))).alias("from_size"))
    table = models.ExperimentTable(models.feature_frame(full, names, KEEP).join(by_seed, "id", "left"), names)
    counts = sampled.groupBy("seed", "size", "status_group").count().collect()  # at most seeds x sizes x classes rows

    def cell(at):
        size, seed = at
        first = F.col("from_size")[seed]
        train, held = F.coalesce(first <= size, F.lit(False)), first.isNull()
        inside = [r for r in counts if r["seed"] == seed and r["size"] <= size]
        if len({r["status_group"] for r in inside}) < len(voting.CLASSES):
            return (size, seed, sum(r["count"] for r in inside), None, None, None, None)
        got = [table.scores(table.fit(train, chosen, models.random_forest(**CURVE_SETTINGS, seed=seed)), train=train, held=held) for chosen in (SMALL, names)]
        return (size, seed, got[0]["train"][0], got[0]["held"][0], got[0]["train"][2], got[0]["train"][1], got[1]["train"][1])

    cells = models.in_parallel(cell, [(size, seed) for size in SIZES for seed in SEEDS], table.at_once(models.random_forest()))
    rows = spark.createDataFrame(cells, "size double, seed int, n_train bigint, n_held bigint, majority double, base_score double, rich_score double")
    outside = table.rows.select(F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("of"), "from_size").where(F.col("from_size")[F.col("of")].isNull()).groupBy("of").agg(F.count("*").alias("outside"))
    better = F.coalesce((F.col("base_score") > F.col("majority")) & (F.col("rich_score") > F.col("majority")), F.lit(True))
    # Every fitted cell's own count of held-out rows must agree with the table's.
    agree = F.coalesce(F.col("n_held") == F.col("outside"), F.lit(True))
    return rows.join(outside, F.col("seed") == F.col("of")).select("size", "seed", "n_train", F.col("outside").alias("n_held"), (better & agree).alias("beats_majority"))


@plan("score_new_rows", with_sites("select count(*) as n_rows, count(distinct id) as n_ids, count(*) as n_in_classes from sites where construction_year = 0"))
def score_new_rows(spark, sf):
    """Unlabelled assets, scored with statistics, codes and model of the labelled ones only."""
    names = [*ft.BASE, *ft.GEO, *ft.INTERACTIONS]
    df = sites(spark, sf)
    known = df.where("construction_year > 0")
    new = df.where("construction_year = 0").drop("status_group")
    train = models.training_rows(models.feature_frame(ft.full_features(known), names, KEEP))
    model = models.fit_model(train, names, models.random_forest())
    rows = models.feature_frame(ft.full_features(new, known), names, ["id"])
    scored = models.predict(model, rows, ["id"], "status_group")
    return scored.agg(F.count("*").alias("n_rows"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("status_group").isin(*voting.CLASSES)).alias("n_in_classes"))


@plan("stage_timing")
def stage_timing(spark, sf):
    df = sites(spark, sf)
    stages = {"scan": df, "columns": ft.add_columns(df), "codes": ft.add_codes(df), "wards": groups.add_ward_statistics(df)}
    return models.timed(stages)


#: Columns that each stage adds to the 25 given ones, in order, with the SQL of each.
GROWTH = {
    "interactions": {
        "ward_centroid_distance": "sqrt((s.latitude - c.lat) * (s.latitude - c.lat) + (s.longitude - c.lon) * (s.longitude - c.lon))",
        "coordination": "cast(p.n as double) / t.top",
        "elevation_people": "gps_height * population",
    },
    "temporal": {
        "season": "quarter(date_recorded)",
        "dry_season": "cast(month(date_recorded) between 6 and 9 as int)",
        "years_in_service": YEARS_SQL,
        "age_category": f"(select length({BINS_SQL}) from (select {YEARS_SQL} as y))",
    },
    "text": {f"{c}_{what}": sql.format(c=f"coalesce({c}, 'nan')") for c in ("scheme_name", "installer", "funder") for what, sql in {
        "words": "len(string_split(trim({c}), ' '))", "chars": "length({c})", "digits": "cast(regexp_matches({c}, '[0-9]') as int)"}.items()},
    "full": {"very_old": "cast(2013 - nullif(construction_year, 0) > 40 as int)", "future": "cast(2013 - nullif(construction_year, 0) < 0 as int)"},
}


def growth_sql():
    """Every added column over all rows: known values and their sum (of lengths, for text)."""
    parts, width = ["select 'original' as stage, 25 as n_columns, '' as feature, count(*) as n_known, 0.0::double as total from sites"], 25
    for stage, columns in GROWTH.items():
        width += len(columns)
        parts += [f"select '{stage}', {width}, '{c}', count({c}), round(coalesce(sum(cast({c} as double)), 0), 4) from wide" for c in columns]
    joined = ", ".join(f"{GROWTH['interactions'][c]} as {c}" for c in ("ward_centroid_distance", "coordination"))
    own = ", ".join(f"{sql} as {c}" for columns in GROWTH.values() for c, sql in columns.items() if c not in joined)
    return with_sites(PAIRS_SQL + ", c as (select ward, avg(latitude) as lat, avg(longitude) as lon from sites group by ward), "
        f"far as (select s.*, {joined} from sites s left join c on s.ward = c.ward left join p on s.installer = p.installer and s.funder = p.funder, t), "
        f"wide as (select ward_centroid_distance, coordination, {own} from far) " + " union all ".join(parts))


@plan("feature_growth", growth_sql())
def feature_growth(spark, sf):
    """Width of the table after each feature family; each column that a stage adds with its known values and their sum over all rows."""
    from siteworks.functions import text

    df = sites(spark, sf)
    years = fx.years_in_service(F.col("date_recorded"), F.col("construction_year"))

    def interactions(t):
        pairs = groups.pair_shares(t, "installer", "funder", "coordination").drop("pair_rows")
        out = groups.join_back(groups.centroid_distance(t, "ward").drop("centre_lat", "centre_lon"), pairs, ["installer", "funder"])
        return out.withColumn("elevation_people", F.col("gps_height") * F.col("population"))

    def temporal(t):
        return t.withColumns({"season": F.quarter("date_recorded"), "dry_season": fx.is_dry_season(F.col("date_recorded")),
                              "years_in_service": years, "age_category": fx.age_bin(years)})

    def texts(t):
        cols = {}
        for c in ("scheme_name", "installer", "funder"):
            cols[f"{c}_words"] = text.word_count(F.col(c))
            cols[f"{c}_chars"] = text.text_length(F.col(c))
            cols[f"{c}_digits"] = text.has_digits(F.col(c))
        return t.withColumns(cols)

    def anomalies(t):
        age = fx.age_at_reference(fx.zero_to_null(F.col("construction_year")))
        return t.withColumns({"very_old": (age > 40).cast("int"), "future": (age < 0).cast("int")})

    current, added = df, [("original", len(df.columns), "", F.lit(1))]
    for stage, add in [("interactions", interactions), ("temporal", temporal), ("text", texts), ("full", anomalies)]:
        before = set(current.columns)
        current = current.transform(add)
        kinds = dict(current.dtypes)
        for c in current.columns:
            if c not in before:
                added.append((stage, len(current.columns), c, F.length(c) if kinds[c] == "string" else F.col(c)))
    # One pass over the widest table; each of its columns is evaluated.
    entries = F.array(*[
        F.struct(
            F.lit(stage).alias("stage"), F.lit(width).alias("n_columns"), F.lit(name).alias("feature"), F.count(c).alias("n_known"),
            (F.coalesce(F.round(F.sum(c.cast("double")), 4), F.lit(0.0)) if name else F.lit(0.0)).alias("total"),
        )
        for stage, width, name, c in added
    ])
    return current.agg(entries.alias("e")).select(F.inline("e"))
