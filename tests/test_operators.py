import hashlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from siteworks.functions import columns as fx
from siteworks.functions import ratings, text
from siteworks.operators import encode, enrich, groups, metrics, models, ordering, quantiles, splits, voting
from siteworks.operators.impute import impute
from siteworks.operators.voting import CLASSES


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


# --- quantiles and ranks ---------------------------------------------------

@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [0.0] * 70 + list(range(1, 31)), list(np.random.default_rng(1).normal(size=4001)), [5.0] * 50, [0.0] * 50 + list(range(1, 51)),
], ids=["one", "two", "mostly zero", "normal", "constant", "half zero"])
def test_quantiles_are_exact(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    row = quantiles.exact_quantiles(df, "v", {"a": 0.5, "b": 0.99, "c": 0.0, "d": 1.0}).first()
    assert [row.a, row.b, row.c, row.d] == pytest.approx(list(np.quantile(values, [0.5, 0.99, 0, 1])))


def test_quantiles_per_group_ignore_nulls_and_keep_hot_groups_exact(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.choice(["hot", "a", "b"], 3000, p=[0.9, 0.07, 0.03]), "v": rng.normal(size=3000)})
    df = spark.createDataFrame(frame).unionByName(spark.createDataFrame([("a", None), ("none", None)], "g string, v double"))
    got = {r.g: r.m for r in quantiles.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()}
    assert got == pytest.approx(frame.groupby("g").v.median().to_dict())


def test_quantile_of_nothing_is_null(spark):
    df = spark.createDataFrame([], "v double")
    assert quantiles.exact_median(df, "v").first().median is None


def test_positions_follow_the_order(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = {r.k: r.position for r in ordering.ordered_positions(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(5000)}


def test_running_totals(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(100)], "k int, v int").repartition(5)
    got = {r.k: r.total for r in ordering.running_totals(df, ["k"], {"total": "v"}).collect()}
    assert got == {k: sum(i * i for i in range(k + 1)) for k in range(100)}


# --- splits ----------------------------------------------------------------

def digest(key, seed):
    return hashlib.md5(f"{key}-{seed}".encode()).hexdigest()


def labelled(spark, n=400):
    return spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(n)] + [(n, "lonely")], "id bigint, y string")


def test_split_takes_the_smallest_hashes_of_each_class(spark):
    rows = splits.stratified_split(labelled(spark), "id", "y", 0.2, 5).collect()
    taken = defaultdict(set)
    members = defaultdict(list)
    for r in rows:
        members[r.y].append(r.id)
        if r.split == "validation":
            taken[r.y].add(r.id)
    for y, ids in members.items():
        want = sorted(ids, key=lambda i: digest(i, 5))[: int(len(ids) * 0.2 + 0.5)]
        assert taken[y] == set(want)
    assert taken["lonely"] == set()


def test_split_is_the_same_twice_and_changes_with_the_seed(spark):
    def chosen(seed):
        return {r.id for r in splits.stratified_split(labelled(spark), "id", "y", 0.2, seed).where("split = 'validation'").collect()}

    assert chosen(1) == chosen(1) != chosen(2)


def test_folds_are_even_within_classes(spark):
    rows = splits.stratified_folds(labelled(spark), "id", "y", 5, 3).collect()
    counts = Counter((r.y, r.fold) for r in rows)
    for y in ("big", "small"):
        sizes = [counts[(y, f)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1 and min(sizes) > 0


def test_learning_curve_samples_are_nested_and_exact(spark):
    rows = splits.learning_curve_samples(labelled(spark), "id", "y", [0.05, 0.1], [1, 2]).collect()
    for seed in (1, 2):
        for size, want in ((0.05, 18 + 2), (0.1, 36 + 4)):
            assert sum(r.seed == seed and r.size <= size for r in rows) == want


# --- encoders --------------------------------------------------------------

def test_codes_sort_as_text_with_python_booleans_and_nan(spark):
    df = spark.createDataFrame([(1, True, 10), (2, False, 2), (3, None, 1)], "id bigint, b boolean, n int")
    got = {r.id: (r.b_encoded, r.n_encoded) for r in encode.label_encode(df, ["b", "n"]).collect()}
    assert got == {1: (1, 1), 2: (0, 2), 3: (2, 0)}


@pytest.mark.parametrize("known,code", [(["a", "unknown"], 1), (["a", "b"], -1)])
def test_unseen_value_with_literal(spark, known, code):
    fit = spark.createDataFrame([(k,) for k in known], "c string")
    dictionary = encode.fit_dictionary(fit, ["c"])
    rows = spark.createDataFrame([(1, "zzz")], "id bigint, c string")
    assert encode.apply_with_literal(rows, dictionary, "c", "x").first().x == code


def test_extending_keeps_known_codes(spark):
    dictionary = encode.fit_dictionary(spark.createDataFrame([("m",), ("k",)], "c string"), ["c"])
    more = encode.extend_dictionary(dictionary, spark.createDataFrame([("a",), ("m",), ("z",)], "c string"), "c")
    assert {r.value: r.code for r in more.collect()} == {"k": 0, "m": 1, "a": 2, "z": 3}


def test_standardize_constant_column_is_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id bigint, v double")
    assert [r.v_scaled for r in encode.standardize(df, ["v"]).collect()] == [None, None]


# --- groups ----------------------------------------------------------------

def test_group_rules_for_null_keys_and_single_rows(spark):
    df = spark.createDataFrame(
        [(1, "w", 1.0, "functional"), (2, None, 2.0, "functional"), (3, "w", None, None)], "id bigint, ward string, latitude double, status_group string")
    got = {r.id: (r.ward_site_count, r.ward_functional_ratio) for r in groups.add_ward_statistics(df).collect()}
    assert got == {1: (1.0, 0.5), 2: (1.0, 0.5), 3: (1.0, 0.5)}
    std = groups.mean_and_std(df, "ward", ["latitude"], "w").first()
    assert std.w_latitude_mean == 1.0 and std.w_latitude_std is None


def test_outliers_need_a_spread(spark):
    df = spark.createDataFrame([(i, "a", 0.0 + (5.0 if i == 0 else i * 1e-3), 1.0) for i in range(30)] + [(99, "b", 1.0, 1.0)],
                               "id bigint, ward string, latitude double, longitude double")
    assert [r.id for r in groups.geographic_outliers(df, "ward").where("is_geographic_outlier = 1").collect()] == [0]


def test_anova_matches_the_textbook(spark):
    a, b, c = [6, 8, 4, 5, 3, 4], [8, 12, 9, 11, 6, 8], [13, 9, 11, 8, 7, 12]
    rows = [(float(v), g) for g, vs in (("a", a), ("b", b), ("c", c)) for v in vs]
    f = groups.anova_f(spark.createDataFrame(rows, "v double, y string"), ["v"], "y").first().f_value
    assert f == pytest.approx(9.264705882)


# --- votes and metrics -----------------------------------------------------

def vote(spark, function, *votes, **kw):
    return one(spark, function([F.lit(v) for v in votes], **kw))


def test_majority_tie_goes_to_the_first_voter(spark):
    assert vote(spark, voting.majority_vote, "b", "a", "c") == "b"
    assert vote(spark, voting.majority_vote, "b", "a", "a") == "a"


def test_weighted_vote(spark):
    assert vote(spark, voting.weighted_vote, "x", "y", "y", weights=[2, 2, 1]) == "y"
    assert vote(spark, voting.weighted_vote, "x", "y", "z", weights=[2, 2, 1]) == "x"


@pytest.mark.parametrize("votes,want", [((0, 1), 0), ((1, 2), 2), ((0, 2), 1)])
def test_ordinal_average_rounds_half_to_even(spark, votes, want):
    picked = vote(spark, voting.ordinal_average, *[CLASSES[v] for v in votes], weights=[F.lit(1.0), F.lit(1.0)])
    assert picked == CLASSES[want]


def test_best_class_prefers_the_lowest_on_a_tie(spark):
    assert one(spark, voting.best_class([F.lit(0.2), F.lit(0.4), F.lit(0.4)])) == CLASSES[1]


def test_report_for_a_class_never_predicted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "y string, p string")
    got = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert got["b"].precision == got["b"].recall == got["b"].f1 == 0.0
    assert got["a"].precision == pytest.approx(2 / 3) and got["accuracy"].f1 == pytest.approx(2 / 3)
    assert got["macro avg"].recall == 0.5 and got["weighted avg"].support == 3


# --- column rules ----------------------------------------------------------

def test_text_rules(spark):
    assert one(spark, text.text_length(F.lit(None).cast("string"))) == 3
    assert one(spark, text.word_count(F.lit(" \t two  words\n"))) == 2
    assert one(spark, text.word_count(F.lit(""))) == 0
    assert one(spark, text.has_special(F.lit("é"))) == 1


@pytest.mark.parametrize("name,want", [(None, 1), ("0", 1), ("X", 1), ("", 1), ("DWE", 2), ("Commu", 3), ("District Council", 4)])
def test_name_quality(spark, name, want):
    assert one(spark, ratings.rate_name_quality(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize("name,want", [("GOVERNMENT of X", 1), ("Danida", 2), ("World Vision", 3), ("Kkkt Church", 4), ("0", 5), (None, 5)])
def test_organisation_type(spark, name, want):
    assert one(spark, ratings.rate_org_type(F.lit(name).cast("string"))) == want


def test_age_rules(spark):
    day = F.to_date(F.lit("2012-02-29"))
    assert one(spark, fx.age_when_recorded(day, F.lit(0))) is None
    assert one(spark, fx.age_when_recorded(day, F.lit(2013))) is None
    assert one(spark, fx.age_when_recorded(day, F.lit(2000))) == 12
    assert one(spark, fx.years_in_service(day, F.lit(0))) == 50
    assert one(spark, fx.years_in_service(day, F.lit(2015))) == 0
    assert one(spark, fx.days_since(day)) == 643


def test_ratio_by_zero_is_null(spark):
    assert one(spark, fx.safe_ratio(F.lit(1), F.lit(0))) is None


# --- responses -------------------------------------------------------------

@pytest.mark.parametrize("raw,want", [(None, 3.0), ("0", 1.0), ("9", 5.0), ("2", 2.0), ("abc", 3.0)])
def test_clamp(spark, raw, want):
    assert one(spark, enrich.clamp_rating(F.lit(raw).cast("string"), 3)) == want


@pytest.mark.parametrize("raw", [
    '{"results": [{"id": 1}, {"id": 2}]}', '{"x": [{"id": 1}, {"id": 2}]}', '[{"id": 1}, {"id": 2}]'])
def test_item_shapes(spark, raw):
    assert [m["id"] for m in one(spark, enrich.response_items(F.lit(raw)))] == ["1", "2"]


def test_bare_item_and_garbage(spark):
    assert one(spark, enrich.response_items(F.lit('{"id": 1, "coordination": 2}'))) == [{"id": "1", "coordination": "2"}]
    for raw in ("oops", "", None):
        assert one(spark, enrich.response_items(F.lit(raw).cast("string"))) is None


@pytest.mark.parametrize("raw", [
    '{"results": [{"id": 1, "coordination":', '{"results": [{"id": 1, "coordination": 3', '[{"id": 1, "coordination":  ', '{"results": [{"id": 1, "coordination": 3}]'])
def test_repair(spark, raw):
    items = one(spark, enrich.response_items(enrich.repair_json(F.lit(raw))))
    assert items[0]["coordination"] == "3"


def test_lines_pad_and_cut(spark):
    wanted = spark.createDataFrame([(1, p, 10 + p) for p in (1, 2, 3)] + [(2, 1, 20)], "batch bigint, pos int, id bigint")
    answers = spark.createDataFrame([(1, "4\nx"), (2, "9\n1\n2")], "batch bigint, response string")
    got = {r.id: r.rating for r in enrich.parse_rating_lines(wanted, answers).collect()}
    assert got == {11: 4, 12: 3, 13: 3, 20: 3}


# --- further rules ---------------------------------------------------------

def test_rate_of_the_other_rows(spark):
    df = spark.createDataFrame([(1, "w", "functional"), (2, "w", "x"), (3, "w", "functional"), (4, "v", "x")], "id bigint, ward string, y string")
    got = {r.id: r.rate for r in groups.own_row_excluded_rate(df, "ward", "y", "functional", "rate").collect()}
    assert got == {1: 0.5, 2: 1.0, 3: 0.5, 4: None}


def test_sample_fraction_is_fixed_and_near_the_share(spark):
    df = spark.range(20000)
    taken = {r.id for r in ordering.sample_fraction(df, "id", 0.1, 3).collect()}
    assert taken == {r.id for r in ordering.sample_fraction(df.repartition(7), "id", 0.1, 3).collect()}
    assert 1800 < len(taken) < 2200


def test_imputation_of_an_empty_fit_leaves_null(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0)], "id bigint, v double")
    assert {r.id: r.v for r in impute(df, ["v"], "mean", df.where("v is null")).collect()} == {1: None, 2: 4.0}
    assert {r.id: r.v for r in impute(df, ["v"], "median").collect()} == {1: 4.0, 2: 4.0}


def test_probabilities_sum_to_one_and_features_are_picked(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 300)
    frame = pd.DataFrame({"id": range(300), "a": y + rng.normal(0, 0.2, 300), "b": rng.normal(size=300), "status_group": [CLASSES[i] for i in y]})
    df = spark.createDataFrame(frame)
    assert models.best_features(df, ["b", "a"], 1) == ["a"]
    model = models.fit_model(df, ["a", "b"], models.random_forest(5, 4))
    rows = models.predict_probabilities(model, df).collect()
    assert len(rows) == 300 and all(abs(r.p_0 + r.p_1 + r.p_2 - 1) < 1e-9 for r in rows)
    assert models.score(model, df).first().score > 0.9
    assert {r.feature for r in models.importances(model, ["a", "b"]).collect()} == {"a", "b"}


def test_decoding_restores_values(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id bigint, c string")
    dictionary = encode.fit_dictionary(df, ["c"])
    coded = encode.apply_dictionary(df, dictionary, {"c": "code"}).drop("c")
    assert {r.id: r.c for r in encode.decode(coded, dictionary, "c", "code", "c").collect()} == {1: "x", 2: "y"}


def test_second_reply_completes_a_batch_and_odd_numbers_take_the_default(spark):
    from siteworks.operators.enrich import normalize_responses

    asked = spark.createDataFrame([(1, 7), (1, 8), (2, 9)], "batch bigint, id bigint")
    replies = [(1, '[{"id": 8, "coordination": 2}]'), (1, '{"results": [{"id": 7, "coordination": "NaN", "text_language": "-Infinity"}'), (1, "no"), (2, None)]
    got = normalize_responses(asked, spark.createDataFrame(replies, "batch bigint, response string")).collect()
    assert {(r.id, r.status, r.coordination) for r in got} == {(7, "repaired", 3.0), (8, "ok", 2.0), (9, "failed", 3.0)}
    assert len(got) == 3


def test_long_text_is_cast_whole(spark):
    from siteworks.plans.cleaning import safe_numeric  # noqa: F401

    digits = "0" * 200 + "5"
    frame = spark.createDataFrame([(f"code {digits}",)], "scheme_name string")
    assert frame.select(F.substr("scheme_name", F.lit(6)).try_cast("double")).first()[0] == 5.0


def test_codes_come_without_a_join_by_id(spark):
    from siteworks.plans import PLANS

    for name in ("interactions_fast", "interactions_infra", "interactions_risk", "feature_set_fast"):
        text = PLANS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Join") and not any("Join" in line and "(id#" in line for line in text.split("\n")), name


@pytest.mark.parametrize("most", [0, 10**6])
def test_quantiles_of_long_bands(spark, monkeypatch, most):
    """The same numbers when a band is summed over slices instead of in one task."""
    monkeypatch.setattr(quantiles, "BAND_ROWS", most)
    gen = np.random.default_rng(5)
    frame = pd.DataFrame({"k": gen.choice(["a", "b", "c"], 3000, p=[0.9, 0.09, 0.01]), "v": np.round(gen.normal(0, 50, 3000))})
    df = spark.createDataFrame(frame)
    got = {r.k: (r.low, r.mid) for r in quantiles.exact_quantiles(df, "v", {"low": 0.1, "mid": 0.5}, ["k"]).collect()}
    for key, part in frame.groupby("k"):
        assert got[key] == pytest.approx((part.v.quantile(0.1), part.v.quantile(0.5)))
    whole = quantiles.exact_quantiles(df, "v", {"low": 0.1, "mid": 0.5}).first()
    assert (whole.low, whole.mid) == pytest.approx((frame.v.quantile(0.1), frame.v.quantile(0.5)))
