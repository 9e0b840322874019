"""MLlib training, scoring and experiment tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, StringIndexer, UnivariateFeatureSelector, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from siteworks.operators import forest
from siteworks.operators.metrics import accuracy_of
from siteworks.operators.spatial import located
from siteworks.session import materialize

LABEL = "status_group"

# Recorded forest settings.
FOREST_SETTINGS = {
    "base": {"trees": 100, "seed": 42},
    "tuned": {"trees": 200, "seed": 43},
    "tuned_with_ratings": {"trees": 300, "seed": 999},
}


def feature_frame(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Keys plus numeric features with gaps filled by -1."""
    filled = [F.coalesce(F.col(f).cast("double"), F.lit(-1.0)).alias(f) for f in features]
    return df.select(*keep, *filled)


def training_rows(df: DataFrame, key: str = "id") -> DataFrame:
    """Store rows for fitting, spread over the session's shuffle partitions.

    Learners read their rows many times, one task per partition; what adaptive
    execution merged into a few partitions would leave most cores idle.
    """
    return materialize(df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key))


#: Rows that a task of a learner should have at least, and may have at most.
LEAST_TREE_ROWS, MOST_TREE_ROWS = 5_000, 200_000


def tree_rows(train: DataFrame) -> DataFrame:
    """All rows in as few partitions as keep the cores busy.

    Each partition sends statistics of every node of a level, whether it has rows of it or not, so what tree learners
    write, move and add up grows with the partitions.
    """
    n = train.count()
    busy = min(-(-n // LEAST_TREE_ROWS), train.sparkSession.sparkContext.defaultParallelism)
    return train.coalesce(max(1, busy, -(-n // MOST_TREE_ROWS)))


def pass_rows(train: DataFrame) -> DataFrame:
    """All rows in one partition per core, or a whole number of them if tasks would get too large.

    L-BFGS reads all rows once an iteration; in each pass every partition gets the weights and sends a gradient back, however few
    rows it has, so with partitions that grow as the rows do the passes grow twice. A last round of few tasks would leave cores idle.
    """
    n, cores = train.count(), train.sparkSession.sparkContext.defaultParallelism
    return train.coalesce(max(1, min(-(-n // LEAST_TREE_ROWS), cores) * -(-n // (cores * MOST_TREE_ROWS))))


def learner_rows(train: DataFrame, estimator) -> DataFrame:
    """All rows, in the partitions that suit the learner."""
    return tree_rows(train) if _grows_trees(estimator) else pass_rows(train)


def _grows_trees(estimator) -> bool:
    one = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    return one.hasParam("maxDepth")


def assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="features")


def label_indexer(label: str = LABEL) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc")


def best_features(df: DataFrame, features: Sequence[str], k: int, label: str = LABEL) -> list[str]:
    """Names of the k numeric features with the highest one-way F statistic."""
    indexed = label_indexer(label).fit(df).transform(assembler(features).transform(df))
    selector = UnivariateFeatureSelector(featuresCol="features", labelCol="label_index", selectionMode="numTopFeatures")
    fitted = selector.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k).fit(indexed)
    return [features[i] for i in sorted(fitted.selectedFeatures)]


def random_forest(trees: int = 100, depth: int = 15, seed: int = 42, weight: str | None = None, **options):
    # Rows remember their nodes; otherwise every task of every level gets all the trees and walks them from the root.
    forest = RandomForestClassifier(labelCol="label_index", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True, **options)
    return forest.setWeightCol(weight) if weight else forest


def boosted_trees(rounds: int = 100, depth: int = 6, step: float = 0.1, seed: int = 42):
    """One boosted binary model per class; MLlib boosting itself is two-class."""
    one = GBTClassifier(labelCol="label_index", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=0.8, seed=seed)
    return OneVsRest(classifier=one, labelCol="label_index", parallelism=3)


def logistic_regression(iterations: int = 100, penalty: float = 0.0):
    return LogisticRegression(
        labelCol="label_index", featuresCol="scaled", family="multinomial", maxIter=iterations, regParam=penalty
    )


def neural_net(inputs: int, classes: int = 3, iterations: int = 100, seed: int = 42):
    return MultilayerPerceptronClassifier(
        labelCol="label_index", featuresCol="scaled", layers=[inputs, 100, 50, classes], maxIter=iterations, seed=seed
    )


def fit_model(train: DataFrame, features: Sequence[str], estimator, label: str = LABEL) -> PipelineModel:
    stages = [label_indexer(label), assembler(features)]
    if estimator.hasParam("featuresCol") and estimator.getOrDefault("featuresCol") == "scaled":
        stages.append(StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True))
    return Pipeline(stages=[*stages, estimator]).fit(learner_rows(train, estimator))


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("id",), name: str = "prediction_label") -> DataFrame:
    """Keys and the decoded label; the label index never leaves this function."""
    stages = PipelineModel([s for s in model.stages if s.uid != model.stages[0].uid])
    names = F.array(*[F.lit(v) for v in model.stages[0].labels])
    scored = stages.transform(df)
    return scored.select(*keep, F.element_at(names, F.col("prediction").cast("int") + 1).alias(name))


def predict_probabilities(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
    """Keys and one probability column per class, ``p_<class index>``."""
    stages = PipelineModel([s for s in model.stages if s.uid != model.stages[0].uid])
    p = vector_to_array("probability")
    count = len(model.stages[0].labels)
    return stages.transform(df).select(*keep, *[p[i].alias(f"p_{i}") for i in range(count)])


def importances(model: PipelineModel, features: Sequence[str]) -> DataFrame:
    """One row per feature, from the fitted trees."""
    values = [float(v) for v in model.stages[-1].featureImportances.toArray()]
    return SparkSession.active().createDataFrame(list(zip(features, values)), "feature string, importance double")


def score(model: PipelineModel, df: DataFrame, label: str = LABEL) -> DataFrame:
    """One row: accuracy on the given rows."""
    scored = predict(model, df, keep=[label])
    return scored.agg(accuracy_of(F.col(label), F.col("prediction_label")).alias("score"), F.count("*").alias("rows"))


class ExperimentTable:
    """Rows of many fits: features assembled once, stored once, never copied.

    What a fit or a score sees of them is a condition on the stored columns (a fold, a split, the size and seed of a sample), and the
    features it uses are a slice of the one vector. So a hundred cells of an experiment read one table. Forests grow on its bytes
    (``operators/forest.py``) while these are few enough to be broadcast.
    """

    def __init__(self, df: DataFrame, features: Sequence[str], label: str = LABEL):
        self.features = list(features)
        rows = training_rows(assembler(features).transform(df).drop(*features))
        indexer = label_indexer(label).fit(rows)
        self.labels = list(indexer.labels)
        self.rows = indexer.transform(rows)
        self._bytes, self._lock = None, Lock()

    def bytes(self) -> forest.ByteTable | None:
        """The rows as bytes, made once; nothing if there are too many."""
        with self._lock:
            if self._bytes is None:
                self._bytes = [forest.byte_table(self.rows, len(self.features), len(self.labels))]
        return self._bytes[0]

    def at_once(self, estimator) -> int:
        """Fits that run at a time: those on bytes are few tasks each."""
        few = forest.fits_here(estimator) and self.bytes() is not None
        return max(4, self.rows.sparkSession.sparkContext.defaultParallelism) if few else 4

    def fit(self, seen: Column, names: Sequence[str], estimator) -> PipelineModel | forest.TableForest:
        """A model of the rows where ``seen`` holds."""
        chosen = [self.features.index(n) for n in names]
        if forest.fits_here(estimator) and (table := self.bytes()) is not None:
            return forest.TableForest(table, seen, chosen, estimator)
        slicer = VectorSlicer(inputCol="features", outputCol="chosen", indices=chosen)
        stages: list = [slicer]
        given = estimator.copy()
        if given.hasParam("featuresCol") and given.getOrDefault("featuresCol") == "scaled":
            stages.append(StandardScaler(inputCol="chosen", outputCol="scaled", withMean=True, withStd=True))
        else:
            given = given.setFeaturesCol("chosen")
        train = self.rows.where(seen)
        return Pipeline(stages=[*stages, given]).fit(learner_rows(train, given))

    def scores(self, model: PipelineModel | forest.TableForest, **parts: Column) -> dict[str, tuple[int, float | None, float | None]]:
        """For each named part of the rows: how many, the share the model gets right, and the share of the most frequent class; one pass."""
        if isinstance(model, forest.TableForest):
            return model.scores(parts)
        scored = model.transform(self.rows)
        right = (F.col("prediction") == F.col("label_index")).cast("double")
        aggs = []
        for name, part in parts.items():
            aggs += [F.count_if(part).alias(f"{name}_n"), F.avg(F.when(part, right)).alias(f"{name}_right")]
            aggs += [F.count_if(part & (F.col("label_index") == i)).alias(f"{name}_{i}") for i in range(len(self.labels))]
        got = scored.agg(*aggs).first()
        most = lambda name: max(got[f"{name}_{i}"] for i in range(len(self.labels))) / got[f"{name}_n"] if got[f"{name}_n"] else None
        return {name: (got[f"{name}_n"], got[f"{name}_right"], most(name)) for name in parts}


def evaluate_sets(table: ExperimentTable, feature_sets: Mapping[str, Sequence[str]], estimator, train: Column, held: Column, min_rows: int = 0) -> DataFrame:
    """Fit and score one model per feature set on the same split.

    Sets whose training rows are fewer than ``min_rows`` are not fitted; ``outcome`` says so.
    ``train_majority`` is the score of a model that always answers the most frequent class.
    """
    spark = table.rows.sparkSession
    available = table.rows.where(train).count()

    def one(item: tuple[str, Sequence[str]]) -> tuple:
        name, features = item
        if available < min_rows:
            return (name, len(features), "too few rows", None, None, None, None, 0.0)
        started = time.time()
        got = table.scores(table.fit(train, features, estimator), train=train, held=held)
        return (name, len(features), "fitted", got["train"][1], got["held"][1], got["train"][2], got["held"][0], time.time() - started)

    return spark.createDataFrame(
        in_parallel(one, list(feature_sets.items()), table.at_once(estimator)),
        "config string, n_features int, outcome string, train_score double, val_score double, train_majority double, n_held bigint, seconds double",
    ).withColumn("gap", F.col("train_score") - F.col("val_score"))


def cross_validate(table: ExperimentTable, features: Callable[[int], Sequence[str]], estimator, folds: int, fold: str = "fold") -> DataFrame:
    """One score per held-out fold; ``features(f)`` names the columns that may be used while fold ``f`` is held out."""

    def one(f: int) -> tuple:
        held = F.col(fold) == f
        got = table.scores(table.fit(~held, features(f), estimator), train=~held, held=held)
        return f, got["held"][0], got["held"][1], got["held"][2], got["train"][1], got["train"][2]

    kind = "fold int, n_rows bigint, score double, majority double, train_score double, train_majority double"
    return table.rows.sparkSession.createDataFrame(in_parallel(one, range(folds), table.at_once(estimator)), kind)


def in_parallel(run: Callable, items: Iterable, threads: int = 4) -> list:
    """Fits that do not depend on one another, some at a time: small jobs leave most cores idle."""
    with ThreadPoolExecutor(threads) as pool:
        return list(pool.map(inheritable_thread_target(run), items))


def spatial_kmeans(df: DataFrame, most: int = 50, seed: int = 42, starts: int = 10) -> DataFrame:
    """``id, latitude, longitude, geographic_cluster, is_nearest`` from k-means on coordinates, k = min(most, n / 10).

    ``most`` clusters at any size is the recorded rule, and so is the best of ten starts (least squared distance);
    every located row gets a cluster.
    """
    rows = materialize(located(df).select("id", "latitude", "longitude"))
    k = max(2, min(most, rows.count() // 10))
    points = materialize(VectorAssembler(inputCols=["latitude", "longitude"], outputCol="features").transform(rows))
    fits = in_parallel(lambda n: KMeans(k=k, seed=seed + n, featuresCol="features", predictionCol="geographic_cluster").fit(points), range(starts))
    model = min(fits, key=lambda fit: fit.summary.trainingCost)
    centres = F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(c, ("centre_lat", "centre_lon"))]) for c in model.clusterCenters()])
    rows = model.transform(points).select("id", "latitude", "longitude", "geographic_cluster")
    away = lambda c: (F.col("latitude") - c["centre_lat"]) ** 2 + (F.col("longitude") - c["centre_lon"]) ** 2
    nearest = F.array_min(F.transform(centres, away))
    own = away(F.get(centres, F.col("geographic_cluster")))
    return rows.withColumn("is_nearest", own <= nearest + 1e-9)


def timed(stages: Mapping[str, DataFrame]) -> DataFrame:
    """Wall-clock seconds and rows per second of each stage, forced by a full no-op write."""
    rows = []
    spark = next(iter(stages.values())).sparkSession
    for name, stage in stages.items():
        started = time.time()
        stage.write.format("noop").mode("overwrite").save()
        seconds = time.time() - started
        n = stage.count()
        rows.append((name, n, seconds, n / seconds if seconds else None))
    return spark.createDataFrame(rows, "stage string, rows bigint, seconds double, rows_per_second double")
