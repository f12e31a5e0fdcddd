"""MLlib classifiers as assemble, scale, classify pipelines."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.portable import ratio
from ..functions.scalar import positive_probability
from .fits import fit_basis
from .profile import class_counts

# Published settings of each model; callers override what they need.
SETTINGS = {
    "logistic_regression": (LogisticRegression, {"maxIter": 100}, "classical"),
    "random_forest": (RandomForestClassifier, {"numTrees": 2000, "maxDepth": 5, "seed": 42}, "classical"),
    "svm": (LinearSVC, {"maxIter": 100, "regParam": 0.1}, "classical"),
    "decision_tree": (DecisionTreeClassifier, {"seed": 42}, "classical"),
    "naive_bayes": (NaiveBayes, {"modelType": "multinomial", "smoothing": 1.0}, "classical"),
    "gaussian_naive_bayes": (NaiveBayes, {"modelType": "gaussian"}, "classical"),
    "neural_network": (MultilayerPerceptronClassifier, {"maxIter": 50, "seed": 42}, "neural"),
}
UNSCALED = {"decision_tree", "random_forest"}


def family_of(model: str) -> str:
    return SETTINGS[model][2]


def assemble(df: DataFrame, features: list[str], name: str = "features") -> DataFrame:
    """Feature columns to one vector column."""
    return VectorAssembler(inputCols=features, outputCol=name, handleInvalid="error").transform(df)


def vector_columns(df: DataFrame, vector: str, names: list[str]) -> DataFrame:
    """Vector column back to one column per element."""
    parts = vector_to_array(vector)
    return df.withColumns({n: parts[i] for i, n in enumerate(names)}).drop(vector)


def array_vector(name: str) -> Column:
    return array_to_vector(F.col(name))


def build(model: str, features: list[str], label: str, weight: str | None = None, scale: bool | None = None,
          minima: dict[str, float] | None = None, **settings) -> Pipeline:
    """Pipeline for a named model. The scaler is part of it, so it is fit on training rows only.

    ``minima`` shifts each feature by the given training minimum first, for
    the multinomial model, which takes no negative readings; later readings
    below the training minimum count as the minimum.
    """
    cls, defaults, _ = SETTINGS[model]
    params = {**defaults, **settings}
    stages, inputs, source = [], features, "raw_features"
    if minima:
        inputs = [f"_shifted_{f}" for f in features]
        shifted = ", ".join(f"greatest(CAST(`{f}` AS DOUBLE) - ({float(minima[f])!r}D), 0D) AS `{i}`"
                            for f, i in zip(features, inputs))
        stages.append(SQLTransformer(statement=f"SELECT *, {shifted} FROM __THIS__"))
    stages.append(VectorAssembler(inputCols=inputs, outputCol=source, handleInvalid="error"))
    if not minima and (scale if scale is not None else model not in UNSCALED):
        stages.append(StandardScaler(inputCol=source, outputCol="features", withMean=True, withStd=True))
        source = "features"
    if model == "neural_network":
        params.setdefault("layers", [len(features), 2 * len(features), 2])
    elif weight:
        params["weightCol"] = weight
    stages.append(cls(featuresCol=source, labelCol=label, **params))
    return Pipeline(stages=stages)


def fit(model: str, train: DataFrame, features: list[str], label: str, **settings) -> PipelineModel:
    """Fit a named model on training rows."""
    if model == "naive_bayes":
        low = train.agg(*[F.min(F.col(f).cast("double")).alias(f) for f in features]).first()
        settings["minima"] = {f: low[f] for f in features}
    return build(model, features, label, **settings).fit(train)


def score_column(scored: DataFrame) -> Column:
    """P(class 1) where the model has one; a margin model is mapped through the logistic curve."""
    if "probability" in scored.columns:
        return positive_probability("probability")
    margin = F.get(vector_to_array("rawPrediction"), F.lit(1))
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)), F.lit(0.0))


def with_scores(model: PipelineModel, df: DataFrame, name: str = "score") -> DataFrame:
    """Scores in place, next to the row they belong to; no join by id."""
    scored = model.transform(df)
    keep = [*df.columns, "prediction"]
    return scored.withColumn(name, score_column(scored)).select(*keep, name)


def save(model: PipelineModel, path: str, features: list[str], label: str) -> None:
    """Model folder, overwritten, and one metadata record beside it."""
    model.write().overwrite().save(path)
    spark = SparkSession.getActiveSession()
    classifier = model.stages[-1]
    trees = classifier.getNumTrees if hasattr(classifier, "getNumTrees") else None
    note = [(path, features, trees, label, classifier.getFeaturesCol())]
    spark.createDataFrame(note, "model_path string, features array<string>, num_trees int, label_col string, "
                                "features_col string").write.mode("overwrite").json(path.rstrip("/") + "_metadata")


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def with_class_weights(df: DataFrame, label: str, name: str = "class_weight") -> DataFrame:
    """Weight total / (classes x count) on every row; 1.0 when the classes are close to even."""
    per = class_counts(df, label).where(F.col(label).isNotNull())
    facts = per.agg(F.struct(F.sum("rows").alias("t"), F.count(F.lit(1)).alias("k"), ratio(F.max("rows"), F.min("rows")).alias("skew"),
                             F.map_from_entries(F.collect_list(F.struct(label, "rows"))).alias("of")).alias("s")).scalar()
    held = df.withColumn("_s", facts)
    even = F.col("_s.t") / (F.col("_s.k") * F.try_element_at(F.col("_s.of"), F.col(label)).cast("double"))
    return held.withColumn(name, F.when((F.col("_s.skew") >= 1.2) & F.col(label).isNotNull(), even).otherwise(1.0)).drop("_s")


def reconstruct(train_normal: DataFrame, df: DataFrame, features: list[str], components: int) -> DataFrame:
    """Linear reconstruction fit on normal rows; adds ``error``, the mean squared gap per row."""
    return fit_basis(train_normal, features, components).error(df)


def gaussian_bayes_facts(train: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Prior, mean and population variance per class, one row per class."""
    total = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    return train.groupBy(label).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(f).alias(f"{f}_mean") for f in features],
        *[F.var_pop(f).alias(f"{f}_var") for f in features]).withColumn("prior", F.col("_n") / total).drop("_n")


def gaussian_bayes(train: DataFrame, df: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Gaussian naive Bayes as one scan each to fit and to predict; adds ``prediction``."""
    facts = gaussian_bayes_facts(train, label, features)
    packed = facts.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), "prior", *[
        F.struct(F.col(f"{f}_mean").alias("m"), F.col(f"{f}_var").alias("v")).alias(f) for f in features]))).alias("s"))

    def log_density(c: Column) -> Column:
        total = F.log(c["prior"])
        for f in features:
            gap = F.col(f).cast("double") - c[f]["m"]
            total = total - F.log(F.lit(6.283185307179586) * c[f]["v"]) / 2 - gap * gap / (c[f]["v"] * 2)
        return total

    held = df.withColumn("_s", packed.scalar())
    rated = F.transform("_s", lambda c: F.struct(log_density(c).alias("d"), (-c["c"]).alias("o")))
    return held.withColumn("prediction", (-F.array_max(rated)["o"]).cast("int")).drop("_s")
