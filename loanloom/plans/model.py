"""Training, applying, storing and evaluating the boosted-tree model with pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from loanloom.functions.scalars import MISSING, fill_for_model
from loanloom.operators.metrics import evaluation
from loanloom.operators.ranking import stratified_split
from loanloom.plans.features import FEATURES_V3
from loanloom.session import materialise, shared_folder

# Columns that define the target; near-perfect scores follow while they are also features.
TARGET_INPUTS = ("loans_overdue", "loans_written_off", "failed_payments_30plus")


@dataclass(frozen=True)
class Training:
    """The boosting settings. `min_info_gain` plays the part of a minimum loss reduction."""

    trees: int = 300
    depth: int = 5
    step: float = 0.05
    row_share: float = 0.8
    column_share: float = 0.8
    min_rows: int = 5
    min_info_gain: float = 1e-5
    seed: int = 42


TRAINING_V3 = Training()
TRAINING_V1 = Training(trees=200, depth=4, min_rows=1, min_info_gain=0.0)


def train(rows: DataFrame, features=FEATURES_V3, settings: Training = TRAINING_V3) -> PipelineModel:
    """Fits on rows with the features and `target`. The pipeline keeps the feature order.

    Boosting passes over its input once per level of every tree, so the matrix is written once to the
    shared folder first: a lost executor re-reads it instead of rebuilding the features. The lineage of
    the working predictions is cut every ten trees by the checkpoint folder.
    """
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    matrix = materialise(fill_for_model(rows.dropna(subset=["target"]).select("target", *features), features))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    booster = GBTClassifier(
        labelCol="target", featuresCol="features", maxIter=settings.trees, maxDepth=settings.depth,
        stepSize=settings.step, subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.column_share), minInstancesPerNode=settings.min_rows,
        minInfoGain=settings.min_info_gain, seed=settings.seed, checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, booster]).fit(matrix)


def feature_names(model: PipelineModel) -> list[str]:
    return model.stages[0].getInputCols()


def predict(rows: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds probability of class 1 and prediction; both NULL without a model."""
    if model is None:
        return rows.withColumns({"probability": F.lit(None).cast("double"), "prediction": F.lit(None).cast("int")})
    kept = rows.columns
    renamed = {f: f"_in_{f}" for f in feature_names(model)}
    filled = rows.selectExpr("*", *[f"coalesce(CAST({f} AS DOUBLE), {MISSING}D) AS {renamed[f]}" for f in renamed])
    assembler = model.stages[0].copy().setInputCols(list(renamed.values()))
    scored = model.stages[1].transform(assembler.transform(filled))
    return scored.select(
        *kept,
        vector_to_array("probability")[1].alias("probability"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def probabilities(features: DataFrame, model: PipelineModel | None) -> DataFrame | None:
    """(user_id, probability, prediction) of features with one row per user (online); None without a model."""
    if model is None:
        return None
    return predict(features, model).select("user_id", "probability", "prediction")


def importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(feature, importance), one row per feature."""
    scores = model.stages[1].featureImportances.toArray()
    rows = [(name, float(score)) for name, score in zip(feature_names(model), scores)]
    return spark.createDataFrame(rows, "feature string, importance double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def load_if_there(spark: SparkSession, path: str) -> PipelineModel | None:
    """The model, or None when there is none: decisions then rest on the rules."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    return load(path)


def train_and_evaluate(
    matrix: DataFrame, features=FEATURES_V3, settings: Training = TRAINING_V3, seed: int = 42
) -> tuple[PipelineModel, DataFrame]:
    """Splits 80/20 by class, fits on the train slice, evaluates on test, train and all rows.

    `matrix` holds user_id, target and the features; it is written once, as three passes follow.
    """
    stored = materialise(matrix)
    split = stratified_split(stored, "target", "user_id", 0.2, seed)
    model = train(split.where(F.col("slice") == "train"), features, settings)
    return model, evaluate(split, model)


def evaluate(split: DataFrame, model: PipelineModel) -> DataFrame:
    return evaluation(predict(split, model).select("slice", "target", "probability", "prediction"))
