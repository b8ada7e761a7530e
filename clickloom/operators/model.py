"""Purchase-conversion model trained with distributed boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.functions.hashing import hash_bucket
from clickloom.operators.ordering import row_positions
from clickloom.schema import CATEGORY_COLUMNS, FEATURE_COLUMNS
from clickloom.session import ensure_checkpoints, materialize

ROUNDS = 300
DEPTH = 4
STEP = 0.05
ROW_SHARE = 0.8
COLUMN_SHARE = "0.8"
SEED = 42
BINS = 256
FOLDS = 5
FOLD = "_fold"
SMOOTHING = 20.0
WEIGHT = "_weight"
UNITS = BINS * BINS  # no training row stands for more than this part of all rows
ENCODED_COLUMNS = {c: f"{c}_code" if c in CATEGORY_COLUMNS else c for c in FEATURE_COLUMNS}


def encode_categories(features: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Features plus a numeric code per categorical column, by sorted vocabulary.

    Unseen and missing values share one extra code. The vocabulary stays a table, so it may
    be of any size.
    """
    known = features if vocabulary is None else vocabulary
    coded = features
    for column in CATEGORY_COLUMNS:
        values = known.select(column).where(F.col(column).isNotNull()).distinct()
        codes = row_positions(values, [column], "_code")
        size = codes.agg(F.count(F.lit(1))).scalar()
        code = F.coalesce("_code", size).cast("double")
        coded = coded.join(codes, column, "left").withColumn(ENCODED_COLUMNS[column], code).drop("_code")
    return coded.select(*features.columns, *[ENCODED_COLUMNS[c] for c in CATEGORY_COLUMNS])


@dataclass(frozen=True)
class ConversionModel:
    """Boosted trees, and the smoothed conversion rate of every category seen in training."""

    trees: GBTClassificationModel
    rates: dict[str, DataFrame]
    prior: float


def _rate(converted: Column, rows: Column, prior: float) -> Column:
    return (converted + F.lit(SMOOTHING * prior)) / (rows + F.lit(SMOOTHING))


def _with_rates(rows: DataFrame, rates: DataFrame, column: str, *more: str) -> DataFrame:
    """Join rates in; a missing category is a category like any other."""
    renamed = rates.withColumnsRenamed({name: f"_r_{name}" for name in (column, *more)})
    same = F.col(column).eqNullSafe(F.col(f"_r_{column}"))
    for name in more:
        same = same & (F.col(name) == F.col(f"_r_{name}"))
    return rows.join(renamed, same, "left").drop(*[f"_r_{name}" for name in (column, *more)])


def _out_of_fold(rows: DataFrame, column: str, prior: float) -> DataFrame:
    """Each row's category rate from the other folds, so that no row sees its own label."""
    counted = rows.groupBy(column, FOLD).agg(
        F.sum(WEIGHT).alias("_n"), F.sum(F.col("label") * F.col(WEIGHT)).alias("_s")
    )
    everywhere = Window.partitionBy(column)
    others = _rate(F.sum("_s").over(everywhere) - F.col("_s"), F.sum("_n").over(everywhere) - F.col("_n"), prior)
    rates = counted.select(column, FOLD, others.alias(ENCODED_COLUMNS[column]))
    return _with_rates(rows, rates, column, FOLD)


def weighted_rows(train: DataFrame) -> DataFrame:
    """One row per combination of features and label, with its number of rows as weight.

    Sessions have few features of few values, so combinations grow far slower than sessions.
    """
    label = F.col("converted").cast("double").alias("label")
    return train.groupBy(*FEATURE_COLUMNS, label).agg(F.count(F.lit(1)).alias(WEIGHT))


def _in_units(rows: DataFrame, units: int) -> DataFrame:
    """Heavy rows cut into equal ones, of the ``units``-th part of all rows at most, rounded up.

    The boosting rounds draw their share of these. With up to ``units`` rows each is drawn by itself.
    """
    most = F.greatest(F.lit(1), F.ceil(rows.agg(F.sum(WEIGHT)).scalar() / F.lit(units)))
    cut = rows.withColumn("_parts", F.ceil(F.col(WEIGHT) / most).cast("int"))
    cut = cut.withColumn("_part", F.explode(F.sequence(F.lit(1), F.col("_parts"))))
    return cut.withColumn(WEIGHT, F.col(WEIGHT) / F.col("_parts")).drop("_parts", "_part")


def train_conversion_model(
    train: DataFrame,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    step: float = STEP,
    row_share: float = ROW_SHARE,
    column_share: str = COLUMN_SHARE,
    seed: int = SEED,
    checkpoint_interval: int = 10,
    units: int = UNITS,
) -> ConversionModel:
    """Boosted trees with logistic loss over the six session features.

    Categories enter as conversion rates, learned by an aggregate and joined in, so a
    vocabulary of any size trains. Equal rows are trained on as weighted ones, all of them, so
    a round costs by the combinations of features that occur. Training data stay distributed; every
    ``checkpoint_interval`` rounds the row weights are written out so that a lost executor
    costs a few rounds at most.
    """
    ensure_checkpoints(train.sparkSession)
    fold = hash_bucket(FEATURE_COLUMNS, FOLDS)
    rows = materialize(weighted_rows(train), "weighted-rows").withColumn(FOLD, fold)
    prior = rows.agg(F.sum(F.col("label") * F.col(WEIGHT)) / F.sum(WEIGHT)).first()[0] or 0.0
    rates, encoded = {}, rows
    for column in CATEGORY_COLUMNS:
        learned = rows.groupBy(column).agg(
            _rate(F.sum(F.col("label") * F.col(WEIGHT)), F.sum(WEIGHT), prior).alias(ENCODED_COLUMNS[column])
        )
        rates[column] = materialize(learned, "category-rates")
        encoded = _out_of_fold(encoded, column, prior)
    trees = GBTClassifier(
        featuresCol="features",
        labelCol="label",
        weightCol=WEIGHT,
        maxIter=rounds,
        maxDepth=depth,
        stepSize=step,
        subsamplingRate=row_share,
        featureSubsetStrategy=column_share,
        maxBins=BINS,
        seed=seed,
        checkpointInterval=checkpoint_interval,
    )
    encoded = _in_units(encoded.select("label", WEIGHT, *ENCODED_COLUMNS.values()), units)
    stored = materialize(encoded.repartition(train.sparkSession.sparkContext.defaultParallelism), "training-rows")
    return ConversionModel(trees.fit(_assembler().transform(stored)), rates, prior)


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(ENCODED_COLUMNS.values()), outputCol="features")


def predict_sessions(model: ConversionModel, features: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Features plus the conversion probability ``score`` and ``prediction`` at the cutoff."""
    encoded = features
    for column, rates in model.rates.items():
        code = ENCODED_COLUMNS[column]
        encoded = _with_rates(encoded, rates, column).fillna(model.prior, [code])
    scored = model.trees.transform(_assembler().transform(encoded))
    probability = vector_to_array("probability")[1]
    return scored.select(*features.columns, probability.alias("score")).withColumn(
        "prediction", F.col("score") >= cutoff
    )


def feature_importance(model: ConversionModel) -> DataFrame:
    """Each feature's share of the total gain, highest first; all 0 if nothing was split."""
    gains = model.trees.featureImportances.toArray()
    total = float(gains.sum())
    rows = [
        (name, float(gain) / total if total else 0.0) for name, gain in zip(FEATURE_COLUMNS, gains)
    ]
    spark = SparkSession.getActiveSession()
    return rank_importance(spark.createDataFrame(rows, "feature string, importance double"))


def rank_importance(importance: DataFrame) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature")
