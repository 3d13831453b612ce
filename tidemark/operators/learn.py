"""Boosted-tree regression on wide tables: features, fit, quality, importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import finite, name
from tidemark.operators import boosting
from tidemark.operators.attribution import long_attributions
from tidemark.operators.clean import fit_one_hot
from tidemark.operators.common import require
from tidemark.session import stored_columns

# Name parts of calendar and of lag features.
TIME_PARTS = ["month", "day", "week", "year", "is_"]
LAG_PARTS = ["lag_", "rolling_", "pct_change_"]


def usable_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric and boolean columns, text columns) that may serve as features."""
    fields = [f for f in df.schema.fields if f.name != target and f.name not in exclude]
    numbers = [f.name for f in fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    return numbers, [f.name for f in fields if isinstance(f.dataType, T.StringType)]


def prepare(df: DataFrame, target: str, numbers: Sequence[str]) -> DataFrame:
    """Numbers as finite doubles without nulls; rows without a target leave."""
    require(df, target, *numbers)
    clean = {c: F.coalesce(finite(name(c).cast("double")), F.lit(0.0)) for c in numbers}
    return df.withColumns({target: name(target).cast("double"), **clean}).filter(name(target).isNotNull())


def fit_boosted(
    train: DataFrame, target: str, numbers: Sequence[str], texts: Sequence[str] = (), *,
    trees: int = 100, depth: int = 5, rate: float = 0.1, rows: float = 0.8, columns: float = 0.8, seed: int = 42,
) -> PipelineModel:
    """One distributed fit over all rows; text columns are one-hot encoded without their first level."""
    # The fit reads its rows several times to find levels and cuts, a few columns at a time; they are written once, by column.
    base = stored_columns(train.select(*[name(c) for c in (target, *numbers, *texts)]))
    stages, encoded = fit_one_hot(base, texts) if texts else ([], [])
    learner = GBTRegressor(
        featuresCol="features", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=rows,
        featureSubsetStrategy=str(columns), seed=seed,
    )
    assembler = VectorAssembler(inputCols=[*numbers, *encoded], outputCol="features")
    # The features are the slots of the assembled vector: of each text all levels but the first, which is the last label.
    levels = {c: labels[:-1] for c, labels in zip(texts, stages[0].labelsArray, strict=True) if len(labels) > 1} if texts else {}
    return PipelineModel([*stages, assembler, boosting.fit_trees(base, target, numbers, levels, learner)])


def feature_names(scored: DataFrame, features: str = "features") -> list[str]:
    """Names of the vector slots, read from the column metadata."""
    attributes = scored.schema[features].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for group in attributes.values() for a in group)
    return [n for _, n in slots]


def quality(scored: DataFrame, target: str, *, split: str = "split", prediction: str = "prediction") -> DataFrame:
    """``split, n, rmse, r2`` in one pass."""
    y, gap = name(target), name(target) - name(prediction)
    sums = scored.groupBy(name(split)).agg(F.count(y).alias("n"), F.sum(gap * gap).alias("sse"), F.var_pop(y).alias("v"))
    r2 = F.lit(1.0) - F.try_divide(F.col("sse"), F.col("v") * F.col("n"))
    return sums.select(name(split), "n", F.sqrt(F.try_divide(F.col("sse"), F.col("n"))).alias("rmse"), r2.alias("r2"))


def importance(scored: DataFrame, model: PipelineModel) -> DataFrame:
    """``feature, importance`` summing to 1, unused features with 0, strongest first."""
    values = model.stages[-1].featureImportances.toArray()
    total = values.sum() or 1.0
    rows = [(n, float(v / total)) for n, v in zip(feature_names(scored), values, strict=True)]
    return scored.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def strongest_by_kind(importances: DataFrame, k: int = 5) -> DataFrame:
    """Top k calendar features and top k lag features, marked in ``kind``."""

    def top(parts: Sequence[str], kind: str) -> DataFrame:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.col("feature").contains(p)
        return importances.filter(hit).orderBy(F.col("importance").desc(), "feature").limit(k).withColumn("kind", F.lit(kind))

    return top(TIME_PARTS, "time").unionByName(top(LAG_PARTS, "lag"))


def dependence(attributed: DataFrame, names: Sequence[str], keep: Sequence[str], importances: DataFrame, k: int = 5) -> DataFrame:
    """Feature value against attribution for the k most important features; no other feature becomes a row."""
    top = [r["feature"] for r in importances.limit(k).collect()]
    return long_attributions(attributed, names, keep, only=top)


def linear_fit(df: DataFrame, target: str, feature: str, *, split: str = "split") -> DataFrame:
    """Every row with the prediction of the line through the training rows."""
    y = F.when(name(split) == "train", name(target).cast("double"))
    x = F.when(name(split) == "train", name(feature).cast("double"))
    line = df.agg(F.struct(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b")).alias("s"))
    return df.withColumn("__l", line.scalar()).withColumn("prediction", F.col("__l.b") + F.col("__l.a") * name(feature)).drop("__l")
