"""Folds, exact ranking metrics, thresholds, boosted trees with out-of-fold scores, and scoring."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltweave.operators.ranking import quantiles, rank_within, running_totals
from voltweave.operators.sampling import mixed


def strip_folds(df: DataFrame, column: str, n: int, name: str = "fold") -> DataFrame:
    """Folds by quantile strips of a coordinate: the number of inner cut points at or below the value. Ties stay together."""
    fold = F.lit(0)
    for c in quantiles(df, [column], [i / n for i in range(1, n)]).get(column, []):
        fold = fold + F.coalesce((F.col(column) >= F.lit(c)).cast("int"), F.lit(0))
    return df.withColumn(name, fold)


def stratified_folds(df: DataFrame, label: str, key: str, n: int, name: str = "fold") -> DataFrame:
    """Folds of equal label shares, dealt in the order of a hash of the key."""
    ranked = rank_within(df, label, [mixed(F.col(key)), F.col(key)], name)
    return ranked.withColumn(name, F.pmod(F.col(name), F.lit(n)).cast("int"))


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score: positives and all rows. What the exact metrics need, and no more."""
    return df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("all"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row, auc: by rank sums, ties counting half; null if a class is missing."""
    per = running_totals(score_counts(df, score, label).withColumn("neg", F.col("all") - F.col("pos")), [F.col("score")], {"neg": "upto"})
    per = per.withColumn("wins", F.col("pos") * (F.col("upto") - F.col("neg") / 2.0))
    both = F.sum("pos").cast("double") * F.sum("neg")
    return per.agg((F.sum("wins") / F.nullif(both, F.lit(0.0))).alias("auc"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row, ap: sum of precision times the step in recall over falling scores, tied scores taken together."""
    per = running_totals(score_counts(df, score, label), [F.col("score").desc()], {"pos": "pos_upto", "all": "all_upto"})
    per = per.withColumn("part", F.col("pos") * F.col("pos_upto") / F.col("all_upto"))
    return per.agg((F.sum("part") / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("ap"))


def f1_by_threshold(df: DataFrame, score: str, label: str, thresholds: Iterable[float]) -> DataFrame:
    """threshold, f1 for each threshold: all of them in one aggregation."""
    grid = list(thresholds)
    y, s = F.col(label) == 1, F.col(score)
    one = df.agg(*[F.struct(F.count_if(y & (s >= t)).alias("tp"), F.count_if(~y & (s >= t)).alias("fp"), F.count_if(y & (s < t)).alias("fn")).alias(f"t{i}") for i, t in enumerate(grid)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("k")) for i, t in enumerate(grid)]))
    tp = F.col("r.k.tp")
    f1 = F.coalesce(2.0 * tp / F.nullif(2 * tp + F.col("r.k.fp") + F.col("r.k.fn"), F.lit(0)), F.lit(0.0))
    return one.select(rows.alias("r")).select("r.threshold", f1.alias("f1"))


def best_threshold(df: DataFrame, score: str, label: str, thresholds: Iterable[float]) -> DataFrame:
    """One row: the first threshold of largest F1."""
    return f1_by_threshold(df, score, label, thresholds).agg(F.min(F.struct((-F.col("f1")).alias("k"), F.col("threshold"))).alias("b")).select("b.threshold", (-F.col("b.k")).alias("f1"))


def class_weight(df: DataFrame, label: str) -> Column:
    """Weight of a row: negatives over positives, to four places, for a positive; 1 for a negative."""
    row = df.agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).first()
    return F.when(F.col(label) == 1, F.lit(round(row["n"] / row["p"], 4) if row["p"] else 1.0)).otherwise(F.lit(1.0))


def boosted_trees(trees: int, depth: int, rate: float, sub: float, columns: float, least: int, seed: int = 42, validation: str | None = None):
    from pyspark.ml.classification import GBTClassifier

    out = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sub, featureSubsetStrategy=str(columns), minInstancesPerNode=least, seed=seed)
    return out.setValidationIndicatorCol(validation) if validation else out


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, key: str, make) -> DataFrame:
    """key, fold, y_true, y_proba: each row scored by a model fitted on the other folds; make() gives an estimator."""
    from pyspark.ml.functions import vector_to_array

    rows = assembled(df.withColumn("label", F.col(label).cast("double")).withColumn("weight", class_weight(df, label)), features).cache()
    out = None
    for f in sorted(r[0] for r in rows.select(fold).distinct().collect()):
        model = make().fit(rows.where(F.col(fold) != f))
        scored = model.transform(rows.where(F.col(fold) == f))
        part = scored.select(key, F.col(fold).alias("fold"), F.col("label").cast("int").alias("y_true"), F.get(vector_to_array("probability"), F.lit(1)).cast("float").alias("y_proba"))
        out = part if out is None else out.unionByName(part)
    assert out is not None
    return out


def final_model(df: DataFrame, features: list[str], label: str, best: list[int], make):
    """The model on all rows, with as many trees as the folds' best iterations had on average; make(trees) gives an estimator."""
    rows = assembled(df.withColumn("label", F.col(label).cast("double")).withColumn("weight", class_weight(df, label)), features)
    return make(max(1, round(sum(best) / len(best)))).fit(rows)


def with_geometry(predictions: DataFrame, geometry: DataFrame, key: str) -> DataFrame:
    """Predictions beside their geometry; ids without one drop out, an id with several gets a row for each."""
    return geometry.join(predictions, key)


def export(predictions: DataFrame, geometry: DataFrame, key: str, oof: bool = False, geo: bool = True) -> DataFrame:
    """What is exported: with oof the out-of-fold scores with fold and true label, else key and score; with geo beside the geometry."""
    some = predictions if oof else predictions.select(key, "y_proba")
    return with_geometry(some, geometry, key) if geo else some


def importances(model, features: list[str], most: int = 30) -> list[tuple[str, float]]:
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))[:most]


def score_all(model, df: DataFrame, features: list[str], key: str) -> DataFrame:
    """key, y_proba; features that df lacks count as 0, others are ignored."""
    from pyspark.ml.functions import vector_to_array

    have = df.withColumns({c: F.lit(0.0) for c in features if c not in df.columns})
    return model.transform(assembled(have, features)).select(key, F.get(vector_to_array("probability"), F.lit(1)).cast("float").alias("y_proba"))


def stacked(target: DataFrame, key: str, predictions: DataFrame, name: str) -> DataFrame:
    """target with another unit's mean prediction as a feature, 0 where there is none."""
    mean = predictions.groupBy(key).agg(F.avg("y_proba").alias(name))
    return target.join(mean, key, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def center_folds(df: DataFrame, k: int, x: str = "x", y: str = "y", seed: int = 42, name: str = "fold"):
    """Spatial folds by k-means on coordinates: rows with their fold, and the model to place further points."""
    from pyspark.ml.clustering import KMeans

    rows = assembled(df, [x, y])
    model = KMeans(k=k, seed=seed, predictionCol=name).fit(rows)
    return model.transform(rows).drop("features"), model
