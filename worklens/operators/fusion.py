"""Detector outputs brought together per project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worklens.functions.values import clip
from worklens.operators.shaping import rename_legacy, require_columns, require_unique
from worklens.operators.similarity import SimilarTexts, neighbours
from worklens.session import materialize

LEGACY = {"anomaly_score": "cost_anomaly_score", "anomaly_reason": "cost_anomaly_reason"}
ANOMALY_COLUMNS = ("cost_anomaly_flag", "cost_anomaly_score", "cost_anomaly_reason")

# Weight of each detector and least score of each level.
WEIGHTS = {"isolation_forest_flag": 40, "zscore_flag": 25, "iqr_flag": 20, "duplicate_flag": 15}
LEVELS = ((80, "Critical"), (50, "High"), (20, "Medium"))


def merge_detectors(duplicates: DataFrame, anomalies: DataFrame, validate: bool = True) -> DataFrame:
    """Duplicate results with the cost results of the same project.

    A project the cost detector never saw keeps a NULL flag and is marked
    unavailable; absence is not a clean bill.
    """
    for frame, label in ((duplicates, "Duplicate output"), (anomalies, "Anomaly output")):
        require_columns(frame, ("project_id",), label)
        if validate:
            require_unique(frame, label=label)
    anomalies = rename_legacy(anomalies, LEGACY)
    require_columns(anomalies, ANOMALY_COLUMNS, "Anomaly output")
    if "cost_anomaly_available" not in anomalies.columns:
        anomalies = anomalies.withColumn("cost_anomaly_available", F.lit(True))
    kept = anomalies.select("project_id", *ANOMALY_COLUMNS, "cost_anomaly_available")
    return duplicates.join(kept, "project_id", "left").withColumns(
        {
            "cost_anomaly_available": F.coalesce(F.col("cost_anomaly_available").cast("boolean"), F.lit(False)),
            "cost_anomaly_reason": F.coalesce("cost_anomaly_reason", F.lit("")),
        }
    )


def ml_risk_level(score: Column) -> Column:
    level = F.lit(None).cast("string")
    for least, name in reversed(LEVELS):
        level = F.when(score >= least, name).otherwise(level)
    return F.coalesce(level, F.when(score > 0, "Low").otherwise("Normal"))


def best_similarity(pairs: DataFrame, both_sides: bool = False) -> DataFrame:
    """Highest pair score of each project; by default only of the pair's first project."""
    sides = pairs.select("project_id", "similarity_score")
    if both_sides:
        sides = sides.unionByName(pairs.select(F.col("similar_project_id").alias("project_id"), "similarity_score"))
    return sides.groupBy("project_id").agg(F.max("similarity_score").alias("similarity_score"))


def similarity_of_rows(found: SimilarTexts, both_sides: bool = False) -> DataFrame:
    """Highest score of each project in its similar pairs, from the factored result.

    By default a project counts as the first of a pair only: some similar row,
    a copy of its own text included, comes after it. Per text only neighbours
    matter that reach a later row than all with a higher score, so pairs of
    rows are never listed.
    """
    near = neighbours(found)
    if both_sides:
        best = near.groupBy("text").agg(F.max("score").alias("similarity_score"))
        return found.members.join(best, "text").select(F.col("id").alias("project_id"), "similarity_score")
    last = found.members.groupBy("text").agg(F.max("seq").alias("last")).withColumnRenamed("text", "other")
    before = W.partitionBy("text").orderBy(F.desc("score"), F.desc("last")).rowsBetween(W.unboundedPreceding, -1)
    reach = (
        near.join(last, "other")
        .withColumn("_reached", F.max("last").over(before))
        .where(F.col("_reached").isNull() | (F.col("last") > F.col("_reached")))
        .select("text", "score", "last")
    )
    return (
        found.members.join(materialize(reach, "text-reach"), "text")
        .where(F.col("last") > F.col("seq"))
        .groupBy(F.col("id").alias("project_id"))
        .agg(F.max("score").alias("similarity_score"))
    )


def fuse_detectors(
    forest: DataFrame,
    zscore_ids: DataFrame,
    iqr_ids: DataFrame,
    similarity: DataFrame,
) -> DataFrame:
    """Weighted machine score 0..100 and level of every project of the forest.

    ``forest`` has project_id, cost_anomaly_flag, anomaly_score, anomaly_reason;
    the id tables list flagged projects; ``similarity`` has one row per project
    with a similar description.
    """
    joined = (
        forest.select(
            "project_id",
            F.col("cost_anomaly_flag").alias("isolation_forest_flag"),
            "anomaly_score",
            "anomaly_reason",
        )
        .join(zscore_ids.select("project_id").distinct().withColumn("zscore_flag", F.lit(1)), "project_id", "left")
        .join(iqr_ids.select("project_id").distinct().withColumn("iqr_flag", F.lit(1)), "project_id", "left")
        .join(
            similarity.select("project_id", "similarity_score").withColumn("duplicate_flag", F.lit(1)),
            "project_id",
            "left",
        )
        .fillna({"zscore_flag": 0, "iqr_flag": 0, "duplicate_flag": 0, "similarity_score": 0.0})
    )
    total = sum((F.col(name) * weight for name, weight in WEIGHTS.items()), F.lit(0))
    scored = joined.withColumn("ml_risk_score", clip(total, 0, 100))
    return scored.withColumn("ml_risk_level", ml_risk_level(F.col("ml_risk_score")))
