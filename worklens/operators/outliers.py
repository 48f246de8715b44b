"""Cost outliers against peers and global spending outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens.functions.values import category, flag, join_labels, to_double
from worklens.operators.percentiles import grain_statistics, grouped_statistics
from worklens.operators.shaping import with_row
from worklens.session import materialize

MINIMUM_PEERS = 20
QUARTILES = {"peer_q1_cost": 0.25, "peer_median_cost": 0.5, "peer_q3_cost": 0.75}

# Reason texts of the cost detector.
IQR_REASON = "Outside the peer-group IQR"
ZSCORE_REASON = "Large peer-group z-score"
MEDIAN_REASON = "Cost is at least twice the peer median"
FOREST_REASON = "Detected by Isolation Forest pattern analysis"
MISSING_COST_REASON = "Missing cost_amount; not analyzed."


def peer_groups(
    projects: DataFrame, state: str = "state", work_type: str = "work_type", cost: str = "cost_amount"
) -> DataFrame:
    """Projects with a cost, their peer categories filled for NULL and blank."""
    return (
        projects.withColumn(cost, to_double(F.col(cost)))
        .where(F.col(cost).isNotNull())
        .withColumns(
            {
                "_state": category(F.col(state).cast("string")),
                "_work_type": category(F.col(work_type).cast("string")),
            }
        )
    )


def peer_statistics(peers: DataFrame, *grains: Sequence[str], cost: str = "cost_amount") -> list[DataFrame]:
    """Count, quartiles, sample deviation and IQR of the peer groups of every grain."""
    others = {"peer_count": F.count(cost), "peer_std_cost": F.stddev_samp(cost)}
    tables = grain_statistics(peers, grains, cost, QUARTILES, others)
    return [t.withColumn("peer_iqr_cost", F.col("peer_q3_cost") - F.col("peer_q1_cost")) for t in tables]


def compare_with_peers(
    projects: DataFrame,
    minimum_peer_size: int = MINIMUM_PEERS,
    state: str = "state",
    work_type: str = "work_type",
    cost: str = "cost_amount",
) -> DataFrame:
    """Every project with a cost next to the statistics of its peers.

    Peers share state and work type; groups under ``minimum_peer_size`` fall
    back to everyone of the same work type.
    """
    if minimum_peer_size < 2:
        raise ValueError("minimum_peer_size must be at least 2")
    peers = peer_groups(projects, state, work_type, cost)
    measures = ["peer_count", "peer_median_cost", "peer_q1_cost", "peer_q3_cost", "peer_std_cost", "peer_iqr_cost"]
    near, wide = peer_statistics(peers, ["_state", "_work_type"], ["_work_type"], cost=cost)
    use_near = F.col("near.peer_count") >= minimum_peer_size
    # The basis is settled on the statistics tables, so projects join once. It is
    # written first: its true size then decides whether projects must move at all.
    basis = materialize(
        near.alias("near")
        .join(wide.alias("wide"), "_work_type")
        .select(
            F.col("near._state").alias("_state"),
            "_work_type",
            F.when(use_near, F.lit("state_work_type")).otherwise(F.lit("work_type")).alias("peer_basis"),
            *[F.when(use_near, F.col(f"near.{c}")).otherwise(F.col(f"wide.{c}")).alias(c) for c in measures],
        ),
        "peer-basis",
    )
    median, std = F.col("peer_median_cost"), F.coalesce(F.col("peer_std_cost"), F.lit(0.0))
    distance = F.col(cost) - median
    reach = 1.5 * F.col("peer_iqr_cost")
    return (
        peers.join(basis, ["_state", "_work_type"])
        .withColumns(
            {
                "cost_deviation_pct": F.try_divide(distance, median),
                "cost_zscore": F.when(std > 0, F.try_divide(distance, std)).otherwise(F.lit(0.0)),
                "cost_iqr_flag": flag(
                    (F.col(cost) < F.col("peer_q1_cost") - reach) | (F.col(cost) > F.col("peer_q3_cost") + reach)
                ),
            }
        )
        .drop("_state", "_work_type")
    )


def cost_reasons(forest_flag: Column) -> Column:
    """Reason text of a project compared with its peers; may be '' ."""
    outside = F.col("cost_iqr_flag") == 1
    far = F.coalesce(F.abs("cost_zscore") >= 3, F.lit(False))
    double = F.coalesce(F.col("cost_deviation_pct") >= 1, F.lit(False))
    only_forest = (forest_flag == 1) & ~outside & ~far & ~double
    return join_labels(
        [
            (outside, F.lit(IQR_REASON)),
            (far, F.lit(ZSCORE_REASON)),
            (double, F.lit(MEDIAN_REASON)),
            (only_forest, F.lit(FOREST_REASON)),
        ]
    )


def zscore_outliers(df: DataFrame, value: str = "total_expenditure", threshold: float = 3.0) -> DataFrame:
    """Rows with a value, their absolute z-score (population deviation) and flag."""
    rows = df.where(F.col(value).isNotNull())
    stats = rows.agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    scored = with_row(rows, stats).withColumn(
        "z_score", F.abs(F.try_divide(F.col(value) - F.col("_mean"), F.col("_std")))
    )
    return scored.withColumn("zscore_anomaly_flag", flag(F.col("z_score") > threshold)).drop("_mean", "_std")


def iqr_bounds(df: DataFrame, value: str = "total_expenditure") -> DataFrame:
    """One row: quartiles, IQR and both fences of a column."""
    stats = grouped_statistics(df, [], value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return stats.select(
        "q1",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - 1.5 * iqr).alias("lower_bound"),
        (F.col("q3") + 1.5 * iqr).alias("upper_bound"),
    )


def iqr_outliers(df: DataFrame, value: str = "total_expenditure") -> DataFrame:
    """Rows with a value and a flag for lying above the upper fence."""
    rows = df.where(F.col(value).isNotNull())
    fence = iqr_bounds(rows, value).select(F.col("upper_bound").alias("_fence"))
    return (
        with_row(rows, fence)
        .withColumn("iqr_anomaly_flag", flag(F.col(value) > F.col("_fence")))
        .drop("_fence")
    )

