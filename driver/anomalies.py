"""Peer statistics, global outliers and isolation forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver import views
from driver.forests import forest_views
from driver.lifecycle import rounded
from driver.registry import query
from worklens.operators import forest, outliers
from worklens.operators.features import add_features
from worklens.operators.lifecycle import expenditure_summary
from worklens.operators.percentiles import grouped_statistics
from worklens.operators.shaping import top

_STATS = """count(cost_amount) AS peer_count,
    round(quantile_cont(CAST(cost_amount AS DOUBLE), 0.5), 4) AS peer_median_cost,
    round(quantile_cont(CAST(cost_amount AS DOUBLE), 0.25), 4) AS peer_q1_cost,
    round(quantile_cont(CAST(cost_amount AS DOUBLE), 0.75), 4) AS peer_q3_cost,
    round(stddev_samp(cost_amount), 4) AS peer_std_cost,
    round(quantile_cont(CAST(cost_amount AS DOUBLE), 0.75) - quantile_cont(CAST(cost_amount AS DOUBLE), 0.25), 4) AS peer_iqr_cost"""
_MEASURES = ("peer_median_cost", "peer_q1_cost", "peer_q3_cost", "peer_std_cost", "peer_iqr_cost")


def _peer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = outliers.peer_groups(views.peers(spark, sf_dir))
    (stats,) = outliers.peer_statistics(groups, ["_state", "_work_type"])
    return rounded(stats.withColumnsRenamed({"_state": "state", "_work_type": "work_type"}), *_MEASURES)


_PEER_SQL = views.with_views("peers", body=f"SELECT state, work_type, {_STATS} FROM peers GROUP BY state, work_type")


@query(_PEER_SQL)
def peer_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _peer_stats(spark, sf_dir)


_MEASURED = {
    "near": """SELECT state, work_type, count(*) AS n, quantile_cont(CAST(cost_amount AS DOUBLE), 0.5) AS med,
        quantile_cont(CAST(cost_amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(cost_amount AS DOUBLE), 0.75) AS q3,
        stddev_samp(cost_amount) AS sd FROM peers GROUP BY state, work_type""",
    "wide": """SELECT work_type, count(*) AS n, quantile_cont(CAST(cost_amount AS DOUBLE), 0.5) AS med,
        quantile_cont(CAST(cost_amount AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(cost_amount AS DOUBLE), 0.75) AS q3,
        stddev_samp(cost_amount) AS sd FROM peers GROUP BY work_type""",
    "based": """SELECT p.project_id, p.cost_amount, CASE WHEN n.n >= 20 THEN 'state_work_type' ELSE 'work_type' END AS peer_basis,
        CASE WHEN n.n >= 20 THEN n.n ELSE w.n END AS cnt, CASE WHEN n.n >= 20 THEN n.med ELSE w.med END AS med,
        CASE WHEN n.n >= 20 THEN n.q1 ELSE w.q1 END AS q1, CASE WHEN n.n >= 20 THEN n.q3 ELSE w.q3 END AS q3,
        CASE WHEN n.n >= 20 THEN n.sd ELSE w.sd END AS sd
        FROM peers p JOIN near n USING (state, work_type) JOIN wide w USING (work_type)""",
    "measured": """SELECT project_id, peer_basis, cnt AS peer_count, med, q3 - q1 AS iqr, (cost_amount - med) / nullif(med, 0) AS dev,
        CASE WHEN coalesce(sd, 0) > 0 THEN (cost_amount - med) / sd ELSE 0 END AS z,
        CASE WHEN cost_amount < q1 - 1.5 * (q3 - q1) OR cost_amount > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END AS flag
        FROM based""",
}


@query(
    views.with_views(
        "peers",
        extra=_MEASURED,
        body="""
        SELECT project_id, peer_basis, peer_count, round(med, 4) AS peer_median_cost, round(iqr, 4) AS peer_iqr_cost,
               round(dev, 6) AS cost_deviation_pct, round(z, 6) AS cost_zscore, flag AS cost_iqr_flag,
               concat_ws('; ', CASE WHEN flag = 1 THEN 'Outside the peer-group IQR' END,
                         CASE WHEN abs(z) >= 3 THEN 'Large peer-group z-score' END,
                         CASE WHEN dev >= 1 THEN 'Cost is at least twice the peer median' END) AS cost_anomaly_reason
        FROM measured""",
    )
)
def peer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects against their peers, with the reasons that need no forest."""
    compared = outliers.compare_with_peers(views.peers(spark, sf_dir))
    result = compared.select(
        "project_id",
        "peer_basis",
        "peer_count",
        "peer_median_cost",
        "peer_iqr_cost",
        "cost_deviation_pct",
        "cost_zscore",
        "cost_iqr_flag",
        outliers.cost_reasons(F.lit(0)).alias("cost_anomaly_reason"),
    )
    return rounded(rounded(result, "peer_median_cost", "peer_iqr_cost"), "cost_deviation_pct", "cost_zscore", digits=6)


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expenditure_summary(views.bare_payments(spark, sf_dir), date=None)


@query(
    views.with_views(
        "payments",
        "totals",
        extra={"s": "SELECT avg(total_expenditure) AS m, stddev_pop(total_expenditure) AS sd FROM totals"},
        body="""
        SELECT project_id, round(total_expenditure, 4) AS total_expenditure,
               round(abs((total_expenditure - m) / sd), 6) AS z_score,
               CASE WHEN abs((total_expenditure - m) / sd) > 3 THEN 1 ELSE 0 END AS zscore_anomaly_flag
        FROM totals, s""",
    )
)
def zscore_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = outliers.zscore_outliers(_totals(spark, sf_dir)).drop("payment_count")
    return rounded(rounded(scored, "total_expenditure"), "z_score", digits=6)


@query(
    views.with_views(
        "payments",
        "totals",
        extra={"s": "SELECT avg(total_expenditure) AS m, stddev_pop(total_expenditure) AS sd FROM totals"},
        body="""
        SELECT project_id, round(total_expenditure, 4) AS total_expenditure, round(abs((total_expenditure - m) / sd), 6) AS z_score
        FROM totals, s ORDER BY round(abs((total_expenditure - m) / sd), 9) DESC, project_id LIMIT 20""",
    )
)
def top_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 projects furthest from the mean."""
    scored = outliers.zscore_outliers(_totals(spark, sf_dir))
    furthest = top(scored, 20, F.desc(F.round("z_score", 9))).select("project_id", "total_expenditure", "z_score")
    return rounded(rounded(furthest, "total_expenditure"), "z_score", digits=6)


_FENCE = """SELECT quantile_cont(total_expenditure, 0.25) AS q1, quantile_cont(total_expenditure, 0.75) AS q3 FROM totals"""


@query(
    views.with_views(
        "payments",
        "totals",
        extra={"f": _FENCE},
        body="""
        SELECT project_id, round(total_expenditure, 4) AS total_expenditure FROM totals, f
        WHERE total_expenditure > q3 + 1.5 * (q3 - q1)""",
    )
)
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = outliers.iqr_outliers(_totals(spark, sf_dir)).where("iqr_anomaly_flag = 1")
    return rounded(flagged.select("project_id", "total_expenditure"), "total_expenditure")


@query(
    views.with_views(
        "payments",
        "totals",
        extra={"f": _FENCE},
        body="""
        SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
               round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound FROM f""",
    )
)
def iqr_bounds_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global quartiles."""
    bounds = outliers.iqr_bounds(_totals(spark, sf_dir))
    return rounded(bounds, "q1", "q3", "iqr", "lower_bound", "upper_bound")


@query(
    views.with_views(
        "payments",
        "totals",
        body="SELECT quantile_cont(CAST(payment_count AS DOUBLE), 0.95) AS payment_threshold FROM totals",
    )
)
def payment_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_statistics(_totals(spark, sf_dir), [], "payment_count", {"payment_threshold": 0.95})


def features_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_features(views.projects(spark, sf_dir), views.AS_OF)


#: Spending features of projects with payments, missing ones as 0, and the detector's reasons.
SPENT = {
    "spent": f"""SELECT project_id, payment_count, total_expenditure, total_expenditure / nullif(sanction_amount, 0) AS fund_utilization,
        total_expenditure / nullif(recommended_amount, 0) AS expenditure_ratio,
        date_diff('day', sanction_date, DATE '{views.AS_OF}') AS project_age_days,
        CASE WHEN total_expenditure > sanction_amount THEN 1 ELSE 0 END AS over_budget FROM projects WHERE total_expenditure IS NOT NULL""",
    "filled": "SELECT project_id, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0) AS {c}" for c in forest.PATTERN_SPEC.numeric) + " FROM spent",
    **forest_views("filled", forest.PATTERN_SPEC),
    "many": "SELECT quantile_cont(CAST(payment_count AS DOUBLE), 0.95) AS many FROM spent",
    "told": """SELECT s.*, d.decision, d.forest_flag, concat_ws('; ',
        CASE WHEN over_budget = 1 THEN 'Expenditure exceeds sanctioned amount' END,
        CASE WHEN fund_utilization > 1 THEN 'Fund utilization above 100%' END,
        CASE WHEN project_age_days > 700 THEN 'Project age unusually high' END,
        CASE WHEN payment_count > many THEN 'Unusually high number of payments' END) AS reasons FROM spent s JOIN decided d USING (project_id), many""",
    "patterns": """SELECT *, CASE WHEN reasons = '' THEN 'Detected by Isolation Forest pattern analysis' ELSE reasons END AS anomaly_reason FROM told""",
}
PROJECT_VIEWS = ("works", "payments", "totals", "completions", "projects")


@query(
    views.with_views(
        *PROJECT_VIEWS,
        extra=SPENT,
        body="SELECT project_id, forest_flag AS cost_anomaly_flag, round(decision, 6) AS anomaly_score, anomaly_reason FROM patterns",
    )
)
def iforest_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation forest over the spending features."""
    result, _ = forest.detect_spending_patterns(features_of(spark, sf_dir))
    return rounded(
        result.select("project_id", "cost_anomaly_flag", "anomaly_score", "anomaly_reason"), "anomaly_score", digits=6
    )


@query(
    views.with_views(
        *PROJECT_VIEWS,
        extra=SPENT,
        body="""
        SELECT project_id, round(fund_utilization, 6) AS fund_utilization, round(expenditure_ratio, 6) AS expenditure_ratio, payment_count,
               project_age_days, over_budget, round(decision, 6) AS anomaly_score, anomaly_reason
        FROM patterns WHERE forest_flag = 1 ORDER BY round(decision, 9), project_id LIMIT 10""",
    )
)
def iforest_most_anomalous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten oddest flagged projects."""
    result, _ = forest.detect_spending_patterns(features_of(spark, sf_dir))
    flagged = result.where("cost_anomaly_flag = 1").select(
        "project_id", *forest.PATTERN_SPEC.numeric, "anomaly_score", "anomaly_reason"
    )
    oddest = top(flagged, 10, F.asc(F.round("anomaly_score", 9)))
    return rounded(oddest, "fund_utilization", "expenditure_ratio", "anomaly_score", digits=6)


_COSTS = {
    "logged": """SELECT project_id, CASE WHEN cost_amount <= -1 THEN -37.0 ELSE ln(1 + cost_amount) END AS log_cost_amount,
        work_type, state, district, work_category FROM peers""",
    **forest_views("logged", forest.COST_SPEC),
}


#: The cost detector over ``peers``: ``cost_anomalies`` and what it stands on.
COST_ANOMALIES = {
    **_MEASURED,
    **_COSTS,
    "cost_anomalies": """
        SELECT project_id, peer_count, round(med, 6) AS peer_median_cost, round(iqr, 6) AS peer_iqr_cost, round(dev, 6) AS cost_deviation_pct,
               round(z, 6) AS cost_zscore, flag AS cost_iqr_flag, forest_flag AS cost_anomaly_flag, round(-decision, 6) AS cost_anomaly_score,
               concat_ws('; ', CASE WHEN flag = 1 THEN 'Outside the peer-group IQR' END,
                         CASE WHEN abs(z) >= 3 THEN 'Large peer-group z-score' END,
                         CASE WHEN dev >= 1 THEN 'Cost is at least twice the peer median' END,
                         CASE WHEN forest_flag = 1 AND flag = 0 AND NOT coalesce(abs(z) >= 3, FALSE) AND NOT coalesce(dev >= 1, FALSE)
                              THEN 'Detected by Isolation Forest pattern analysis' END) AS cost_anomaly_reason
        FROM measured JOIN decided USING (project_id)""",
}


@query(views.with_views("peers", extra=COST_ANOMALIES, body="SELECT *, TRUE AS cost_anomaly_available FROM cost_anomalies"))
def iforest_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost detector: peers, isolation forest and reasons of every project."""
    result, _ = forest.detect_cost_anomalies(views.peers(spark, sf_dir), validate=False)
    measures = ("peer_median_cost", "peer_iqr_cost", "cost_deviation_pct", "cost_zscore", "cost_anomaly_score")
    return rounded(result, *measures, digits=6)


_COST_SCORES = views.with_views("peers", extra=_COSTS, body="SELECT project_id, round(-decision, 6) AS cost_anomaly_score FROM decided ORDER BY round(-decision, 9) DESC, project_id LIMIT 20")


@query(_COST_SCORES)
def top_cost_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 projects that the forest finds oddest."""
    result, _ = forest.detect_cost_anomalies(views.peers(spark, sf_dir), validate=False)
    oddest = top(result, 20, F.desc(F.round("cost_anomaly_score", 9))).select("project_id", "cost_anomaly_score")
    return rounded(oddest, "cost_anomaly_score", digits=6)


_SCALED = forest.PATTERN_SPEC.numeric


@query(
    views.with_views(
        *PROJECT_VIEWS,
        extra={
            "spent": SPENT["spent"],
            "filled": SPENT["filled"],
            "s": "SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED) + " FROM filled",
        },
        body="SELECT project_id, " + ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1 END, 4) AS {c}" for c in _SCALED) + " FROM filled, s",
    )
)
def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five spending features, missing ones as 0, on one scale."""
    spent = features_of(spark, sf_dir).where("total_expenditure IS NOT NULL").select("project_id", *_SCALED)
    scaled, _ = forest.standard_scale(spent, _SCALED)
    return rounded(scaled, *_SCALED)


@query(
    views.with_views(
        "peers",
        extra=_MEASURED,
        body="""
        SELECT project_id, peer_count, round(med, 4) AS peer_median_cost, round(iqr, 4) AS peer_iqr_cost, round(dev, 6) AS cost_deviation_pct,
               round(z, 6) AS cost_zscore, flag AS cost_iqr_flag, 1 AS cost_anomaly_available,
               CASE WHEN flag = 1 THEN 1 ELSE 0 END AS names_iqr, CASE WHEN abs(z) >= 3 THEN 1 ELSE 0 END AS names_zscore,
               CASE WHEN dev >= 1 THEN 1 ELSE 0 END AS names_median
        FROM measured""",
    )
)
def cost_detector_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the full cost detector says apart from the forest's own score."""
    result, _ = forest.detect_cost_anomalies(views.peers(spark, sf_dir), validate=False)
    reason = F.col("cost_anomaly_reason")
    table = result.select(
        "project_id",
        "peer_count",
        "peer_median_cost",
        "peer_iqr_cost",
        "cost_deviation_pct",
        "cost_zscore",
        "cost_iqr_flag",
        F.col("cost_anomaly_available").cast("int").alias("cost_anomaly_available"),
        F.contains(reason, F.lit(outliers.IQR_REASON)).cast("int").alias("names_iqr"),
        F.contains(reason, F.lit(outliers.ZSCORE_REASON)).cast("int").alias("names_zscore"),
        F.contains(reason, F.lit(outliers.MEDIAN_REASON)).cast("int").alias("names_median"),
    )
    return rounded(rounded(table, "peer_median_cost", "peer_iqr_cost"), "cost_deviation_pct", "cost_zscore", digits=6)


@query(
    views.with_views(
        "works",
        "payments",
        "totals",
        "completions",
        "projects",
        extra={
            "p": "SELECT quantile_cont(CAST(payment_count AS DOUBLE), 0.95) AS many FROM totals",
            "r": f"""SELECT project_id, concat_ws('; ',
                CASE WHEN total_expenditure > sanction_amount THEN 'Expenditure exceeds sanctioned amount' END,
                CASE WHEN total_expenditure / sanction_amount > 1 THEN 'Fund utilization above 100%' END,
                CASE WHEN date_diff('day', sanction_date, DATE '{views.AS_OF}') > 700 THEN 'Project age unusually high' END,
                CASE WHEN payment_count > many THEN 'Unusually high number of payments' END) AS reasons
                FROM projects, p WHERE total_expenditure IS NOT NULL""",
        },
        body="""SELECT project_id, CASE WHEN reasons = '' THEN 'Detected by Isolation Forest pattern analysis' ELSE reasons END AS anomaly_reason FROM r""",
    )
)
def spending_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reason text of every project with payments, flagged or not."""
    result, _ = forest.detect_spending_patterns(features_of(spark, sf_dir))
    return result.select("project_id", "anomaly_reason")
