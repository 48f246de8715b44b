"""Rule engine, detector merge, fusion and the end-to-end risk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver import views
from driver.anomalies import COST_ANOMALIES, PROJECT_VIEWS, SPENT, features_of
from driver.lifecycle import SIDES, rounded
from driver.registry import query
from driver.text import CORPUS, rollup_sql
from worklens.operators import fusion, outliers, quality
from worklens.operators.forest import detect_spending_patterns
from worklens.operators.lifecycle import expenditure_summary
from worklens.operators.rules import FLAGS, RiskRules, flag_counts as count_flags, score_projects
from worklens.operators.shaping import top
from worklens.operators.similarity import PROJECT_MODEL, similar_texts
from worklens.plans.monitoring import Artefacts, MonitoringResult, run
from worklens.session import materialize, new_path, scratch

RULES = RiskRules(as_of=views.AS_OF, portal_launch=views.PORTAL_LAUNCH)


def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in duplicate output: same customer and day is exact, same customer,
    priority and month is potential."""
    orders = views.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderdate").cast("date").alias("day")
    )
    month = F.trunc("day", "month")
    exact = orders.groupBy("o_custkey", "day").agg(F.count(F.lit(1)).alias("same_day"))
    near = orders.groupBy("o_custkey", "o_orderpriority", month.alias("month")).agg(
        F.count(F.lit(1)).alias("same_month"), F.min("o_orderkey").alias("first")
    )
    joined = orders.withColumn("month", month).join(exact, ["o_custkey", "day"]).join(
        near, ["o_custkey", "o_orderpriority", "month"]
    )
    is_exact, is_near = F.col("same_day") > 1, F.col("same_month") > 1
    return joined.select(
        views.project_key("o_orderkey").alias("project_id"),
        is_exact.alias("exact_duplicate_flag"),
        (is_exact | is_near).alias("potential_duplicate_flag"),
        F.when(is_near, F.round(1 - 1 / F.col("same_month"), 4)).otherwise(F.lit(0.0)).alias("similarity_score"),
        F.when(is_exact, "Exact description duplicate within the same constituency.")
        .when(is_near, F.concat(F.lit("Description is similar to "), "first", F.lit(".")))
        .otherwise("")
        .alias("duplicate_reason"),
        F.when(is_near, F.col("first").cast("string")).otherwise("").alias("similar_project_id"),
    )


def cost_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in cost output: upper-fence outliers of the payment total."""
    return fence_flags(materialize(expenditure_summary(views.bare_payments(spark, sf_dir), date=None), "totals"))


def fence_flags(totals: DataFrame) -> DataFrame:
    return outliers.iqr_outliers(totals).select(
        "project_id",
        F.col("iqr_anomaly_flag").alias("cost_anomaly_flag"),
        F.round(F.col("total_expenditure") / 1_000_000, 6).alias("anomaly_score"),
        F.when(F.col("iqr_anomaly_flag") == 1, outliers.IQR_REASON).otherwise("").alias("anomaly_reason"),
    )


def detectors(spark: SparkSession, sf_dir: str, costs: DataFrame | None = None, duplicates: DataFrame | None = None) -> DataFrame:
    costs = cost_flags(spark, sf_dir) if costs is None else costs
    duplicates = duplicate_flags(spark, sf_dir) if duplicates is None else duplicates
    return fusion.merge_detectors(duplicates, costs, validate=False)


BASE = ("works", "payments", "totals", "completions", "projects")
DETECTORS = {
    "dup_orders": """SELECT *, CAST(o_orderdate AS DATE) AS day, date_trunc('month', o_orderdate) AS month,
        count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS same_day,
        count(*) OVER (PARTITION BY o_custkey, o_orderpriority, date_trunc('month', o_orderdate)) AS same_month,
        min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority, date_trunc('month', o_orderdate)) AS first FROM orders""",
    "dup": """SELECT 'WS/MP' || o_orderkey || '/2024-2025/' || o_orderkey AS project_id,
        CASE WHEN same_day > 1 THEN 1 ELSE 0 END AS exact_duplicate_flag,
        CASE WHEN same_day > 1 OR same_month > 1 THEN 1 ELSE 0 END AS potential_duplicate_flag,
        CASE WHEN same_month > 1 THEN round(1 - 1 / same_month, 4) ELSE 0 END AS similarity_score,
        CASE WHEN same_day > 1 THEN 'Exact description duplicate within the same constituency.'
             WHEN same_month > 1 THEN 'Description is similar to ' || first || '.' ELSE '' END AS duplicate_reason,
        CASE WHEN same_month > 1 THEN CAST(first AS VARCHAR) ELSE '' END AS similar_project_id FROM dup_orders""",
    "fence": """SELECT quantile_cont(total_expenditure, 0.75) + 1.5 * (quantile_cont(total_expenditure, 0.75) - quantile_cont(total_expenditure, 0.25)) AS upper
        FROM totals""",
    "cost": """SELECT project_id, CASE WHEN total_expenditure > upper THEN 1 ELSE 0 END AS cost_anomaly_flag,
        round(total_expenditure / 1000000, 6) AS cost_anomaly_score,
        CASE WHEN total_expenditure > upper THEN 'Outside the peer-group IQR' ELSE '' END AS cost_anomaly_reason FROM totals, fence""",
    "detectors": """SELECT dup.*, cost_anomaly_flag, cost_anomaly_score, coalesce(cost_anomaly_reason, '') AS cost_anomaly_reason,
        CASE WHEN cost_anomaly_flag IS NULL THEN 0 ELSE 1 END AS cost_anomaly_available
        FROM dup LEFT JOIN cost USING (project_id)""",
}


@query(views.with_views(*BASE, extra=DETECTORS, body="SELECT * FROM detectors"))
def merged_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = ("exact_duplicate_flag", "potential_duplicate_flag", "cost_anomaly_available")
    return detectors(spark, sf_dir).withColumns({c: F.col(c).cast("int") for c in flags})


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_projects(views.projects(spark, sf_dir), detectors(spark, sf_dir), RULES)


def _b(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


# Fixed values, written out here so that the SQL does not follow the code it checks.
_POINTS = """delay_flag * 35 + stalled_flag * 30 + over_expenditure_flag * 30 + exact_duplicate_flag * 25 + status_flag * 20
    + sanction_delay_flag * 15 + invalid_date_flag * 15 + cost_anomaly_flag * 15 + potential_duplicate_flag * 10
    + low_amount_flag * 10 + pending_mark_flag * 8"""
_LABELS = """CASE WHEN delay_flag = 1 THEN 'Project delayed beyond 1 year from sanction' END,
    CASE WHEN stalled_flag = 1 THEN 'Incomplete and older than 1 year' END,
    CASE WHEN pending_mark_flag = 1 THEN 'Expenditure suggests work is finished, but not yet marked complete on the portal' END,
    CASE WHEN sanction_delay_flag = 1 THEN 'Sanction took more than 45 days after recommendation' END,
    CASE WHEN over_expenditure_flag = 1 THEN 'Expenditure exceeds sanctioned amount' END,
    CASE WHEN invalid_date_flag = 1 THEN 'Completion date is before sanction date' END,
    CASE WHEN status_flag = 1 THEN 'Work status does not match completion information' END,
    CASE WHEN low_amount_flag = 1 THEN 'Cost is below the usual Rs 2.5 lakh guideline' END,
    CASE WHEN cost_anomaly_flag = 1 THEN 'Cost anomaly indicated by ML' END,
    CASE WHEN exact_duplicate_flag = 1 THEN 'Exact duplicate work indicated by ML' END,
    CASE WHEN potential_duplicate_flag = 1 THEN 'Potential similar work indicated by ML' END,
    CASE WHEN pre_portal_flag = 1 THEN 'Recommendation/sanction predates the eSAKSHI portal (pre-FY2023-24) — underlying data may be incomplete' END,
    CASE WHEN awaiting_sanction_flag = 1 THEN 'Not yet sanctioned — recommended only, execution has not started' END"""

SCORED = {
    **DETECTORS,
    "joined": f"""SELECT p.*, d.* EXCLUDE (project_id, cost_anomaly_flag), d.cost_anomaly_flag AS raw_anomaly,
        coalesce(d.cost_anomaly_flag, 0) * d.cost_anomaly_available AS cost_anomaly_flag,
        coalesce(p.total_expenditure, p.amount_disbursed) AS spend,
        date_diff('day', sanction_date, DATE '{views.AS_OF}') AS age,
        date_diff('day', sanction_date, coalesce(completion_date, DATE '{views.AS_OF}')) AS delay_days
        FROM projects p LEFT JOIN detectors d USING (project_id)""",
    "ratio": """SELECT *, CASE WHEN sanction_amount > 0 THEN spend / sanction_amount END AS spend_completion_ratio,
        coalesce(delay_days > 365, false) AS late, completion_date IS NULL AND coalesce(age > 365, false) AS stuck FROM joined""",
    "pending": f"SELECT *, {_b('(late OR stuck) AND coalesce(spend_completion_ratio >= 0.95, false)')} AS pending_mark_flag FROM ratio",
    "flags": f"""SELECT *, {_b('late AND pending_mark_flag = 0')} AS delay_flag, {_b('stuck AND pending_mark_flag = 0')} AS stalled_flag,
        {_b("date_diff('day', recommended_date, sanction_date) > 45")} AS sanction_delay_flag,
        {_b('spend > sanction_amount')} AS over_expenditure_flag, {_b('completion_date < sanction_date')} AS invalid_date_flag,
        {_b("completion_date IS NOT NULL AND lower(trim(work_status)) <> 'work completed'")} AS status_flag,
        {_b('cost_amount < 250000')} AS low_amount_flag,
        {_b(f"sanction_date < DATE '{views.PORTAL_LAUNCH}' OR recommended_date < DATE '{views.PORTAL_LAUNCH}'")} AS pre_portal_flag,
        {_b('sanction_date IS NULL AND completion_date IS NULL AND spend IS NULL')} AS awaiting_sanction_flag FROM pending""",
    "s0": f"SELECT *, least({_POINTS}, 100) AS v0 FROM flags",
    "s1": "SELECT *, CASE WHEN delay_flag = 1 AND over_expenditure_flag = 1 THEN greatest(v0, 90) ELSE v0 END AS v1 FROM s0",
    "s2": """SELECT *, CASE WHEN exact_duplicate_flag = 1 AND (over_expenditure_flag = 1 OR delay_flag = 1)
        THEN greatest(v1, 85) ELSE v1 END AS v2 FROM s1""",
    "s3": "SELECT *, CASE WHEN exact_duplicate_flag = 1 AND v2 < 60 THEN greatest(v2, 55) ELSE v2 END AS v3 FROM s2",
    "s4": "SELECT *, CASE WHEN stalled_flag = 1 AND age > 500 THEN greatest(v3, 85) ELSE v3 END AS v4 FROM s3",
    "s5": "SELECT *, CASE WHEN invalid_date_flag = 1 THEN greatest(v4, 55) ELSE v4 END AS v5 FROM s4",
    "s6": "SELECT *, CASE WHEN status_flag = 1 THEN greatest(v5, 50) ELSE v5 END AS risk_score FROM s5",
    "scored": f"""SELECT *, CASE WHEN risk_score >= 65 THEN 'HIGH' WHEN risk_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
        concat_ws('; ', {_LABELS},
            CASE WHEN (exact_duplicate_flag = 1 OR potential_duplicate_flag = 1) AND duplicate_reason <> '' THEN 'Duplicate detail: ' || duplicate_reason END,
            CASE WHEN cost_anomaly_flag = 1 AND cost_anomaly_reason <> '' THEN 'Cost anomaly detail: ' || cost_anomaly_reason END) AS indicators
        FROM s6""",
}
_FLAG_LIST = ", ".join(FLAGS)


@query(
    views.with_views(
        *BASE,
        extra=SCORED,
        body=f"""SELECT project_id, CAST(risk_score AS INTEGER) AS risk_score, risk_level, CAST(delay_days AS INTEGER) AS delay_days,
            round(spend_completion_ratio, 6) AS spend_completion_ratio, cost_anomaly_available, {_FLAG_LIST} FROM scored""",
    )
)
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = scored(spark, sf_dir).select(
        "project_id", "risk_score", "risk_level", "delay_days", "spend_completion_ratio", "cost_anomaly_available", *FLAGS
    )
    return rounded(table, "spend_completion_ratio", digits=6)


@query(
    views.with_views(
        *BASE,
        extra=SCORED,
        body="""
        SELECT project_id, indicators,
               CASE WHEN indicators <> '' THEN 'Flagged because: ' || indicators || '.'
                    ELSE 'No rule-based irregularity flagged on available fields.' END AS explanation,
               CASE WHEN awaiting_sanction_flag = 1 AND risk_score = 0 THEN 'Awaiting sanction — not yet applicable for execution risk.'
                    WHEN risk_score >= 65 THEN 'Prioritize for human verification.'
                    WHEN risk_score >= 35 THEN 'Review when resources allow.' ELSE 'Routine monitoring.' END AS recommended_action
        FROM scored""",
    )
)
def risk_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("project_id", "indicators", "explanation", "recommended_action")


@query(
    views.with_views(
        *BASE,
        extra=SCORED,
        body="""SELECT risk_level AS value, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct
            FROM scored GROUP BY 1""",
    )
)
def risk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.value_counts(scored(spark, sf_dir), "risk_level"), "share_pct", digits=6)


@query(
    views.with_views(
        *BASE,
        extra=SCORED,
        body=" UNION ALL ".join(f"SELECT '{c}' AS flag, CAST(sum({c}) AS BIGINT) AS raised FROM scored" for c in FLAGS),
    )
)
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_flags(scored(spark, sf_dir))


def _fusion_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    totals = materialize(expenditure_summary(views.bare_payments(spark, sf_dir), date=None), "totals")
    costs = materialize(fence_flags(totals), "cost-flags")
    z = outliers.zscore_outliers(totals).where("zscore_anomaly_flag = 1")
    return costs, z, costs.where("cost_anomaly_flag = 1")


@query(
    views.with_views(
        *BASE,
        extra={
            **DETECTORS,
            "zs": "SELECT avg(total_expenditure) AS m, stddev_pop(total_expenditure) AS sd FROM totals",
            "z": "SELECT project_id FROM totals, zs WHERE abs((total_expenditure - m) / sd) > 3",
            "iqr": "SELECT project_id FROM totals, fence WHERE total_expenditure > upper",
            "sim": "SELECT project_id, max(similarity_score) AS similarity_score FROM dup WHERE potential_duplicate_flag = 1 GROUP BY 1",
            "f": f"""SELECT c.project_id, c.cost_anomaly_flag AS isolation_forest_flag, c.cost_anomaly_score AS anomaly_score,
                c.cost_anomaly_reason AS anomaly_reason, {_b('z.project_id IS NOT NULL')} AS zscore_flag, {_b('iqr.project_id IS NOT NULL')} AS iqr_flag,
                {_b('sim.project_id IS NOT NULL')} AS duplicate_flag, coalesce(sim.similarity_score, 0) AS similarity_score
                FROM cost c LEFT JOIN z ON c.project_id = z.project_id LEFT JOIN iqr ON c.project_id = iqr.project_id
                LEFT JOIN sim ON c.project_id = sim.project_id""",
            "s": """SELECT *, CAST(least(greatest(isolation_forest_flag * 40 + zscore_flag * 25 + iqr_flag * 20 + duplicate_flag * 15, 0), 100) AS INTEGER)
                AS ml_risk_score FROM f""",
        },
        body="""SELECT *, CASE WHEN ml_risk_score >= 80 THEN 'Critical' WHEN ml_risk_score >= 50 THEN 'High'
            WHEN ml_risk_score >= 20 THEN 'Medium' WHEN ml_risk_score > 0 THEN 'Low' ELSE 'Normal' END AS ml_risk_level FROM s""",
    )
)
def ml_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted machine score from SQL-expressible detectors."""
    forest, z, iqr = _fusion_inputs(spark, sf_dir)
    pairs = duplicate_flags(spark, sf_dir).where("potential_duplicate_flag")
    return fusion.fuse_detectors(forest, z, iqr, fusion.best_similarity(pairs))


_LEVELLED = """SELECT *, CASE WHEN ml_risk_score >= 80 THEN 'Critical' WHEN ml_risk_score >= 50 THEN 'High'
    WHEN ml_risk_score >= 20 THEN 'Medium' WHEN ml_risk_score > 0 THEN 'Low' ELSE 'Normal' END AS ml_risk_level FROM s"""
_FUSED = {
    **SPENT,
    **rollup_sql(CORPUS, "lang", "lang"),
    "fence": DETECTORS["fence"],
    "zs": "SELECT avg(total_expenditure) AS m, stddev_pop(total_expenditure) AS sd FROM totals",
    "z": "SELECT project_id FROM totals, zs WHERE abs((total_expenditure - m) / sd) > 3",
    "iqr": "SELECT project_id FROM totals, fence WHERE total_expenditure > upper",
    "sim": """SELECT 'WS/MP' || doc_id || '/2024-2025/' || doc_id AS project_id, max(score) AS similarity_score
        FROM matches WHERE other > doc_id GROUP BY doc_id""",
    "f": f"""SELECT c.project_id, c.forest_flag AS isolation_forest_flag, round(c.decision, 6) AS anomaly_score, c.anomaly_reason,
        {_b('z.project_id IS NOT NULL')} AS zscore_flag, {_b('iqr.project_id IS NOT NULL')} AS iqr_flag,
        {_b('sim.project_id IS NOT NULL')} AS duplicate_flag, round(coalesce(sim.similarity_score, 0), 4) AS similarity_score
        FROM patterns c LEFT JOIN z ON c.project_id = z.project_id LEFT JOIN iqr ON c.project_id = iqr.project_id
        LEFT JOIN sim ON c.project_id = sim.project_id""",
    "s": """SELECT *, CAST(least(greatest(isolation_forest_flag * 40 + zscore_flag * 25 + iqr_flag * 20 + duplicate_flag * 15, 0), 100) AS INTEGER)
        AS ml_risk_score FROM f""",
}


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted machine score from the forest, both total tests and the similar descriptions themselves."""
    patterns, _ = detect_spending_patterns(features_of(spark, sf_dir))
    _, z, iqr = _fusion_inputs(spark, sf_dir)
    described = views.described(spark, sf_dir).withColumn("project_id", views.project_key("serial_no"))
    found = similar_texts(described, "project_id", "serial_no", "work_description", CORPUS)
    return rounded(rounded(fusion.fuse_detectors(patterns, z, iqr, fusion.similarity_of_rows(found)), "anomaly_score", digits=6), "similarity_score")


@query(views.with_views(*PROJECT_VIEWS, extra=_FUSED, body=_LEVELLED))
def ml_fusion_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine score over real detector output, copies included."""
    return _fused(spark, sf_dir)


@query(
    views.with_views(
        *PROJECT_VIEWS, extra=_FUSED, body=f"SELECT project_id, ml_risk_score, ml_risk_level, anomaly_score FROM ({_LEVELLED}) ORDER BY ml_risk_score DESC, project_id LIMIT 20"
    )
)
def top_ml_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 projects with the highest machine score."""
    return top(_fused(spark, sf_dir), 20, "ml_risk_score").select("project_id", "ml_risk_score", "ml_risk_level", "anomaly_score")


_FILLED = "CASE WHEN length(trim({0})) > 0 THEN {0} ELSE '__missing__' END"
_PROJECT_BLOCK = "coalesce('=' || state, '?') || chr(1) || coalesce('=' || work_type, '?')"
_CONSTITUENCY = "coalesce('=' || state, '?') || chr(1) || coalesce('=' || constituency, '?')"

#: The whole job: the outer master with whole documents as descriptions, both detectors, merge.
_WHOLE = {
    "given_texts": "SELECT 'WS/MP' || doc_id || '/2024-2025/' || doc_id AS project_id, text FROM documents",
    "sanctioned": SIDES["sanctioned"],
    "completed": SIDES["completed"],
    "first_payment": SIDES["first_payment"],
    "projects": """
        SELECT project_id, coalesce(s.state, c.state, p.state) AS state, coalesce(s.district, c.district, p.district) AS district,
               coalesce(s.constituency, c.constituency, p.constituency) AS constituency, coalesce(s.work_category, c.work_category) AS work_category,
               coalesce(s.work_type, c.work_type, p.work_type) AS work_type,
               CASE WHEN s.state IS NOT NULL OR c.state IS NOT NULL THEN g.text END AS work_description, s.work_status,
               s.recommended_date, s.sanction_date, c.completion_date, r.recommended_amount, s.sanction_amount, c.amount_disbursed, t.total_expenditure,
               coalesce(s.sanction_amount, r.recommended_amount, c.amount_disbursed, t.total_expenditure) AS cost_amount
        FROM sanctioned s FULL OUTER JOIN works r USING (project_id) FULL OUTER JOIN completed c USING (project_id)
             FULL OUTER JOIN totals t USING (project_id) LEFT JOIN first_payment p USING (project_id) LEFT JOIN given_texts g USING (project_id)""",
    "told_texts": "SELECT project_id AS doc_id, work_description AS text, state, constituency, work_type FROM projects",
    **rollup_sql(PROJECT_MODEL, _PROJECT_BLOCK, _CONSTITUENCY, "told_texts"),
    "peers": f"""SELECT project_id, cost_amount, {', '.join(f"{_FILLED.format(c)} AS {c}" for c in ('state', 'work_type', 'district', 'work_category'))}
        FROM projects WHERE cost_amount IS NOT NULL""",
    **COST_ANOMALIES,
    "detectors": """SELECT d.project_id, exact_duplicate_flag, exact_group_id, exact_duplicate_count, potential_duplicate_flag, similarity_score, similar_project_id,
        duplicate_reason, c.cost_anomaly_flag, c.cost_anomaly_score, coalesce(c.cost_anomaly_reason, 'Missing cost_amount; not analyzed.') AS cost_anomaly_reason,
        CASE WHEN c.cost_anomaly_flag IS NULL THEN 0 ELSE 1 END AS cost_anomaly_available FROM rollup d LEFT JOIN cost_anomalies c USING (project_id)""",
    **{name: sql for name, sql in SCORED.items() if name not in DETECTORS},
}


_RISK = views.with_views(
    "works",
    "payments",
    "completions",
    "totals",
    extra=_WHOLE,
    body="""
    SELECT project_id, state, district, constituency, work_type, CAST(risk_score AS INTEGER) AS risk_score, risk_level,
           CAST(delay_days AS INTEGER) AS delay_days, delay_flag, sanction_delay_flag, stalled_flag, pending_mark_flag, over_expenditure_flag,
           invalid_date_flag, status_flag, low_amount_flag, cost_anomaly_flag, round(cost_anomaly_score, 6) AS cost_anomaly_score, cost_anomaly_available,
           cost_anomaly_reason, exact_duplicate_flag, exact_group_id, exact_duplicate_count, potential_duplicate_flag, similarity_score, similar_project_id,
           duplicate_reason, pre_portal_flag, awaiting_sanction_flag, round(spend_completion_ratio, 6) AS spend_completion_ratio, indicators,
           CASE WHEN indicators <> '' THEN 'Flagged because: ' || indicators || '.'
                ELSE 'No rule-based irregularity flagged on available fields.' END AS explanation,
           CASE WHEN awaiting_sanction_flag = 1 AND risk_score = 0 THEN 'Awaiting sanction — not yet applicable for execution risk.'
                WHEN risk_score >= 65 THEN 'Prioritize for human verification.'
                WHEN risk_score >= 35 THEN 'Review when resources allow.' ELSE 'Routine monitoring.' END AS recommended_action
    FROM scored""",
)


@query(_RISK)
def risk_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End to end: life-cycle tables, master, both detectors, merge, rules.

    Descriptions are whole documents, given to the works of the same number.
    """
    return _explained(_whole_run(spark, sf_dir).risk)


@query(_RISK)
def risk_output_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table from stored term weights and a stored forest of an earlier run."""
    path = new_path(spark, "artefacts")
    # Of the first run only the artefacts are of use.
    with scratch():
        _whole_run(spark, sf_dir).artefacts.save(path)
    return _explained(_whole_run(spark, sf_dir, artefacts=Artefacts.load(spark, path)).risk)


def _explained(risk: DataFrame) -> DataFrame:
    return rounded(risk, "cost_anomaly_score", "spend_completion_ratio", digits=6)


def _whole_run(spark: SparkSession, sf_dir: str, **options) -> MonitoringResult:
    texts = views.table(spark, sf_dir, "documents").select(
        views.project_key("doc_id").alias("project_id"), F.col("text").alias("work_description")
    )

    def with_texts(df: DataFrame) -> DataFrame:
        return df.drop("work_description").join(texts, "project_id", "left")

    return run(
        spark,
        cleaned={
            "recommended": views.recommended(spark, sf_dir),
            "sanctioned": with_texts(views.sanctioned(spark, sf_dir)),
            "completed": with_texts(views.completed(spark, sf_dir)),
            "expenditure": views.payments(spark, sf_dir),
        },
        rules=RULES,
        model=PROJECT_MODEL,
        **options,
    )
