"""Payment rollup, master table, features and data quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver import views
from driver.registry import query
from worklens.operators import constraints, quality
from worklens.operators.features import add_features
from worklens.operators.lifecycle import build_master, expenditure_summary as summarize
from worklens.operators.shaping import duplicate_keys, first_per_key, last_per_key, top

MONEY = (
    "recommended_amount",
    "sanction_amount",
    "amount_disbursed",
    "total_expenditure",
    "cost_amount",
)


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    views.with_views(
        "payments",
        body="""
        SELECT project_id, round(sum(fund_disbursed_amount), 4) AS total_expenditure, count(*) AS payment_count,
               max(expenditure_date) AS latest_payment_date
        FROM payments GROUP BY project_id""",
    )
)
def expenditure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(summarize(views.bare_payments(spark, sf_dir)), "total_expenditure")


@query(
    views.with_views(
        "payments",
        body="""
        SELECT project_id, round(coalesce(sum(CASE WHEN line_status = 'F' THEN floor(fund_disbursed_amount) END), 0), 4) AS total_expenditure,
               count(*) AS payment_count
        FROM payments GROUP BY project_id""",
    )
)
def expenditure_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as text, half of them unreadable."""
    written = views.bare_payments(spark, sf_dir).withColumn(
        "fund_disbursed_amount",
        F.when(F.col("line_status") == "F", F.floor("fund_disbursed_amount").cast("string")).otherwise("pending"),
    )
    return rounded(summarize(written, date=None), "total_expenditure")


FEATURES_SQL = views.with_views(
    "works",
    "payments",
    "totals",
    "completions",
    "projects",
    body=f"""
    SELECT project_id, CASE WHEN completion_date IS NOT NULL THEN 1 ELSE 0 END AS completed_flag,
           round(total_expenditure / nullif(sanction_amount, 0), 6) AS fund_utilization,
           round(total_expenditure / nullif(recommended_amount, 0), 6) AS expenditure_ratio,
           CAST(date_diff('day', sanction_date, DATE '{views.AS_OF}') AS INTEGER) AS project_age_days,
           CASE WHEN total_expenditure > sanction_amount THEN 1 ELSE 0 END AS over_budget,
           CASE WHEN completion_date IS NULL THEN 1 ELSE 0 END AS missing_completion,
           payment_count, latest_payment_date
    FROM projects""",
)


@query(FEATURES_SQL)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = add_features(views.projects(spark, sf_dir), views.AS_OF).select(
        "project_id",
        "completed_flag",
        "fund_utilization",
        "expenditure_ratio",
        "project_age_days",
        "over_budget",
        "missing_completion",
        "payment_count",
        "latest_payment_date",
    )
    return rounded(df, "fund_utilization", "expenditure_ratio", digits=6)


SIDES = {
    "sanctioned": "SELECT * FROM works WHERE stage <> 'P'",
    "completed": "SELECT w.*, c.completion_date, c.amount_disbursed FROM works w JOIN completions c USING (project_id)",
    "first_payment": "SELECT * FROM payments QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY serial_no) = 1",
}


@query(
    views.with_views(
        "works",
        "payments",
        "completions",
        "totals",
        extra=SIDES,
        body="""
        SELECT s.project_id, s.state, s.constituency AS district, s.constituency, s.mp_name, s.ida, s.work_category,
               s.work_category AS work_type, s.work_status,
               coalesce(s.recommended_date, r.recommended_date) AS recommended_date, s.sanction_date, c.completion_date,
               round(r.recommended_amount, 4) AS recommended_amount, round(s.sanction_amount, 4) AS sanction_amount,
               round(c.amount_disbursed, 4) AS amount_disbursed, round(t.total_expenditure, 4) AS total_expenditure,
               t.payment_count, t.latest_payment_date, round(s.sanction_amount, 4) AS cost_amount
        FROM sanctioned s LEFT JOIN works r USING (project_id) LEFT JOIN completed c USING (project_id)
             LEFT JOIN totals t USING (project_id)""",
    )
)
def master_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = build_master(
        views.recommended(spark, sf_dir),
        views.sanctioned(spark, sf_dir).drop("district", "work_type"),
        views.completed(spark, sf_dir),
        views.bare_payments(spark, sf_dir),
        mode="sanctioned_left",
    )
    return rounded(master.drop("serial_no", "work_description"), *MONEY)


@query(
    views.with_views(
        "works",
        "payments",
        "completions",
        "totals",
        extra=SIDES,
        body="""
        SELECT project_id, coalesce(s.state, c.state, p.state) AS state, coalesce(s.district, c.district, p.district) AS district,
               coalesce(s.constituency, c.constituency, p.constituency) AS constituency,
               coalesce(s.mp_name, c.mp_name, p.mp_name) AS mp_name, coalesce(s.ida, c.ida, p.ida) AS ida,
               coalesce(s.work_category, c.work_category) AS work_category,
               coalesce(s.work_type, c.work_type, p.work_type) AS work_type,
               coalesce(s.work_description, c.work_description) AS work_description, s.work_status,
               s.recommended_date, s.sanction_date, c.completion_date,
               round(r.recommended_amount, 4) AS recommended_amount, round(s.sanction_amount, 4) AS sanction_amount,
               round(c.amount_disbursed, 4) AS amount_disbursed, round(t.total_expenditure, 4) AS total_expenditure,
               t.payment_count,
               round(coalesce(s.sanction_amount, r.recommended_amount, c.amount_disbursed, t.total_expenditure), 4) AS cost_amount
        FROM sanctioned s FULL OUTER JOIN works r USING (project_id) FULL OUTER JOIN completed c USING (project_id)
             FULL OUTER JOIN totals t USING (project_id) LEFT JOIN first_payment p USING (project_id)""",
    )
)
def master_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    master = build_master(
        views.recommended(spark, sf_dir),
        views.sanctioned(spark, sf_dir),
        views.completed(spark, sf_dir),
        views.payments(spark, sf_dir),
    )
    return rounded(master, *MONEY)


def _pick_sql(direction: str) -> str:
    return views.with_views(
        "payments",
        body=f"""
        SELECT project_id, serial_no, state, mp_name, work_type FROM payments
        QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY serial_no {direction}) = 1""",
    )


@query(_pick_sql("ASC"))
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = first_per_key(views.payments(spark, sf_dir), "project_id", "serial_no")
    return kept.select("project_id", "serial_no", "state", "mp_name", "work_type")


@query(_pick_sql("DESC"))
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = last_per_key(views.payments(spark, sf_dir), "project_id", "serial_no")
    return kept.select("project_id", "serial_no", "state", "mp_name", "work_type")


@query("SELECT l_orderkey AS project_id, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_keys(
        views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id")), "project_id"
    )


@query("SELECT DISTINCT o_orderkey AS project_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def key_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"))
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"))
    return quality.common_keys(orders, lines)


@query("SELECT o_orderkey AS project_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"))
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"))
    return quality.unmatched(orders, lines)


@query(
    """
    SELECT (SELECT count(*) FROM orders) AS rows_before, count(*) AS rows_after,
           count(*) FILTER (WHERE l_orderkey IS NULL) AS unmatched
    FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"""
)
def join_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("project_id"))
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project_id"))
    return quality.join_integrity(orders, lines)


_LINEITEM = (
    *("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    *("l_returnflag", "l_linestatus", "l_shipdate"),
)
_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
_PROFILED = (
    *("serial_no", "project_id", "state", "district", "constituency", "mp_name", "ida", "work_category", "work_type", "work_description"),
    *("recommended_date", "sanction_date", "recommended_amount", "sanction_amount", "work_status", "total_expenditure", "payment_count"),
    *("latest_payment_date", "completion_date", "amount_disbursed", "cost_amount"),
)


@query(
    views.with_views(
        "works",
        "payments",
        "totals",
        "completions",
        "projects",
        body=" UNION ALL ".join(
            f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NULL) AS nulls,
                round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS share FROM projects"""
            for c in _PROFILED
        ),
    )
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.null_profile(views.projects(spark, sf_dir).select(*_PROFILED)), "share", digits=6)


@query(
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM lineitem"""
        for c in _LINEITEM
    )
)
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.distinct_counts(views.table(spark, sf_dir, "lineitem"), _LINEITEM)


def _profile_sql(table: str, columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS "table", '{c}' AS "column", (SELECT count(*) FROM {table}) AS rows, (SELECT count(*) FROM {table} WHERE {c} IS NULL) AS nulls,
            (SELECT count(DISTINCT {c}) FROM {table}) AS distinct_values, (SELECT coalesce(string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, v), '') FROM (
            SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) AS top_values"""
        for c in columns
    )


@query(_profile_sql("lineitem", _LINEITEM) + " UNION ALL " + _profile_sql("orders", _ORDERS))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of two tables."""
    parts = [quality.profile(views.table(spark, sf_dir, name)).select(F.lit(name).alias("table"), "*") for name in ("lineitem", "orders")]
    return parts[0].unionByName(parts[1])


def _describe_sql(columns: tuple[str, ...], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            round(CAST(min({c}) AS DOUBLE), 4) AS "min", round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS p25,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS p75,
            round(CAST(max({c}) AS DOUBLE), 4) AS "max" FROM {source}"""
        for c in columns
    )


_DESCRIBED = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(_describe_sql(_DESCRIBED, "lineitem"))
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = quality.describe(views.table(spark, sf_dir, "lineitem"), _DESCRIBED)
    return rounded(summary, "mean", "std", "min", "p25", "p50", "p75", "max", digits=4)


@query(
    """SELECT o_orderpriority AS value, count(*) AS rows, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share_pct
       FROM orders GROUP BY 1"""
)
def value_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.value_counts(views.table(spark, sf_dir, "orders"), "o_orderpriority"), "share_pct", digits=6)


_TABLES = {
    "orders": "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority",
    "customer": "c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment",
    "nation": "n_nationkey, n_name, n_regionkey",
}


@query(
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", count(*) AS rows, CAST({len(c.split(','))} AS INTEGER) AS columns, '{c}' AS column_names FROM {t}"""
        for t, c in _TABLES.items()
    )
)
def table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.table_profile({name: views.table(spark, sf_dir, name) for name in _TABLES})


@query(
    views.with_views(
        "works",
        "payments",
        "completions",
        body=" UNION ALL ".join(
            f"""SELECT '{t}' AS "table", count(project_id) AS non_null, count(DISTINCT project_id) AS distinct_keys,
                min(project_id) AS sample FROM {t}"""
            for t in ("works", "payments", "completions")
        ),
    )
)
def key_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_coverage(
        {
            "works": views.works(spark, sf_dir),
            "payments": views.bare_payments(spark, sf_dir),
            "completions": views.completions(spark, sf_dir),
        }
    )


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = views.table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))
    return quality.preview(orders, "o_orderkey")


@query(
    views.with_views(
        "payments",
        "totals",
        body="SELECT project_id, round(total_expenditure, 4) AS total_expenditure FROM totals ORDER BY total_expenditure DESC, project_id LIMIT 20",
    )
)
def top_expenditure(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = summarize(views.bare_payments(spark, sf_dir), date=None)
    return rounded(top(totals, 20, "total_expenditure").select("project_id", "total_expenditure"), "total_expenditure")


#: Conditions that some payments break.
_PAYMENT_RULES = {
    "amount under 90,000": "fund_disbursed_amount < 90000",
    "paid after 1992": "expenditure_date >= DATE '1993-01-01'",
    "a returned line is final": "NOT (work_type = 'R' AND line_status <> 'F')",
}


@query(
    views.with_views(
        "payments",
        body=" UNION ALL ".join(
            f"""SELECT '{name}' AS "constraint", project_id AS "key", count(*) AS rows FROM payments WHERE NOT coalesce({sql}, FALSE) GROUP BY project_id"""
            for name, sql in _PAYMENT_RULES.items()
        )
        + """ UNION ALL SELECT 'unique project_id', project_id, count(*) FROM payments WHERE project_id IS NOT NULL GROUP BY project_id HAVING count(*) > 1""",
    )
)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose payments break a rule or share a key."""
    lines = views.table(spark, sf_dir, "lineitem")
    paid = lines.select(
        views.project_key("l_orderkey").alias("project_id"),
        F.col("l_shipdate").cast("date").alias("expenditure_date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("fund_disbursed_amount"),
        F.col("l_returnflag").alias("work_type"),
        F.col("l_linestatus").alias("line_status"),
    )
    return constraints.all_violations(constraints.violations(paid, "project_id", _PAYMENT_RULES), constraints.repeated(paid, "project_id"))
