"""The driver's tables in the roles of the works tables.

orders with customer and nation are the works, lineitem the payments, documents
the descriptions, part the peers. ``VIEWS`` holds the same roles as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2002-01-01"
PORTAL_LAUNCH = "1998-01-01"


def open_line():
    """1 for a payment that is not final; an integer keeps the grouping hash-based."""
    return F.when(F.col("line_status") == "F", 0).otherwise(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def project_key(column: str):
    return F.concat(F.lit("WS/MP"), F.col(column), F.lit("/2024-2025/"), F.col(column))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    ordered = F.col("o_orderdate").cast("date")
    return joined.select(
        F.col("o_orderkey").alias("serial_no"),
        project_key("o_orderkey").alias("project_id"),
        F.col("n_name").alias("state"),
        F.col("n_name").alias("district"),
        F.col("c_mktsegment").alias("constituency"),
        F.col("c_name").alias("mp_name"),
        F.concat("n_name", F.lit("(DISTRICT OFFICE "), "n_name", F.lit("_IDA)")).alias("ida"),
        F.concat(F.lit("REGION "), "n_regionkey").alias("work_category"),
        F.col("o_orderpriority").alias("work_type"),
        F.concat(F.lit("Works for "), "c_name", F.lit(" in "), "n_name").alias("work_description"),
        F.date_sub(ordered, 4 * F.col("c_nationkey")).alias("recommended_date"),
        ordered.alias("sanction_date"),
        (F.col("o_totalprice") * 1.25).alias("recommended_amount"),
        F.col("o_totalprice").alias("sanction_amount"),
        F.when(F.col("o_orderstatus") == "F", "Work Completed")
        .when(F.col("o_orderstatus") == "O", "Physical Inspection")
        .otherwise("Vendor Identification")
        .alias("work_status"),
        F.col("o_orderstatus").alias("stage"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return lines.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (
            F.col("l_linenumber").cast("long") * 100_000_000_000_000_000
            + F.col("l_partkey") * 100_000_000
            + F.col("l_suppkey")
        ).alias("serial_no"),
        project_key("l_orderkey").alias("project_id"),
        F.col("n_name").alias("state"),
        F.col("n_name").alias("district"),
        F.lit(None).cast("string").alias("constituency"),
        F.col("s_name").alias("mp_name"),
        F.concat("n_name", F.lit("(DISTRICT OFFICE)")).alias("ida"),
        F.col("l_returnflag").alias("work_type"),
        F.col("l_shipdate").cast("date").alias("expenditure_date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("fund_disbursed_amount"),
    )


def bare_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments without the payer's identity: a plain lineitem scan."""
    return table(spark, sf_dir, "lineitem").select(
        project_key("l_orderkey").alias("project_id"),
        F.col("l_shipdate").cast("date").alias("expenditure_date"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("fund_disbursed_amount"),
        F.col("l_linestatus").alias("line_status"),
    )


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion date and disbursed amount of works whose payments are all final."""
    return (
        bare_payments(spark, sf_dir)
        .groupBy("project_id")
        .agg(
            F.max(open_line()).alias("_open"),
            F.max("expenditure_date").alias("completion_date"),
            F.sum("fund_disbursed_amount").alias("amount_disbursed"),
        )
        .where("_open = 0")
        .drop("_open")
    )


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).drop("sanction_amount", "work_status", "stage")


def sanctioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works past the pending stage."""
    return works(spark, sf_dir).where("stage != 'P'").drop("recommended_amount", "stage")


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = works(spark, sf_dir).drop(
        "recommended_date", "sanction_date", "recommended_amount", "sanction_amount", "work_status", "stage"
    )
    return identity.join(completions(spark, sf_dir), "project_id")


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works with payment totals and completion: the input of features and rules."""
    totals = (
        bare_payments(spark, sf_dir)
        .groupBy("project_id")
        .agg(
            F.sum("fund_disbursed_amount").alias("total_expenditure"),
            F.count(F.lit(1)).alias("payment_count"),
            F.max("expenditure_date").alias("latest_payment_date"),
            F.max(open_line()).alias("_open"),
        )
        .withColumns(
            {
                "completion_date": F.when(F.col("_open") == 0, F.col("latest_payment_date")),
                "amount_disbursed": F.when(F.col("_open") == 0, F.col("total_expenditure")),
            }
        )
        .drop("_open")
    )
    return (
        works(spark, sf_dir)
        .drop("stage")
        .join(totals, "project_id", "left")
        .withColumn("cost_amount", F.col("sanction_amount"))
    )


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as projects; the language is the block, whole texts are compared."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("serial_no"),
        F.col("doc_id").cast("string").alias("project_id"),
        F.col("lang").alias("state"),
        F.col("lang").alias("constituency"),
        F.lit("Prose").alias("work_type"),
        F.lit("Prose").alias("work_category"),
        F.col("text").alias("work_description"),
    )


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("project_id"),
        F.col("p_brand").alias("state"),
        F.col("p_type").alias("work_type"),
        F.col("p_size").cast("string").alias("district"),
        F.substring_index("p_name", " ", 1).alias("work_category"),
        F.col("p_retailprice").alias("cost_amount"),
    )


# --- the same roles as SQL ---------------------------------------------------

_KEY = "'WS/MP' || {0} || '/2024-2025/' || {0}"

VIEWS = {
    "works": f"""
        SELECT o_orderkey AS serial_no, {_KEY.format('o_orderkey')} AS project_id,
               n_name AS state, n_name AS district, c_mktsegment AS constituency, c_name AS mp_name,
               n_name || '(DISTRICT OFFICE ' || n_name || '_IDA)' AS ida,
               'REGION ' || n_regionkey AS work_category, o_orderpriority AS work_type,
               'Works for ' || c_name || ' in ' || n_name AS work_description,
               CAST(CAST(o_orderdate AS DATE) - CAST(4 * c_nationkey AS INTEGER) AS DATE) AS recommended_date,
               CAST(o_orderdate AS DATE) AS sanction_date,
               o_totalprice * CAST(1.25 AS DOUBLE) AS recommended_amount, o_totalprice AS sanction_amount,
               CASE o_orderstatus WHEN 'F' THEN 'Work Completed' WHEN 'O' THEN 'Physical Inspection'
                    ELSE 'Vendor Identification' END AS work_status,
               o_orderstatus AS stage
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "payments": f"""
        SELECT CAST(l_linenumber AS BIGINT) * 100000000000000000 + l_partkey * 100000000 + l_suppkey AS serial_no,
               {_KEY.format('l_orderkey')} AS project_id, n_name AS state, n_name AS district,
               CAST(NULL AS VARCHAR) AS constituency, s_name AS mp_name,
               n_name || '(DISTRICT OFFICE)' AS ida, l_returnflag AS work_type,
               CAST(l_shipdate AS DATE) AS expenditure_date,
               l_extendedprice * (1 - l_discount) AS fund_disbursed_amount, l_linestatus AS line_status
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "completions": """
        SELECT project_id, max(expenditure_date) AS completion_date,
               sum(fund_disbursed_amount) AS amount_disbursed
        FROM payments GROUP BY project_id HAVING max(line_status) = 'F'""",
    "totals": """
        SELECT project_id, sum(fund_disbursed_amount) AS total_expenditure, count(*) AS payment_count,
               max(expenditure_date) AS latest_payment_date
        FROM payments GROUP BY project_id""",
    "projects": """
        SELECT w.*, t.total_expenditure, t.payment_count, t.latest_payment_date, c.completion_date,
               c.amount_disbursed, w.sanction_amount AS cost_amount
        FROM works w LEFT JOIN totals t USING (project_id) LEFT JOIN completions c USING (project_id)""",
    "peers": """
        SELECT CAST(p_partkey AS VARCHAR) AS project_id, p_brand AS state, p_type AS work_type,
               CAST(p_size AS VARCHAR) AS district, split_part(p_name, ' ', 1) AS work_category,
               p_retailprice AS cost_amount
        FROM part""",
    "described": """
        SELECT doc_id AS serial_no, CAST(doc_id AS VARCHAR) AS project_id, lang AS state, text AS work_description
        FROM documents""",
}


def with_views(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """SQL text with the named roles as common table expressions."""
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in names]
    parts += [f"{name} AS ({sql})" for name, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}"
