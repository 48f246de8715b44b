"""Reporting views: project 360, key figures, distributions, search, detail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from worklens.functions.keys import lenient_key
from worklens.functions.values import any_of, blank_to_null, first_non_blank, flag, loose_number, strip, to_double, to_flag
from worklens.operators.shaping import SORT_HASH, existing, sort_hash, top

PAGE = 200
TOP = 6
#: Columns that a text query looks into.
SEARCHED = ("project_id", "state", "work_description", "work")

# Labels of the dashboards.
HIGH_RISK = "High risk"
COST_ANOMALY = "Cost anomaly"
EXACT_DUPLICATE = "Exact duplicate"
POTENTIAL_DUPLICATE = "Potential duplicate"
NORMAL = "Normal"
UNSPECIFIED = "Unspecified"

DUPLICATE_FIELDS = ("exact_duplicate_flag", "potential_duplicate_flag", "duplicate_reason", "similar_project_id")
ANOMALY_FIELDS = ("cost_anomaly_flag", "cost_anomaly_score", "cost_anomaly_reason", "cost_anomaly_available")

# Columns each source may bring, under canonical names; expenditure brings
# ``fund_disbursed_amount``.
SOURCE_FIELDS = {
    "recommended": (
        "work_category",
        "work",
        "state",
        "ida",
        "mp_name",
        "constituency",
        "work_description",
        "recommended_date",
        "sanction_date",
        "recommended_amount",
    ),
    "sanctioned": (
        "work_category",
        "work",
        "state",
        "ida",
        "mp_name",
        "constituency",
        "work_description",
        "recommended_date",
        "sanction_date",
        "sanction_amount",
        "work_status",
    ),
    "completed": (
        "work_category",
        "work",
        "state",
        "ida",
        "mp_name",
        "constituency",
        "work_description",
        "completion_date",
        "amount_disbursed",
    ),
    "merged": ANOMALY_FIELDS,
    "duplicates": DUPLICATE_FIELDS,
    "anomalies": ANOMALY_FIELDS,
}
KEY_COLUMNS = ("work", "project_id", "work_id")
PAYMENT_KEY_COLUMNS = ("work_id", "work", "project_id")


def _paid(df: DataFrame) -> DataFrame:
    """Payment totals by project, summed under the raw key before keys are read.

    There are far fewer projects than payments, and the sum has a map-side part,
    so neither key parsing nor the shuffle sees every payment.
    """
    amount = F.col("fund_disbursed_amount")
    is_text = isinstance(df.schema["fund_disbursed_amount"].dataType, T.StringType)
    value = loose_number(amount) if is_text else F.coalesce(to_double(amount), F.lit(0.0))
    raw = first_non_blank(*[F.col(c) for c in existing(df, PAYMENT_KEY_COLUMNS)])
    summed = df.groupBy(raw.alias("_raw")).agg(F.sum(value).alias("fund_disbursed_amount"))
    return summed.where("_raw IS NOT NULL").select(lenient_key(F.col("_raw")).alias("project_id"), "fund_disbursed_amount")


def _side(df: DataFrame, name: str, order: str) -> DataFrame:
    if name == "expenditure":
        return _paid(df)
    fields = SOURCE_FIELDS[name]
    candidates = ("project_id",) if name in ("merged", "duplicates", "anomalies") else KEY_COLUMNS
    raw = first_non_blank(*[F.col(c) for c in existing(df, candidates)])
    values = [
        (F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")).alias(c) for c in fields
    ]
    position = F.col(order) if order in df.columns else F.lit(0)
    # Text that is not blank always gives a key, so rows are told apart before keys are read.
    return df.where(raw.isNotNull()).select(lenient_key(raw).alias("project_id"), position.cast("long").alias("_order"), F.struct(*values).alias(name))


def _rank(source: str) -> Column:
    """Place of a source's row: rows without an order value come before all others, ties go by content."""
    return F.struct(F.col("_order").isNotNull().alias("known"), F.col("_order").alias("order"), F.xxhash64(source).alias("tie"))


def project_state(sources: dict[str, DataFrame], order: str = "serial_no") -> DataFrame:
    """What the project view is made from: each source's last row with its rank, and the payments, by project.

    Sources are text tables named as in ``SOURCE_FIELDS``; absent ones may be
    left out. All rows are stacked and grouped by project once: the last row of
    a source wins, payments add up. That equals a chain of full outer joins
    after "last row per key", with one shuffle in place of seven.
    """
    stacked = reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [_side(df, name, order) for name, df in sources.items()],
    )
    absent = {
        name: F.lit(None).cast("struct<" + ",".join(f"{c}:string" for c in fields) + ">")
        for name, fields in SOURCE_FIELDS.items()
        if name not in sources
    }
    if "expenditure" not in sources:
        absent["fund_disbursed_amount"] = F.lit(None).cast("double")
    if "_order" not in stacked.columns:
        absent["_order"] = F.lit(None).cast("long")
    if absent:
        stacked = stacked.withColumns(absent)
    kept = {name: F.when(F.col(name).isNotNull(), F.struct(_rank(name).alias("rank"), F.col(name).alias("row"))) for name in SOURCE_FIELDS}
    return _last_rows(stacked.withColumns(kept))


def _last_rows(rows: DataFrame) -> DataFrame:
    # A source's struct begins with its rank.
    return rows.groupBy(sort_hash("project_id"), "project_id").agg(
        *[F.max(name).alias(name) for name in SOURCE_FIELDS],
        F.sum("fund_disbursed_amount").alias("fund_disbursed_amount"),
    ).drop(SORT_HASH)


def merged_states(*states: DataFrame) -> DataFrame:
    """The state of all rows that went into the given states."""
    return _last_rows(reduce(DataFrame.unionByName, states))


def project_360(sources: dict[str, DataFrame], order: str = "serial_no") -> DataFrame:
    """One row per project seen in any of the seven sources of ``project_state``."""
    return view_of(project_state(sources, order))


def view_of(state: DataFrame) -> DataFrame:
    """The project view of a state."""
    grouped = state.select(
        "project_id",
        *[F.col(f"{name}.row").alias(name) for name in SOURCE_FIELDS],
        F.coalesce("fund_disbursed_amount", F.lit(0.0)).alias("fund_disbursed_amount"),
    )

    def pick(*paths: str) -> Column:
        return F.coalesce(first_non_blank(*[F.col(p) for p in paths]), F.lit(""))

    def identity(column: str) -> Column:
        return pick(f"sanctioned.{column}", f"recommended.{column}", f"completed.{column}")

    return grouped.select(
        "project_id",
        identity("work_category").alias("work_category"),
        F.coalesce(
            first_non_blank(F.col("sanctioned.work"), F.col("recommended.work"), F.col("completed.work")),
            F.when(F.col("merged").isNotNull(), F.col("project_id")),
            F.lit(""),
        ).alias("work"),
        *[
            identity(c).alias(c)
            for c in ("state", "ida", "mp_name", "constituency", "work_description")
        ],
        pick("recommended.recommended_date", "sanctioned.recommended_date").alias("recommended_date"),
        pick("sanctioned.sanction_date", "recommended.sanction_date").alias("sanction_date"),
        loose_number(pick("sanctioned.sanction_amount", "recommended.recommended_amount")).alias("sanction_amount"),
        loose_number(pick("recommended.recommended_amount")).alias("recommended_amount"),
        pick("sanctioned.work_status").alias("work_status"),
        pick("completed.completion_date").alias("completion_date"),
        loose_number(pick("completed.amount_disbursed")).alias("amount_disbursed"),
        "fund_disbursed_amount",
        *[F.coalesce(f"duplicates.{c}", F.lit("")).alias(c) for c in DUPLICATE_FIELDS],
        *[F.coalesce(f"anomalies.{c}", f"merged.{c}", F.lit("")).alias(c) for c in ANOMALY_FIELDS],
    )


def by_project_id(view: DataFrame, locale_order: bool = False) -> DataFrame:
    """Whole view ordered by project id; binary order unless asked otherwise."""
    key = F.collate("project_id", "UNICODE") if locale_order else F.col("project_id")
    return view.orderBy(key)


def _anomaly() -> Column:
    return to_flag(F.col("cost_anomaly_flag"))


def _exact() -> Column:
    return to_flag(F.col("exact_duplicate_flag"))


def _potential() -> Column:
    return to_flag(F.col("potential_duplicate_flag"))


def risk_label() -> Column:
    return (
        F.when(_anomaly() & (_exact() | _potential()), HIGH_RISK)
        .when(_anomaly(), COST_ANOMALY)
        .when(_exact(), EXACT_DUPLICATE)
        .when(_potential(), POTENTIAL_DUPLICATE)
        .otherwise(NORMAL)
    )


def key_figures(view: DataFrame) -> DataFrame:
    """One row of totals. ``duplicates`` counts a project with both flags twice,
    ``duplicate_projects`` once."""
    zero = F.lit(0.0)
    money = F.coalesce("amount_disbursed", zero) + F.coalesce("fund_disbursed_amount", zero)
    return view.agg(
        F.count(F.lit(1)).alias("total_projects"),
        F.count_if(blank_to_null(F.col("completion_date").cast("string")).isNotNull()).alias("completed_projects"),
        F.coalesce(F.sum("sanction_amount"), zero).alias("total_sanctioned"),
        F.coalesce(F.sum(money), zero).alias("total_disbursed"),
        F.count_if(_anomaly()).alias("anomalies"),
        F.count_if(_exact()).alias("exact_duplicates"),
        F.count_if(_potential()).alias("potential_duplicates"),
        (F.count_if(_exact()) + F.count_if(_potential())).alias("duplicates"),
        F.count_if(_exact() | _potential()).alias("duplicate_projects"),
        F.count_if(any_of(_anomaly(), _exact(), _potential())).alias("high_risk_projects"),
    )


def risk_overview(view: DataFrame) -> DataFrame:
    """(label, value) of the three risk figures."""
    counted = view.agg(
        F.count_if(_anomaly()).alias(COST_ANOMALY),
        F.count_if(_potential()).alias(POTENTIAL_DUPLICATE),
        F.count_if(_exact()).alias(EXACT_DUPLICATE),
    )
    return counted.unpivot([], counted.columns, "label", "value")


def state_counts(view: DataFrame) -> DataFrame:
    """(label, value) per state; blank states are left out."""
    named = view.select(strip(F.col("state")).alias("label")).where("label != ''")
    return named.groupBy("label").agg(F.count(F.lit(1)).alias("value"))


def status_counts(view: DataFrame) -> DataFrame:
    """(label, value) per work status; blank is 'Unspecified'."""
    label = F.coalesce(F.nullif(strip(F.col("work_status")), F.lit("")), F.lit(UNSPECIFIED))
    return view.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("value"))


def leading(counts: DataFrame, n: int = TOP) -> DataFrame:
    return counts.orderBy(F.desc("value"), "label").limit(n)


def largest_projects(view: DataFrame, n: int = TOP) -> DataFrame:
    """Largest sanctioned projects with their risk label."""
    return top(view, n, "sanction_amount").withColumn("risk_label", risk_label())


def search(
    view: DataFrame,
    query: str = "",
    state: str = "all",
    status: str = "all",
    flags: str = "all",
) -> DataFrame:
    """Projects matching a text query and the facets; 'all' lets everything pass.

    ``flags`` is anomaly, duplicate, normal or all.
    """
    wanted = query.strip().lower()
    if wanted:
        view = view.where(
            any_of(
                *[
                    F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(wanted))
                    for c in SEARCHED
                ]
            )
        )
    if state != "all":
        view = view.where(F.col("state") == state)
    if status != "all":
        view = view.where(F.col("work_status") == status)
    if flags == "anomaly":
        view = view.where(_anomaly())
    elif flags == "duplicate":
        view = view.where(_exact() | _potential())
    elif flags == "normal":
        view = view.where(~any_of(_anomaly(), _exact(), _potential()))
    elif flags != "all":
        raise ValueError(f"Unknown flag facet: {flags}")
    return view


def page(results: DataFrame, size: int = PAGE) -> DataFrame:
    """First page of a result; the total is ``results.count()``."""
    return results.orderBy("project_id").limit(size)


def facet_values(view: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-blank values of a facet column."""
    return view.select(strip(F.col(column)).alias(column)).where(F.col(column) != "").distinct().orderBy(column)


def project_detail(view: DataFrame, project_id: str) -> DataFrame:
    """One project with its disbursed total and yes/no flags."""
    return view.where(F.col("project_id") == project_id).withColumns(
        {
            "disbursed_amount": F.col("amount_disbursed") + F.col("fund_disbursed_amount"),
            "cost_anomaly": F.when(_anomaly(), "Yes").otherwise("No"),
            "duplicate_match": F.when(_exact() | _potential(), "Yes").otherwise("No"),
        }
    )


def flag_total(view: DataFrame, column: str) -> DataFrame:
    return view.agg(F.sum(flag(to_flag(F.col(column)))).alias(column))
