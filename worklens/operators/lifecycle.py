"""Payment rollup and the one-row-per-project master table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from worklens import schemas
from worklens.functions.values import number
from worklens.operators.shaping import add_aliases, first_per_key, select_existing, sort_hash

SANCTIONED_ALIASES = {
    "work_type": "work_category",
    "district": "constituency",
    "cost_amount": "sanction_amount",
}


def expenditure_summary(
    payments: DataFrame,
    amount: str = "fund_disbursed_amount",
    date: str | None = "expenditure_date",
    key: str = "project_id",
) -> DataFrame:
    """Total, number and latest date of the payments of each project.

    Unreadable amounts are skipped; a project with none readable totals 0.
    """
    is_text = payments.schema[amount].dataType.simpleString() == "string"
    value = number(F.col(amount)) if is_text else F.col(amount).cast("double")
    measures = [
        F.coalesce(F.sum(value), F.lit(0.0)).alias("total_expenditure"),
        F.count(F.lit(1)).alias("payment_count"),
    ]
    if date:
        measures.append(F.max(F.col(date).cast("date")).alias("latest_payment_date"))
    return payments.where(F.col(key).isNotNull()).groupBy(key).agg(*measures)


def cost_amount() -> Column:
    return F.coalesce("sanction_amount", "recommended_amount", "amount_disbursed", "total_expenditure")


def build_master(
    recommended: DataFrame,
    sanctioned: DataFrame,
    completed: DataFrame,
    payments: DataFrame,
    mode: str = "full_outer",
    order: str = "serial_no",
) -> DataFrame:
    """One row per project over the life-cycle tables.

    ``full_outer`` keeps every project seen in any table and fills identity
    columns sanctioned, then completed, then first payment.
    ``sanctioned_left`` keeps sanctioned projects only.
    """
    if mode == "sanctioned_left":
        return _sanctioned_left(recommended, sanctioned, completed, payments, order)
    if mode == "full_outer":
        return _full_outer(recommended, sanctioned, completed, payments, order)
    raise ValueError(f"Unknown mode: {mode}")


def _sanctioned_left(recommended, sanctioned, completed, payments, order) -> DataFrame:
    # Each side is cut to one row per project first, so no join can fan out,
    # and all of them are already partitioned by project_id.
    base = first_per_key(sanctioned, "project_id", order).withColumnRenamed(
        "recommended_date", "_sanctioned_side"
    )
    first_recommended = first_per_key(recommended, "project_id", order).select(
        "project_id", F.col("recommended_date").alias("_recommended_side"), "recommended_amount"
    )
    first_completed = first_per_key(completed, "project_id", order).select(
        "project_id", "completion_date", "amount_disbursed"
    )
    joined = (
        base.join(first_recommended, "project_id", "left")
        .join(first_completed, "project_id", "left")
        .join(expenditure_summary(payments), "project_id", "left")
    )
    dated = joined.withColumn(
        "recommended_date", F.coalesce("_sanctioned_side", "_recommended_side")
    ).drop("_sanctioned_side", "_recommended_side")
    return add_aliases(dated, SANCTIONED_ALIASES)


def _tagged(df: DataFrame, source: str, order: str, columns: tuple[str, ...]) -> DataFrame:
    first = first_per_key(df, "project_id", order)
    return first.select("project_id", F.struct(*columns).alias(source))


def _full_outer(recommended, sanctioned, completed, payments, order) -> DataFrame:
    """Chained full outer joins as one union and one grouping.

    A full outer join leaves no known partitioning, so four of them would
    shuffle the growing result again and again. Each table is cut to one row
    per project first (a rank filter and, for payments, a hash aggregate, both
    with a map-side part); those rows are stacked, each under its own struct
    column, and grouped by project once.
    """
    identity = schemas.IDENTITY
    sources = {
        "sanctioned": (
            sanctioned,
            (*identity, "recommended_date", "sanction_date", "sanction_amount", "work_status"),
        ),
        "recommended": (recommended, ("recommended_amount",)),
        "completed": (completed, (*identity, "completion_date", "amount_disbursed")),
        "payment": (payments, schemas.PAYMENT_IDENTITY),
    }
    stacked = reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True),
        [_tagged(df, name, order, columns) for name, (df, columns) in sources.items()],
    )
    totals = (
        payments.where(F.col("project_id").isNotNull())
        .groupBy("project_id")
        .agg(F.sum("fund_disbursed_amount").alias("_paid"), F.count(F.lit(1)).alias("_payments"))
    )
    stacked = stacked.unionByName(totals, allowMissingColumns=True)
    # One row a source at most: the first that is there is the only one.
    grouped = stacked.groupBy(sort_hash("project_id"), "project_id").agg(
        *[F.first(name, ignorenulls=True).alias(name) for name in (*sources, "_paid", "_payments")]
    )
    has_payment = F.col("_payments") > 0
    merged = grouped.select(
        "project_id",
        *[
            F.coalesce(
                f"sanctioned.{c}",
                f"completed.{c}",
                *([f"payment.{c}"] if c in schemas.PAYMENT_IDENTITY else []),
            ).alias(c)
            for c in identity
        ],
        "sanctioned.work_status",
        "sanctioned.recommended_date",
        "sanctioned.sanction_date",
        "completed.completion_date",
        "recommended.recommended_amount",
        "sanctioned.sanction_amount",
        "completed.amount_disbursed",
        F.when(has_payment, F.coalesce("_paid", F.lit(0.0))).alias("total_expenditure"),
        F.when(has_payment, F.col("_payments")).alias("payment_count"),
    )
    return select_existing(merged.withColumn("cost_amount", cost_amount()), schemas.MASTER)
