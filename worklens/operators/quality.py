"""Table profiles, key coverage and join checks as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worklens.operators.percentiles import counted_values, moments_of, percentiles_of
from worklens.operators.shaping import with_row
from worklens.session import materialize


def null_profile(df: DataFrame, top: int | None = None) -> DataFrame:
    """(column, nulls, share) of every column, emptiest first, from one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    )
    long = counted.unpivot("_rows", df.columns, "column", "nulls").select(
        "column", "nulls", F.try_divide("nulls", "_rows").alias("share")
    )
    return long.orderBy(F.desc("nulls"), "column").limit(top) if top else long


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """(column, non_null, distinct_values); NULL is no value.

    Exact counts group each column's values on their own, so no column's set of
    values has to fit one place; ``approximate`` uses one pass with sketches.
    """
    if approximate:
        counted = df.agg(
            *[F.count(c).alias(f"{c}|n") for c in columns],
            *[F.approx_count_distinct(c).alias(f"{c}|d") for c in columns],
        )
        parts = [
            counted.select(F.lit(c).alias("column"), F.col(f"{c}|n").alias("non_null"), F.col(f"{c}|d").alias("distinct_values"))
            for c in columns
        ]
        return reduce(DataFrame.unionByName, parts)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "_v")
    return (
        long.groupBy("column", "_v")
        .agg(F.count("_v").alias("_n"))
        .groupBy("column")
        .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("non_null"), F.count("_v").alias("distinct_values"))
    )


def profile(df: DataFrame, leading: int = 3, shown: int = 64) -> DataFrame:
    """(column, rows, nulls, distinct_values, top_values) of every column of any table.

    Values of all columns are counted together, so a frequent one is summed
    before it travels, and long ones travel as their first ``shown`` characters
    and a digest. ``top_values`` names the most frequent ones with their
    counts, ties by value.
    """
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]).unpivot([], [f"`{c}`" for c in df.columns], "column", "_v")
    rest = F.when(F.length("_v") > shown, F.xxhash64("_v"))
    counted = materialize(long.groupBy("column", F.left("_v", F.lit(shown)).alias("_v"), rest.alias("_rest")).agg(F.count(F.lit(1)).alias("_n")), "column-values")
    facts = counted.groupBy("column").agg(
        F.sum("_n").alias("rows"), F.sum(F.when(F.col("_v").isNull(), F.col("_n")).otherwise(0)).alias("nulls"), F.count("_v").alias("distinct_values")
    )
    order = W.partitionBy("column").orderBy(F.desc("_n"), "_v", "_rest")
    first = counted.where("_v IS NOT NULL").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= leading)
    named = F.transform(F.sort_array(F.collect_list(F.struct("_r", "_v", "_n"))), lambda x: F.concat(x["_v"], F.lit(" ("), x["_n"].cast("string"), F.lit(")")))
    most = first.groupBy("column").agg(F.array_join(named, ", ").alias("top_values"))
    return facts.join(most, "column", "left").select("column", "rows", "nulls", "distinct_values", F.coalesce("top_values", F.lit("")).alias("top_values"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, mean, std, min, p25, p50, p75, max) with exact percentiles, from one scan."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "_v")
    counted = counted_values(long, "_v", [F.col("column")])
    found = moments_of(counted).join(percentiles_of(counted, {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "_key")
    # A column without values has a count of 0 and nothing else.
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    whole = named.join(found.withColumnRenamed("_key", "column"), "column", "left").fillna({"count": 0})
    return whole.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, rows, share_pct) of a column."""
    counted = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return with_row(counted, total).withColumn("share_pct", 100.0 * F.col("rows") / F.col("_total")).drop("_total")


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows, columns, column_names) of several tables."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"),
            "rows",
            F.lit(len(df.columns)).alias("columns"),
            F.lit(", ".join(df.columns)).alias("column_names"),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, order: str, n: int = 3) -> DataFrame:
    return df.orderBy(order).limit(n)


def key_coverage(tables: Mapping[str, DataFrame], key: str = "project_id") -> DataFrame:
    """(table, non_null, distinct_keys, sample) of the key in several tables."""
    parts = []
    for name, df in tables.items():
        per_key = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        parts.append(
            per_key.agg(
                F.coalesce(F.sum("_n"), F.lit(0)).alias("non_null"),
                F.count(key).alias("distinct_keys"),
                F.min(F.col(key).cast("string")).alias("sample"),
            ).select(F.lit(name).alias("table"), "non_null", "distinct_keys", "sample")
        )
    return reduce(DataFrame.unionByName, parts)


def common_keys(left: DataFrame, right: DataFrame, key: str = "project_id") -> DataFrame:
    """Distinct keys present in both tables."""
    return left.select(key).where(F.col(key).isNotNull()).intersect(right.select(key))


def unmatched(left: DataFrame, right: DataFrame, key: str = "project_id") -> DataFrame:
    """Rows of the left table whose key the right table lacks."""
    return left.join(right.select(key), key, "left_anti")


def join_integrity(left: DataFrame, right: DataFrame, key: str = "project_id") -> DataFrame:
    """One row: rows before and after a left join, and unmatched rows.

    Counts per key are compared instead of building the joined rows.
    """
    here = left.groupBy(key).agg(F.count(F.lit(1)).alias("_l"))
    there = right.groupBy(key).agg(F.count(F.lit(1)).alias("_r"))
    return here.join(there, key, "left").agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.col("_l") * F.coalesce("_r", F.lit(1))), F.lit(0)).alias("rows_after"),
        F.coalesce(F.sum(F.when(F.col("_r").isNull(), F.col("_l")).otherwise(0)), F.lit(0)).alias("unmatched"),
    )
