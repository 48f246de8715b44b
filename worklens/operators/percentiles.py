"""Exact interpolated percentiles of groups of any size, many groups and columns in one pass.

Equal values of a group are counted first, coarser groups from the counts of
finer ones. The counted values are sorted by (group, value) into ranges and
written once. Each range's sums tell in which range a wanted rank lies, and
only there values are ranked one by one, so a group that holds most rows is
spread over as many ranges as it needs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from worklens.session import materialize

#: Ranges that counted values are sorted into; by default as many as Spark finds fit.
RANGES: int | None = None


def group_name(keys: Sequence[Column], grain: int = 0) -> Column:
    """One text for a grain and its key values; NULL is a value like any other."""
    texts = [F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("?")) for k in keys]
    return F.concat(F.lit(str(grain)), *[part for t in texts for part in (F.lit(":"), F.length(t).cast("string"), t)])


def counted_values(df: DataFrame, value: str, names: Sequence[Column]) -> DataFrame:
    """(_key, _v, _c, _part): how often each group has a value, sorted into ranges and written.

    ``names`` are the groups a row belongs to, one for each grain.
    """
    rows = df.where(F.col(value).isNotNull()).select(*[n.alias(f"_g{i}") for i, n in enumerate(names)], F.col(value).cast("double").alias("_v"))
    grains = [f"_g{i}" for i in range(len(names))]
    counted = rows.groupBy(*grains, "_v").agg(F.count(F.lit(1)).alias("_c"))
    if len(grains) > 1:
        counted = counted.select(F.explode(F.array(*grains)).alias("_key"), "_v", "_c").groupBy("_key", "_v").agg(F.sum("_c").alias("_c"))
    else:
        counted = counted.withColumnRenamed("_g0", "_key")
    dealt = counted.repartitionByRange("_key", "_v") if RANGES is None else counted.repartitionByRange(RANGES, "_key", "_v")
    return materialize(dealt.withColumn("_part", F.spark_partition_id()), "counted-values")


def percentiles_of(counted: DataFrame, percentiles: Mapping[str, float]) -> DataFrame:
    """(_key, one column per percentile) of counted values."""
    position = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    ranks = F.array(
        *[
            F.struct(F.lit(2 * i + side).alias("slot"), edge(position(p)).cast("long").alias("rank"))
            for i, p in enumerate(percentiles.values())
            for side, edge in enumerate((F.floor, F.ceil))
        ]
    )
    along = W.partitionBy("_key").orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow)
    # A row per group and range: few groups lie in more than one.
    spans = (
        counted.groupBy("_key", "_part")
        .agg(F.sum("_c").alias("_m"))
        .withColumns({"_before": F.sum("_m").over(along) - F.col("_m"), "_n": F.sum("_m").over(W.partitionBy("_key"))})
        .withColumn("_wanted", F.filter(ranks, lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_m"))))
        .where(F.size("_wanted") > 0)
    )
    inside = W.partitionBy("_key", "_part").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("_before") + F.col("_upto")
    hits = (
        counted.withColumn("_upto", F.sum("_c").over(inside))
        .join(spans, ["_key", "_part"])
        .withColumn("_hit", F.explode(F.filter("_wanted", lambda r: (r["rank"] >= upto - F.col("_c")) & (r["rank"] < upto))))
    )
    picked = hits.groupBy("_key").agg(
        F.first("_n").alias("_n"),
        *[F.max(F.when(F.col("_hit.slot") == s, F.col("_v"))).alias(f"_s{s}") for s in range(2 * len(percentiles))],
    )
    between = lambda i, p: F.col(f"_s{2 * i}") + (position(p) - F.floor(position(p))) * (F.col(f"_s{2 * i + 1}") - F.col(f"_s{2 * i}"))
    return picked.select("_key", *[between(i, p).alias(name) for i, (name, p) in enumerate(percentiles.items())])


def moments_of(counted: DataFrame) -> DataFrame:
    """(_key, count, mean, std, min, max) of counted values; std is the sample deviation."""
    first = counted.groupBy("_key").agg(
        F.sum("_c").alias("count"), (F.sum(F.col("_c") * F.col("_v")) / F.sum("_c")).alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max")
    )
    gap = F.col("_v") - F.col("mean")
    spread = counted.join(first.select("_key", "mean"), "_key").groupBy("_key").agg(F.sum(F.col("_c") * gap * gap).alias("_m2"))
    return first.join(spread, "_key").withColumn("std", F.sqrt(F.try_divide(F.col("_m2"), F.col("count") - 1))).drop("_m2")


def grain_statistics(
    df: DataFrame,
    grains: Sequence[Sequence[str]],
    value: str,
    percentiles: Mapping[str, float],
    others: Mapping[str, Column] | None = None,
) -> list[DataFrame]:
    """Per-group exact percentiles ``{name: fraction}`` plus other aggregates, a table for every grain.

    A grain is a list of key columns. All grains share one table of counted
    values, so the percentiles of all are found together. NULL values are left
    out of every percentile; a group without values has NULL percentiles. NULL
    is a key like any other. A grain without keys is one row, also over an
    empty table.
    """
    others = dict(others or {})
    names = [group_name([F.col(k) for k in keys], i) for i, keys in enumerate(grains)]
    found = percentiles_of(counted_values(df, value, names), percentiles)
    out = []
    for keys, name in zip(grains, names, strict=True):
        summary = df.groupBy(*keys).agg(F.count(value).alias("_n"), *[column.alias(c) for c, column in others.items()])
        out.append(summary.withColumn("_key", name).join(found, "_key", "left").select(*keys, *others, *percentiles))
    return out


def grouped_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percentiles: Mapping[str, float],
    others: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``grain_statistics`` of one grain."""
    return grain_statistics(df, [keys], value, percentiles, others)[0]
