"""Column names, projections and one-row-per-key reductions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SORT_HASH = "_sort_hash"


def canonical_name(name: str, rule: str = "brackets") -> str:
    """Canonical header text.

    ``brackets``: lower case, spaces to underscores, brackets dropped;
    ``currency``: lower case, rupee sign dropped, spaces to underscores, double
    underscores halved once; ``lower``: trimmed lower case only.
    """
    text = name.strip().lower()
    if rule == "brackets":
        return text.replace(" ", "_").replace("(", "").replace(")", "")
    if rule == "currency":
        return text.replace("₹", "").replace(" ", "_").replace("__", "_")
    if rule == "lower":
        return text
    raise ValueError(f"Unknown naming rule: {rule}")


def canonical_columns(df: DataFrame, rule: str = "brackets") -> DataFrame:
    return df.toDF(*[canonical_name(name, rule) for name in df.columns])


def existing(df: DataFrame, columns: Iterable[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def select_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Ordered projection of the columns that are there."""
    return df.select(*existing(df, columns))


def add_missing(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add absent columns as typed NULLs, ``{name: type}``."""
    absent = {c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns}
    return df.withColumns(absent) if absent else df


def add_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Fill absent columns from a stand-in column, ``{name: stand-in}``."""
    filled = {c: F.col(s) for c, s in aliases.items() if c not in df.columns and s in df.columns}
    return df.withColumns(filled) if filled else df


def rename_legacy(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Old column names to new ones; where both exist the new one is kept."""
    for old, new in aliases.items():
        if old in df.columns:
            df = df.drop(old) if new in df.columns else df.withColumnRenamed(old, new)
    return df


def require_columns(df: DataFrame, columns: Iterable[str], label: str = "") -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        prefix = f"{label} missing" if label else "Missing required"
        raise ValueError(f"{prefix} columns: {missing}")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys held by more than one row (NULL included) with their row counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def require_unique(df: DataFrame, key: str = "project_id", label: str = "Input") -> None:
    if not duplicate_keys(df, key).isEmpty():
        raise ValueError(f"{label} must contain one row per unique {key}")


def sort_hash(key: str) -> Column:
    """A number to group by before a text key.

    Grouping rows with text or structs sorts them. Keys such as WS/MP... share
    their first eight bytes, by which Spark sorts; beyond these it reads the
    rows themselves, again and again. The number tells nearly all apart.
    """
    return F.xxhash64(key).alias(SORT_HASH)


def _ranked(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    # A rank filter of 1 is applied before the shuffle as well, so a key that
    # holds most rows sends one row per input partition.
    ranked = df.where(F.col(key).isNotNull()).withColumn(
        "_rank", F.row_number().over(W.partitionBy(sort_hash(key), key).orderBy(*order))
    )
    return ranked.where("_rank = 1").drop("_rank")


def tie_break(df: DataFrame) -> Column:
    """Hash of a whole row: rows that no order column tells apart always rank alike."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def first_per_key(df: DataFrame, key: str, order: str | Sequence[str]) -> DataFrame:
    """Earliest row of every non-NULL key; rows without an order value come after all others."""
    order = [order] if isinstance(order, str) else order
    return _ranked(df, key, [*[F.col(c).asc_nulls_last() for c in order], tie_break(df)])


def last_per_key(df: DataFrame, key: str, order: str | Sequence[str]) -> DataFrame:
    """Latest row of every non-NULL key; rows without an order value come before all others."""
    order = [order] if isinstance(order, str) else order
    return _ranked(df, key, [*[F.col(c).desc_nulls_last() for c in order], tie_break(df)])


def with_row(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row.

    The hint is safe: a global aggregate is one row whatever the input size.
    """
    return (
        rows.withColumn("_one", F.lit(1))
        .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one", "left")
        .drop("_one")
    )


def top(df: DataFrame, n: int, by: Column | str, tie: str = "project_id") -> DataFrame:
    """The n leading rows, ties settled by ``tie``; no full sort."""
    return df.orderBy(F.desc(by) if isinstance(by, str) else by, F.asc(tie)).limit(n)
