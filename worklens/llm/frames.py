"""DataFrame helpers shared by the operators: safe column choice and small summaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worklens.session import work_dir


#: Stands for a missing document number inside tasks, where a column with gaps would turn into floats.
NO_NUMBER = -(2**63)


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """(doc_id, text, ...) without gaps: a missing text is empty, a missing number is NO_NUMBER.

    All other columns of the table stay behind, so their names cannot clash.
    """
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_NUMBER))
    return docs.select(number.alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def numbered(frame: DataFrame, name: str = "doc_id") -> DataFrame:
    """The missing numbers as NULL again."""
    return frame.withColumn(name, F.nullif(F.col(name), F.lit(NO_NUMBER)))


def share(doc_id: Column, parts: int) -> Column:
    """crc32 of a document's number written as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of sorted rows: a group that goes on in the next batch waits for it."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        going = (batch[key] == batch[key].iloc[-1]).all(axis=1).to_numpy()
        if held and going.all() and (held[-1][key].iloc[-1] == batch[key].iloc[0]).all():
            held.append(batch)
            continue
        whole = pd.concat([*held, batch], ignore_index=True)
        going = (whole[key] == whole[key].iloc[-1]).all(axis=1).to_numpy()
        held = [whole[going]]
        if not going.all():
            yield whole[~going]
    if held:
        yield pd.concat(held, ignore_index=True)


def delete(spark: SparkSession, frame: DataFrame) -> None:
    """Remove the files of a cut point that nothing will read again."""
    for name in frame.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if path.toString().find(work_dir(spark).rstrip("/").split(":", 1)[-1]) >= 0:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
