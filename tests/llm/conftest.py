import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parent))

from worklens.llm.registry import import_in_workers

#: A documents table that also has columns the operators use for their own ends.
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in ("fp", "node", "h", "f", "kind", "fold", "keep", "n_lines", "kept_text", "piece", "length", "digest", "score")],
    ]
)


@pytest.fixture
def docs(spark):
    """Documents from {number: text} or [(number, text)], extra columns included."""
    import_in_workers(spark)

    def make(rows, lang="en"):
        pairs = rows.items() if isinstance(rows, dict) else rows
        full = [(i, t, lang, "src0", None if t is None else len(t), *["x"] * 13) for i, t in pairs]
        return spark.createDataFrame(full, SCHEMA)

    return make
