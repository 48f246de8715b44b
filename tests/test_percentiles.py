import numpy as np
import pytest
from pyspark.sql import functions as F

from worklens.operators import percentiles as p

FRACTIONS = {"low": 0.05, "q1": 0.25, "mid": 0.5, "q3": 0.75, "high": 0.95, "all": 1.0}


@pytest.fixture(scope="module")
def values(spark):
    """One group holds a third of all rows, another has a single value; NULL is a group too."""
    random = np.random.default_rng(3)
    groups = {"hot": 40_000, "b": 301, "c": 2, "one": 1, "flat": 5_000, "ties": 20_000, None: 77}
    rows = []
    for name, size in groups.items():
        drawn = np.full(size, 7.0) if name == "flat" else random.normal(size=size) * 1e3
        if name == "ties":
            drawn = random.integers(0, 5, size).astype(float)
        rows += [(name, float(v)) for v in drawn]
    rows += [("b", None), ("empty", None)]
    return spark.createDataFrame(rows, "g string, v double"), rows


@pytest.mark.parametrize("ranges", [None, 13])
def test_equal_to_interpolated_percentiles(values, monkeypatch, ranges):
    monkeypatch.setattr(p, "RANGES", ranges)
    df, rows = values
    found = {r["g"]: r for r in p.grouped_statistics(df, ["g"], "v", FRACTIONS).collect()}
    assert set(found) == {g for g, _ in rows}
    for group in set(found) - {"empty"}:
        data = [v for g, v in rows if g == group and v is not None]
        for name, fraction in FRACTIONS.items():
            assert found[group][name] == pytest.approx(np.percentile(data, 100 * fraction), rel=1e-12, abs=1e-9)
    assert found["empty"]["mid"] is None


def test_without_keys(values):
    df, rows = values
    found = p.grouped_statistics(df, [], "v", FRACTIONS).first()
    data = [v for _, v in rows if v is not None]
    for name, fraction in FRACTIONS.items():
        assert found[name] == pytest.approx(np.percentile(data, 100 * fraction), rel=1e-12)
    assert p.grouped_statistics(df.where("false"), [], "v", FRACTIONS).first()["mid"] is None


def test_grains_together(values, monkeypatch):
    """Coarse groups from the counts of fine ones, all with one table of counted values."""
    df, rows = values
    wide = df.withColumn("half", F.when(F.col("g").isin("hot", "b"), 1).otherwise(2))
    written = []
    plain = p.materialize
    monkeypatch.setattr(p, "materialize", lambda frame, name, *rest: (written.append(name), plain(frame, name, *rest))[1])
    fine, coarse, one = p.grain_statistics(wide, [["g", "half"], ["half"], []], "v", FRACTIONS, {"n": F.count("v")})
    assert written == ["counted-values"]
    assert {r["g"] for r in fine.collect()} == {g for g, _ in rows}
    for r in coarse.collect():
        data = [v for g, v in rows if v is not None and (g in ("hot", "b")) == (r["half"] == 1)]
        assert r["n"] == len(data)
        for name, fraction in FRACTIONS.items():
            assert r[name] == pytest.approx(np.percentile(data, 100 * fraction), rel=1e-12, abs=1e-9)
    assert one.first()["mid"] == pytest.approx(np.percentile([v for _, v in rows if v is not None], 50), rel=1e-12)


def test_moments(values):
    df, rows = values
    counted = p.counted_values(df, "v", [p.group_name([F.col("g")])])
    got = {r["_key"]: r for r in p.moments_of(counted).collect()}
    for g in {g for g, _ in rows} - {"empty"}:
        data = [v for h, v in rows if h == g and v is not None]
        r = got["0:1?" if g is None else f"0:{len(g) + 1}={g}"]
        assert (r["count"], r["min"], r["max"]) == (len(data), min(data), max(data))
        assert r["mean"] == pytest.approx(np.mean(data), abs=1e-9)
        assert r["std"] is None if len(data) == 1 else r["std"] == pytest.approx(np.std(data, ddof=1), abs=1e-9)
