"""Unit fixtures of the two detectors and of the merge."""

import pytest
from pyspark.sql import functions as F

from worklens.operators.duplicates import detect_duplicates, duplicate_report
from worklens.operators.forest import detect_cost_anomalies
from worklens.operators.fusion import fuse_detectors, merge_detectors, ml_risk_level

COST_SCHEMA = "project_id string, state string, district string, work_type string, work_category string, cost_amount double"


def cost_rows(costs):
    states = ["A", "A", "A", "B", "B", "B"]
    return [(f"P{i}", s, "D", "Roads", "Normal", c) for i, (s, c) in enumerate(zip(states, costs))]


def test_cost_peers_fall_back_and_missing_cost_is_skipped(spark, rows):
    projects = spark.createDataFrame(cost_rows([100.0, 110.0, 90.0, 1000.0, 1100.0, None]), COST_SCHEMA)
    result = rows(detect_cost_anomalies(projects, minimum_peer_size=3, contamination=0.2)[0])
    assert len(result) == 6
    assert result["P5"]["cost_anomaly_available"] is False
    assert result["P5"]["cost_anomaly_flag"] is None
    assert result["P5"]["cost_anomaly_reason"] == "Missing cost_amount; not analyzed."
    expected = {
        "P0": (3, 100, 10, 0, 0),
        "P1": (3, 100, 10, 0.1, 1),
        "P2": (3, 100, 10, -0.1, -1),
        "P3": (5, 110, 900, 8.090909, 1.706340),
        "P4": (5, 110, 900, 9, 1.898064),
    }
    for key, (count, median, iqr, deviation, z) in expected.items():
        row = result[key]
        assert (row["peer_count"], row["peer_median_cost"], row["peer_iqr_cost"]) == (count, median, iqr)
        assert row["cost_deviation_pct"] == pytest.approx(deviation, abs=1e-6)
        assert row["cost_zscore"] == pytest.approx(z, abs=1e-6)
        assert row["cost_iqr_flag"] == 0
    assert "Cost is at least twice the peer median" in result["P4"]["cost_anomaly_reason"]


def test_cost_detector_without_any_cost(spark, rows):
    projects = spark.createDataFrame(cost_rows([None] * 6), COST_SCHEMA)
    result = rows(detect_cost_anomalies(projects)[0])
    assert {r["cost_anomaly_reason"] for r in result.values()} == {"Missing cost_amount; not analyzed."}
    assert not any(r["cost_anomaly_available"] for r in result.values())


def test_cost_detector_checks_its_input(spark):
    with pytest.raises(ValueError, match="work_type"):
        detect_cost_anomalies(spark.createDataFrame([("P1", 100.0)], "project_id string, cost_amount double"))
    repeated = spark.createDataFrame(cost_rows([1.0] * 6) + cost_rows([1.0] * 6), COST_SCHEMA)
    with pytest.raises(ValueError, match="unique"):
        detect_cost_anomalies(repeated)
    with pytest.raises(ValueError, match="at least 2"):
        detect_cost_anomalies(repeated, minimum_peer_size=1)


def test_exact_duplicates_are_flagged(spark, rows):
    text = "Construction of a road"
    projects = spark.createDataFrame(
        [
            ("P1", 1, "KARNATAKA", "DHA", "Roads", text),
            ("P2", 2, "KARNATAKA", "DHA", "Roads", text),
            ("P3", 3, "KARNATAKA", "OTHER", "Buildings", text),
        ],
        "project_id string, serial_no long, state string, constituency string, work_type string, work_description string",
    )
    result = rows(detect_duplicates(projects).projects)
    assert result["P1"]["exact_duplicate_flag"] and result["P1"]["potential_duplicate_flag"]
    assert result["P1"]["exact_group_id"] == result["P2"]["exact_group_id"] == "P1"
    assert result["P1"]["exact_duplicate_count"] == result["P2"]["exact_duplicate_count"] == 1
    assert result["P1"]["duplicate_reason"] == "Exact description duplicate within the same constituency."
    assert result["P3"]["exact_group_id"] is None and result["P3"]["exact_duplicate_count"] == 0
    assert not result["P3"]["potential_duplicate_flag"]


def test_similar_descriptions_stay_in_their_block(spark, rows):
    longer = "construction concrete road village improvement"
    projects = spark.createDataFrame(
        [
            ("P1", 1, "KARNATAKA", "Roads", "construction concrete road village"),
            ("P2", 2, "KARNATAKA", "Roads", longer),
            ("P3", 3, "KERALA", "Roads", longer),
        ],
        "project_id string, serial_no long, state string, work_type string, work_description_clean string",
    )
    found = detect_duplicates(projects, similarity_threshold=0.5)
    result = rows(found.projects)
    assert result["P1"]["leading_similar_ids"] == ["P2"]
    assert result["P2"]["leading_similar_ids"] == ["P1"]
    assert result["P1"]["similarity_score"] == 0.8237
    assert result["P1"]["duplicate_reason"] == "Description is similar to P2."
    assert result["P3"]["leading_similar_ids"] == []
    assert duplicate_report(found).columns[-1] == "similar_project_id"


def test_empty_descriptions_match_nothing(spark, rows):
    projects = spark.createDataFrame(
        [("P1", 1, "KARNATAKA", "Roads", None), ("P2", 2, "KARNATAKA", "Roads", None)],
        "project_id string, serial_no long, state string, work_type string, work_description_clean string",
    )
    result = rows(detect_duplicates(projects).projects)
    assert len(result) == 2
    assert not any(r["potential_duplicate_flag"] or r["exact_duplicate_flag"] for r in result.values())


def test_duplicate_detector_checks_its_input(spark):
    with pytest.raises(ValueError, match="work_description"):
        detect_duplicates(spark.createDataFrame([("P1", "S", "R")], "project_id string, state string, work_type string"))


def test_merge_keeps_duplicate_rows_and_marks_coverage(spark, rows):
    duplicates = spark.createDataFrame(
        [("P1", True, 1.0), ("P2", False, 0.0)],
        "project_id string, potential_duplicate_flag boolean, similarity_score double",
    )
    anomalies = spark.createDataFrame(
        [("P1", 1, -0.2, "Unusual cost pattern")],
        "project_id string, cost_anomaly_flag int, anomaly_score double, anomaly_reason string",
    )
    result = rows(merge_detectors(duplicates, anomalies))
    assert len(result) == 2
    assert result["P1"]["cost_anomaly_available"] is True
    assert result["P1"]["cost_anomaly_score"] == -0.2
    assert result["P2"]["cost_anomaly_available"] is False
    assert result["P2"]["cost_anomaly_flag"] is None
    assert result["P2"]["cost_anomaly_reason"] == ""
    with pytest.raises(ValueError, match="cost_anomaly_reason"):
        merge_detectors(duplicates, anomalies.drop("anomaly_reason"))
    with pytest.raises(ValueError, match="unique"):
        merge_detectors(duplicates.union(duplicates), anomalies)


def test_fusion_weights_and_levels(spark, rows):
    forest = spark.createDataFrame(
        [("A", 1), ("B", 1), ("C", 0), ("D", 0), ("E", 0)], "project_id string, cost_anomaly_flag int"
    ).withColumns({"anomaly_score": F.lit(0.0), "anomaly_reason": F.lit("")})
    z = spark.createDataFrame([("A",), ("C",)], "project_id string")
    iqr = spark.createDataFrame([("A",), ("B",)], "project_id string")
    similar = spark.createDataFrame([("A", 0.97), ("D", 0.96)], "project_id string, similarity_score double")
    result = rows(fuse_detectors(forest, z, iqr, similar))
    assert {k: (r["ml_risk_score"], r["ml_risk_level"]) for k, r in result.items()} == {
        "A": (100, "Critical"),
        "B": (60, "High"),
        "C": (25, "Medium"),
        "D": (15, "Low"),
        "E": (0, "Normal"),
    }
    edges = spark.createDataFrame([(s,) for s in (80, 79, 50, 49, 20, 19, 1, 0)], "s int")
    levels = [r[0] for r in edges.select(ml_risk_level(F.col("s"))).collect()]
    assert levels == ["Critical", "High", "High", "Medium", "Medium", "Low", "Low", "Normal"]
