import pytest

from worklens.operators import quality
from worklens.plans import views


@pytest.fixture(scope="module")
def view(spark):
    def frame(rows, columns):
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))

    sources = {
        "recommended": frame(
            [("1", "WS/MP1/2024-2025/1-a", "R", "01-Jan-2024", "1,000"), ("2", "WS/MP2/2024-2025/2-b", "R2", None, "5")],
            ("serial_no", "work", "state", "recommended_date", "recommended_amount"),
        ),
        "sanctioned": frame(
            [
                ("1", "ws/ mp1/2024-2025/1", "old", "02-Jan-2024", "900", "Sanctioned"),
                ("2", "WS/MP1/2024-2025/1", " ", "03-Jan-2024", " ", "Work Completed"),
            ],
            ("serial_no", "work", "state", "recommended_date", "sanction_amount", "work_status"),
        ),
        "expenditure": frame(
            [("WS/MP1/2024-2025/1", "10"), ("WS/ MP1/2024-2025/1", "Rs 5"), ("WS/MP3/2024-2025/3", "bad")],
            ("work_id", "fund_disbursed_amount"),
        ),
        "merged": frame(
            [("WS/MP1/2024-2025/1", "1", "0.5", "merged text"), ("WS/MP4/2024-2025/4", "0", "0.1", "x")],
            ("project_id", "cost_anomaly_flag", "cost_anomaly_score", "cost_anomaly_reason"),
        ),
        "duplicates": frame(
            [("WS/MP1/2024-2025/1", "False", "True", "like 2", "2")],
            ("project_id", "exact_duplicate_flag", "potential_duplicate_flag", "duplicate_reason", "similar_project_id"),
        ),
        "anomalies": frame(
            [("WS/MP1/2024-2025/1", "1.0", "")], ("project_id", "cost_anomaly_flag", "cost_anomaly_reason")
        ),
    }
    return views.project_360(sources).persist()


def test_priorities(view, rows):
    got = rows(view)
    numbered = [f"WS/MP{i}/2024-2025/{i}" for i in (1, 2, 3, 4)]
    assert sorted(got) == [*numbered, "ws/mp1/2024-2025/1"]
    one = got["WS/MP1/2024-2025/1"]
    assert one["state"] == "R"  # blank in the sanctioned row
    assert one["recommended_date"] == "01-Jan-2024"
    assert one["sanction_amount"] == 1000.0  # blank there, so the recommended amount
    assert one["work_status"] == "Work Completed"
    assert one["fund_disbursed_amount"] == 15.0
    assert one["cost_anomaly_flag"] == "1.0"
    assert one["cost_anomaly_score"] == "0.5"  # absent in the anomaly output
    assert one["cost_anomaly_reason"] == ""  # blank text there is kept
    assert one["cost_anomaly_available"] == ""
    assert got["WS/MP3/2024-2025/3"]["fund_disbursed_amount"] == 0.0
    assert got["WS/MP4/2024-2025/4"]["work"] == "WS/MP4/2024-2025/4"
    assert len(view.columns) == 24


def test_figures_and_search(view):
    figures = views.key_figures(view).first()
    assert figures["total_projects"] == 5
    assert (figures["anomalies"], figures["exact_duplicates"], figures["potential_duplicates"]) == (1, 0, 1)
    assert figures["high_risk_projects"] == 1
    labels = {r["project_id"]: r["risk_label"] for r in views.largest_projects(view).collect()}
    assert labels["WS/MP1/2024-2025/1"] == "High risk"
    assert {r["label"]: r["value"] for r in views.status_counts(view).collect()}["Unspecified"] == 3
    assert views.search(view, "MP2/").count() == 1
    assert views.search(view, flags="normal").count() == 4
    assert views.search(view, flags="duplicate", state="R").count() == 1
    with pytest.raises(ValueError):
        views.search(view, flags="other")
    assert [r["state"] for r in views.facet_values(view, "state").collect()] == ["R", "R2", "old"]
    detail = views.project_detail(view, "WS/MP1/2024-2025/1").first()
    assert (detail["disbursed_amount"], detail["cost_anomaly"], detail["duplicate_match"]) == (15.0, "Yes", "Yes")


def test_locale_order(spark):
    df = spark.createDataFrame([("b",), ("A",), ("a",), ("B",)], "project_id string")
    assert [r[0] for r in views.by_project_id(df, locale_order=True).collect()] == ["a", "A", "b", "B"]
    assert [r[0] for r in views.by_project_id(df).collect()] == ["A", "B", "a", "b"]


def test_sources_may_be_left_out(spark):
    only = spark.createDataFrame([("WS/MP3/2024-2025/3", "8")], "work_id string, fund_disbursed_amount string")
    row = views.project_360({"expenditure": only}).first()
    assert (row["fund_disbursed_amount"], row["state"], row["cost_anomaly_flag"]) == (8.0, "", "")


def test_approximate_distinct_counts(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (None, None)], "a int, b string")
    exact = {r["column"]: (r["non_null"], r["distinct_values"]) for r in quality.distinct_counts(df, ["a", "b"]).collect()}
    sketch = {
        r["column"]: (r["non_null"], r["distinct_values"])
        for r in quality.distinct_counts(df, ["a", "b"], approximate=True).collect()
    }
    assert exact == sketch == {"a": (2, 2), "b": (2, 1)}


def test_state_sorts_by_a_number_before_the_text_key(spark):
    """Project ids share their first bytes, so sorting by them alone compares whole rows."""
    rows = [(f" ws/ MP{i % 50}/2024-2025/{i % 50}" if i % 7 else " \u00a0\t", i, f"w{i}") for i in range(200)]
    state = views.project_state({"sanctioned": spark.createDataFrame(rows, "work string, serial_no long, state string")})
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_" in plan and "xxhash64(project_id" in plan and "max_by" not in plan
    got = {r["project_id"]: r["sanctioned"]["row"]["state"] for r in state.collect()}
    last = {i % 50: f"w{i}" for i in range(200) if i % 7}
    assert got == {f"ws/MP{k}/2024-2025/{k}": v for k, v in last.items()}
