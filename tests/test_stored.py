"""The stored project view against the view itself."""

import pytest
from pyspark.sql import functions as F

from worklens.plans import views
from worklens.plans.stored import _gram_lists, is_stored, load_view, store_view


@pytest.fixture(scope="module")
def view(spark):
    data = [
        (f"WS/MP{i}/2024-2025/{i}", f"State {i % 7}" if i % 11 else None, ["Road from Üñi to the mill", "school (new) hall", "", None][i % 4], f"WS/MP{i}-w", "Done" if i % 2 else "", *[str(i % 5 == 0)] * 3)
        for i in range(500)
    ]
    columns = ("project_id", "state", "work_description", "work", "work_status", "cost_anomaly_flag", "exact_duplicate_flag", "potential_duplicate_flag")
    frame = spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))
    return frame.withColumns({"amount_disbursed": F.lit(1.0), "fund_disbursed_amount": F.lit(2.0)}).persist()


@pytest.fixture(scope="module")
def stored(spark, view, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("view") / "projects")
    assert not is_stored(spark, path)
    store_view(view, path, shelves=9)
    assert is_stored(spark, path)
    return load_view(spark, path)


def ids(frame):
    return [r["project_id"] for r in frame.collect()]


def test_rows_and_shelves(view, stored):
    assert sorted(map(tuple, stored.view.select(view.columns).collect()), key=str) == sorted(map(tuple, view.collect()), key=str)
    spans = stored.shelves.orderBy("shelf").collect()
    assert len(spans) == 9 and sum(r["rows"] for r in spans) == 500
    assert all(a["last"] < b["first"] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("text", ["mp12", "MP4/2024", "üñi to", "hall", "(new)", "state 3", "zzz", "ws/mp4", "ll", " 9", ""])
def test_index_finds_what_a_scan_finds(view, stored, text):
    for facets in ({}, {"status": "Done", "flags": "duplicate"}):
        assert sorted(ids(stored.search(text, **facets))) == sorted(ids(views.search(view, text, **facets)))


def test_index_reads_candidates_only(stored):
    assert stored.candidates("mp123/").count() == 1
    assert stored.candidates("qqq").isEmpty()


def test_pages_follow_the_sorted_result(view, stored):
    everything = sorted(ids(views.search(view, flags="normal")))
    found = stored.search(flags="normal")
    for number in (0, 1, 7, 400):
        listed, total = stored.page(found, number, 20)
        assert ids(listed) == everything[20 * number : 20 * number + 20] and total == len(everything)
    at, walked = None, []
    while page := ids(stored.following(found, at, 90)):
        walked += page
        at = page[-1]
    assert walked == everything


def test_one_project_opens_one_shelf(stored):
    found = stored.detail("WS/MP77/2024-2025/77")
    assert ids(found) == ["WS/MP77/2024-2025/77"] and found.first()["disbursed_amount"] == 3.0
    assert len(found.inputFiles()) <= 9 and "PartitionFilters" in found._jdf.queryExecution().executedPlan().toString()
    assert stored.detail("none such").isEmpty()


def test_grams_are_not_shuffled(view, stored):
    lists = _gram_lists(stored.rows, 9)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    # The one exchange deals rows by shelf; grams are made and grouped above it.
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    held = {(r["gram"], r["shelf"]): r["places"] for r in lists.collect()}
    assert held == {(r["gram"], r["shelf"]): r["places"] for r in stored.index.collect()}
    assert all(places == sorted(set(places)) for places in held.values())


def test_index_is_made_piece_by_piece(view, stored, monkeypatch):
    monkeypatch.setattr("worklens.plans.stored.PIECE", 10)
    monkeypatch.setattr("worklens.plans.stored.PIECE_BYTES", 300)
    lists = _gram_lists(stored.rows, 3)
    plan = lists._jdf.queryExecution().executedPlan().toString()
    # Grams leave the worker as lists: rows of one gram are neither grouped nor sorted by Spark.
    assert "MapInArrow" in plan and "HashAggregate" not in plan
    got, pieces = {}, lists.collect()
    for r in pieces:
        assert r["places"][0] // 10 == r["places"][-1] // 10
        got.setdefault((r["gram"], r["shelf"]), []).extend(r["places"])
    assert len(pieces) > len(got)
    assert {k: sorted(v) for k, v in got.items()} == {(r["gram"], r["shelf"]): r["places"] for r in stored.index.collect()}
    wanted = {}
    for r in stored.rows.collect():
        for c in views.SEARCHED:
            text = (r[c] or "").lower()
            for i in range(len(text) - 2):
                wanted.setdefault((text[i : i + 3], r["shelf"]), set()).add(r["place"])
    assert {k: set(v) for k, v in got.items()} == wanted
