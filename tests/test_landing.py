import pytest
from pyspark.sql import functions as F

from worklens import schemas
from worklens.functions import keys, values
from worklens.operators import shaping
from worklens.operators.lifecycle import build_master, expenditure_summary
from worklens.plans.monitoring import run
from worklens.sources.landing import ingest, read_optional, read_required
from worklens.sources.sinks import write_csv, write_table

CALAMITY = (
    '﻿"Sr. No.","Calamity Type","Calamity Name","Hon\'ble Members of Parliament","Date of Consent","Consent Amount ( ₹ )"\n'
    '"1","National Calamity","Flood, north","Member One","07-Dec-2025","7067400"\n'
    '"2","State Calamity","Land\nslide ""east"""," Member Two\t","03-Nov-2025","75,00,000"\n'
    '"2","State Calamity","Land\nslide ""east"""," Member Two\t","03-Nov-2025","75,00,000"\n'
    '"Grand Total"," "," "," "," ","1,45,67,400"'
)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_csv_with_mark_quotes_breaks_footer_and_repeats(spark, tmp_path):
    path = tmp_path / "calamity.csv"
    path.write_text(CALAMITY, encoding="utf-8")
    got = ingest(spark, "calamity", str(path), multi_line=True).orderBy("serial_no").collect()
    assert [r["serial_no"] for r in got] == [1, 2]
    assert got[1]["calamity_name"] == 'Landslide "east"'
    assert got[1]["mp_name"] == "Member Two"
    assert [str(r["consent_date"]) for r in got] == ["2025-12-07", "2025-11-03"]
    assert sum(r["consent_amount"] for r in got) == 14_567_400.0


def test_required_and_optional_sources(spark, tmp_path):
    schema = schemas.landing_schema("completed")
    missing = str(tmp_path / "nothing.csv")
    with pytest.raises(FileNotFoundError, match="completed"):
        read_required(spark, missing, schema, "completed")
    empty = read_optional(spark, missing, schema)
    assert empty.isEmpty() and empty.schema == schema


def test_headers_decide_and_must_be_there(spark, tmp_path):
    schema = schemas.landing_schema("calamity")
    names = schema.fieldNames()
    line = lambda cells: ",".join(f'"{c}"' for c in cells)
    rows = [[f"{name[:3]} {i}" for name in names] for i in range(2000)]
    path = tmp_path / "reversed.csv"
    path.write_text("\n".join(["\ufeff" + line(reversed(names)), *[line(reversed(r)) for r in rows]]), encoding="utf-8")
    got = read_required(spark, str(path), schema, "calamity")
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert read_required(spark, str(path), schema, "calamity").rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path.write_text(line(names[1:]) + "\n", encoding="utf-8")
    with pytest.raises(ValueError, match="Sr"):
        read_required(spark, str(path), schema, "calamity")


def test_canonical_names():
    raw = "RECOMMENDED AMOUNT   ( ₹ )"
    assert shaping.canonical_name(raw) == "recommended_amount____₹_"
    assert shaping.canonical_name("Sanction Amount ( ₹ )", "currency") == "sanction_amount_(_)"
    assert shaping.canonical_name("  State ", "lower") == "state"
    with pytest.raises(ValueError):
        shaping.canonical_name("x", "other")


@pytest.mark.parametrize(
    "work, key, kind",
    [
        ("WS/MP479/2024-2025/138772-Development of playground", "WS/MP479/2024-2025/138772", "Development of playground"),
        ("WS/ MP479/2024-2025/138772 - X", "WS/MP479/2024-2025/138772", "X"),
        ("no key", None, "no key"),
        (None, None, None),
    ],
)
def test_project_keys(spark, work, key, kind):
    assert value(spark, keys.project_key(F.lit(work).cast("string"))) == key
    assert value(spark, keys.work_type(F.lit(work).cast("string"))) == kind


def test_other_key_fields(spark):
    assert value(spark, keys.district(F.lit("Bankura (DISTRICT MAGISTRATE BANKURA_IDA)"))) == "BANKURA"
    assert value(spark, keys.lenient_key(F.lit("see ws mp1/2024-2025/9 now"))) == "wsmp1/2024-2025/9"
    assert value(spark, keys.lenient_key(F.lit("  other "))) == "other"
    assert value(spark, keys.lenient_key(F.lit("  "))) is None


@pytest.mark.parametrize(
    "text, strict, loose, flag",
    [
        ("4,05,67,400", 40567400.0, 40567400.0, False),
        ("12.5", 12.5, 12.5, True),
        ("Rs 1,200", None, 1200.0, False),
        ("1-2", None, 0.0, False),
        ("NaN", None, 0.0, False),
        ("1d", None, 1.0, False),
        ("", None, 0.0, False),
        (None, None, 0.0, False),
        (" Yes ", None, 0.0, True),
        ("f", None, 0.0, False),
        ("0.0", 0.0, 0.0, False),
        ("-3", -3.0, -3.0, True),
    ],
)
def test_numbers_and_flags(spark, text, strict, loose, flag):
    cell = F.lit(text).cast("string")
    assert value(spark, values.amount(cell)) == strict
    assert value(spark, values.loose_number(cell)) == loose
    if text != "4,05,67,400":
        assert value(spark, values.to_flag(cell)) is flag


@pytest.mark.parametrize(
    "text, day",
    [
        ("07-Dec-2025", "2025-12-07"),
        ("2024-12-03", "2024-12-03"),
        ("03/12/2024", "2024-12-03"),
        ("03-12-2024", "2024-12-03"),
        ("31-Feb-2024", None),
        ("soon", None),
        (None, None),
    ],
)
def test_dates(spark, text, day):
    got = value(spark, values.parse_date(F.lit(text).cast("string")))
    assert (str(got) if got else None) == day


def test_sinks_replace_and_keep_lists_readable(spark, tmp_path):
    df = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "project_id string, ids array<string>")
    for _ in range(2):
        write_table(df, str(tmp_path / "new" / "table"))
        write_csv(df, str(tmp_path / "csv"))
    assert spark.read.parquet(str(tmp_path / "new" / "table")).count() == 2
    text = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert {r["project_id"]: r["ids"] for r in text.collect()} == {"a": '["x","y"]', "b": "[]"}


def test_summary_of_unreadable_amounts(spark):
    df = spark.createDataFrame(
        [("a", "bad", None), ("a", None, None), ("b", "5", None), (None, "9", None)],
        "project_id string, fund_disbursed_amount string, expenditure_date date",
    )
    got = {r["project_id"]: (r["total_expenditure"], r["payment_count"]) for r in expenditure_summary(df).collect()}
    assert got == {"a": (0.0, 2), "b": (5.0, 1)}


def export(path, table, rows):
    """Write a raw export with the table's own headers."""
    lines = [",".join(f'"{h}"' for h in schemas.HEADERS[table])]
    lines += [",".join('"{}"'.format(r.get(c, "")) for c in schemas.HEADERS[table].values()) for r in rows]
    lines.append(",".join(['"Grand Total"'] + ['" "'] * (len(schemas.HEADERS[table]) - 1)))
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


@pytest.fixture
def exports(tmp_path):
    works = [
        {
            "serial_no": i,
            "work": f"WS/ MP{i}/2024-2025/{i}-Roads",
            "state": "S",
            "ida": "Town (OFFICE)",
            "constituency": "C",
            "work_category": "Normal",
            "work_description": f"Road {i} in ward" if i < 4 else "Same road twice",
            "recommended_date": "01-Jan-2024",
            "sanction_date": "20-Mar-2024",
            "recommended_amount": "1,00,000",
            "sanction_amount": "90,000",
            "work_status": "Sanctioned",
        }
        for i in range(1, 6)
    ]
    done = [{**works[0], "completion_date": "01-May-2024", "amount_disbursed": "95,000"}]
    paid = [
        {**works[0], "serial_no": n, "work_id": "WS/MP1/2024-2025/ 1", "fund_disbursed_amount": "50,000", "expenditure_date": d}
        for n, d in ((1, "02-Apr-2024"), (2, "11-Apr-2024"))
    ]
    paid.append({"serial_no": 3, "work_id": "WS/MP9/2024-2025/9", "state": "T", "work_type": "Wells", "fund_disbursed_amount": "7"})
    tables = {"recommended": works, "sanctioned": works[:4] + works[:1] + works[4:], "completed": done, "expenditure": paid}
    return {name: export(tmp_path / f"{name}.csv", name, rows) for name, rows in tables.items()}


@pytest.mark.parametrize("mode, projects", [("full_outer", 6), ("sanctioned_left", 5)])
def test_whole_job_from_raw_exports(spark, exports, mode, projects):
    result = run(spark, paths=exports, mode=mode)
    risk = {r["project_id"]: r for r in result.risk.collect()}
    assert len(risk) == projects
    first = risk["WS/MP1/2024-2025/1"]
    assert first["over_expenditure_flag"] == 1 and first["status_flag"] == 1 and first["sanction_delay_flag"] == 1
    assert risk["WS/MP4/2024-2025/4"]["exact_duplicate_flag"] == 1
    assert risk["WS/MP5/2024-2025/5"]["exact_group_id"] == risk["WS/MP4/2024-2025/4"]["exact_group_id"] == "WS/MP4/2024-2025/4"
    master = {r["project_id"]: r for r in result.master.collect()}
    assert master["WS/MP1/2024-2025/1"]["total_expenditure"] == 100_000.0
    assert master["WS/MP1/2024-2025/1"]["work_type"] == ("Roads" if mode == "full_outer" else "Normal")
    assert master["WS/MP1/2024-2025/1"]["district"] == ("TOWN" if mode == "full_outer" else "C")
    if mode == "full_outer":
        assert master["WS/MP9/2024-2025/9"]["state"] == "T"
        assert master["WS/MP9/2024-2025/9"]["cost_amount"] == 7.0


def test_modes_are_checked(spark):
    empty = spark.createDataFrame([], "project_id string, serial_no long")
    with pytest.raises(ValueError, match="mode"):
        build_master(empty, empty, empty, empty, mode="inner")
    with pytest.raises(ValueError, match="either"):
        run(spark)
