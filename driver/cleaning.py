"""Landing, parsing and key extraction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driver import views
from driver.registry import query
from worklens.functions import keys, text, values
from worklens.operators.shaping import with_row
from worklens.schemas import SANCTIONED, landing_schema
from worklens.session import new_path
from worklens.sources.landing import clean, ingest, read_optional
from worklens.sources.sinks import write_csv

KEY_RE = r"WS/\s*MP\d+/\d{4}-\d{4}/\d+"


@query(
    views.with_views(
        "works",
        body=f"""
        SELECT serial_no,
               NULLIF(regexp_replace(regexp_extract(work, '({KEY_RE})', 1), '\\s+', '', 'g'), '') AS project_id,
               NULLIF(trim(regexp_replace(work, '{KEY_RE}\\s*-?\\s*', '', 'g')), '') AS work_type,
               NULLIF(regexp_replace(work_id, '\\s+', '', 'g'), '') AS key_of_id,
               CASE WHEN regexp_extract(lower(loose), 'ws/?\\s*mp\\d+/\\d{{4}}-\\d{{4}}/\\d+') <> ''
                    THEN regexp_replace(regexp_extract(loose, '(?i)ws/?\\s*mp\\d+/\\d{{4}}-\\d{{4}}/\\d+'), '\\s+', '', 'g')
                    ELSE NULLIF(trim(loose), '') END AS loose_key,
               upper(trim(split_part(ida, '(', 1))) AS district
        FROM texts""",
        extra={
            "texts": """
            SELECT serial_no, ida,
                   CASE stage WHEN 'P' THEN 'no key yet' WHEN 'F' THEN replace(project_id, 'WS/', 'WS/ ') || ' - ' || work_type
                        ELSE project_id || '-' || work_type END AS work,
                   CASE stage WHEN 'P' THEN ' ' ELSE replace(project_id, '/', '/ ') END AS work_id,
                   CASE stage WHEN 'P' THEN '  note ' || serial_no ELSE 'see ws mp' || serial_no || '/2024-2025/7 today' END AS loose
            FROM works"""
        },
    )
)
def project_key_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, stage = F.col("project_id"), F.col("stage")
    pending = stage == "P"
    texts = views.works(spark, sf_dir).select(
        "serial_no",
        "ida",
        F.when(pending, "no key yet")
        .when(stage == "F", F.concat(F.replace(key, F.lit("WS/"), F.lit("WS/ ")), F.lit(" - "), "work_type"))
        .otherwise(F.concat(key, F.lit("-"), "work_type"))
        .alias("work"),
        F.when(pending, " ").otherwise(F.replace(key, F.lit("/"), F.lit("/ "))).alias("work_id"),
        F.when(pending, F.concat(F.lit("  note "), "serial_no"))
        .otherwise(F.concat(F.lit("see ws mp"), "serial_no", F.lit("/2024-2025/7 today")))
        .alias("loose"),
    )
    return texts.select(
        "serial_no",
        keys.project_key(F.col("work")).alias("project_id"),
        keys.work_type(F.col("work")).alias("work_type"),
        keys.project_key_from_id(F.col("work_id")).alias("key_of_id"),
        keys.lenient_key(F.col("loose")).alias("loose_key"),
        keys.district(F.col("ida")).alias("district"),
    )


@query(
    """
    SELECT doc_id,
           md5(coalesce(translate(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(9) || chr(10), ''), '')) AS cleaned,
           md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS spaced,
           md5(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS joined
    FROM documents"""
)
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    return views.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(F.coalesce(values.clean_text(body), F.lit(""))).alias("cleaned"),
        F.md5(text.normalize_spaced(body)).alias("spaced"),
        F.md5(text.normalize_joined(body)).alias("joined"),
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(floor(l_extendedprice) AS DOUBLE) AS grouped_amount,
           CASE l_returnflag WHEN 'A' THEN CAST(floor(l_extendedprice) AS DOUBLE) END AS strict_amount,
           CASE l_returnflag WHEN 'A' THEN CAST(floor(l_extendedprice) AS DOUBLE)
                             WHEN 'N' THEN CAST(floor(l_quantity) AS DOUBLE) ELSE 0.0::DOUBLE END AS loose_amount
    FROM lineitem"""
)
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("l_extendedprice")
    mixed = (
        F.when(F.col("l_returnflag") == "A", price.cast("string"))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit("Rs "), F.floor("l_quantity"), F.lit(" only")))
        .otherwise("not known")
    )
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        values.amount(F.format_number(price, 0)).alias("grouped_amount"),
        values.number(mixed).alias("strict_amount"),
        values.loose_number(mixed).alias("loose_amount"),
    )


@query(
    """
    WITH written AS (
        SELECT l_orderkey, l_linenumber, l_partkey,
               CASE l_linenumber % 5
                    WHEN 0 THEN strftime(l_shipdate, '%d-%b-%Y') WHEN 1 THEN strftime(l_shipdate, '%Y-%m-%d')
                    WHEN 2 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 3 THEN strftime(l_shipdate, '%d-%m-%Y')
                    ELSE 'soon' END AS text
        FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(coalesce(try_strptime(text, '%d-%b-%Y'), try_strptime(text, '%Y-%m-%d'),
                         try_strptime(text, '%d/%m/%Y'), try_strptime(text, '%d-%m-%Y')) AS DATE) AS parsed
    FROM written"""
)
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = F.col("l_linenumber") % 5
    day = F.col("l_shipdate").cast("date")
    written = (
        F.when(layout == 0, F.date_format(day, "dd-MMM-yyyy"))
        .when(layout == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(layout == 2, F.date_format(day, "dd/MM/yyyy"))
        .when(layout == 3, F.date_format(day, "dd-MM-yyyy"))
        .otherwise("soon")
    )
    return views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", values.parse_date(written).alias("parsed")
    )


@query(
    """
    SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN CASE WHEN value <> 0 THEN 1 ELSE 0 END
                          ELSE 0 END AS flag
    FROM events"""
)
def bool_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    written = F.when(kind == "click", " Yes ").when(kind == "error", F.col("value").cast("string")).otherwise("unsure")
    return views.table(spark, sf_dir, "events").select(
        "event_id", values.to_flag(written).cast("int").alias("flag")
    )


@query(
    views.with_views(
        "works",
        "payments",
        "totals",
        "completions",
        "projects",
        body="""
        SELECT project_id,
               round(coalesce(total_expenditure, amount_disbursed), 4) AS effective_spend,
               round(coalesce(CASE WHEN stage = 'F' THEN sanction_amount END, recommended_amount), 4) AS cost_amount,
               coalesce(CASE WHEN stage = 'P' THEN NULL ELSE work_status END, work_type) AS first_text,
               round(ln(1 + sanction_amount), 6) AS log_amount,
               least(greatest(sanction_amount, 100000), 200000) AS clipped,
               concat_ws('; ', CASE WHEN stage = 'F' THEN 'final' END, CASE WHEN total_expenditure > sanction_amount THEN 'over' END) AS labels,
               CASE WHEN stage = 'P' THEN '__missing__' ELSE work_category END AS category
        FROM projects""",
    )
)
def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("work_status") == "Work Completed"
    waiting = F.col("work_status") == "Vendor Identification"
    return views.projects(spark, sf_dir).select(
        "project_id",
        F.round(F.coalesce("total_expenditure", "amount_disbursed"), 4).alias("effective_spend"),
        F.round(F.coalesce(F.when(done, F.col("sanction_amount")), "recommended_amount"), 4).alias("cost_amount"),
        values.first_non_blank(F.when(waiting, F.lit("  ")).otherwise(F.col("work_status")), F.col("work_type")).alias(
            "first_text"
        ),
        F.round(F.log1p("sanction_amount"), 6).alias("log_amount"),
        values.clip(F.col("sanction_amount"), 100_000, 200_000).alias("clipped"),
        values.join_labels(
            [(done, F.lit("final")), (F.col("total_expenditure") > F.col("sanction_amount"), F.lit("over"))]
        ).alias("labels"),
        values.category(F.when(waiting, F.lit(" ")).otherwise(F.col("work_category"))).alias("category"),
    )


def raw_sanctioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works in the layout of a raw export: text cells, repeated rows, a footer."""
    source = views.works(spark, sf_dir)
    cells = {
        "serial_no": F.col("serial_no").cast("string"),
        "work": F.concat(F.replace("project_id", F.lit("WS/"), F.lit("WS/ ")), F.lit("-"), "work_type"),
        "work_description": F.concat(F.lit('A "quoted", '), "work_description", F.lit("\nsecond line ")),
        "recommended_date": F.date_format("recommended_date", "dd-MMM-yyyy"),
        "sanction_date": F.date_format("sanction_date", "dd-MMM-yyyy"),
        "sanction_amount": F.format_number("sanction_amount", 2),
    }
    rows = source.select(
        *[cells.get(name, F.col(name) if name in source.columns else F.lit(None)).alias(header) for header, name in SANCTIONED.items()],
        "stage",
    )
    repeated = rows.unionByName(rows.where("stage = 'P'")).drop("stage")
    total = source.agg(F.format_number(F.sum("sanction_amount"), 2).alias("total"))
    footer = total.select(
        *[
            (F.lit("Grand Total") if name == "serial_no" else F.col("total") if name == "sanction_amount" else F.lit(" ")).alias(header)
            for header, name in SANCTIONED.items()
        ]
    )
    return repeated.unionByName(footer)


LANDED = views.with_views(
    "works",
    body="""
    SELECT serial_no, project_id, work_category, state, district, ida, mp_name, constituency, work_type,
           'A "quoted", ' || work_description || 'second line' AS work_description,
           recommended_date, sanction_date, round(sanction_amount, 4) AS sanction_amount, work_status
    FROM works""",
)
LANDED_COLUMNS = (
    "serial_no",
    "project_id",
    "work_category",
    "state",
    "district",
    "ida",
    "mp_name",
    "constituency",
    "work_type",
    "work_description",
    "recommended_date",
    "sanction_date",
    "sanction_amount",
    "work_status",
)


@query(LANDED)
def csv_landing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw export written as CSV, read back with the landing schema and cleaned."""
    path = new_path(spark, "raw-sanctioned")
    write_csv(raw_sanctioned(spark, sf_dir), path)
    return ingest(spark, "sanctioned", path, multi_line=True).select(*LANDED_COLUMNS)


@query(LANDED)
def csv_landing_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same export with its columns in reverse order and one more column: headers decide."""
    path = new_path(spark, "raw-reordered")
    raw = raw_sanctioned(spark, sf_dir).withColumn("Remarks of the office", F.lit("n/a"))
    write_csv(raw.select(*[f"`{c}`" for c in reversed(raw.columns)]), path)
    return ingest(spark, "sanctioned", path, multi_line=True).select(*LANDED_COLUMNS)


@query(LANDED)
def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(raw_sanctioned(spark, sf_dir), "sanctioned").select(*LANDED_COLUMNS)


@query(views.with_views("works", body="SELECT count(*) AS rows, CAST(0 AS BIGINT) AS absent_rows FROM works"))
def optional_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source that is there next to one that is not."""
    absent = read_optional(spark, new_path(spark, "never-written"), landing_schema("completed"))
    here = views.works(spark, sf_dir).agg(F.count(F.lit(1)).alias("rows"))
    return with_row(here, absent.agg(F.count(F.lit(1)).alias("absent_rows")))
