"""Project keys and the fields that travel inside work and agency texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from worklens.functions.values import blank_to_null, strip

# Shape of a project key inside the exports.
PROJECT_KEY = r"WS/\s*MP\d+/\d{4}-\d{4}/\d+"
PROJECT_KEY_LENIENT = r"(?i)WS/?\s*MP\d+/\d{4}-\d{4}/\d+"


def without_spaces(column: Column) -> Column:
    return F.regexp_replace(column, r"\s+", "")


def project_key(work: Column) -> Column:
    """First key found in the work text, white space removed; NULL when there is none."""
    return F.nullif(without_spaces(F.regexp_extract(work, f"({PROJECT_KEY})", 1)), F.lit(""))


def project_key_from_id(work_id: Column) -> Column:
    return F.nullif(without_spaces(work_id), F.lit(""))


def lenient_key(value: Column) -> Column:
    """Key anywhere in the text in any case, else the trimmed text; NULL when blank."""
    found = F.try_element_at(F.regexp_extract_all(value, F.lit(f"({PROJECT_KEY_LENIENT})")), F.lit(1))
    return F.coalesce(without_spaces(found), blank_to_null(strip(value)))


def work_type(work: Column) -> Column:
    """Work text without its key."""
    return blank_to_null(strip(F.regexp_replace(work, PROJECT_KEY + r"\s*-?\s*", "")))


def district(agency: Column) -> Column:
    """Upper-case text before the first bracket of the agency name."""
    return blank_to_null(F.upper(strip(F.substring_index(agency, "(", 1))))
