"""Strings, dates, JSON and numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def source_date(v) -> Column:
    """Milliseconds above 10^10, else yyyymmdd; NULL if neither."""
    v = _c(v)
    return F.when(v > 10_000_000_000, F.to_date(F.timestamp_millis(v))).otherwise(F.try_to_date(v.cast("string"), "yyyyMMdd"))


def first_date(text) -> Column:
    """The first ISO date in a text, else the first of January of the first year 20yy, else NULL."""
    text = _c(text)
    iso = F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), "yyyy-MM-dd")
    year = F.nullif(F.regexp_extract(text, r"(20\d{2})", 1), F.lit(""))
    return F.coalesce(iso, F.try_to_date(F.concat(year, F.lit("-01-01")), "yyyy-MM-dd"))


def quarter_label(day) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit(" Q"), F.quarter(day).cast("string"))


def month_label(day, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return F.concat_ws(" ", F.element_at(table, F.month(day)), F.year(day).cast("string"))


def timestamp(text) -> Column:
    """ISO; without a zone it is UTC; NULL if unreadable."""
    return F.try_to_timestamp(_c(text))


def safe_label(text, default: str) -> Column:
    """Letters and digits, anything else a single underscore; letters with marks lose them."""
    plain = F.translate(_c(text), "àâäáãçéèêëíìîïñóòôöõúùûüÀÂÄÁÃÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜ", "aaaaaceeeeiiiinooooouuuuAAAAACEEEEIIIINOOOOOUUUU")
    ascii_only = F.regexp_replace(plain, r"[^\x00-\x7F]", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), F.lit("")), F.lit(default))


def service_name(release) -> Column:
    """World imagery service of a release id WB_yyyy_Rnn; an error for any other id."""
    year, number = F.regexp_extract(_c(release), r"^WB_(\d{4})_R(\d{2})$", 1), F.regexp_extract(_c(release), r"^WB_(\d{4})_R(\d{2})$", 2)
    return F.when(year == "", F.raise_error(F.concat(F.lit("not a release id: "), _c(release)))).otherwise(F.concat(F.lit("metadata_"), year, F.lit("_r"), number))


def fill_template(template: str, values: dict) -> Column:
    """{name} by value."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), _c(value).cast("string"))
    return out


def lenient_double(text, kind) -> Column:
    """Numbers and numeric text; booleans are none. kind: the JSON type."""
    return F.when(_c(kind) != "boolean", F.trim(_c(text)).try_cast("double"))


def human_bytes(n) -> Column:
    """One decimal place, halves to the even digit."""
    n = _c(n)
    scaled = lambda k, unit: F.concat(F.bround(n / 1024**k, 1).cast("string"), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, " KB")).when(n < 1024**3, scaled(2, " MB")).otherwise(scaled(3, " GB"))


def job_stage(progress) -> Column:
    """By the fraction done."""
    p = _c(progress)
    return F.when(p < 0.35, "imagery").when(p < 0.65, "inference").when(p < 0.8, "vector").when(p < 0.92, "export").otherwise("finalise")


def job_percent(progress) -> Column:
    return F.greatest(F.lit(25), F.least(F.lit(92), F.bround(_c(progress) * 100))).cast("int")
