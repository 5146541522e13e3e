"""Dates as archives write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, stripped

#: What an ISO date looks like, and the other formats, in the order in which they are tried.
ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?$"
BASIC = r"^\d{8}$"
RFC = r"^(?:[A-Za-z]{3},\s*)?\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}(?::\d{2})?(?: (?:[+-]\d{4}|GMT|UTC|Z))?$"
FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]+ \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
)


def _if(text: Column, pattern: str) -> Column:
    return F.when(F.rlike(text, F.lit(pattern)), text)


def parsed_date(value: Column | str) -> Column:
    """A timestamp in UTC, or null: ISO 8601, then RFC 2822, then the formats in turn; without a zone UTC is meant. Never fails."""
    text = stripped(_col(value))
    iso = F.replace(F.replace(_if(text, ISO), F.lit("Z"), F.lit("+00:00")), F.lit(","), F.lit("."))
    rfc = F.regexp_replace(F.regexp_replace(F.regexp_replace(_if(text, RFC), r"^[A-Za-z]{3},\s*", ""), "(GMT|UTC|Z)$", "+0000"), r"(?<![:\d])(\d{2}:\d{2})( |$)", "$1:00$2")
    rfc = F.when(F.rlike(rfc, F.lit(r"[+-]\d{4}$")), rfc).otherwise(F.concat(rfc, F.lit(" +0000")))
    tries = [F.try_to_timestamp(iso), F.try_to_timestamp(_if(text, BASIC), F.lit("yyyyMMdd")), F.try_to_timestamp(F.initcap(rfc), F.lit("d MMM yyyy HH:mm:ss Z"))]
    tries += [F.try_to_timestamp(F.initcap(_if(text, p)), F.lit(f)) for p, f in FORMATS]
    return F.coalesce(*tries)


def iso_date(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd")


def header_date(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss")
