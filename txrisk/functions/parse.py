"""Scalar parsing as Column expressions: bodies, fields, civil time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.schema import REQUEST


def strict_body(body: Column) -> Column:
    """Whether a body may be scored: two characters at least, the first an opening brace, and JSON."""
    return F.coalesce((F.length(body) >= 2) & F.startswith(body, F.lit("{")), F.lit(False))


def loose_body(body: Column) -> Column:
    """The telemetry's looser test, which skips leading white space."""
    return F.coalesce(F.regexp_like(body, F.lit("^[ \\t\\r\\n]*\\{")), F.lit(False))


def payload(body: Column) -> Column:
    """The request of a JSON body; null where the body is not an object.

    Unknown keys are ignored and missing ones null.  Numbers may have exponents, and only exact key
    names count.
    """
    return F.when(strict_body(body) & F.try_parse_json(body).isNotNull(), F.from_json(body, REQUEST))


def number(value: Column) -> Column:
    return F.coalesce(value.cast("double"), F.lit(0.0))


def flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(False))


def _stamp(text: Column, least: int) -> Column:
    return (F.length(text) >= least) & (F.substring(text, 11, 1) == "T")


def _day(text: Column) -> Column:
    return F.substring(text, 1, 10).try_cast("date")


def _two(text: Column, at: int) -> Column:
    return F.substring(text, at, 2).try_cast("int")


def hour(text: Column) -> Column:
    """Hour as written, whatever the offset; 0 if there is none."""
    return F.coalesce(F.when(_stamp(text, 13), _two(text, 12)), F.lit(0))


def weekday(text: Column) -> Column:
    """Monday 0 to Sunday 6; 0 for an impossible date."""
    return F.coalesce(F.when(_stamp(text, 13), F.weekday(_day(text))), F.lit(0))


def epoch_seconds(text: Column) -> Column:
    """Seconds since 1970 of the civil time as written; fractions and offsets are ignored, 0 if invalid."""
    days = F.datediff(_day(text), F.lit("1970-01-01").cast("date")).cast("bigint")
    clock = _two(text, 12) * 3600 + _two(text, 15) * 60 + _two(text, 18)
    return F.coalesce(F.when(_stamp(text, 19), days * 86_400 + clock), F.lit(0).cast("bigint"))


def instant(text: Column) -> Column:
    """Strict RFC 3339 with its offset; null if invalid.  Not used by scoring."""
    shape = "^\\d{4}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\d(\\.\\d+)?(Z|[+-]\\d\\d:\\d\\d)$"
    return F.when(F.regexp_like(text, F.lit(shape)), F.try_to_timestamp(text))
