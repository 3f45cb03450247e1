"""Dates and times as ISO-8601 text in UTC.

Text has 0, 3, 6 or 9 fractional digits, whichever is the fewest that loses nothing. All functions
need a session zone of UTC (``changefeed.session.configure``) when the input is a TIMESTAMP.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A column is taken for a time by its lower-case name.
TIME_NAME_PATTERN = r"time|date|timestamp|_at\z|_on\z|\A(created|updated|modified)\z"

EPOCH_UNITS = ("s", "ms", "us", "ns", "days")

# An instant has seconds and a zone; a local date-time may lack both. The second form is set with a space.
_ISO_FORM = r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?([Zz]|[+-]\d{2}:\d{2}(:\d{2})?)?)?"
_SPACED_FORM = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,9})?"


def is_time_name(name: Column) -> Column:
    return F.lower(name).rlike(TIME_NAME_PATTERN)


def looks_like_time(text: Column) -> Column:
    return (
        text.contains("T")
        | (text.contains("-") & text.contains(":"))
        | text.rlike(r"\A\d{10,13}\z")
    )


def iso_instant(value: Column) -> Column:
    """DATE, TIMESTAMP_NTZ or TIMESTAMP as ISO text; a date is the start of its day."""
    at = value.cast("timestamp")
    micros = F.unix_micros(at)
    return (
        F.when(at.isNull(), F.lit(None).cast("string"))
        .when(micros % 1_000_000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(micros % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    )


def _within(value: Column, limit: int) -> Column:
    return F.when(value.between(-limit, limit), value)


def epoch_to_iso(value: Column, unit: str = "ms") -> Column:
    """Whole-number epoch value as ISO text; NULL outside Spark's timestamp range."""
    value = value.cast("bigint")
    if unit == "ms":
        return iso_instant(F.timestamp_millis(_within(value, 9223372036854775)))
    if unit == "us":
        return iso_instant(F.timestamp_micros(value))
    if unit == "s":
        return iso_instant(F.timestamp_seconds(_within(value, 9223372036854)))
    if unit == "days":
        return iso_instant(F.date_from_unix_date(_within(value, 2932896).cast("int")))
    if unit == "ns":
        nanos = F.pmod(value, F.lit(1_000_000_000))
        seconds = F.timestamp_seconds(F.call_function("div", value - nanos, F.lit(1_000_000_000)))
        return _with_fraction(seconds, F.lpad(nanos.cast("string"), 9, "0"))
    raise ValueError(f"epoch unit must be one of {EPOCH_UNITS}: {unit!r}")


def _with_fraction(whole_seconds: Column, nine_digits: Column) -> Column:
    """ISO text of a whole second plus a fraction given as nine digits."""
    base = F.translate(whole_seconds.cast("timestamp_ntz").cast("string"), " ", "T")
    fraction = (
        F.when(nine_digits == "000000000", F.lit(""))
        .when(nine_digits.endswith("000000"), F.concat(F.lit("."), F.substring(nine_digits, 1, 3)))
        .when(nine_digits.endswith("000"), F.concat(F.lit("."), F.substring(nine_digits, 1, 6)))
        .otherwise(F.concat(F.lit("."), nine_digits))
    )
    return F.concat(base, fraction, F.lit("Z"))


def _parse_written(text: Column, forms: str) -> Column:
    """Text of one of ``forms`` as ISO text in UTC; the digits below a microsecond are kept."""
    at = F.upper(text).try_cast("timestamp")
    nanos = F.rpad(F.regexp_extract(text, r"\.(\d{7,9})", 1), 9, "0")
    precise = _with_fraction(F.date_trunc("second", at), nanos)
    return F.when(
        text.rlike(rf"\A(?:{forms})\z"),
        F.when(text.rlike(r"\.\d{7}") & at.isNotNull(), precise).otherwise(iso_instant(at)),
    )


def parse_time_string(text: Column, spaced: bool = False, any_integer: bool = True) -> Column:
    """ISO text for text that holds an instant, a local date-time (UTC) or epoch ms; else NULL.

    ``spaced`` also takes ``2025-11-01 10:30:00``. ``any_integer=False`` takes whole numbers only
    with 10 to 13 digits.
    """
    whole = r"\A[+-]?\d{1,19}\z" if any_integer else r"\A\d{10,13}\z"
    epoch = F.when(text.rlike(whole), epoch_to_iso(text.try_cast("bigint")))
    return F.coalesce(_parse_written(text, f"{_ISO_FORM}|{_SPACED_FORM}" if spaced else _ISO_FORM), epoch)
