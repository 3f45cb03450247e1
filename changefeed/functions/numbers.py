"""Numbers as JSON can hold them without loss: a safe integer, an exact double, or text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the largest integer that a JSON reader keeps exactly, 2^53 - 1.
MAX_SAFE_INTEGER = 9007199254740991

# The exponent may have at most ten digits, as in arbitrary-precision decimal text.
NUMBER_PATTERN = r"\A[+-]?(\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)([eE][+-]?\p{Nd}{1,10})?\z"


def looks_like_number(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)


def _as_long(value: Column) -> Column:
    """The value if it is whole and safe, else NULL."""
    whole = value.try_cast("bigint")
    return F.when(whole.between(-MAX_SAFE_INTEGER, MAX_SAFE_INTEGER) & (whole == value), whole)


def _as_double(value: Column, scale: int) -> Column:
    """The value as a double if its shortest text is the value, else NULL. Up to 15 digits it always is."""
    double = value.cast("double")
    always = F.lit(False) if scale > 15 else F.abs(value) < F.lit(10 ** (15 - scale))
    shortest = double.cast("string").try_cast(f"decimal(38,{scale})")
    return F.when(always, double).when(shortest == value, double)


def _significand(text: Column) -> Column:
    """The digits of a number written in text, without zeros at the ends, and the power of ten of the first of them; equal for equal numbers of any length."""
    part = [F.regexp_extract(text, r"\A[+-]?([0-9]*)\.?([0-9]*)(?:[eE]\+?(-?[0-9]+))?\z", i) for i in (1, 2, 3)]
    digits = F.concat(part[0], part[1])
    plain = F.regexp_replace(digits, r"\A0+", "")
    power = F.length(part[0]) - (F.length(digits) - F.length(plain)) + F.coalesce(part[2].try_cast("int"), F.lit(0))
    return F.struct(F.regexp_replace(plain, r"0+\z", "").alias("digits"), F.when(plain != "", power).otherwise(0).alias("power"))


def same_number(a: Column, b: Column) -> Column:
    """Whether two texts write the same number, digit by digit, however many they have."""
    zero = (_significand(a)["digits"] == "") & (_significand(b)["digits"] == "")
    return zero | ((_significand(a) == _significand(b)) & (a.startswith("-") == b.startswith("-")))


def decimal_kind(value: Column, scale: int) -> Column:
    """'long', 'double' or 'string' for DECIMAL(p, ``scale``)."""
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(_as_long(value).isNotNull(), F.lit("long"))
        .when(_as_double(value, scale).isNotNull(), F.lit("double"))
        .otherwise(F.lit("string"))
    )


def normalize_decimal(value: Column, scale: int) -> Column:
    """DECIMAL as VARIANT: BIGINT, DOUBLE or the plain digits as STRING."""
    return F.coalesce(
        _as_long(value).cast("variant"), _as_double(value, scale).cast("variant"), value.cast("string").cast("variant")
    )


def biginteger_kind(value: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(value.between(-MAX_SAFE_INTEGER, MAX_SAFE_INTEGER), F.lit("long"))
        .otherwise(F.lit("string"))
    )


def normalize_biginteger(value: Column) -> Column:
    """DECIMAL(p, 0) as VARIANT: BIGINT in the safe range, else STRING."""
    kind = biginteger_kind(value)
    return F.when(kind == "long", value.try_cast("bigint").cast("variant")).when(
        kind == "string", value.cast("string").cast("variant")
    )


def is_special_float(value: Column) -> Column:
    wide = value.cast("double")
    return F.isnan(wide) | (F.abs(wide) == float("inf"))


def normalize_float(value: Column) -> Column:
    """FLOAT or DOUBLE as VARIANT: DOUBLE, or the text NaN, Infinity, -Infinity."""
    wide = value.cast("double")
    return (
        F.when(wide.isNull(), F.lit(None).cast("variant"))
        .when(is_special_float(wide), wide.cast("string").cast("variant"))
        .otherwise(wide.cast("variant"))
    )
