"""Value normalization for typed rows and for VARIANT row images.

``typed`` (default) follows each column's declared type. ``compat`` also applies the older guesses:
every BIGINT is epoch milliseconds, and a time-like column name turns numbers into text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefeed.functions import instants, numbers, text

MODES = ("typed", "compat")


@dataclass(frozen=True)
class Field:
    """What a normalizer may look at besides the value."""

    name: str
    data_type: T.DataType
    mode: str = "typed"
    epoch_unit: str | None = None
    time_name: bool = False


Normalizer = Callable[[Column, Field], Column]


def _keep(value: Column, field: Field) -> Column:
    return value


def _instant(value: Column, field: Field) -> Column:
    return instants.iso_instant(value)


def _bigint(value: Column, field: Field) -> Column:
    if field.mode == "compat":
        return F.coalesce(instants.epoch_to_iso(value, "ms"), value.cast("string"))
    return _small_int(value, field)


def _small_int(value: Column, field: Field) -> Column:
    if field.mode == "compat":
        return value.cast("string") if field.time_name else value
    if field.epoch_unit:
        return F.coalesce(instants.epoch_to_iso(value, field.epoch_unit), value.cast("string"))
    return value


def _float(value: Column, field: Field) -> Column:
    if field.mode == "compat" and field.time_name:
        return value.cast("string")
    return numbers.normalize_float(value)


def _decimal(value: Column, field: Field) -> Column:
    if field.mode == "compat" and field.time_name:
        return value.cast("string")
    return numbers.normalize_decimal(value, field.data_type.scale)


def _boolean(value: Column, field: Field) -> Column:
    return value.cast("string") if field.mode == "compat" and field.time_name else value


def _string(value: Column, field: Field) -> Column:
    if field.mode == "compat":
        parsed = F.coalesce(instants.parse_time_string(value), value)
        if field.time_name:
            return parsed
        return F.when(instants.looks_like_time(value), parsed).otherwise(text.valid_utf8(value))
    if field.time_name:
        parsed = instants.parse_time_string(value, spaced=True, any_integer=False)
        return F.coalesce(parsed, text.valid_utf8(value))
    return text.valid_utf8(value)


def _binary(value: Column, field: Field) -> Column:
    return text.decode_bytes(value)


_NORMALIZERS: dict[str, Normalizer] = {
    "timestamp": _instant,
    "timestamp_ntz": _instant,
    "date": _instant,
    "bigint": _bigint,
    "int": _small_int,
    "smallint": _small_int,
    "tinyint": _small_int,
    "float": _float,
    "double": _float,
    "decimal": _decimal,
    "boolean": _boolean,
    "string": _string,
    "binary": _binary,
}


def register_normalizer(type_name: str, normalizer: Normalizer) -> None:
    """Use ``normalizer`` for a Spark type (``bigint``, ``decimal``, ``array``, ...)."""
    _NORMALIZERS[type_name] = normalizer


def _type_name(data_type: T.DataType) -> str:
    return data_type.simpleString().split("(")[0].split("<")[0]


def _is_time_name(name: str) -> bool:
    # Python writes \Z for the end of text where Spark writes \z
    return re.search(instants.TIME_NAME_PATTERN.replace(r"\z", r"\Z"), name.lower()) is not None


def normalize_column(
    value: Column, name: str, data_type: T.DataType, mode: str = "typed", epoch_unit: str | None = None
) -> Column:
    """One normalized column; types without a normalizer (arrays, structs, maps) pass unchanged."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {mode!r}")
    field = Field(name, data_type, mode, epoch_unit, _is_time_name(name))
    return _NORMALIZERS.get(_type_name(data_type), _keep)(value, field)


def normalize_frame(
    df: DataFrame,
    mode: str = "typed",
    epoch_units: Mapping[str, str] | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Normalize every column of a typed table in one projection.

    ``epoch_units`` declares whole-number columns that hold instants; ``keep`` names columns to
    leave alone. DECIMAL, FLOAT and DOUBLE columns become VARIANT, as their JSON type depends on the value.
    """
    units = epoch_units or {}
    return df.select(
        *[
            F.col(f"`{f.name}`")
            if f.name in keep
            else normalize_column(F.col(f"`{f.name}`"), f.name, f.dataType, mode, units.get(f.name)).alias(f.name)
            for f in df.schema.fields
        ]
    )


def _image_decimal(value: Column) -> Column:
    """A JSON number that is no plain integer. Its scale is that of its text, not of a declared column.

    Up to 15 characters always fit a double; longer ones are compared digit by digit, whatever their length.
    """
    digits = value.cast("string")
    double = value.try_cast("double")
    whole = digits.try_cast("bigint")
    has_point, short = digits.contains("."), F.length(digits) <= 15
    return (
        F.when(has_point & short, double.cast("variant"))
        .when(~has_point & whole.between(-numbers.MAX_SAFE_INTEGER, numbers.MAX_SAFE_INTEGER), whole.cast("variant"))
        .when(numbers.same_number(double.cast("string"), digits), double.cast("variant"))
        .otherwise(digits.cast("variant"))
    )


# kinds of values that a VARIANT tells apart, and the Spark type that their normalizer is registered for
_IMAGE_KINDS: dict[str, tuple[str, T.DataType]] = {
    "BIGINT": ("bigint", T.LongType()),
    "STRING": ("string", T.StringType()),
    "DOUBLE": ("double", T.DoubleType()),
    "FLOAT": ("float", T.FloatType()),
    "BOOLEAN": ("boolean", T.BooleanType()),
    "DATE": ("date", T.DateType()),
    "TIMESTAMP": ("timestamp", T.TimestampType()),
    "TIMESTAMP_NTZ": ("timestamp_ntz", T.TimestampNTZType()),
    "BINARY": ("binary", T.BinaryType()),
}


def _image_value(name: Column, value: Column, type_name: str, data_type: T.DataType, mode: str) -> Column | None:
    """A value of one kind through the normalizer of its type; None where that changes nothing."""
    normalizer, typed = _NORMALIZERS.get(type_name, _keep), value.try_cast(type_name)
    plain, timed = (normalizer(typed, Field("", data_type, mode, None, flag)) for flag in (False, True))
    if plain is typed and timed is typed:
        return None
    if mode == "typed" and type_name != "string":  # names count for text only
        return plain.cast("variant")
    return F.when(instants.is_time_name(name), timed.cast("variant")).otherwise(plain.cast("variant"))


def normalize_image(
    image: Column, epoch_units: Mapping[str, str] | None = None, mode: str = "typed", types: Mapping[str, str] | None = None
) -> Column:
    """Normalize the fields of a VARIANT row image, each by the kind of its value, with the normalizers that columns have.

    A JSON number does not tell INT from BIGINT: in ``compat`` mode, where it matters, ``types`` names the columns that are narrower (``{"age": "int"}``).
    A NULL image stays NULL, so an absent image is never taken for an empty row. Objects and arrays pass unchanged.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}: {mode!r}")
    narrow = [column for column, type_name in (types or {}).items() if type_name in ("int", "smallint", "tinyint")]

    def one(name: Column, value: Column) -> Column:
        kind = F.schema_of_variant(value)
        as_text = value.try_cast("string")
        result = F.when(kind.isNull() | (kind == "VOID"), value)
        if mode == "typed":
            for column, unit in (epoch_units or {}).items():
                iso = instants.epoch_to_iso(value.try_cast("bigint"), unit)
                result = result.when((kind == "BIGINT") & (name == column), F.coalesce(iso, as_text).cast("variant"))
        elif narrow:
            small = _image_value(name, value, "int", T.IntegerType(), mode)
            result = result.when((kind == "BIGINT") & name.isin(narrow), value if small is None else small)
        for variant_kind, (type_name, data_type) in _IMAGE_KINDS.items():
            changed = _image_value(name, value, type_name, data_type, mode)
            if changed is not None:
                result = result.when(kind == variant_kind, changed)
        own = _NORMALIZERS["decimal"]
        decimal = _image_decimal(value) if own is _decimal else own(value.try_cast("decimal(38,18)"), Field("", T.DecimalType(38, 18), mode)).cast("variant")
        if mode == "compat":
            decimal = F.when(instants.is_time_name(name), as_text.cast("variant")).otherwise(decimal)
        return result.when(kind.startswith("DECIMAL"), decimal).otherwise(value)

    fields = image.try_cast("map<string,variant>")
    return F.to_variant_object(F.transform_values(fields, one))
