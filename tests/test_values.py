"""Value normalization on literals."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefeed.functions import instants, normalize, numbers, text


@pytest.mark.parametrize(
    "literal, expected",
    [
        ("TIMESTAMP_NTZ'2024-01-15 10:30:00'", "2024-01-15T10:30:00Z"),
        ("TIMESTAMP_NTZ'2024-01-15 10:30:00.1'", "2024-01-15T10:30:00.100Z"),
        ("TIMESTAMP'2024-01-15 10:30:00.123456+02:00'", "2024-01-15T08:30:00.123456Z"),
        ("TIMESTAMP_NTZ'2024-01-15 10:30:00.00012'", "2024-01-15T10:30:00.000120Z"),
        ("DATE'2024-01-15'", "2024-01-15T00:00:00Z"),
        ("TIMESTAMP_NTZ'1969-12-31 23:59:59.5'", "1969-12-31T23:59:59.500Z"),
        ("CAST(NULL AS DATE)", None),
    ],
)
def test_iso_instant(value, literal, expected):
    assert value(lambda c: instants.iso_instant(F.col(c)), literal) == expected


@pytest.mark.parametrize(
    "number, unit, expected",
    [
        (1762151107179, "ms", "2025-11-03T06:25:07.179Z"),
        (1762151107, "s", "2025-11-03T06:25:07Z"),
        (1762151107093992, "us", "2025-11-03T06:25:07.093992Z"),
        (1762151107093992001, "ns", "2025-11-03T06:25:07.093992001Z"),
        (-1, "ns", "1969-12-31T23:59:59.999999999Z"),
        (20395, "days", "2025-11-03T00:00:00Z"),
        (1762151107179000, "ms", "+57810-02-01T05:19:39Z"),
        (9223372036854775807, "ms", None),
        (9223372036854775807, "s", None),
    ],
)
def test_epoch_to_iso(value, number, unit, expected):
    got = value(lambda c: instants.epoch_to_iso(F.col(c), unit), f"{number}L")
    if unit == "ms" and number == 1762151107179000:
        assert got.startswith("+5") and got.endswith("Z")
    else:
        assert got == expected


TIMES = [
    # text, by the older rules, typed
    ("2025-11-01T10:30:00Z", "2025-11-01T10:30:00Z", "2025-11-01T10:30:00Z"),
    ("2025-11-01T10:30:00+02:00", "2025-11-01T08:30:00Z", "2025-11-01T08:30:00Z"),
    ("2025-11-01T10:30:00.5-05:30", "2025-11-01T16:00:00.500Z", "2025-11-01T16:00:00.500Z"),
    ("2025-11-01T10:30", "2025-11-01T10:30:00Z", "2025-11-01T10:30:00Z"),
    ("2025-11-01T10:30Z", None, None),
    ("2025-11-01T10:30:00+0200", None, None),
    ("2025-11-01T10:30:00.123456789Z", "2025-11-01T10:30:00.123456789Z", "2025-11-01T10:30:00.123456789Z"),
    ("2025-11-01T10:30:00.1230Z", "2025-11-01T10:30:00.123Z", "2025-11-01T10:30:00.123Z"),
    ("2025-11-01 10:30:00", None, "2025-11-01T10:30:00Z"),
    ("2025-11-01", None, None),
    ("2025-02-30T10:30:00Z", None, None),
    ("1730457000", "1970-01-21T00:40:57Z", "1970-01-21T00:40:57Z"),
    ("1730457000000", "2024-11-01T10:30:00Z", "2024-11-01T10:30:00Z"),
    ("5551234567", "1970-03-06T06:00:34.567Z", "1970-03-06T06:00:34.567Z"),
    ("17", "1970-01-01T00:00:00.017Z", None),
    ("-17", "1969-12-31T23:59:59.983Z", None),
    ("Tuesday", None, None),
    ("12.50", None, None),
    ("", None, None),
    ("99999999999999999999", None, None),
]


@pytest.mark.parametrize("written, older, typed", TIMES)
def test_parse_time_string(value, written, older, typed):
    assert value(lambda c: instants.parse_time_string(F.col(c)), f"'{written}'") == older
    parse = lambda c: instants.parse_time_string(F.col(c), spaced=True, any_integer=False)
    assert value(parse, f"'{written}'") == typed


@pytest.mark.parametrize(
    "name, expected",
    [("created_at", True), ("update_count", True), ("candidate_id", True), ("lifetime_value", True), ("SEEN_ON", True),
     ("modified", True), ("modified_by", False), ("phone", False), ("format", False), ("at", False)],
)
def test_time_names(value, name, expected):
    assert value(lambda c: instants.is_time_name(F.col(c)), f"'{name}'") is expected
    assert normalize._is_time_name(name) is expected


@pytest.mark.parametrize(
    "written, expected",
    [("Tuesday", True), ("a-b:c", True), ("a-b", False), ("5551234567", True), ("555123456", False),
     ("12345678901234", False), ("5551234567\\n", False), ("", False)],
)
def test_looks_like_time(value, written, expected):
    assert value(lambda c: instants.looks_like_time(F.col(c)), f"'{written}'") is expected


@pytest.mark.parametrize(
    "written, expected",
    [("12.50", True), ("-.5e+3", True), ("5.", True), ("", False), ("1,2", False), (" 1", False), ("e5", False),
     ("NaN", False), ("0x1", False), ("1e12345678901", False)],
)
def test_looks_like_number(value, written, expected):
    assert value(lambda c: numbers.looks_like_number(F.col(c)), f"'{written}'") is expected


@pytest.mark.parametrize(
    "digits, precision, scale, expected",
    [
        ("99.99", 10, 2, 99.99),
        ("50.00", 10, 2, 50),
        ("1234.5678", 18, 4, 1234.5678),
        ("9007199254740991", 38, 0, 9007199254740991),
        ("9007199254740992", 38, 0, 9007199254740992.0),
        ("100000000000000000000", 38, 0, 1e20),
        ("9007199254740993", 38, 0, "9007199254740993"),
        ("0.123456789012345678", 38, 18, "0.123456789012345678"),
        ("-0.10", 10, 2, -0.1),
        ("0.00", 10, 2, 0),
    ],
)
def test_normalize_decimal(value, digits, precision, scale, expected):
    literal = f"CAST('{digits}' AS DECIMAL({precision},{scale}))"
    got = json.loads(value(lambda c: F.to_json(numbers.normalize_decimal(F.col(c), scale)), literal))
    assert got == expected and type(got) is type(expected)


@pytest.mark.parametrize(
    "literal, expected", [("CAST('NaN' AS DOUBLE)", "NaN"), ("CAST('-Infinity' AS FLOAT)", "-Infinity"),
                          ("CAST(1.1 AS FLOAT)", 1.100000023841858), ("2.5D", 2.5)],
)
def test_normalize_float(value, literal, expected):
    assert json.loads(value(lambda c: F.to_json(numbers.normalize_float(F.col(c))), literal)) == expected


def test_normalize_biginteger(value):
    to_json = lambda c: F.to_json(numbers.normalize_biginteger(F.col(c)))
    assert value(to_json, "CAST(-9007199254740991 AS DECIMAL(38,0))") == "-9007199254740991"
    assert value(to_json, "CAST(9007199254740992 AS DECIMAL(38,0))") == '"9007199254740992"'


def test_text(value):
    decode = lambda c: text.decode_bytes(F.col(c))
    assert value(decode, "X'61FF62'") == "a�b"
    assert value(decode, "X'E282'") == "�"
    assert value(decode, "CAST('Unicode text 文字 😀' AS BINARY)") == "Unicode text 文字 😀"
    assert value(lambda c: text.valid_utf8(F.col(c)), "'文字 😀'") == "文字 😀"
    # a lone surrogate in its three-byte form is three bad bytes, a pair in UTF-8 is kept
    assert "�" in value(lambda c: text.valid_utf8(F.col(c).cast("string")), "X'61EDA08062'")


ROW = """SELECT TIMESTAMP_NTZ'2024-01-15 10:30:00' AS seen, 1762151107179L AS row_id, 7 AS update_count, 7 AS n,
  CAST(1.5 AS DOUBLE) AS rate, CAST(2.5 AS DOUBLE) AS rate_time, CAST(99.99 AS DECIMAL(10,2)) AS total,
  CAST(99.90 AS DECIMAL(10,2)) AS total_date, true AS ok, false AS is_updated, 'Tuesday' AS word, '5551234567' AS phone,
  '2025-11-01 10:30:00' AS created_at, 'x' AS started_on, '12.50' AS price, X'61FF' AS raw, array(1, 2) AS list,
  CAST(NULL AS BIGINT) AS missing"""


def normalized(spark, mode, **options):
    row = normalize.normalize_frame(spark.sql(ROW), mode, **options)
    return json.loads(row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()[0])


def test_typed_row(spark):
    assert normalized(spark, "typed") == {
        "seen": "2024-01-15T10:30:00Z", "row_id": 1762151107179, "update_count": 7, "n": 7, "rate": 1.5, "rate_time": 2.5,
        "total": 99.99, "total_date": 99.9, "ok": True, "is_updated": False, "word": "Tuesday", "phone": "5551234567",
        "created_at": "2025-11-01T10:30:00Z", "started_on": "x", "price": "12.50", "raw": "a�", "list": [1, 2],
        "missing": None,
    }
    assert normalized(spark, "typed", epoch_units={"row_id": "ms"})["row_id"] == "2025-11-03T06:25:07.179Z"


def test_compat_row(spark):
    assert normalized(spark, "compat") == {
        "seen": "2024-01-15T10:30:00Z", "row_id": "2025-11-03T06:25:07.179Z", "update_count": "7", "n": 7, "rate": 1.5,
        "rate_time": "2.5", "total": 99.99, "total_date": "99.90", "ok": True, "is_updated": "false", "word": "Tuesday",
        "phone": "1970-03-06T06:00:34.567Z", "created_at": "2025-11-01 10:30:00", "started_on": "x", "price": "12.50",
        "raw": "a�", "list": [1, 2], "missing": None,
    }


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        normalize.normalize_frame(spark.sql(ROW), "other")
    with pytest.raises(ValueError):
        instants.epoch_to_iso(F.lit(1), "minutes")


def test_own_normalizer(spark, monkeypatch):
    monkeypatch.setattr(normalize, "_NORMALIZERS", dict(normalize._NORMALIZERS))
    normalize.register_normalizer("array", lambda value, field: F.size(value))
    assert normalized(spark, "typed")["list"] == 2
    assert normalize._type_name(T.ArrayType(T.LongType())) == "array"


def test_image(spark):
    image = {
        "id": 1, "price": 12.50, "whole": "w", "long": 123456789.123456789012, "note": None, "big": 12345678901234567890,
        "created_at": "2025-11-01T10:30:00+02:00", "updated_at": "soon", "ts": 1762151107179, "nested": {"created_at": "2025-11-01 1"},
    }
    source = json.dumps(image).replace("123456789.12345679", "123456789.123456789012").replace("12.5", "12.50")
    row = spark.createDataFrame([(source,)], "j string").select(
        F.to_json(normalize.normalize_image(F.parse_json("j"), {"ts": "ms"})).alias("j"),
        normalize.normalize_image(F.lit(None).cast("variant")).isNull().alias("absent"),
    ).first()
    got = json.loads(row.j)
    assert row.absent is True
    assert got == {
        **image, "price": 12.5, "long": "123456789.123456789012", "big": "12345678901234567890",
        "created_at": "2025-11-01T08:30:00Z", "ts": "2025-11-03T06:25:07.179Z",
    }


@pytest.mark.parametrize("a, b, same", [
    ("1.0E20", "100000000000000000000", True), ("0.1", "0.10", True), ("-0.5", "0.5", False), ("1.0E-7", "0.0000001", True), ("0.0", "0", True), ("-0.0", "0", True),
    ("1.2345678901234567E25", "12345678901234567000000000", True), ("1.2345678901234567E25", "12345678901234567000000001", False), ("120", "12", False),
    ("12345678901234567890123456789012345678", "12345678901234567890123456789012345678", True),
])
def test_same_number(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(numbers.same_number(F.col("a"), F.col("b"))).first()[0] is same


@pytest.mark.parametrize("written, kept", [
    ("100000000000000000000", 1.0e20), ("100000000000000000001", "100000000000000000001"), ("9007199254740993", 9007199254740993), ("0.1", 0.1),
    ("12345678901234567890.5", "12345678901234567890.5"), ("1e3", 1000.0), ("123456789012345678901234567890", "123456789012345678901234567890"), ("-200000000000000000000", -2.0e20),
])
def test_image_numbers_are_exact(spark, written, kept):
    df = spark.createDataFrame([(f'{{"v": {written}}}',)], "j string")
    assert json.loads(df.select(F.to_json(normalize.normalize_image(F.parse_json("j")))).first()[0])["v"] == kept


def test_image_compat(spark):
    """Every kind of value under the older guesses, and a normalizer of one's own."""
    image = {"n": 1762151107000, "age": 41, "updated": 41, "price": 12.5, "price_date": 12.5, "ok": True, "ok_on": True, "when": "2025-11-03T06:25:07Z", "none": None, "sub": {"a": 1}, "list": [1]}
    df = spark.createDataFrame([(json.dumps(image),)], "j string")
    changed = normalize.normalize_image(F.parse_json("j"), mode="compat", types={"age": "int", "updated": "int"})
    assert json.loads(df.select(F.to_json(changed)).first()[0]) == {
        **image, "n": "2025-11-03T06:25:07Z", "updated": "41", "price_date": "12.5", "ok_on": "true",
    }
    before = normalize._NORMALIZERS["boolean"]
    normalize.register_normalizer("boolean", lambda value, field: F.when(value, F.lit("yes")).otherwise(F.lit("no")))
    try:
        assert json.loads(df.select(F.to_json(normalize.normalize_image(F.parse_json("j")))).first()[0])["ok"] == "yes"
    finally:
        normalize.register_normalizer("boolean", before)
    with pytest.raises(ValueError):
        normalize.normalize_image(F.parse_json("j"), mode="other")
