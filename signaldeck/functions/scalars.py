"""Per-row data functions, all built-in column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from signaldeck.schema import int_div

# Names shared with the wire formats.
SPAN_KINDS = {1: "internal", 2: "server", 3: "client", 4: "producer", 5: "consumer"}
STATUS_CODES = {1: "ok", 2: "error"}
TEMPORALITIES = {1: "delta", 2: "cumulative"}
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")
# Upper end of the severity-number band of each level, in the order of LEVELS.
SEVERITY_BANDS = (4, 8, 12, 16, 20, 24)
SEVERITY_TEXT = {
    "trace": "trace",
    "debug": "debug",
    "warn": "warn",
    "warning": "warn",
    "error": "error",
    "fatal": "fatal",
}
DURATION_UNITS_MS = {"s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def _names(number: Column, table: dict[int, str], default: str) -> Column:
    result = F.lit(default)
    for code, name in table.items():
        result = F.when(number == code, F.lit(name)).otherwise(result)
    return result


def severity(number: Column, text: Column) -> Column:
    """Log level of a severity number 1..24; outside it, of the severity text."""
    by_text = F.lit("info")
    for word, level in SEVERITY_TEXT.items():
        by_text = F.when(F.lower(text) == word, F.lit(level)).otherwise(by_text)
    banded = F.when((number < 1) | (number > SEVERITY_BANDS[-1]) | number.isNull(), by_text)
    for upper, level in zip(SEVERITY_BANDS, LEVELS):
        banded = banded.when(number <= upper, F.lit(level))
    return banded


def span_kind(code: Column) -> Column:
    return _names(code, SPAN_KINDS, "unspecified")


def status_code(code: Column) -> Column:
    return _names(code, STATUS_CODES, "unset")


def temporality_name(code: Column) -> Column:
    return _names(code, TEMPORALITIES, "unspecified")


def hex_bytes(value: Column) -> Column:
    return F.lower(F.hex(value))


def hex16(value: Column) -> Column:
    """Unsigned 64-bit id (two's complement BIGINT) as 16 hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def finite_number(value: Column) -> Column:
    """DOUBLE as VARIANT; NaN and infinities become their names as strings."""
    named = (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("Infinity"))
        .when(value == float("-inf"), F.lit("-Infinity"))
    )
    return F.coalesce(named.cast("variant"), value.cast("variant"))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & ~value.isin(float("inf"), float("-inf"))


def trace_id_128(low: Column, high_hex: Column) -> Column:
    """Low 64 bits, preceded by the high half when that is 16 valid hex digits."""
    high = F.when(high_hex.rlike("^[0-9a-fA-F]{16}$"), F.lower(high_hex))
    return F.concat(F.coalesce(high, F.lit("")), hex16(low))


def error_title(error_type: Column, error_value: Column) -> Column:
    """``type: value``, or the type alone when the value is empty or missing."""
    return F.when(
        F.coalesce(error_value, F.lit("")) == "", error_type
    ).otherwise(F.concat(error_type, F.lit(": "), error_value))


RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
)


def rfc3339_nano(text: Column) -> Column:
    """RFC 3339 text -> nanoseconds since 1970; NULL when it is not one."""
    shaped = F.when(text.rlike(RFC3339), F.upper(F.translate(text, " ", "T")))
    seconds = F.unix_seconds(F.try_to_timestamp(shaped))
    fraction = F.rpad(F.substring(F.regexp_extract(shaped, r"\.(\d+)", 1), 1, 9), 9, "0")
    # Dates beyond the range of the nanoseconds are no valid times, like malformed ones.
    nano = F.try_add(F.try_multiply(seconds, F.lit(1_000_000_000)), fraction.cast("bigint"))
    return F.when(nano >= 0, nano)


def seconds_to_nano(seconds: Column) -> Column:
    """Seconds since 1970 -> nanoseconds; NULL when negative, not finite or out of range."""
    inside = is_finite(seconds) & (seconds >= 0) & (seconds * 1e9 < float(2**63))
    return F.when(inside, F.floor(F.when(inside, seconds) * 1e9).cast("bigint"))


def duration_ms(text: Column) -> Column:
    """'15m' -> milliseconds; NULL unless digits and one unit of s, m, h, d, w."""
    amount = F.regexp_extract(text, r"^(\d+)[smhdw]$", 1)
    unit = F.regexp_extract(text, r"^\d+([smhdw])$", 1)
    factor = F.lit(None).cast("bigint")
    for name, size in DURATION_UNITS_MS.items():
        factor = F.when(unit == name, F.lit(size).cast("bigint")).otherwise(factor)
    return F.try_multiply(F.nullif(amount, F.lit("")).try_cast("bigint"), factor)


def parse_duration_ms(text: str) -> int:
    """Driver-side form of :func:`duration_ms` for query parameters."""
    match = re.fullmatch(r"(\d+)([smhdw])", text)
    if not match:
        raise ValueError("duration needs a number and a unit: s, m, h, d, or w")
    return int(match[1]) * DURATION_UNITS_MS[match[2]]


def receive_date(received_at_ms: Column) -> Column:
    """UTC calendar date of an arrival time, independent of the session zone."""
    return F.date_add(
        F.lit("1970-01-01").cast("date"),
        F.call_function("div", received_at_ms, F.lit(86_400_000).cast("bigint")).cast("int"),
    )


def logical_bytes(*columns: Column | str) -> Column:
    """Length of the JSON text of a record."""
    return F.octet_length(F.to_json(F.struct(*columns))).cast("bigint")


def human_duration(nanoseconds: Column) -> Column:
    """Duration for people: ns, us and ms with one decimal, s with two (rounded half up)."""

    def scaled(step: int, decimals: int, unit: str) -> Column:
        # Whole steps of the last shown digit, so that rounding is exact.
        steps = int_div(nanoseconds + step // 2, step)
        base = 10**decimals
        digits = F.lpad((steps % base).cast("string"), decimals, "0")
        return F.concat(int_div(steps, base).cast("string"), F.lit("."), digits, F.lit(f" {unit}"))

    return (
        F.when(nanoseconds.isNull(), F.lit("--"))
        .when(nanoseconds < 1_000, F.concat(nanoseconds.cast("string"), F.lit(" ns")))
        .when(nanoseconds < 1_000_000, scaled(100, 1, "us"))
        .when(nanoseconds < 1_000_000_000, scaled(100_000, 1, "ms"))
        .otherwise(scaled(10_000_000, 2, "s"))
    )
