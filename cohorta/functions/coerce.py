"""Column helpers for lenient coercion of text input.

All helpers return built-in Spark Column expressions (whole-stage codegen,
no Python on the executors).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohorta.schema import spark_type

_INT_RANGE = {
    "tinyint": (-128, 127),
    "integer": (-(2 ** 31), 2 ** 31 - 1),
    "bigint": (-(2 ** 63), 2 ** 63 - 1),
}


# Numeric text forms accepted besides plain decimals —
# digit groups joined by single underscores (1_000, 1_000.5, 1e1_0), and
# unsigned hexadecimal / binary literals (0x1F, 0b101), without spaces.
_DIGIT_GROUPS = r"^[+-]?[0-9]+(_[0-9]+)*(\.[0-9]+(_[0-9]+)*)?([eE][+-]?[0-9]+(_[0-9]+)*)?$"
_HEX = r"^0[xX][0-9a-fA-F]+(_[0-9a-fA-F]+)*$"
_BIN = r"^0[bB][01]+(_[01]+)*$"
# A whole date, and a whole date with an optional time of day.
# Spark's parser also takes '2020', '2020-05' and '10:30'; those are no dates here.
FULL_DATE = r"^[0-9]{1,6}-[0-9]{1,2}-[0-9]{1,2}$"
FULL_TIMESTAMP = (r"^[0-9]{1,6}-[0-9]{1,2}-[0-9]{1,2}"
                  r"([ T][0-9]{1,2}:[0-9]{1,2}(:[0-9]{1,2}(\.[0-9]+)?)?( ?(Z|[+-][0-9]{1,2}(:?[0-9]{2})?))?)?$")
#: Last second of the year 9999: a larger epoch is no timestamp.
MAX_EPOCH = 253402300799


def numeric_text(c: Column) -> Column:
    """Trimmed text with valid digit-group underscores removed."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(_DIGIT_GROUPS), F.regexp_replace(s, "_", "")).otherwise(s)


def _radix_literal(c: Column) -> Column:
    """Hexadecimal or binary literal that fits a bigint, else NULL."""
    raw = c.cast("string")
    # leading zeros carry no value; what is left must fit 63 bits, or conv would overflow
    digits = F.regexp_replace(F.regexp_replace(raw, "_", ""), "^0[xXbB]0*", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    n = F.length(digits)
    hex_fits = raw.rlike(_HEX) & ((n < 16) | ((n == 16) & (F.substring(digits, 1, 1) < "8")))
    bin_fits = raw.rlike(_BIN) & (n <= 63)
    return (F.when(hex_fits, F.conv(F.when(hex_fits, digits), 16, 10))
             .when(bin_fits, F.conv(F.when(bin_fits, digits), 2, 10))).try_cast("bigint")


def date_text(c: Column) -> Column:
    """Date of a whole date text, else NULL."""
    s = F.trim(c.cast("string"))
    return F.when(s.rlike(FULL_DATE), s).try_cast("date")


def timestamp_text(c: Column) -> Column:
    """Timestamp of a whole date with an optional time of day, else NULL."""
    s = F.trim(c.cast("string"))
    return F.try_to_timestamp(F.when(s.rlike(FULL_TIMESTAMP), s))


def safe_int(c: Column, kind: str = "bigint") -> Column:
    """Text/number -> integer type, rounding decimals half away from zero.

    ``'12.50'`` -> 13, ``'1e3'`` -> 1000, ``'300'`` as tinyint -> NULL,
    ``'1_000'`` -> 1000, ``'0x1F'`` -> 31.  The exact bigint parse runs first
    so ids above 2**53 keep every digit.
    """
    s = numeric_text(c)
    exact = s.try_cast("bigint")
    # plain decimals round exactly (HALF_UP on DECIMAL); exponent forms via DOUBLE
    dec = F.round(s.try_cast("decimal(38,18)"), 0).try_cast("bigint")
    dbl = s.try_cast("double")
    lo, hi = _INT_RANGE[kind]
    rounded = F.when(dbl.isNotNull() & ~F.isnan(dbl) & (F.abs(dbl) < F.lit(9.223372036854775807e18)),
                     F.round(dbl).try_cast("bigint"))
    v = F.coalesce(exact, dec, rounded, _radix_literal(c))
    return F.when((v >= F.lit(lo)) & (v <= F.lit(hi)), v).cast(spark_type(kind))


def epoch_or_timestamp(c: Column) -> Column:
    """Timestamp from text, or from epoch seconds when the value is an
    integer above 100000.  All-digit text never goes through the text parser
    (it would read ``'2020'`` as a year)."""
    s = F.trim(c.cast("string"))
    digits = s.rlike(r"^-?\d+$")
    as_long = s.try_cast("bigint")
    valid = (as_long > F.lit(100000)) & (as_long <= F.lit(MAX_EPOCH))
    from_epoch = F.timestamp_seconds(F.when(valid, as_long))
    return F.when(digits, from_epoch).otherwise(timestamp_text(s))


def safe_cast(c: Column, kind: str) -> Column:
    """Lenient cast to a catalog type; bad values become NULL."""
    if kind in _INT_RANGE:
        return safe_int(c, kind)
    if kind == "timestamp":
        return epoch_or_timestamp(c)
    if kind == "varchar":
        return c.cast("string")
    if kind == "double":
        return numeric_text(c).try_cast("double")
    if kind == "date":
        return date_text(c)
    return c.try_cast(spark_type(kind))


def blank_to_null(c: Column) -> Column:
    """``NULLIF(TRIM(x), '')``."""
    t = F.trim(c)
    return F.when(t != F.lit(""), t)


def email_domain(email: Column, domain: Column | None = None) -> Column:
    """``COALESCE(domain, NULLIF(split_part(email, '@', 2), ''))``."""
    part = F.split_part(email.cast("string"), F.lit("@"), F.lit(2))
    derived = F.when(part != F.lit(""), part)
    return derived if domain is None else F.coalesce(domain, derived)


def like_escape(text: str) -> str:
    """Escape ``\\ % _`` so a value matches literally inside ILIKE."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
