"""Column functions. All are built-in expressions, so they stay in generated code."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradewell.schema import BAND_LIMITS, BANDS, NO, PRIVILEGES, SCORE_TEXT, UNKNOWN_PRIVILEGE, YES

POINT_DIGITS = 6  # points are sums of doubles; this many decimals are kept

# E-mail pattern (unanchored) and the characters that a strip removes.
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,4}"
WHITESPACE = " \t\n\x0b\f\r\0"


def points(c) -> Column:
    """Points rounded so that equal sums compare equal."""
    return F.round(c, POINT_DIGITS)


def score_band(score, max_score) -> Column:
    score, max_score = F.col(score), F.col(max_score)
    return (
        F.when(score < BAND_LIMITS[0] * max_score, BANDS[0])
        .when(score < BAND_LIMITS[1] * max_score, BANDS[1])
        .otherwise(BANDS[2])
    )


def score_label(score, max_score) -> Column:
    return F.format_string(SCORE_TEXT, F.col(score).cast("string"), F.col(max_score).cast("string"))


def privilege_mask(*names: str) -> int:
    """All named privileges OR-ed; a name that is not known asks for bit 1."""
    return reduce(lambda mask, name: mask | PRIVILEGES.get(name, UNKNOWN_PRIVILEGE), names, 0)


def bits_to_int(bits) -> Column:
    return F.conv(bits, 2, 10).cast("int")


def has_bits(bits, mask) -> Column:
    """True when every bit of ``mask`` is set; null rights give false."""
    mask = mask if isinstance(mask, Column) else F.lit(mask)
    return F.coalesce(bits_to_int(bits).bitwiseAND(mask) == mask, F.lit(False))


def leading_int(text) -> Column:
    """The whole number a text starts with, else 0."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))


def format_time(t) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSS")


def parse_time(text, zoned: bool = True) -> Column:
    """Null when the text is not a time. ``zoned=False`` gives TIMESTAMP_NTZ."""
    return F.col(text).try_cast("timestamp" if zoned else "timestamp_ntz")


def strip(text) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def is_member(items, value) -> Column:
    return F.coalesce(F.array_contains(items, value), F.lit(False))


def blank(text) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(r"^\s*$")


def present(text) -> Column:
    return ~blank(text)


def default_to(value, default) -> Column:
    return F.coalesce(value, F.lit(default))


def block_of(position, stride: int) -> Column:
    return F.floor(F.col(position) / stride)


def slot_of(position, stride: int) -> Column:
    return F.pmod(F.col(position), F.lit(stride))


def email_ok(text) -> Column:
    return F.coalesce(F.col(text), F.lit("")).rlike(EMAIL_PATTERN)


def question_kind(option_count, multi) -> Column:
    """multi is looked at first, then one option means open."""
    return F.when(F.col(multi), "multi").when(F.col(option_count) == 1, "open").otherwise("single")


def yes_no(flag: Column) -> Column:
    return F.when(flag, YES).otherwise(NO)
