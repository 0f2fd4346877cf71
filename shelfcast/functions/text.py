"""Parsing of text fields into typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as a number: sign, digits with an optional dot, exponent; or an infinity.
NUMBER_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))$"
DATE_PATTERN = r"^\d{4}-\d{1,2}-\d{1,2}$"
ITEM_CODE_PATTERN = r"^[A-Za-z0-9._\-]{1,64}$"
# The characters Unicode counts as white space.
WHITE_SPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trimmed(text: Column) -> Column:
    """Drop white space of any kind (tabs too) at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def _checked_number(text: Column) -> Column:
    """Double of a text that is a number as a whole; the check keeps out what a cast alone would take (1d, nan).

    ``regexp_extract`` gives "" for other texts, which casts to null.
    """
    return F.regexp_extract(text, NUMBER_PATTERN, 0).try_cast("double")


def _from_digit_to_digit(text: Column) -> Column:
    """True for a text that begins with a digit, or a minus and a digit, ends with a digit and holds no x after a leading 0.

    There is nothing to trim then, and a cast takes no more than NUMBER_PATTERN does (no 1d, nan or 0x1p3).
    Byte comparisons only, as most fields are like that and the pattern costs far more.
    """
    starts = ((text >= "0") & (text < ":")) | ((text >= "-0") & (text < "-:"))
    not_zero = ((text >= "1") & (text < ":")) | ((text >= "-1") & (text < "-:"))
    return starts & F.substring(text, -1, 1).between("0", "9") & (not_zero | (~text.contains("x") & ~text.contains("X")))


def _number(text: Column, plain: Column, odd: Column) -> Column:
    """Double of ``plain`` where ``text`` goes from digit to digit, else of ``odd`` where that is a number.

    What is no number is not cast: a cast that fails makes an exception, which costs more than the pattern.
    """
    number = F.when(_from_digit_to_digit(text), plain.try_cast("double")).when(~odd.rlike(NUMBER_PATTERN), F.lit(None))
    return number.otherwise(_checked_number(odd))


def plain_number(text: Column) -> Column:
    """Dot-decimal text to double, null when it is not a number."""
    return _number(text, text, trimmed(text))


def vn_decimal(text: Column) -> Column:
    """P1. ``12.345,67`` to 12345.67; null when it is not a number.

    Dots are thousands separators and always dropped, so ``62.5`` gives 625.
    """
    undotted = F.replace(F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return _number(text, undotted, F.translate(trimmed(text), ",. ", "."))


def integer_number(text: Column) -> Column:
    """Dot-decimal text to bigint; null when it is not a whole number."""
    value = plain_number(text)
    return F.when(value == F.floor(value), value.try_cast("bigint"))


def item_code(text: Column) -> Column:
    """P2. Upper case without any white space; empty becomes null."""
    return F.nullif(F.translate(F.upper(text), WHITE_SPACE, ""), F.lit(""))


def iso_date(text: Column) -> Column:
    """P3. Year-month-day text to date. One-digit months and days are fine, edge spaces are not."""
    date = text.try_cast("date")
    # The pattern keeps out what a cast alone would take (2025, 2025-09-05T); a date that is written back as the text matches it.
    other = F.regexp_extract(text, DATE_PATTERN, 0).try_cast("date")
    return F.when((date.cast("string") == text) & (text >= "0"), date).otherwise(other)


def trimmed_iso_date(text: Column) -> Column:
    """P3 for single values: as :func:`iso_date` after trimming both ends."""
    return iso_date(trimmed(text))


def wide_id_item(identifier: Column) -> Column:
    """P17. Item code of a ``<item>_validation`` or ``<item>_evaluation`` id; null for other ids."""
    return F.when(
        identifier.endswith("_validation") | identifier.endswith("_evaluation"),
        F.regexp_extract(identifier, r"^(.*)_(validation|evaluation)$", 1),
    )


def wide_horizon(identifier: Column, period: Column) -> Column:
    """P18. ``F<k>`` to horizon k, plus 28 in the evaluation half."""
    offset = F.when(identifier.endswith("_evaluation"), F.lit(28)).otherwise(F.lit(0))
    return F.substring(period, 2, 3).cast("int") + offset
