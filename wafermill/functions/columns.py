"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a plain decimal number looks like in the text formats read here.
INT_PATTERN = r"^[+-]?[0-9]+$"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def plain_int(text: Column) -> Column:
    """Whole number in ``text`` or null; letters after the digits never pass."""
    return F.when(text.rlike(INT_PATTERN), text.try_cast("bigint"))


def plain_float(text: Column) -> Column:
    """Decimal number in ``text`` or null. A cast alone would read '12f' and '12d'."""
    return F.when(text.rlike(FLOAT_PATTERN), text.try_cast("double"))


def digest_unit(digest: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def digest_int(digest: Column) -> Column:
    """A non-negative whole number from the first 13 hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def strip(text: Column | str) -> Column:
    """Text without white space at both ends (tabs and line ends too, not only blanks)."""
    return F.btrim(text, F.lit(" \t\r\n\x0b\x0c"))


def tokens(text: Column) -> Column:
    """Parts between runs of white space, without empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def is_whole_json(text: Column) -> Column:
    """Is the text one JSON value and nothing else? The parser alone stops after the first value.

    The text must still parse as the only item of a list and as a member followed by another.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit(',"z":0}')))
    one = F.try_parse_json(text).isNotNull() & listed.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    return one & F.coalesce(F.try_variant_get(member, "$.z", "int") == 0, F.lit(False))
