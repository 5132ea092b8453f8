"""Turning raw text fields into typed values without ever failing a row."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# A raw field that equals one of these, before trimming, is missing.
NULL_TOKENS = ("", "\\N", "null", "NULL")

# The Unicode space separators (category Zs). Tabs and line ends are not in it.
SPACE_SEPARATORS = (
    "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u202f\u205f\u3000"
)

# A trailing d or f is a number suffix for Spark, but not a number in the data.
_SUFFIXED_NUMBER = r"[0-9.][dDfF]\s*\z"

# A full date, or a full date with at least hours and minutes. A bare year, a bare month and a
# date with hours only are not timestamps here, although Spark's own cast would take them.
_TIMESTAMP_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?.*)?\z"
# Rarer spellings: leading blanks, other separators, short years, more blanks before the time.
_LOOSE_TIMESTAMP = (
    r"^\s*(\d{1,4})([-/\\ ])(\d{1,2})\2(\d{1,2})"
    r"(?:[T\s]\s*(\d{1,2}:\d{1,2}(?::\d{1,2}(?:\.\d+)?)?)\s?(?:Z|UTC|[-+]\d{1,2}(?::?\d{2})?)?)?\z"
)
# The end of a day, written as an hour of its own.
_MIDNIGHT_AFTER = r"^24:00?(:00?(\.0+)?)?\z"


def null_tokens(field: Column, tokens: tuple[str, ...] = NULL_TOKENS) -> Column:
    """The field, or NULL where it is exactly one of ``tokens``.

    The match comes before trimming, so the text ``" null "`` survives and, once trimmed, is the
    ordinary value ``null``.
    """
    return F.when(~field.isin(*tokens), field)


def trim_spaces(text: Column) -> Column:
    """Strip every Unicode space separator from both ends."""
    return F.btrim(text, F.lit(SPACE_SEPARATORS))


def blank_to_null(text: Column) -> Column:
    """The trimmed text, or NULL where nothing is left."""
    return F.nullif(trim_spaces(text), F.lit(""))


def to_double(text: Column) -> Column:
    """The number in ``text``, or NULL. Underscores may stand between digits."""
    joined = F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")
    return F.when(
        ~text.rlike(_SUFFIXED_NUMBER),
        F.coalesce(text.try_cast("double"), F.when(text.contains("_"), joined.try_cast("double"))),
    )


def to_int(text: Column) -> Column:
    """The number in ``text`` rounded half away from zero, or NULL when out of range."""
    return F.round(to_double(text)).try_cast("int")


def to_timestamp(text: Column) -> Column:
    """The zone-less timestamp in ``text``, or NULL. A zone suffix is ignored, not applied."""
    usual = F.when(text.rlike(_TIMESTAMP_SHAPE), text.try_cast("timestamp_ntz"))

    def part(group: int) -> Column:
        return F.regexp_extract(text, _LOOSE_TIMESTAMP, group)

    date = F.concat_ws("-", F.lpad(part(1), 4, "0"), part(3), part(4))
    clock = part(5)
    day = date.try_cast("timestamp_ntz")
    loose = (
        F.when(clock == "", day)
        .when(clock.rlike(_MIDNIGHT_AFTER), day + F.lit(timedelta(days=1)))
        .otherwise(F.concat_ws(" ", date, clock).try_cast("timestamp_ntz"))
    )
    return F.coalesce(usual, F.when(text.rlike(_LOOSE_TIMESTAMP), loose))


def all_present(*columns: Column) -> Column:
    """TRUE where every column has a value; never NULL."""
    flag = columns[0].isNotNull()
    for column in columns[1:]:
        flag = flag & column.isNotNull()
    return flag
