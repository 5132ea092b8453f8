"""Simple measures of a piece of text. All are null-safe only where stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as markup, a word, a hashtag and a link. Words are ASCII only, as \w is
# in Spark, so an accented letter ends one.
TAG = r"<[^>]+>"
WORD = r"\w+"
HASHTAG = r"#\w+"
LINK = r"https?://"


def strip_tags(text: Column) -> Column:
    """Replace every tag by one space; a missing text becomes the empty text."""
    known = F.coalesce(text, F.lit(""))
    return F.when(known.contains("<"), F.regexp_replace(known, TAG, " ")).otherwise(known)


def occurrences(text: Column, pattern: str, holding: str | None = None) -> Column:
    """Number of matches.

    ``holding`` is a text that every match holds; looking for it first is far quicker than trying
    a pattern that is not there.
    """
    count = F.regexp_count(text, F.lit(pattern))
    if holding is not None:
        count = F.when(text.contains(holding), count).when(text.isNotNull(), 0)
    return count.cast("bigint")


def text_measures(visible: Column) -> dict[str, Column]:
    """Length in code points and the number of words, hashtags and links."""
    return {
        "character_count": F.length(visible).cast("bigint"),
        "word_count": occurrences(visible, WORD),
        "hashtag_count": occurrences(visible, HASHTAG, "#"),
        "url_count": occurrences(visible, LINK, "http"),
    }
