"""Declared layouts of raw delimited tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreach.functions.cleaning import (
    all_present,
    blank_to_null,
    to_double,
    to_int,
    to_timestamp,
)
from tallyreach.functions.time import in_window, moment

_TYPES = {
    "trimmed": T.StringType(),
    "verbatim": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "timestamp": T.TimestampNTZType(),
}


@dataclass(frozen=True)
class FieldSpec:
    """A raw field: its name and how its text is read.

    ``trimmed`` strips spaces and turns blanks into NULL, ``verbatim`` keeps the text as it is.
    A ``timestamp`` keeps the raw text beside the value, as ``<name>_raw``.
    """

    name: str
    kind: str = "trimmed"

    def columns(self, raw: Column) -> list[Column]:
        readers = {
            "trimmed": blank_to_null,
            "verbatim": lambda text: text,
            "double": to_double,
            "int": to_int,
            "timestamp": to_timestamp,
        }
        typed = [readers[self.kind](raw).alias(self.name)]
        return typed + ([raw.alias(f"{self.name}_raw")] if self.kind == "timestamp" else [])

    def schema_fields(self) -> list[T.StructField]:
        fields = [T.StructField(self.name, _TYPES[self.kind])]
        if self.kind == "timestamp":
            fields.append(T.StructField(f"{self.name}_raw", T.StringType()))
        return fields


@dataclass(frozen=True)
class TimeCheck:
    """A flag that is TRUE where ``column`` lies in ``[start, end)``."""

    flag: str
    column: str
    start: str
    end: str


@dataclass(frozen=True)
class TableSpec:
    """A raw table: where it lies, how its lines are cut, and what makes a row valid."""

    name: str
    files: tuple[str, ...]
    delimiter: str
    fields: tuple[FieldSpec, ...]
    required: tuple[str, ...]
    time_check: TimeCheck | None = None

    @property
    def timestamp_flag(self) -> str | None:
        return None if self.time_check is None else self.time_check.flag

    def flags(self) -> list[Column]:
        valid = all_present(*[F.col(name) for name in self.required])
        flags = [valid.alias("identifier_is_valid")]
        check = self.time_check
        if check is not None:
            inside = in_window(F.col(check.column), moment(check.start), moment(check.end))
            flags.append(inside.alias(check.flag))
        return flags

    def schema(self) -> T.StructType:
        """Schema of the clean table."""
        fields = [part for field in self.fields for part in field.schema_fields()]
        fields.append(T.StructField("source_file", T.StringType()))
        fields.append(T.StructField("identifier_is_valid", T.BooleanType()))
        if self.time_check is not None:
            fields.append(T.StructField(self.time_check.flag, T.BooleanType()))
        return T.StructType(fields)


def _fields(*parts: str | tuple[str, str]) -> tuple[FieldSpec, ...]:
    return tuple(FieldSpec(part) if isinstance(part, str) else FieldSpec(*part) for part in parts)


def _origin(time: str) -> tuple[str | tuple[str, str], ...]:
    """The fields in the middle of both posts and comments."""
    return (
        "author_id", "source_name", "source_url", ("geo_x", "double"), ("geo_y", "double"),
        (time, "timestamp"),
    )


# The study window, and the wider window in which a like is plausible.
STUDY_START, STUDY_END = "2010-08-01", "2010-10-01"
LIKES_START, LIKES_END = "2008-01-01", "2010-10-17"


def dump_tables(
    study_start: str = STUDY_START,
    study_end: str = STUDY_END,
    likes_start: str = LIKES_START,
    likes_end: str = LIKES_END,
) -> dict[str, TableSpec]:
    """The seven tables of the social-network dump. Names, order and delimiters are fixed values."""

    def study(column: str) -> TimeCheck:
        return TimeCheck("timestamp_in_study_window", column, study_start, study_end)

    specs = [
        TableSpec(
            "entries",
            ("entries1.csv", "entries2.csv", "entries3.csv"),
            "\t",
            _fields(
                "post_id",
                *_origin("posted_at"),
                ("post_text", "verbatim"),
                ("image_count", "int"),
                "image_urls",
                ("video_count", "int"),
                "video_urls",
            ),
            ("post_id", "author_id"),
            study("posted_at"),
        ),
        TableSpec(
            "comments",
            ("commentAugSept.csv",),
            "\t",
            _fields(
                "comment_id", "entry_id", *_origin("commented_at"), ("comment_text", "verbatim")
            ),
            ("comment_id", "entry_id"),
            study("commented_at"),
        ),
        TableSpec(
            "likes",
            ("likes.csv",),
            "\t",
            _fields("user_id", "post_id", ("liked_at", "timestamp")),
            ("user_id", "post_id"),
            TimeCheck("timestamp_is_plausible", "liked_at", likes_start, likes_end),
        ),
        TableSpec(
            "following_events",
            ("followingAugSept.csv",),
            "\t",
            _fields("followed_id", "follower_id", ("observed_at", "timestamp")),
            ("followed_id", "follower_id"),
            study("observed_at"),
        ),
        TableSpec(
            "subscriptions",
            ("subscriptions.csv",),
            ",",
            _fields("subscriber_id", "subscribed_to_id"),
            ("subscriber_id", "subscribed_to_id"),
        ),
        TableSpec(
            "services",
            ("services.csv",),
            "|",
            _fields(
                "user_id", "service_id", "service_name", "service_url", "username_on_service",
                "user_url_on_service",
            ),
            ("user_id",),
        ),
        TableSpec(
            "users",
            ("users.csv",),
            "|",
            _fields("user_id", "user_type", "display_name", "reserved_value", "user_description"),
            ("user_id",),
        ),
    ]
    return {spec.name: spec for spec in specs}
