"""Counting reactions to items inside a time window that opens with each item."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreach.functions.time import in_window, moment, within
from tallyreach.sources.layouts import Colocated

COUNT_COLUMNS = (
    "has_full_7d_window",
    "comment_count_recorded",
    "like_count_recorded",
    "comment_count_7d",
    "like_count_7d",
    "engagement_count_7d",
)


def windowed_counts(
    items: DataFrame,
    reactions: dict[str, tuple[DataFrame, str, str]],
    key: str,
    opened_at: str,
    window: timedelta,
    window_name: str = "7d",
) -> DataFrame:
    """All rows of ``items``, one per key, with counts of the reactions to each.

    ``reactions`` maps a kind to (DataFrame, key column, time column). Each kind gives
    ``<kind>_count_recorded``, all reactions, and ``<kind>_count_<window_name>``, those in
    ``[opened_at, opened_at + window)``; ``engagement_count_<window_name>`` sums the latter.

    All kinds are stacked, so they shuffle and join once, with the keys and times of the items alone.
    A key may hold any share of the reactions. Pass only the item columns that the result should carry.
    """
    kinds = list(reactions)
    stacked = reduce(
        DataFrame.unionByName,
        [
            frame.select(
                F.col(frame_key).alias(key),
                F.col(time).alias("_time"),
                F.lit(number).alias("_kind"),
            ).filter(F.col(key).isNotNull())
            for number, (frame, frame_key, time) in enumerate(reactions.values())
        ],
    )
    # Reactions meet the items in an inner join, whose hot partitions Spark can split, and are counted
    # where they are. The struct keeps Spark from counting each key in the one task that joined it.
    inside = within(F.col("_time"), F.col(opened_at), window)
    counts = []
    for number, kind in enumerate(kinds):
        of_kind = F.col("_kind") == number
        counts.append(F.count_if(of_kind).alias(f"_all_{kind}"))
        counts.append(F.count_if(of_kind & inside).alias(f"_in_{kind}"))
    counted = (
        stacked.join(items.select(key, opened_at), key)
        .groupBy(F.struct(key).alias("_of"))
        .agg(*counts)
        .select(F.col(f"_of.{key}").alias(key), *[F.col(f"_{n}_{kind}") for kind in kinds for n in ("all", "in")])
    )
    counted = items.join(counted, key, "left").fillna(0, [f"_{n}_{kind}" for kind in kinds for n in ("all", "in")])
    recorded = [F.col(f"_all_{kind}").alias(f"{kind}_count_recorded") for kind in kinds]
    inside = [F.col(f"_in_{kind}").alias(f"{kind}_count_{window_name}") for kind in kinds]
    total = reduce(lambda a, b: a + b, [F.col(f"_in_{kind}") for kind in kinds])
    return counted.select(
        *items.columns, *recorded, *inside, total.alias(f"engagement_count_{window_name}")
    )


def colocated_counts(
    items: Colocated,
    reactions: dict[str, tuple[Colocated, str]],
    opened_at: str,
    window: timedelta,
    window_name: str = "7d",
) -> DataFrame:
    """The rows of :func:`windowed_counts`, from tables stored by key in as many buckets, without a shuffle.

    ``reactions`` maps a kind to (table, time column). A kind's heavy keys are fewer than the buckets: their
    items are broadcast to the heavy reactions, and so are their counts to the items.
    """
    if any(table.buckets != items.buckets for table, _ in reactions.values()):
        raise ValueError("the tables differ in their number of buckets")
    key = items.key
    openings = items.even.select(key, opened_at)
    inside = within(F.col("_time"), F.col(opened_at), window)
    result, empty = items.even, items.heavy
    for kind, (table, time) in reactions.items():
        names = [f"{kind}_count_recorded", f"{kind}_count_{window_name}"]
        counts = [F.count(F.lit(1)).alias(names[0]), F.count_if(inside).alias(names[1])]

        def slim(rows: DataFrame) -> DataFrame:
            return rows.select(F.col(table.key).alias(key), F.col(time).alias("_time"))

        found = openings.join(slim(table.even), key).groupBy(key).agg(*counts)
        result = result.join(found, key, "left")
        if table.heavy_keys:
            keys = table.keys_frame(items.even.sparkSession).withColumnRenamed(table.key, key)
            few = F.broadcast(openings.join(F.broadcast(keys), key))
            heavy = slim(table.heavy).join(few, key).groupBy(key).agg(*counts)
            renamed = heavy.toDF(key, *[f"_heavy_{name}" for name in names])
            result = result.join(F.broadcast(renamed), key, "left").withColumns(
                {name: F.coalesce(name, f"_heavy_{name}") for name in names}
            ).drop(*[f"_heavy_{name}" for name in names])
        result = result.fillna(0, names)
        empty = empty.withColumns({name: F.lit(0).cast("long") for name in names})
    # Items have one row per key, so those out of the buckets are the ones without a key.
    if items.heavy_rows:
        result = result.unionByName(empty)
    recorded = [f"{kind}_count_recorded" for kind in reactions]
    in_time = [f"{kind}_count_{window_name}" for kind in reactions]
    total = reduce(lambda a, b: a + b, [F.col(name) for name in in_time])
    return result.select(
        *items.even.columns, *recorded, *in_time, total.alias(f"engagement_count_{window_name}")
    )


def engaged_posts_colocated(
    posts: Colocated,
    comments: Colocated,
    likes: Colocated,
    study_start: str,
    study_end: str,
    window: timedelta = timedelta(days=7),
) -> DataFrame:
    """The rows of :func:`engaged_posts`, from tables stored by post."""
    counted = colocated_counts(
        posts,
        {"comment": (comments, "commented_at"), "like": (likes, "liked_at")},
        opened_at="posted_at",
        window=window,
    )
    return counted.withColumn("has_full_7d_window", _covered(study_start, study_end, window))


def _covered(study_start: str, study_end: str, window: timedelta) -> Column:
    return in_window(F.col("posted_at"), moment(study_start), moment(study_end) - F.lit(window))


def engaged_posts(
    posts: DataFrame,
    comments: DataFrame,
    likes: DataFrame,
    study_start: str,
    study_end: str,
    window: timedelta = timedelta(days=7),
) -> DataFrame:
    """Every unique post, all columns, with its comment and like counts.

    ``posts``: one row per post_id, with posted_at. ``comments``: entry_id, commented_at.
    ``likes``: post_id, liked_at. Both valid rows only. ``has_full_7d_window`` tells whether the
    study covers the whole window of a post.

    Taking the features of a post along here spares joining them back by post later on.
    """
    counted = windowed_counts(
        posts,
        {
            "comment": (comments, "entry_id", "commented_at"),
            "like": (likes, "post_id", "liked_at"),
        },
        key="post_id",
        opened_at="posted_at",
        window=window,
    )
    return counted.withColumn("has_full_7d_window", _covered(study_start, study_end, window))


def post_engagement(engaged: DataFrame) -> DataFrame:
    """The engagement table: identity, time and counts of every unique post."""
    return engaged.select(
        "post_id", "author_id", "posted_at", "timestamp_in_study_window", *COUNT_COLUMNS
    )


def with_engagement(posts: DataFrame, engagement: DataFrame) -> DataFrame:
    """Join posts to an engagement table that was stored apart from them."""
    return posts.join(engagement.select("post_id", *COUNT_COLUMNS), "post_id")
