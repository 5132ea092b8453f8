"""Activity, network size and profile of everyone who posted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreach.operators.dedup import first_per_key


def degree_counts(edges: DataFrame, start: str, end: str) -> tuple[DataFrame, DataFrame]:
    """Distinct neighbours of both ends of a directed edge list.

    Returns (``start``, out_degree) and (``end``, in_degree). Both come from the same distinct
    pairs: the edge list, the largest input there is, shuffles once, by pair, which also spreads
    a node that holds a third of all edges.
    """
    pairs = _pairs(edges, start, end)
    return (
        pairs.groupBy(start).agg(F.count("*").alias("out_degree")),
        pairs.groupBy(end).agg(F.count("*").alias("in_degree")),
    )


def _pairs(edges: DataFrame, start: str, end: str) -> DataFrame:
    known = edges.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
    return known.select(start, end).distinct()


def author_activity(posts: DataFrame) -> DataFrame:
    """Number of posts and the first and last posting time of each author."""
    return (
        posts.filter(F.col("author_id").isNotNull())
        .groupBy("author_id")
        .agg(
            F.count("*").alias("post_count"),
            F.min("posted_at").alias("first_post_at"),
            F.max("posted_at").alias("last_post_at"),
        )
    )


def author_statistics(
    posts: DataFrame,
    comments: DataFrame,
    likes: DataFrame,
    services: DataFrame,
    subscriptions: DataFrame,
    follow_events: DataFrame,
    users: DataFrame,
) -> DataFrame:
    """One row per posting author.

    ``posts``: author_id, posted_at, one row per post. ``comments``: author_id. ``likes``:
    user_id. ``services``: user_id, service_id. ``subscriptions``: subscriber_id,
    subscribed_to_id. ``follow_events``: followed_id, follower_id. ``users``: user_id,
    user_type, user_description, source_file. All valid rows only, follow events those of the
    study window.

    Follower and following counts stay missing for an author outside the network snapshot; every
    other count is 0 where nothing was seen. Instead of joining seven aggregates, all inputs are
    stacked as partial tallies and grouped once; distinct counts tally distinct pairs.
    """
    tally = F.lit(1).cast("bigint")
    # Both directions count from the same pairs, so the edges shuffle once.
    edges = _pairs(subscriptions, "subscriber_id", "subscribed_to_id")
    connected = services.select("user_id", "service_id").distinct()
    arrivals = _pairs(follow_events, "followed_id", "follower_id")

    # A user whose only service id is missing is counted as having none.
    has_service = F.when(F.col("service_id").isNotNull(), 1).otherwise(0).cast("bigint")
    stacked = [
        posts.select(
            F.col("author_id"),
            tally.alias("posts"),
            F.col("posted_at").alias("first_at"),
            F.col("posted_at").alias("last_at"),
        ),
        _tally(comments, "author_id", "comments", tally),
        _tally(likes, "user_id", "likes", tally),
        _tally(connected, "user_id", "services", has_service),
        _tally(edges, "subscribed_to_id", "followers", tally),
        _tally(edges, "subscriber_id", "following", tally),
        _tally(arrivals, "followed_id", "arrivals", tally),
    ]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    totals = (
        union.filter(F.col("author_id").isNotNull())
        .groupBy("author_id")
        .agg(
            *[
                F.sum(name).alias(name)
                for name in (
                    "posts", "comments", "likes", "services", "followers", "following", "arrivals"
                )
            ],
            F.min("first_at").alias("first_post_at"),
            F.max("last_at").alias("last_post_at"),
        )
        .filter(F.col("posts").isNotNull())
    )
    profiles = first_per_key(
        users.select("user_id", "source_file", "user_type", "user_description"),
        ["user_id"],
        ["source_file"],
    ).select(
        F.col("user_id").alias("author_id"),
        "user_type",
        F.col("user_description").isNotNull().alias("described"),
    )

    def counted(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0).cast("bigint"))

    return totals.join(profiles, "author_id", "left").select(
        "author_id",
        "user_type",
        F.coalesce("described", F.lit(False)).alias("has_profile_description"),
        F.col("posts").alias("post_count"),
        "first_post_at",
        "last_post_at",
        counted("comments").alias("comments_written"),
        counted("likes").alias("likes_given"),
        counted("services").alias("connected_service_count"),
        F.col("followers").alias("follower_count"),
        F.col("following").alias("following_count"),
        counted("arrivals").alias("new_follower_count"),
        F.col("followers").isNotNull().alias("network_snapshot_available"),
    )


def _tally(frame: DataFrame, who: str, name: str, value: Column) -> DataFrame:
    return frame.select(F.col(who).alias("author_id"), value.alias(name))
