"""One wide feature row per unique post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyreach.functions import bands, text, time
from tallyreach.operators.categories import (
    TOP_CATEGORIES,
    named_category,
    with_category_group,
)
from tallyreach.operators.dedup import first_per_key


def unique_posts(entries: DataFrame, default_source: str) -> DataFrame:
    """The first row of every valid post, reduced to what later steps need.

    Text is measured before the rows shuffle, so the text itself, by far the widest column, never
    does. ``default_source`` names the source of posts that give none.
    """
    visible = text.strip_tags(F.col("post_text"))
    slim = entries.filter("identifier_is_valid").select(
        "post_id",
        "author_id",
        "posted_at",
        "source_file",
        "timestamp_in_study_window",
        named_category(F.col("source_name"), default_source).alias("source_name"),
        "image_count",
        "video_count",
        *[measure.alias(name) for name, measure in text.text_measures(visible).items()],
    )
    return first_per_key(slim, ["post_id"], ["posted_at", "source_file"])


def post_features(
    engaged: DataFrame,
    authors: DataFrame,
    top_sources: int = TOP_CATEGORIES,
) -> DataFrame:
    """Join unique posts with their engagement to their authors, and derive the features.

    The posts are the outer side of the join and nothing is grouped after it, so Spark splits the
    partition of an author with very many posts.
    """
    profile = authors.select(
        "author_id",
        "user_type",
        "has_profile_description",
        F.col("post_count").alias("author_post_count"),
        F.col("comments_written").alias("author_comments_written"),
        F.col("likes_given").alias("author_likes_given"),
        "connected_service_count",
        "follower_count",
        "following_count",
        "new_follower_count",
        "network_snapshot_available",
    )
    joined = engaged.join(profile, "author_id", "left")
    grouped = with_category_group(
        joined, "source_name", "source_group", top_sources, counted=engaged
    )
    zero = F.lit(0).cast("bigint")
    posted_at = F.col("posted_at")
    followers = F.col("follower_count")
    hour = time.hour(posted_at)
    return grouped.select(
        "post_id",
        "author_id",
        "posted_at",
        "source_name",
        "source_group",
        F.coalesce("image_count", F.lit(0)).alias("image_count"),
        F.coalesce("video_count", F.lit(0)).alias("video_count"),
        "character_count",
        "word_count",
        "hashtag_count",
        "url_count",
        (F.coalesce("image_count", F.lit(0)) > 0).alias("has_image"),
        (F.coalesce("video_count", F.lit(0)) > 0).alias("has_video"),
        hour.alias("post_hour"),
        time.iso_weekday(posted_at).alias("weekday_number"),
        time.weekday_name(posted_at).alias("weekday_name"),
        time.is_weekend(posted_at).alias("is_weekend"),
        "user_type",
        F.coalesce("has_profile_description", F.lit(False)).alias("has_profile_description"),
        F.coalesce("author_post_count", zero).alias("author_post_count"),
        F.coalesce("author_comments_written", zero).alias("author_comments_written"),
        F.coalesce("author_likes_given", zero).alias("author_likes_given"),
        F.coalesce("connected_service_count", zero).alias("connected_service_count"),
        "follower_count",
        "following_count",
        F.coalesce("new_follower_count", zero).alias("new_follower_count"),
        F.coalesce("network_snapshot_available", F.lit(False)).alias("network_snapshot_available"),
        "comment_count_recorded",
        "like_count_recorded",
        "comment_count_7d",
        "like_count_7d",
        "engagement_count_7d",
        "has_full_7d_window",
        bands.TEXT_LENGTH.of(F.col("character_count")).alias("post_length_band"),
        bands.TIME_OF_DAY.of(hour).alias("time_of_day"),
        bands.FOLLOWERS.of(followers).alias("follower_band"),
        bands.ACTIVITY.of(F.col("author_post_count")).alias("author_activity_band"),
        (F.col("engagement_count_7d").cast("double") / (followers + 1)).alias(
            "reach_adjusted_engagement"
        ),
        (
            F.col("timestamp_in_study_window")
            & F.col("has_full_7d_window")
            & F.col("post_id").isNotNull()
            & F.col("author_id").isNotNull()
        ).alias("analysis_eligible"),
    )
