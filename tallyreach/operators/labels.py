"""High-engagement labels from percentile thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyreach.operators.quantiles import Quantile, exact_quantiles

# Fixed value: the percentile above which a post counts as highly engaging.
HIGH_QUANTILE = 0.99
TARGETS = ("high_engagement", "high_reach_adjusted_engagement")


def check_quantile(quantile: float) -> float:
    if not 0.5 <= quantile < 1.0:
        raise ValueError(f"the quantile must be at least 0.5 and below 1.0, not {quantile}")
    return quantile


def thresholds(features: DataFrame, quantile: float = HIGH_QUANTILE) -> DataFrame:
    """One row: ``raw_threshold`` and ``reach_threshold`` over the eligible rows.

    The raw one is the nearest-rank quantile of the engagement count, at least 1. The other is
    the interpolated quantile of the positive reach-adjusted ratios, at least 0.
    """
    check_quantile(quantile)
    eligible = features.filter("analysis_eligible").select(
        "engagement_count_7d", "reach_adjusted_engagement"
    )
    found = exact_quantiles(
        eligible,
        [
            Quantile("raw", "engagement_count_7d", quantile),
            Quantile(
                "reach",
                "reach_adjusted_engagement",
                quantile,
                interpolate=True,
                above=0.0,
            ),
        ],
    )
    return found.select(
        F.greatest(F.lit(1).cast("bigint"), F.coalesce("raw", F.lit(0).cast("bigint"))).alias(
            "raw_threshold"
        ),
        F.greatest(F.lit(0.0), F.coalesce("reach", F.lit(0.0))).alias("reach_threshold"),
    )


def with_labels(features: DataFrame, limits: DataFrame) -> DataFrame:
    """Add both labels. ``limits`` is the single row of :func:`thresholds`, read as a scalar."""
    limit = limits.select(F.struct("raw_threshold", "reach_threshold")).scalar()
    raw, reach = limit.getField("raw_threshold"), limit.getField("reach_threshold")
    eligible = F.col("analysis_eligible")
    engaged = F.col("engagement_count_7d")
    ratio = F.col("reach_adjusted_engagement")
    return features.withColumns(
        {
            "high_engagement": eligible & (engaged > 0) & (engaged >= raw),
            "high_reach_adjusted_engagement": eligible
            & ratio.isNotNull()
            & (ratio > 0)
            & (ratio >= reach),
        }
    )


def feature_metadata(
    limits: DataFrame, quantile: float, top_sources: int, window_days: int, last_full_window: str
) -> DataFrame:
    """One row that records the choices behind a feature table."""
    return limits.select(
        F.lit(float(quantile)).alias("high_engagement_quantile"),
        F.col("raw_threshold").alias("high_engagement_minimum_count"),
        F.col("reach_threshold").alias("high_reach_adjusted_engagement_minimum"),
        F.lit("posts with positive engagement").alias("reach_adjusted_quantile_population"),
        F.lit(top_sources).alias("top_source_categories"),
        F.lit(window_days).alias("engagement_window_days"),
        F.lit(last_full_window).alias("last_full_window_post_time"),
    )
