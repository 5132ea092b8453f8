"""Descriptive summaries of a labelled feature table, ready for charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreach.functions import bands
from tallyreach.operators.quantiles import Quantile, exact_quantiles

# The quantiles of the overview and the profile, the histogram cap, the chart limits.
OVERVIEW_QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
HISTOGRAM_CAP = 50
CHART_MIN_POSTS = 100
CHART_GROUPS = 15


def overview(features: DataFrame) -> DataFrame:
    """One row of totals, the mean and the quantiles of engagement."""
    eligible = F.col("analysis_eligible")
    engaged = F.col("engagement_count_7d")
    totals = features.agg(
        F.count("*").alias("total_posts"),
        F.count_if(eligible).alias("eligible_posts"),
        F.count_if(eligible & (engaged == 0)).alias("zero_engagement_posts"),
        F.count_if("high_engagement").alias("high_engagement_posts"),
        F.avg(F.when(eligible, engaged)).alias("mean_engagement_7d"),
        F.count_if(eligible & F.col("follower_count").isNull()).alias("missing_follower_posts"),
    )
    names = [f"p{round(100 * fraction)}" for fraction in OVERVIEW_QUANTILES]
    found = exact_quantiles(
        features.filter(eligible).select("engagement_count_7d"),
        [
            Quantile(name, "engagement_count_7d", fraction)
            for name, fraction in zip(names, OVERVIEW_QUANTILES)
        ],
    ).select(F.array(*[F.col(name).cast("bigint") for name in names]).alias("quantiles"))
    return totals.select(
        "total_posts",
        "eligible_posts",
        "zero_engagement_posts",
        "high_engagement_posts",
        "mean_engagement_7d",
        found.scalar().alias("engagement_quantiles"),
        "missing_follower_posts",
    )


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, range, distinct values, mean, spread, quartiles and gaps, all exact.

    Mean, spread and quartiles (elements of the data) are given for numbers only. Distinct values are
    counted as one grouping of all columns' values, which combines before it shuffles and spreads
    frequent values over all tasks. The quartiles are found when this is called.
    """
    fields = df.schema.fields
    numbers = [field.name for field in fields if isinstance(field.dataType, T.NumericType)]
    wanted = [
        Quantile(f"{at} {name}", name, fraction)
        for name in numbers
        for at, fraction in QUARTILES.items()
    ]
    quartiles = exact_quantiles(df, wanted).first().asDict() if wanted else {}

    measures = [F.count("*").alias("rows")]
    for number, field in enumerate(fields):
        column = named(field.name)
        value = column.cast("double") if field.name in numbers else F.lit(None).cast("double")
        measures += [
            F.min(column).cast("string").alias(f"min{number}"),
            F.max(column).cast("string").alias(f"max{number}"),
            F.avg(value).alias(f"mean{number}"),
            F.stddev(value).alias(f"std{number}"),
            F.count(column).alias(f"present{number}"),
        ]
    rows = [
        F.struct(
            F.lit(field.name).alias("column_name"),
            F.lit(field.dataType.simpleString()).alias("column_type"),
            F.col(f"min{number}").alias("min"),
            F.col(f"max{number}").alias("max"),
            F.col(f"mean{number}").alias("avg"),
            F.col(f"std{number}").alias("std"),
            *[
                F.lit(quartiles.get(f"{at} {field.name}")).cast("double").alias(at)
                for at in QUARTILES
            ],
            F.col("rows").alias("count"),
            F.round(
                F.try_divide((F.col("rows") - F.col(f"present{number}")) * 100.0, "rows"), 2
            ).alias("null_percentage"),
        )
        for number, field in enumerate(fields)
    ]
    profile = df.agg(*measures).select(F.inline(F.array(*rows)))
    values = [
        F.struct(F.lit(field.name).alias("column_name"), named(field.name).cast("string").alias("value"))
        for field in fields
    ]
    distinct = (
        df.select(F.inline(F.array(*values)))
        .filter(F.col("value").isNotNull())
        .distinct()
        .groupBy("column_name")
        .agg(F.count("*").alias("distinct_values"))
    )
    return profile.join(distinct, "column_name", "left").withColumn(
        "distinct_values", F.coalesce("distinct_values", F.lit(0).cast("bigint"))
    )


def named(column: str) -> Column:
    """A column by its name as it is, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def capped_histogram(
    features: DataFrame, column: str = "engagement_count_7d", cap: int = HISTOGRAM_CAP
) -> DataFrame:
    """Eligible rows per value of ``column``, all values from ``cap`` on together."""
    capped = F.least(F.col(column), F.lit(cap).cast(features.schema[column].dataType))
    return (
        features.filter("analysis_eligible")
        .groupBy(capped.alias("engagement"))
        .agg(F.count("*").alias("posts"))
        .orderBy("engagement")
    )


def engagement_by(features: DataFrame, column: str) -> DataFrame:
    """Posts, mean engagement and share of high engagement per value of ``column``."""
    return (
        features.filter("analysis_eligible")
        .groupBy(column)
        .agg(
            F.count("*").alias("posts"),
            F.avg("engagement_count_7d").alias("mean_engagement"),
            F.avg(F.col("high_engagement").cast("int")).alias("high_engagement_share"),
        )
    )


def profile_by_source(
    features: DataFrame, min_posts: int = CHART_MIN_POSTS, groups: int = CHART_GROUPS
) -> DataFrame:
    """The largest source groups of at least ``min_posts`` posts, by rising share."""
    return (
        engagement_by(features, "source_group")
        .filter(F.col("posts") >= min_posts)
        .orderBy(F.col("posts").desc(), "source_group")
        .limit(groups)
        .orderBy("high_engagement_share", "source_group")
    )


def profile_by_hour(features: DataFrame) -> DataFrame:
    return engagement_by(features, "post_hour").orderBy("post_hour")


def profile_by_band(features: DataFrame) -> DataFrame:
    """By follower band, in the natural order of the bands."""
    return engagement_by(features, "follower_band").orderBy(
        bands.band_rank(F.col("follower_band"), bands.FOLLOWERS)
    )
