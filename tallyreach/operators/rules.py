"""Association rules ``feature combination => target`` and what supports them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyreach.operators.categories import TOP_CATEGORIES
from tallyreach.operators.itemsets import (
    antecedent_text,
    frequent_itemset_counts,
    itemset_counts,
    set_size,
    uses_column,
)

# The feature columns that may appear in a rule.
RULE_COLUMNS = (
    "post_length_band",
    "time_of_day",
    "weekday_name",
    "source_group",
    "follower_band",
    "author_activity_band",
    "has_image",
    "has_video",
    "is_weekend",
)

# The plain meaning of each category.
DEFINITIONS = {
    "post_length_band": {
        "empty": "No visible text after HTML tags are removed",
        "short": "1--79 visible characters",
        "medium": "80--199 visible characters",
        "long": "200--499 visible characters",
        "very_long": "At least 500 visible characters",
    },
    "time_of_day": {
        "night": "00:00--05:59 (GMT+1)",
        "morning": "06:00--11:59 (GMT+1)",
        "afternoon": "12:00--17:59 (GMT+1)",
        "evening": "18:00--23:59 (GMT+1)",
    },
    "follower_band": {
        "unknown": "Follower count unavailable in the network snapshot",
        "0": "No recorded followers",
        "1-9": "1--9 recorded followers",
        "10-99": "10--99 recorded followers",
        "100-999": "100--999 recorded followers",
        "1000+": "At least 1,000 recorded followers",
    },
    "author_activity_band": {
        "1-9": "Author published 1--9 posts in the dataset",
        "10-99": "Author published 10--99 posts in the dataset",
        "100-999": "Author published 100--999 posts in the dataset",
        "1000+": "Author published at least 1,000 posts in the dataset",
    },
    "has_image": {
        "no": "Post has no recorded image",
        "yes": "Post has at least one recorded image",
    },
    "has_video": {
        "no": "Post has no recorded video",
        "yes": "Post has at least one recorded video",
    },
    "is_weekend": {
        "no": "Post was published Monday--Friday",
        "yes": "Post was published Saturday or Sunday",
    },
}


@dataclass(frozen=True)
class RuleLimits:
    """What a rule must reach. Fixed default values."""

    min_support: float = 0.0005
    min_confidence: float = 0.05
    min_lift: float = 1.05
    min_count: int = 500
    max_antecedent: int = 2


@dataclass(frozen=True)
class Population:
    """Eligible rows and how many of them hit each target."""

    rows: int
    hits: dict[str, int]

    def baseline(self, target: str) -> float:
        return self.hits[target] / self.rows


def population(features: DataFrame, targets: list[str]) -> Population:
    """Count the eligible rows; an error where there are none, or none for a target."""
    row = (
        features.filter("analysis_eligible")
        .agg(F.count("*"), *[F.count_if(target) for target in targets])
        .first()
    )
    found = Population(row[0], dict(zip(targets, row[1:])))
    for target in targets:
        if not found.rows or not found.hits[target]:
            raise ValueError(f"no usable rows were found for target {target!r}")
    return found


def definition(feature: Column, category: Column, top_sources: int = TOP_CATEGORIES) -> Column:
    """Plain meaning of a category, NULL for one that is not known."""
    known = [
        (f"{name}={value}", meaning)
        for name, meanings in DEFINITIONS.items()
        for value, meaning in meanings.items()
    ]
    table = F.create_map(*[F.lit(text) for pair in known for text in pair])
    # concat gives NULL where the category is missing.
    source = F.when(
        category == "Other", F.lit(f"Source is outside the {top_sources} most frequent services")
    ).otherwise(F.concat(F.lit("Post was published through "), category))
    return (
        F.when(feature == "weekday_name", F.concat(F.lit("Post was published on "), category))
        .when(feature == "source_group", source)
        .otherwise(F.try_element_at(table, F.concat(feature, F.lit("="), category)))
    )


def category_summary(
    features: DataFrame,
    columns: tuple[str, ...] = RULE_COLUMNS,
    target: str = "high_engagement",
    entity: str = "author_id",
    top_sources: int = TOP_CATEGORIES,
) -> DataFrame:
    """Posts, distinct authors and highly engaging posts of every category of every feature.

    ``top_sources`` is how many sources the feature table keeps apart.
    """
    names = list(columns)
    counts = itemset_counts(
        features.filter("analysis_eligible"), names, [target], 1, entity
    )
    feature = F.get(F.lit(names), F.col("set_id"))
    category = F.coalesce(F.get("values", F.lit(0)), F.lit("missing"))
    return (
        counts.select(
            "set_id",
            feature.alias("feature"),
            category.alias("category"),
            F.col("antecedent_count").alias("post_count"),
            F.col("entities").alias("author_count"),
            F.col(f"joint_{target}").alias("high_engagement_count"),
            (F.col(f"joint_{target}") / F.col("antecedent_count")).alias("high_engagement_share"),
        )
        .orderBy("set_id", F.col("post_count").desc(), "category")
        .select(
            "feature",
            "category",
            definition(F.col("feature"), F.col("category"), top_sources).alias("definition"),
            "post_count",
            "author_count",
            "high_engagement_count",
            "high_engagement_share",
        )
    )


def rule_counts(
    features: DataFrame,
    columns: tuple[str, ...],
    targets: list[str],
    max_antecedent: int = 2,
    entity: str = "author_id",
    min_count: int | None = None,
) -> DataFrame:
    """Counts of every antecedent for every target, all targets in one pass.

    With ``min_count`` only antecedents of so many rows, found level by level.
    """
    names = list(columns)
    eligible = features.filter("analysis_eligible")
    if min_count is None:
        counts = itemset_counts(eligible, names, targets, max_antecedent, entity)
    else:
        counts = frequent_itemset_counts(eligible, names, targets, max_antecedent, min_count, entity)
    per_target = F.array(
        *[
            F.struct(
                F.lit(target).alias("target"),
                F.col(f"joint_{target}").alias("joint_count"),
                F.col(f"entities_{target}").alias("joint_author_count"),
            )
            for target in targets
        ]
    )
    return counts.select(
        antecedent_text(names, max_antecedent).alias("antecedent"),
        set_size(names, max_antecedent).alias("antecedent_size"),
        "antecedent_count",
        F.col("entities").alias("antecedent_author_count"),
        F.inline(per_target),
    )


def mine_rules(
    features: DataFrame,
    targets: list[str],
    columns: tuple[str, ...] = RULE_COLUMNS,
    limits: RuleLimits = RuleLimits(),
    entity: str = "author_id",
) -> DataFrame:
    """Rules that reach all limits, strongest lift first, for every target at once.

    Ties in lift go to support, then confidence, then the antecedent text.
    """
    found = population(features, targets)
    # Sets of three and more are too many to spread all; those of two are spread in one pass.
    floor = limits.min_count if limits.max_antecedent > 2 else None
    counts = rule_counts(features, columns, targets, limits.max_antecedent, entity, floor)
    baseline = _by_target({target: found.baseline(target) for target in targets})
    return (
        counts.filter(F.col("antecedent_count") >= limits.min_count)
        .withColumns(
            {
                "support": F.col("joint_count") / F.lit(found.rows),
                "confidence": F.col("joint_count") / F.col("antecedent_count"),
                "target_baseline": baseline,
            }
        )
        .withColumn("lift", F.col("confidence") / F.col("target_baseline"))
        .filter(
            (F.col("support") >= limits.min_support)
            & (F.col("confidence") >= limits.min_confidence)
            & (F.col("lift") >= limits.min_lift)
        )
        .orderBy(
            F.col("lift").desc(),
            F.col("support").desc(),
            F.col("confidence").desc(),
            "antecedent",
            "target",
        )
        .select(
            "antecedent",
            F.concat("target", F.lit("=yes")).alias("consequent"),
            "antecedent_size",
            "antecedent_count",
            "joint_count",
            "antecedent_author_count",
            "joint_author_count",
            "support",
            "confidence",
            "lift",
            "target_baseline",
            F.lit(found.rows).cast("bigint").alias("eligible_posts"),
        )
    )


def _by_target(values: dict[str, float]) -> Column:
    chosen = None
    for target, value in values.items():
        test = F.col("target") == target
        chosen = F.when(test, F.lit(value)) if chosen is None else chosen.when(test, F.lit(value))
    return chosen


def rule_candidates(
    features: DataFrame,
    target: str,
    found: Population,
    loosest_support: float,
    columns: tuple[str, ...] = RULE_COLUMNS,
    max_antecedent: int = 2,
    source_column: str = "source_group",
) -> DataFrame:
    """Every antecedent whose joint count reaches the loosest support, without any other limit."""
    names = list(columns)
    floor = max(1, int(loosest_support * found.rows))
    joint = F.col(f"joint_{target}")
    return (
        itemset_counts(features.filter("analysis_eligible"), names, [target], max_antecedent)
        .filter(joint >= floor)
        .select(
            antecedent_text(names, max_antecedent).alias("antecedent"),
            set_size(names, max_antecedent).alias("antecedent_size"),
            uses_column(names, max_antecedent, source_column).alias("uses_source"),
            "antecedent_count",
            joint.alias("joint_count"),
            (joint / F.lit(found.rows)).alias("support"),
            (joint / F.col("antecedent_count")).alias("confidence"),
        )
        .withColumn("lift", F.col("confidence") / F.lit(found.baseline(target)))
        .orderBy(F.col("lift").desc(), F.col("support").desc(), "antecedent")
    )
