"""How the set of rules changes with the thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The grid.
SUPPORT_GRID = (0.0001, 0.0005, 0.001, 0.002)
CONFIDENCE_GRID = (0.02, 0.05, 0.10, 0.20)


def sensitivity_grid(
    candidates: DataFrame,
    baseline: float,
    supports: tuple[float, ...] = SUPPORT_GRID,
    confidences: tuple[float, ...] = CONFIDENCE_GRID,
) -> DataFrame:
    """One row per pair of thresholds, also where no rule is left.

    The candidates are read once and never multiplied: each cell is a handful of conditional
    aggregates, and the single wide row is turned into one row per cell at the end.
    """
    measures, cells = [], []
    number = 0
    for support in supports:
        for confidence in confidences:
            kept = (F.col("support") >= support) & (F.col("confidence") >= confidence)
            best = F.min(
                F.when(
                    kept,
                    F.struct(
                        (-F.col("lift")).alias("worst_lift"),
                        (-F.col("support")).alias("worst_support"),
                        F.col("antecedent"),
                    ),
                )
            )
            measures += [
                F.count_if(kept).alias(f"rules{number}"),
                F.count_if(kept & ~F.col("uses_source")).alias(f"plain{number}"),
                F.min(F.when(kept, F.col("joint_count"))).alias(f"joint{number}"),
                best.alias(f"best{number}"),
            ]
            cells.append(
                F.struct(
                    F.lit(support).alias("min_support"),
                    F.lit(confidence).alias("min_confidence"),
                    F.round(F.lit(confidence / baseline), 2).alias("implied_min_lift"),
                    F.col(f"rules{number}").alias("rules"),
                    F.col(f"plain{number}").alias("rules_without_source"),
                    F.coalesce(f"joint{number}", F.lit(0).cast("bigint")).alias("min_joint_posts"),
                    F.coalesce(f"best{number}.antecedent", F.lit("")).alias("top_rule"),
                    F.round(-F.col(f"best{number}.worst_lift"), 2).alias("top_lift"),
                )
            )
            number += 1
    return candidates.agg(*measures).select(F.inline(F.array(*cells)))


def rules_without_column(
    candidates: DataFrame,
    min_support: float = min(SUPPORT_GRID),
    min_confidence: float = min(CONFIDENCE_GRID),
) -> DataFrame:
    """Candidates above both limits that do not use the source column."""
    return candidates.filter(
        ~F.col("uses_source")
        & (F.col("support") >= min_support)
        & (F.col("confidence") >= min_confidence)
    )
