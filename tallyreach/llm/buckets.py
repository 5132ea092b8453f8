"""Links between alike documents that share buckets, without comparing all pairs of a bucket.

All members of a bucket are compared with its member of the highest weight, the pivot. Members of one
pivot whose classes still differ are told apart by their differences from it, the elements that one of the two has
and the other lacks. What sets two documents apart are the elements in which their differences differ, so
two that are alike enough share one of the rarer elements of their differences, and only
such pairs are compared. That is exact: :func:`_keyed` and :func:`_may_link` tell the bounds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyreach.llm.components import components
from tallyreach.sources.storage import scratch_table

Measure = Callable[[DataFrame], DataFrame]


def _round(
    pairs: DataFrame, links: DataFrame | None, measure: Measure, threshold: float
) -> tuple[DataFrame, DataFrame]:
    """Measure ``pairs``, and add those that are alike to ``links``."""
    measured = measure(scratch_table(pairs.distinct(), "pairs"))
    found = measured.filter(F.col("similarity") >= threshold).select("a", "b")
    links = found if links is None else scratch_table(links.unionAll(found), "links")
    return measured, links


def _ordered(one: Column, other: Column) -> list[Column]:
    return [F.greatest(one, other).alias("a"), F.least(one, other).alias("b")]


def _placed(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with the ``component`` that ``links`` put each into, itself without any."""
    classes = scratch_table(components(links), "classes")
    found = members.join(classes, members["doc_id"] == classes["node"], "left")
    return found.select(members["*"], F.coalesce("component", "doc_id").alias("component"))


def _keyed(apart: DataFrame, threshold: float) -> DataFrame:
    """The rarer elements of each difference that another one of the same pivot shares.

    ``before`` is the number of rarer elements in the difference. Where two documents are alike, the
    elements that only one difference has are at most (1 - t) / t of the elements of either document. The rarest
    shared element has no others before it.
    """
    elements = apart.select(
        "pivot", "doc_id", "size", F.size("apart").alias("width"), F.explode("apart").alias("element")
    )
    often = elements.groupBy("pivot", "element").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("pivot", "doc_id").orderBy("often", "element")
    ranked = elements.join(often, ["pivot", "element"]).withColumn(
        "before", F.row_number().over(rarest) - 1
    )
    most = F.col("size") * ((1 - threshold) / threshold) + 1e-6
    return ranked.filter((F.col("often") > 1) & (F.col("before") <= most)).drop("often")


def _may_link(x: str, y: str, threshold: float) -> Column:
    """Whether two documents in different classes may be alike, by an element that both differences have.

    If it is the rarest of those, then what is ``before`` it is in one difference only. Alike documents
    have at most (1 - t) / (1 + t) of all their elements in one difference only, which with the widths
    bounds those of each side.
    """
    of = lambda side, name: F.col(f"{side}.{name}")
    most = (of(x, "size") + of(y, "size")) * ((1 - threshold) / (1 + threshold)) + 1e-6
    wider = of(x, "width") - of(y, "width")
    return (
        (of(x, "component") != of(y, "component"))
        & (2 * of(x, "before") <= most + wider)
        & (2 * of(y, "before") <= most - wider)
    )


def bucket_links(
    members: DataFrame, measure: Measure, differences: Callable[[DataFrame], DataFrame], threshold: float
) -> DataFrame:
    """Pairs a, b of alike documents that connect all alike documents of every bucket.

    ``members`` has a row for each bucket (key) and document in it, with the document's ``weight``.
    ``measure`` adds to stored pairs their ``similarity``, and whether it is ``exact`` or an upper bound
    of one below the threshold. ``differences`` adds to stored rows of doc_id and pivot the ``size`` of the
    document's set and ``apart``, an array of the elements that are in one set of the two only.
    """
    pivots = scratch_table(
        members.groupBy("key")
        .agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("negative"))).alias("top"))
        .select("key", (-F.col("top.negative")).alias("pivot")),
        "pivots",
    )
    others = members.join(pivots, "key").filter("doc_id <> pivot").select("doc_id", "pivot")
    others = scratch_table(others.distinct(), "others")
    measured, links = _round(
        others.select(*_ordered(F.col("doc_id"), F.col("pivot"))), None, measure, threshold
    )
    # Who may still have a link that no comparison with the pivot has shown?
    near = scratch_table(
        others.select("doc_id", "pivot", *_ordered(F.col("doc_id"), F.col("pivot")))
        .join(measured, ["a", "b"])
        .select("doc_id", "pivot", "similarity"),
        "near",
    )
    failed = scratch_table(
        near.filter(F.col("similarity") < threshold)
        .groupBy("pivot")
        .agg(F.max("similarity").alias("nearest")),
        "failed",
    )
    # Distance is a metric.
    reach = 1 - threshold
    left = near.join(failed, "pivot").filter(F.col("similarity") <= F.col("nearest") + reach + 1e-6)
    left = scratch_table(left.select("doc_id", "pivot"), "left")
    placed = scratch_table(_placed(left, links), "placed")
    several = placed.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    several = scratch_table(several.filter("low < high").select("pivot"), "several")
    members = scratch_table(placed.join(several, "pivot").select("doc_id", "pivot"), "members")
    if members.isEmpty():
        return links
    apart = scratch_table(differences(members), "apart")
    keyed = scratch_table(_keyed(apart, threshold), "keyed")
    # All that share an element with one of them, so that copies of an edited text become one class.
    now = scratch_table(_placed(keyed, links), "placed")
    heads = now.groupBy("pivot", "element").agg(
        F.min(F.struct("doc_id", "size", "width", "before", "component")).alias("y")
    )
    one = ["pivot", "element"]
    pairs = (
        now.alias("x").join(heads, one).filter(_may_link("x", "y", threshold))
        .select(*_ordered(F.col("x.doc_id"), F.col("y.doc_id")))
    )
    _, links = _round(pairs, links, measure, threshold)
    now = scratch_table(_placed(keyed, links), "placed")
    pairs = (
        now.alias("x").join(now.alias("y"), one)
        .filter((F.col("x.doc_id") > F.col("y.doc_id")) & _may_link("x", "y", threshold))
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    )
    return _round(pairs, links, measure, threshold)[1]
