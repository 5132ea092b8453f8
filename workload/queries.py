"""One query per operator. Each takes a session and the folder of the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreach.functions import bands, text, time
from tallyreach.functions.cleaning import null_tokens, to_double, to_int, to_timestamp
from tallyreach.operators import authors as author_ops
from tallyreach.operators import engagement as engagement_ops
from tallyreach.operators import features as feature_ops
from tallyreach.operators import labels as label_ops
from tallyreach.operators import rules as rule_ops
from tallyreach.operators import sensitivity as sensitivity_ops
from tallyreach.operators import sketches, summaries
from tallyreach.operators.categories import with_category_group
from tallyreach.operators.dedup import first_per_key as first_row
from tallyreach.operators.quality import quality_row
from tallyreach.operators.quality import reject_count as count_rejects
from tallyreach.plans import pipeline
from tallyreach.sources import delimited, layouts, published, storage
from tallyreach.sources.storage import scratch_folder, scratch_table, size_in_bytes
from workload import tables
from workload.tables import table

QUANTILE = 0.9
TARGETS = list(label_ops.TARGETS)
LIMITS = rule_ops.RuleLimits(
    min_support=0.0005, min_confidence=0.02, min_lift=1.0, min_count=50, max_antecedent=2
)
LOOSEST = min(sensitivity_ops.SUPPORT_GRID)
HISTOGRAM_CAP = 3
CHART_MIN_POSTS = 100
CHART_GROUPS = 5


# Raw lines to clean rows.


def ingest_delimited(spark: SparkSession, sf: str) -> DataFrame:
    return delimited.parse(tables.lines(spark, sf), list(tables.LINE_FIELDS), "\t")


def null_token_fields(spark: SparkSession, sf: str) -> DataFrame:
    cut = delimited.split_lines(tables.lines(spark, sf), "\t")
    return cut.select(F.explode("fields").alias("field")).groupBy(
        F.coalesce(null_tokens(F.col("field")), F.lit("(missing)")).alias("field")
    ).agg(F.count("*").alias("times"))


def rejects(spark: SparkSession, sf: str) -> DataFrame:
    return delimited.rejects(tables.lines(spark, sf), len(tables.LINE_FIELDS), "\t")


def reject_count(spark: SparkSession, sf: str) -> DataFrame:
    return count_rejects(rejects(spark, sf))


def _numbered_rejects(spark: SparkSession, sf: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/tallyreach/numbered-{uuid.uuid4().hex}"
    tables.line_files(spark, sf, folder)
    lines = delimited.read_lines(spark, [folder], numbered=True)
    return delimited.rejects(lines, len(tables.LINE_FIELDS), "\t")


def numbered_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rejected lines of text files with their numbers; ``part`` tells the files apart."""
    part = F.regexp_extract("source_file", "part=([0-9]+)/", 1).cast("bigint")
    return _numbered_rejects(spark, sf).withColumn("part", part).drop("source_file")


def rejected_line_count(spark: SparkSession, sf: str) -> DataFrame:
    return count_rejects(_numbered_rejects(spark, sf))


def clean_typed(spark: SparkSession, sf: str) -> DataFrame:
    clean, _ = delimited.clean_table(tables.lines(spark, sf), tables.LINE_SPEC)
    return clean.drop("identifier_is_valid", "timestamp_in_study_window")


def try_casts(spark: SparkSession, sf: str) -> DataFrame:
    return tables.messy_values(spark, sf).select(
        "o_orderkey",
        to_int(F.col("number")).alias("as_int"),
        to_double(F.col("number")).alias("as_double"),
        to_timestamp(F.col("time")).alias("as_time"),
    )


def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    clean, _ = delimited.clean_table(tables.lines(spark, sf), tables.LINE_SPEC)
    return clean.select("post_id", "identifier_is_valid", "timestamp_in_study_window")


def quality_summary(spark: SparkSession, sf: str) -> DataFrame:
    spec = tables.LINE_SPEC
    both = delimited.sorted_out(tables.lines(spark, sf), spec)
    rejected = count_rejects(both.filter("rejected = 1")).scalar()
    return quality_row(both.filter("rejected = 0"), spec.name, spec.timestamp_flag, rejected)


def preprocessing_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of the pipeline on seven raw tables, twice: the second run finds all of them done."""
    folder = f"{scratch_folder(spark)}/tallyreach/dump-{uuid.uuid4().hex}"
    tables.raw_files(spark, sf, f"{folder}/raw")
    settings = pipeline.Settings(folder, tables.DEFAULT_SOURCE, tables.raw_specs())
    for _ in range(2):
        pipeline.preprocess(spark, settings)
    report = pipeline.quality_report(spark, settings)
    return report.withColumn("has_bytes", F.col("parquet_bytes") > 0).drop("parquet_bytes")


def ingest_files(spark: SparkSession, sf: str) -> DataFrame:
    """The lines as text files, a folder for each source, read back and cut."""
    folder = f"{scratch_folder(spark)}/tallyreach/lines-{uuid.uuid4().hex}"
    tables.lines(spark, sf).write.partitionBy("source_file").text(folder)
    lines = delimited.read_lines(spark, [folder])
    source = F.regexp_extract("source_file", "source_file=([^/]+)/", 1)
    return delimited.parse(
        lines.withColumn("source_file", source), list(tables.LINE_FIELDS), "\t"
    )


def stored_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Clean rows written as a Parquet table, twice over, and read back."""
    path = f"{scratch_folder(spark)}/tallyreach/rows-{uuid.uuid4().hex}"
    for _ in range(2):
        rows = storage.materialise(spark, path, lambda: clean_typed(spark, sf), force=True)
    return rows


def published_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Clean rows published as two versions of a table, the second from the first, and read back."""
    path = f"{scratch_folder(spark)}/tallyreach/published-{uuid.uuid4().hex}"
    published.publish(clean_typed(spark, sf), path)
    published.publish(published.read(spark, path), path)
    return published.read(spark, path)


def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per source as a CSV report and as JSON, and read back."""
    folder = f"{scratch_folder(spark)}/tallyreach/report-{uuid.uuid4().hex}"
    counts = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("row_count"))
    storage.write_report(counts.orderBy("source"), f"{folder}/csv")
    storage.write_json(counts, f"{folder}/json")
    read = spark.read.schema("source string, row_count bigint")
    written = read.option("header", True).csv(f"{folder}/csv").withColumn("format", F.lit("csv"))
    return written.unionByName(read.json(f"{folder}/json").withColumn("format", F.lit("json")))


# One row per key, counts per post, authors.


def first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice",
    )
    return first_row(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    return feature_ops.unique_posts(tables.entries(spark, sf), tables.DEFAULT_SOURCE)


def unique_posts(spark: SparkSession, sf: str) -> DataFrame:
    return _posts(spark, sf)


def _slim_posts(spark: SparkSession, sf: str) -> DataFrame:
    """Unique posts without their content, for counts that need none of it."""
    rows = tables.entries(spark, sf).filter("identifier_is_valid").select(
        "post_id", "author_id", "posted_at", "source_file", "timestamp_in_study_window"
    )
    return first_row(rows, ["post_id"], ["posted_at", "source_file"])


def inner_join_window_count(spark: SparkSession, sf: str) -> DataFrame:
    counted = engagement_ops.windowed_counts(
        _slim_posts(spark, sf).select("post_id", "posted_at"),
        {"comment": (table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")},
        "post_id",
        "posted_at",
        tables.WINDOW,
        "365d",
    )
    return counted.filter("comment_count_recorded > 0").select(
        "post_id", "comment_count_recorded", "comment_count_365d"
    )


def _engaged(spark: SparkSession, sf: str, posts: DataFrame) -> DataFrame:
    return engagement_ops.engaged_posts(
        posts,
        tables.comments(spark, sf),
        tables.likes(spark, sf),
        tables.STUDY_START,
        tables.STUDY_END,
        tables.WINDOW,
    )


def post_engagement(spark: SparkSession, sf: str) -> DataFrame:
    posts = _slim_posts(spark, sf).drop("source_file")
    return engagement_ops.post_engagement(_engaged(spark, sf, posts))


BUCKETS = 16


def post_engagement_colocated(spark: SparkSession, sf: str) -> DataFrame:
    """Posts, comments and likes stored by post, then counted without a shuffle."""
    folder = f"{scratch_folder(spark)}/tallyreach/colocated-{uuid.uuid4().hex}"
    inputs = {
        "posts": (_slim_posts(spark, sf).drop("source_file"), "post_id"),
        "comments": (tables.comments(spark, sf), "entry_id"),
        "likes": (tables.likes(spark, sf), "post_id"),
    }
    stored = [
        layouts.colocate(rows, f"{folder}/{name}", key, BUCKETS) for name, (rows, key) in inputs.items()
    ]
    engaged = engagement_ops.engaged_posts_colocated(
        *stored, tables.STUDY_START, tables.STUDY_END, tables.WINDOW
    )
    return engagement_ops.post_engagement(engaged)


def window_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitems stored by month, then counted by flag and day in six weeks of them."""
    path = f"{scratch_folder(spark)}/tallyreach/by-month-{uuid.uuid4().hex}"
    layouts.write_by_month(table(spark, sf, "lineitem"), path, "l_shipdate")
    rows = layouts.read_window(spark, path, "l_shipdate", "1996-02-15", "1996-04-01")
    return rows.groupBy("l_returnflag", F.to_date("l_shipdate").cast("string").alias("day")).agg(
        F.count("*").alias("row_count"), F.sum("l_orderkey").alias("key_sum")
    )


def distinct_authors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.entries(spark, sf).filter("author_id IS NOT NULL").select("author_id").distinct()


def author_activity(spark: SparkSession, sf: str) -> DataFrame:
    return author_ops.author_activity(_slim_posts(spark, sf))


def degree_counts(spark: SparkSession, sf: str) -> DataFrame:
    out, into = author_ops.degree_counts(
        tables.subscriptions(spark, sf), "subscriber_id", "subscribed_to_id"
    )
    return out.select(
        F.lit("following").alias("direction"),
        F.col("subscriber_id").alias("node"),
        F.col("out_degree").alias("degree"),
    ).unionAll(
        into.select(
            F.lit("followers").alias("direction"),
            F.col("subscribed_to_id").alias("node"),
            F.col("in_degree").alias("degree"),
        )
    )


def _authors(spark: SparkSession, sf: str, posts: DataFrame) -> DataFrame:
    return author_ops.author_statistics(
        posts,
        tables.comments(spark, sf),
        tables.likes(spark, sf),
        tables.services(spark, sf),
        tables.subscriptions(spark, sf),
        tables.follow_events(spark, sf),
        tables.users(spark, sf),
    )


def author_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _authors(spark, sf, _slim_posts(spark, sf))


# Features.


def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", text.strip_tags(F.col("html")).alias("visible_text")
    )


def text_features(spark: SparkSession, sf: str) -> DataFrame:
    def measured(frame: DataFrame, kind: str, key: str, column: str) -> DataFrame:
        measures = text.text_measures(F.col(column))
        return frame.select(
            F.lit(kind).alias("kind"),
            F.col(key).alias("id"),
            *[measure.alias(name) for name, measure in measures.items()],
        )

    return measured(table(spark, sf, "documents"), "document", "doc_id", "text").unionAll(
        measured(table(spark, sf, "pages"), "url", "page_id", "url")
    )


def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts")
    return table(spark, sf, "events").select(
        "event_id",
        time.hour(at).alias("post_hour"),
        time.iso_weekday(at).alias("weekday_number"),
        time.weekday_name(at).alias("weekday_name"),
        time.is_weekend(at).alias("is_weekend"),
    )


def band_names(spark: SparkSession, sf: str) -> DataFrame:
    def banded(frame: DataFrame, kind: str, key: str, band) -> DataFrame:
        return frame.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), band.alias("band"))

    shipped = table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.sum(F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))).alias("followers"),
        F.count("*").alias("posts"),
    )
    return (
        banded(
            table(spark, sf, "documents"),
            "length",
            "doc_id",
            bands.TEXT_LENGTH.of(F.length("text")),
        )
        .unionAll(
            banded(
                table(spark, sf, "events"), "hour", "event_id", bands.TIME_OF_DAY.of(F.hour("ts"))
            )
        )
        .unionAll(
            banded(shipped, "followers", "l_partkey", bands.FOLLOWERS.of(F.col("followers")))
        )
        .unionAll(banded(shipped, "activity", "l_partkey", bands.ACTIVITY.of(F.col("posts"))))
    )


def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "source")
    return with_category_group(documents, "source", "source_group", 7)


# Later queries read what earlier steps stored, as the steps of the pipeline do. A stored table is
# built once per session, from the whole tables of the folder.

_stored: dict[tuple, DataFrame] = {}


def _store(
    spark: SparkSession, sf: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, size_in_bytes(spark, sf), name)
    if key not in _stored:
        _stored[key] = scratch_table(build(spark, sf), name)
    return _stored[key]


def _stored_posts(spark: SparkSession, sf: str) -> DataFrame:
    return _store(
        spark, sf, "posts", lambda spark, sf: _engaged(spark, sf, _posts(spark, sf))
    )


def _stored_authors(spark: SparkSession, sf: str) -> DataFrame:
    return _store(
        spark, sf, "authors", lambda spark, sf: _authors(spark, sf, _stored_posts(spark, sf))
    )


def post_features(spark: SparkSession, sf: str) -> DataFrame:
    return feature_ops.post_features(
        _stored_posts(spark, sf), _stored_authors(spark, sf), tables.TOP_SOURCES
    )


def post_features_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same features from posts and engagement that are stored apart."""
    engaged = engagement_ops.with_engagement(
        _posts(spark, sf), engagement_ops.post_engagement(_stored_posts(spark, sf))
    )
    return feature_ops.post_features(engaged, _stored_authors(spark, sf), tables.TOP_SOURCES)


def _stored_features(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf, "features", post_features)


def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return label_ops.thresholds(_stored_features(spark, sf), QUANTILE)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return label_ops.with_labels(_stored_features(spark, sf), thresholds(spark, sf))


def labels_tied(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of lineitems by ratios of small numbers; a fifth of all rows hold the highest."""
    quantity = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select(
        "l_returnflag",
        F.lit(True).alias("analysis_eligible"),
        quantity.cast("bigint").alias("engagement_count_7d"),
        (F.ceil(quantity / 10) / F.lit(3.0)).alias("reach_adjusted_engagement"),
    )
    labelled = label_ops.with_labels(rows, label_ops.thresholds(rows, 0.99))
    return labelled.groupBy("l_returnflag").agg(
        F.count("*").alias("row_count"),
        F.count_if("high_engagement").alias("high_rows"),
        F.count_if("high_reach_adjusted_engagement").alias("high_reach_rows"),
    )


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf, "labelled", labels)


# Summaries.


def feature_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return label_ops.feature_metadata(
        thresholds(spark, sf),
        QUANTILE,
        tables.TOP_SOURCES,
        tables.WINDOW.days,
        "2000-01-02T00:00:00",
    )


def overview(spark: SparkSession, sf: str) -> DataFrame:
    row = summaries.overview(_labelled(spark, sf))
    quantiles = [
        F.get("engagement_quantiles", F.lit(i)).alias(f"p{round(100 * fraction)}")
        for i, fraction in enumerate(summaries.OVERVIEW_QUANTILES)
    ]
    return row.select("*", *quantiles).drop("engagement_quantiles")


def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    rounded = {name: F.round(name, 6) for name in ("avg", "std")}
    return summaries.column_profile(_labelled(spark, sf)).withColumns(rounded).drop("column_type")


def sketch_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitems by sketches of each month, merged: are they as near to exact counts as they should be?"""
    rows = table(spark, sf, "lineitem")
    monthly = rows.withColumn("month", F.date_trunc("month", "l_shipdate"))
    parts = scratch_table(sketches.column_sketches(monthly, ("month",)), "sketches")
    profile = scratch_table(sketches.sketch_profile(sketches.merged(parts)), "profile")

    # A row a column: how many of the values lie below each quartile, and at it or below. RANK_ERROR holds 99
    # times of 100; twice as much is off by chance once in a million.
    checks = []
    for row in profile.filter("q50 IS NOT NULL").collect():
        value = F.col(row["column_name"]).cast("double")
        near = F.lit(True)
        for at, fraction in summaries.QUARTILES.items():
            present = F.count(value)
            near &= F.count_if(value < row[at]) <= (fraction + 2 * sketches.RANK_ERROR) * present
            near &= F.count_if(value <= row[at]) >= (fraction - 2 * sketches.RANK_ERROR) * present
        checks.append(F.struct(F.lit(row["column_name"]).alias("column_name"), near.alias("quartiles_within")))
    ranks = rows.agg(F.array(*checks).alias("checks")).select(F.inline("checks"))
    values = F.array(
        *[F.struct(F.lit(n).alias("column_name"), F.col(n).cast("string").alias("value")) for n in rows.columns]
    )
    exact = rows.select(F.inline(values)).distinct().groupBy("column_name").agg(F.count("value").alias("distinct"))
    # Three standard errors, and one for the rounding to whole values.
    off = F.abs(F.col("distinct_values") - F.col("distinct"))
    return profile.join(exact, "column_name").join(ranks, "column_name", "left").select(
        "column_name",
        F.col("count").alias("row_count"),
        "min",
        "max",
        F.col("distinct").alias("distinct_values"),
        (off <= 3 * sketches.DISTINCT_ERROR * F.col("distinct") + 1).alias("distinct_within"),
        "quartiles_within",
    )


def capped_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.capped_histogram(_labelled(spark, sf), cap=HISTOGRAM_CAP)


def profile_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.profile_by_source(_labelled(spark, sf), CHART_MIN_POSTS, CHART_GROUPS)


def profile_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.profile_by_hour(_labelled(spark, sf))


def profile_by_band(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.profile_by_band(_labelled(spark, sf))


# Rules.


def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rule_ops.category_summary(_labelled(spark, sf), top_sources=tables.TOP_SOURCES)


def rule_counts(spark: SparkSession, sf: str) -> DataFrame:
    return rule_ops.rule_counts(_labelled(spark, sf), rule_ops.RULE_COLUMNS, TARGETS)


def rules(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _labelled(spark, sf)
    return rule_ops.mine_rules(labelled, TARGETS, limits=LIMITS)


def frequent_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of antecedents of up to three values that are frequent, found level by level."""
    return rule_ops.rule_counts(
        _labelled(spark, sf), rule_ops.RULE_COLUMNS, TARGETS, 3, min_count=LIMITS.min_count
    )


def rules_of_three(spark: SparkSession, sf: str) -> DataFrame:
    return rule_ops.mine_rules(
        _labelled(spark, sf), TARGETS, limits=replace(LIMITS, max_antecedent=3)
    )


def _candidates(spark: SparkSession, sf: str) -> tuple[DataFrame, float]:
    labelled = _labelled(spark, sf)
    target = TARGETS[0]
    found = rule_ops.population(labelled, [target])
    return rule_ops.rule_candidates(labelled, target, found, LOOSEST), found.baseline(target)


def rule_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf)[0]


def sensitivity_grid(spark: SparkSession, sf: str) -> DataFrame:
    candidates, baseline = _candidates(spark, sf)
    return sensitivity_ops.sensitivity_grid(candidates, baseline)


def rules_without_column(spark: SparkSession, sf: str) -> DataFrame:
    return sensitivity_ops.rules_without_column(_candidates(spark, sf)[0])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "ingest_delimited": ingest_delimited,
    "ingest_files": ingest_files,
    "stored_rows": stored_rows,
    "published_rows": published_rows,
    "report_rows": report_rows,
    "null_tokens": null_token_fields,
    "rejects": rejects,
    "reject_count": reject_count,
    "numbered_rejects": numbered_rejects,
    "rejected_line_count": rejected_line_count,
    "clean_typed": clean_typed,
    "try_casts": try_casts,
    "quality_flags": quality_flags,
    "quality_summary": quality_summary,
    "preprocessing_summary": preprocessing_summary,
    "first_per_key": first_per_key,
    "unique_posts": unique_posts,
    "inner_join_window_count": inner_join_window_count,
    "post_engagement": post_engagement,
    "post_engagement_colocated": post_engagement_colocated,
    "window_by_month": window_by_month,
    "distinct_authors": distinct_authors,
    "author_activity": author_activity,
    "degree_counts": degree_counts,
    "author_statistics": author_statistics,
    "strip_tags": strip_tags,
    "text_features": text_features,
    "calendar_features": calendar_features,
    "bands": band_names,
    "top_categories": top_categories,
    "post_features": post_features,
    "post_features_joined": post_features_joined,
    "thresholds": thresholds,
    "labels": labels,
    "labels_tied": labels_tied,
    "feature_metadata": feature_metadata,
    "overview": overview,
    "column_profile": column_profile,
    "sketch_profile": sketch_profile,
    "capped_histogram": capped_histogram,
    "profile_by_source": profile_by_source,
    "profile_by_hour": profile_by_hour,
    "profile_by_band": profile_by_band,
    "category_summary": category_summary,
    "rule_counts": rule_counts,
    "frequent_triples": frequent_triples,
    "rules_of_three": rules_of_three,
    "rules": rules,
    "rule_candidates": rule_candidates,
    "sensitivity_grid": sensitivity_grid,
    "rules_without_column": rules_without_column,
}
