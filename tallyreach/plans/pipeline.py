"""Raw dump to rules in five steps; each step reads stored tables and writes stored tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyreach.operators import summaries
from tallyreach.operators.authors import author_statistics
from tallyreach.operators.categories import TOP_CATEGORIES
from tallyreach.operators.engagement import (
    engaged_posts,
    engaged_posts_colocated,
    post_engagement,
)
from tallyreach.operators.features import post_features, unique_posts
from tallyreach.operators.labels import (
    HIGH_QUANTILE,
    TARGETS,
    check_quantile,
    feature_metadata,
    thresholds,
    with_labels,
)
from tallyreach.operators.quality import quality_measures
from tallyreach.operators.rules import (
    RuleLimits,
    category_summary,
    mine_rules,
    population,
    rule_candidates,
)
from tallyreach.operators.sensitivity import (
    SUPPORT_GRID,
    rules_without_column,
    sensitivity_grid,
)
from tallyreach.sources import delimited, storage
from tallyreach.sources.layouts import MONTH, Colocated, in_months, materialise_colocated, with_month
from tallyreach.sources.specs import STUDY_END, STUDY_START, TableSpec, dump_tables


@dataclass(frozen=True)
class Settings:
    """``default_source`` names the source of posts that give none: the host network's own name.

    ``tables`` are by default those of the dump, with their checks on the study window given here.
    With ``buckets`` the posts and their reactions are stored by post in as many buckets, so that
    another window is counted without a shuffle. With ``by_month`` clean tables that have a time are stored
    by month, so that the study window reads its months alone; their rows shuffle once for that.
    """

    data_dir: str
    default_source: str
    tables: dict[str, TableSpec] | None = None
    study_start: str = STUDY_START
    study_end: str = STUDY_END
    window: timedelta = timedelta(days=7)
    top_sources: int = TOP_CATEGORIES
    high_quantile: float = HIGH_QUANTILE
    targets: tuple[str, ...] = TARGETS
    rule_limits: RuleLimits = RuleLimits()
    buckets: int | None = None
    by_month: bool = False

    def __post_init__(self) -> None:
        if self.tables is None:
            object.__setattr__(self, "tables", dump_tables(self.study_start, self.study_end))

    def clean(self, table: str) -> str:
        return f"{self.data_dir}/parquet/clean/{table}"

    def work(self, table: str) -> str:
        return f"{self.data_dir}/parquet/work/{table}"

    def aggregated(self, table: str) -> str:
        return f"{self.data_dir}/parquet/aggregated/{table}"

    @property
    def features(self) -> str:
        return f"{self.data_dir}/parquet/features/post_features"

    def months(self, table: str) -> bool:
        """Whether the clean table is stored by month."""
        return self.by_month and self.tables[table].time_check is not None

    def quality(self, name: str) -> str:
        return f"{self.data_dir}/quality/{name}"

    def report(self, name: str) -> str:
        return f"{self.data_dir}/reports/{name}"


def stored_table(spark: SparkSession, settings: Settings, table: str) -> DataFrame:
    """Clean and rejected rows of a table, with all columns."""
    schema = settings.tables[table].schema()
    for name, kind in delimited.REJECT_FIELDS:
        if name not in schema.fieldNames():
            schema = schema.add(name, kind)
    schema = schema.add("rejected", T.IntegerType())
    if settings.months(table):
        schema = schema.add(MONTH, T.IntegerType())
    return spark.read.schema(schema).parquet(settings.clean(table))


def clean_rows(spark: SparkSession, settings: Settings, table: str) -> DataFrame:
    names = settings.tables[table].schema().fieldNames()
    return stored_table(spark, settings, table).filter("rejected = 0").select(*names)


def rejected_rows(spark: SparkSession, settings: Settings, table: str) -> DataFrame:
    rows = stored_table(spark, settings, table).filter("rejected = 1")
    return rows.select(*[name for name, _ in delimited.REJECT_FIELDS])


def valid_rows(spark: SparkSession, settings: Settings, table: str) -> DataFrame:
    return clean_rows(spark, settings, table).filter("identifier_is_valid")


def study_rows(spark: SparkSession, settings: Settings, table: str) -> DataFrame:
    """Valid rows with a time in the window that the table is checked for."""
    check, spec = settings.tables[table].time_check, settings.tables[table]
    rows = stored_table(spark, settings, table).filter("rejected = 0")
    if settings.months(table):
        rows = rows.filter(in_months(check.start, check.end))
    return rows.filter(F.col("identifier_is_valid") & F.col(check.flag)).select(*spec.schema().fieldNames())


def preprocess(spark: SparkSession, settings: Settings, force: bool = False) -> None:
    """Step 1: raw files to clean tables, reject reports and the quality summary.

    A table is written anew where its layout, its study window or one of its raw files has changed.
    """
    raw = storage.raw_directory(spark, settings.data_dir)
    paths = {
        name: [f"{raw}/{file}" for file in spec.files] for name, spec in settings.tables.items()
    }
    storage.require_paths(spark, [path for group in paths.values() for path in group])
    for name, spec in settings.tables.items():
        files = {
            file: storage.list_files(spark, path) for file, path in zip(spec.files, paths[name])
        }
        made_from = {"layout": asdict(spec), "files": files}
        if settings.months(name):
            made_from["by"] = MONTH
        if force or not storage.is_current(spark, settings.clean(name), made_from):
            lines = delimited.read_lines(spark, paths[name])
            rows, parts = delimited.sorted_out(lines, spec), ("rejected",)
            if settings.months(name):
                rows = with_month(rows, spec.time_check.column, *parts)
                parts = (*parts, MONTH)
            storage.write_parquet(
                rows,
                settings.clean(name),
                parts,
                made_from,
                quality_measures(spec.timestamp_flag),
            )
        rejects = settings.quality(f"csv_rejects/{name}")
        if force or not storage.is_current(spark, rejects, made_from):
            report = reject_report(spark, settings, name, paths[name])
            storage.write_lines(report, rejects, made_from)
    storage.write_report(
        quality_report(spark, settings), settings.quality("preprocessing_summary")
    )


def reject_report(spark: SparkSession, settings: Settings, table: str, paths: list[str]) -> DataFrame:
    """The rejected lines with their numbers. Only a table that has any is read again, to count lines."""
    if not _measures(spark, settings, table)["rejected_csv_rows"]:
        return rejected_rows(spark, settings, table).withColumn("line", F.lit(None).cast("bigint"))
    spec = settings.tables[table]
    lines = delimited.read_lines(spark, paths, numbered=True)
    return delimited.rejects(lines, len(spec.fields), spec.delimiter)


def _measures(spark: SparkSession, settings: Settings, table: str) -> dict:
    return storage.read_manifest(spark, settings.clean(table))["measures"]


QUALITY_SCHEMA = (
    "table string, row_count bigint, invalid_identifier_rows bigint, invalid_timestamp_rows bigint, "
    "rejected_csv_rows bigint, parquet_file string, parquet_bytes bigint"
)


def quality_report(spark: SparkSession, settings: Settings) -> DataFrame:
    """One row per clean table, also for tables that an earlier run wrote.

    The counts were taken while the tables were written; no table is read for them.
    """
    rows = []
    for name in settings.tables:
        path = settings.clean(name)
        rows.append(
            {
                "table": name,
                **_measures(spark, settings, name),
                "parquet_file": path.removeprefix(f"{settings.data_dir}/"),
                "parquet_bytes": sum(size for _, size, _ in storage.list_files(spark, path)),
            }
        )
    return spark.createDataFrame(rows, QUALITY_SCHEMA)


def _made_from(spark: SparkSession, settings: Settings, inputs: list[str], **options) -> dict:
    """The versions of the stored tables that another one is made from, and the settings in its making."""
    versions = {
        path.removeprefix(f"{settings.data_dir}/"): storage.version(spark, path) for path in inputs
    }
    return {"inputs": versions, "settings": options}


def _by_post(spark: SparkSession, settings: Settings, force: bool) -> list[Colocated]:
    """Unique posts, comments and likes, stored by post."""
    reactions = {"comments": ("entry_id", "commented_at"), "likes": ("post_id", "liked_at")}

    def posts() -> DataFrame:
        entries = valid_rows(spark, settings, "entries")
        return storage.scratch_table(unique_posts(entries, settings.default_source), "posts")

    def stored(table: str, key: str, build: Callable[[], DataFrame], **options) -> Colocated:
        return materialise_colocated(
            spark,
            settings.work(f"by_post/{table}"),
            build,
            key,
            settings.buckets,
            _made_from(spark, settings, [settings.clean(table)], **options),
            force,
        )

    return [
        stored("entries", "post_id", posts, default_source=settings.default_source),
        *[
            stored(table, columns[0], lambda: valid_rows(spark, settings, table).select(*columns))
            for table, columns in reactions.items()
        ],
    ]


def aggregate(spark: SparkSession, settings: Settings, force: bool = False) -> None:
    """Step 2: unique posts, their engagement, and the authors.

    Like the tables of step 3, each is written anew where one of its inputs or a setting that it
    depends on has changed since.
    """
    storage.require_paths(spark, [settings.clean(name) for name in settings.tables])

    def valid(table: str) -> DataFrame:
        return valid_rows(spark, settings, table)

    def clean(*tables: str) -> list[str]:
        return [settings.clean(table) for table in tables]

    def counted() -> DataFrame:
        study = (settings.study_start, settings.study_end, settings.window)
        if settings.buckets is not None:
            return engaged_posts_colocated(*_by_post(spark, settings, force), *study)
        posts = unique_posts(valid("entries"), settings.default_source)
        return engaged_posts(posts, valid("comments"), valid("likes"), *study)

    posts = storage.materialise(
        spark,
        settings.work("engaged_posts"),
        counted,
        force,
        made_from=_made_from(
            spark,
            settings,
            clean("entries", "comments", "likes"),
            default_source=settings.default_source,
            study=[settings.study_start, settings.study_end],
            window_seconds=settings.window.total_seconds(),
        ),
    )
    stored_posts = settings.work("engaged_posts")
    storage.materialise(
        spark,
        settings.aggregated("post_engagement"),
        lambda: post_engagement(posts),
        force,
        made_from=_made_from(spark, settings, [stored_posts]),
    )
    others = ("comments", "likes", "services", "subscriptions", "following_events", "users")
    storage.materialise(
        spark,
        settings.aggregated("author_statistics"),
        lambda: author_statistics(
            posts,
            valid("comments"),
            valid("likes"),
            valid("services"),
            valid("subscriptions"),
            study_rows(spark, settings, "following_events"),
            valid("users"),
        ),
        force,
        made_from=_made_from(spark, settings, [stored_posts, *clean(*others)]),
    )


def extract_features(spark: SparkSession, settings: Settings, force: bool = False) -> None:
    """Step 3: the labelled feature table and the choices behind it."""
    check_quantile(settings.high_quantile)
    inputs = [settings.work("engaged_posts"), settings.aggregated("author_statistics")]
    storage.require_paths(spark, inputs)
    base = storage.materialise(
        spark,
        settings.work("base_features"),
        lambda: post_features(
            *[spark.read.parquet(path) for path in inputs],
            top_sources=settings.top_sources,
        ),
        force,
        made_from=_made_from(spark, settings, inputs, top_sources=settings.top_sources),
    )
    made_from = _made_from(
        spark, settings, [settings.work("base_features")], high_quantile=settings.high_quantile
    )
    if not force and storage.is_current(spark, settings.features, made_from):
        return
    # Fetched once, so the stored labels and the stored metadata rest on the same two numbers.
    limits = thresholds(base, settings.high_quantile)
    limits = spark.createDataFrame(limits.collect(), limits.schema)
    last = datetime.fromisoformat(settings.study_end) - settings.window
    # Before the features: a run that ends between the two writes both again.
    storage.write_json(
        feature_metadata(
            limits,
            settings.high_quantile,
            settings.top_sources,
            settings.window.days,
            last.isoformat(),
        ),
        settings.quality("feature_metadata"),
    )
    storage.write_parquet(with_labels(base, limits), settings.features, made_from=made_from)


def stored_features(spark: SparkSession, settings: Settings) -> DataFrame:
    storage.require_paths(spark, [settings.features])
    return spark.read.parquet(settings.features)


def explore(spark: SparkSession, settings: Settings, force: bool = False) -> None:
    """Step 4: summaries and the data behind the charts. Always written anew."""
    features = stored_features(spark, settings)
    reports = {
        "dataset_overview": summaries.overview(features),
        "column_summary": summaries.column_profile(features),
        "engagement_distribution": summaries.capped_histogram(features),
        "high_engagement_by_source": summaries.profile_by_source(features),
        "high_engagement_by_hour": summaries.profile_by_hour(features),
        "high_engagement_by_followers": summaries.profile_by_band(features),
    }
    for name, report in reports.items():
        storage.write_report(report, settings.report(f"eda/{name}"))


def associate(spark: SparkSession, settings: Settings, force: bool = False) -> None:
    """Step 5: category summary and rules, both targets in one pass. Always written anew."""
    features = stored_features(spark, settings)
    storage.write_report(
        category_summary(features, top_sources=settings.top_sources),
        settings.report("association_rules/category_summary")
    )
    # The rules of all targets are small; kept apart only in the written reports.
    rules = storage.scratch_table(
        mine_rules(features, list(settings.targets), limits=settings.rule_limits), "rules"
    )
    for target in settings.targets:
        chosen = rules.filter(F.col("consequent") == f"{target}=yes").orderBy(
            F.col("lift").desc(),
            F.col("support").desc(),
            F.col("confidence").desc(),
            "antecedent",
        )
        storage.write_report(chosen, settings.report(f"association_rules/rules_{target}"))


def sensitivity(spark: SparkSession, settings: Settings) -> None:
    """Candidates, threshold grid and rules without the source, per target. Not part of ``run``."""
    features = stored_features(spark, settings)
    found = population(features, list(settings.targets))
    for target in settings.targets:
        candidates = storage.scratch_table(
            rule_candidates(
                features,
                target,
                found,
                min(SUPPORT_GRID),
                max_antecedent=settings.rule_limits.max_antecedent,
            ),
            "candidates",
        )
        ranked = candidates.orderBy(F.col("lift").desc(), F.col("support").desc(), "antecedent")
        folder = settings.report("association_rules")
        storage.write_report(ranked, f"{folder}/sensitivity_rules_{target}")
        storage.write_report(
            sensitivity_grid(candidates, found.baseline(target)),
            f"{folder}/sensitivity_grid_{target}",
        )
        storage.write_report(
            rules_without_column(ranked), f"{folder}/rules_without_source_{target}"
        )


STEPS = (preprocess, aggregate, extract_features, explore, associate)


def run(
    spark: SparkSession,
    settings: Settings,
    from_step: int = 1,
    to_step: int = len(STEPS),
    force: bool = False,
) -> None:
    """Run the steps ``from_step`` to ``to_step``, counted from 1; the first failure ends the run."""
    if not 1 <= from_step <= to_step <= len(STEPS):
        raise ValueError(f"steps run from 1 to {len(STEPS)}, in rising order")
    for step in STEPS[from_step - 1 : to_step]:
        step(spark, settings, force)
