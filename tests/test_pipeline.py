"""The whole run on a small made-up dump, checked against SQL over the same raw lines."""

import csv
import json
import random
import shutil
from dataclasses import replace
from datetime import datetime, timedelta
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyreach.operators.quality import quality_row
from tallyreach.operators.rules import RuleLimits
from tallyreach.plans import pipeline
from tallyreach.plans.pipeline import Settings
from tallyreach.sources import storage
from tallyreach.sources.specs import FieldSpec, TableSpec

START = datetime(2010, 7, 30)


def moment(draw):
    return str(START + timedelta(minutes=draw.randint(0, 60 * 24 * 60)))


def write_dump(folder):
    draw = random.Random(7)
    people = [f"u{i}" for i in range(40)]
    posts, comments, likes, follows, subscriptions, services, users = ([] for _ in range(7))
    for i in range(600):
        author = "u0" if i % 3 == 0 else draw.choice(people)
        text = " ".join(["<b>hi</b>", "#tag", "http://x", "word"] * draw.randint(0, 30))
        posts.append(
            [f"p{i}", author, draw.choice(["Blog", "Wiki", "", " "]), "u", "1.5", "x", moment(draw),
             text, draw.choice(["", "0", "2"]), "", draw.choice(["\\N", "1"]), ""]
        )
    posts += [row[:6] + [moment(draw)] + row[7:] for row in posts[:20]]
    posts += [["short"], [""] * 12, ["p9"] * 13]
    by_id = {row[0]: row[6] for row in posts[:600]}
    for i in range(4000):
        post = "p1" if i % 3 == 0 else f"p{draw.randint(0, 620)}"
        base = datetime.fromisoformat(by_id.get(post, str(START)))
        at = str(base + timedelta(minutes=draw.randint(-3000, 20000)))
        if i % 2:
            comments.append([f"c{i}", post, draw.choice(people), "", "", "", "", at, "text"])
        else:
            likes.append([draw.choice(people), post, at])
    for _ in range(400):
        pair = [draw.choice(people[:30]), draw.choice(people[5:])]
        subscriptions.append(pair)
        follows.append([*pair, moment(draw)])
        services.append([pair[0], draw.choice("abc"), "n", "", "", ""])
    users += [[name, draw.choice(["person", "group"]), "n", "", draw.choice(["", "about"])] for name in people]
    files = {
        "entries1.csv": ("\t", posts[:200]),
        "entries2.csv": ("\t", posts[200:400]),
        "entries3.csv": ("\t", posts[400:]),
        "commentAugSept.csv": ("\t", comments),
        "likes.csv": ("\t", likes),
        "followingAugSept.csv": ("\t", follows),
        "subscriptions.csv": (",", subscriptions),
        "services.csv": ("|", services),
        "users.csv": ("|", users),
    }
    for name, (delimiter, rows) in files.items():
        (folder / name).write_text("".join(delimiter.join(row) + "\n" for row in rows))


def report(folder, name):
    (path,) = (folder / name).glob("*.csv")
    with path.open(newline="") as handle:
        return list(csv.DictReader(handle))


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    (folder / "raw").mkdir()
    write_dump(folder / "raw")
    settings = Settings(
        str(folder), "Host", high_quantile=0.9, rule_limits=RuleLimits(min_count=5, min_lift=1.0)
    )
    pipeline.run(spark, settings)
    pipeline.sensitivity(spark, settings)
    return folder, settings


def test_quality_summary(finished):
    rows = {row["table"]: row for row in report(finished[0], "quality/preprocessing_summary")}
    assert len(rows) == 7
    entries = rows["entries"]
    assert (entries["row_count"], entries["rejected_csv_rows"]) == ("621", "2")
    assert entries["invalid_identifier_rows"] == "1"
    assert entries["parquet_file"] == "parquet/clean/entries"
    assert int(entries["parquet_bytes"]) > 0
    assert rows["users"]["invalid_timestamp_rows"] == ""
    rejected = report(finished[0], "quality/csv_rejects/entries")
    assert sorted(row["field_count"] for row in rejected) == ["1", "13"]


def test_engagement_equals_sql_over_the_raw_files(spark, finished):
    folder = finished[0]
    raw = folder / "raw"
    database = duckdb.connect()

    def lines(pattern):
        return (
            f"SELECT string_split(column0, chr(9)) AS f, filename FROM read_csv('{raw}/{pattern}', "
            "delim=chr(1), header=false, quote='', escape='', auto_detect=false, filename=true, "
            "columns={'column0': 'VARCHAR'})"
        )

    expected = database.execute(
        f"""
        WITH posts AS (
            SELECT f[1] AS post_id, f[7]::TIMESTAMP AS posted_at FROM ({lines('entries*.csv')})
            WHERE len(f) = 12 AND f[1] <> ''
            QUALIFY row_number() OVER (PARTITION BY f[1] ORDER BY f[7]::TIMESTAMP, filename) = 1
        ),
        reactions AS (
            SELECT f[2] AS post_id, f[8]::TIMESTAMP AS happened, 1 AS c FROM ({lines('comment*.csv')})
            UNION ALL
            SELECT f[2], f[3]::TIMESTAMP, 0 FROM ({lines('likes.csv')})
        )
        SELECT
            post_id, count(happened) FILTER (WHERE c = 1), count(happened) FILTER (WHERE c = 0),
            count(happened) FILTER (WHERE happened >= posted_at AND happened < posted_at + INTERVAL 7 DAY)
        FROM posts LEFT JOIN reactions USING (post_id) GROUP BY post_id
        """
    ).fetchall()
    found = spark.read.parquet(f"{folder}/parquet/aggregated/post_engagement").select(
        "post_id", "comment_count_recorded", "like_count_recorded", "engagement_count_7d"
    )
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert len(expected) == 600


def test_features_and_metadata(spark, finished):
    folder = finished[0]
    features = spark.read.parquet(f"{folder}/parquet/features/post_features")
    assert features.count() == features.select("post_id").distinct().count() == 600
    assert len(features.columns) == 41
    assert {r[0] for r in features.select("source_group").distinct().collect()} == {"Blog", "Wiki", "Host"}
    (path,) = (folder / "quality/feature_metadata").glob("*.json")
    metadata = json.loads(path.read_text())
    assert metadata["last_full_window_post_time"] == "2010-09-24T00:00:00"
    assert metadata["engagement_window_days"] == 7
    floor = metadata["high_engagement_minimum_count"]
    wrong = features.filter(
        f"high_engagement <> (analysis_eligible AND engagement_count_7d >= {floor})"
    )
    assert wrong.count() == 0


def test_reports(finished):
    folder = finished[0]
    reports = folder / "reports"
    (overview,) = report(reports, "eda/dataset_overview")
    assert overview["total_posts"] == "600"
    assert len(json.loads(overview["engagement_quantiles"])) == 5
    assert len(report(reports, "eda/column_summary")) == 41
    histogram = report(reports, "eda/engagement_distribution")
    assert sum(int(row["posts"]) for row in histogram) == int(overview["eligible_posts"])
    for target in ("high_engagement", "high_reach_adjusted_engagement"):
        rules = report(reports, f"association_rules/rules_{target}")
        lifts = [float(row["lift"]) for row in rules]
        assert rules and lifts == sorted(lifts, reverse=True)
        assert {row["consequent"] for row in rules} == {f"{target}=yes"}
        assert len(report(reports, f"association_rules/sensitivity_grid_{target}")) == 16
        candidates = report(reports, f"association_rules/sensitivity_rules_{target}")
        plain = report(reports, f"association_rules/rules_without_source_{target}")
        assert {"true", "false"} == {row["uses_source"] for row in candidates}
        assert {row["uses_source"] for row in plain} == {"false"}
    per_feature = {}
    for row in report(reports, "association_rules/category_summary"):
        per_feature.setdefault(row["feature"], []).append(int(row["post_count"]))
    assert {sum(counts) for counts in per_feature.values()} == {int(overview["eligible_posts"])}


def test_second_run_skips_and_force_rebuilds(spark, finished):
    folder, settings = finished
    engagement = folder / "parquet/aggregated/post_engagement"
    before = sorted(p.name for p in engagement.glob("*.parquet"))
    pipeline.run(spark, settings, 1, 3)
    assert sorted(p.name for p in engagement.glob("*.parquet")) == before
    pipeline.run(spark, settings, 2, 2, force=True)
    assert sorted(p.name for p in engagement.glob("*.parquet")) != before


def stored(folder):
    """The data files of every stored table. A table that is written anew has other files."""
    tables = {}
    for path in (folder / "parquet").rglob("*.parquet"):
        group, table = path.relative_to(folder / "parquet").parts[:2]
        tables.setdefault(f"{group}/{table}", set()).add(path.name)
    return tables


def rebuilt(spark, settings):
    folder = Path(settings.data_dir)
    before = stored(folder)
    pipeline.run(spark, settings, 1, 3)
    after = stored(folder)
    assert before.keys() == after.keys()
    return {table for table in after if after[table] != before[table]}


def test_changes_rebuild_what_depends_on_them(spark, finished, tmp_path):
    folder, settings = finished
    shutil.copytree(folder, tmp_path, dirs_exist_ok=True)
    features = {"work/base_features", "features/post_features"}
    authors = {"aggregated/author_statistics"}
    moved = replace(settings, data_dir=str(tmp_path))
    assert rebuilt(spark, moved) == set()

    strict = replace(moved, high_quantile=0.8)
    assert rebuilt(spark, strict) == {"features/post_features"}
    (path,) = (tmp_path / "quality/feature_metadata").glob("*.json")
    assert json.loads(path.read_text())["high_engagement_quantile"] == 0.8

    shorter = replace(strict, window=timedelta(days=3))
    posts = {"work/engaged_posts", "aggregated/post_engagement"}
    assert rebuilt(spark, shorter) == posts | authors | features
    assert rebuilt(spark, shorter) == set()

    with (tmp_path / "raw/users.csv").open("a") as file:
        file.write("new|person|n||about\nshort\n")
    assert rebuilt(spark, shorter) == {"clean/users"} | authors | features
    rows = {row["table"]: row for row in report(tmp_path, "quality/preprocessing_summary")}
    assert (rows["users"]["row_count"], rows["users"]["rejected_csv_rows"]) == ("41", "1")
    (rejected,) = report(tmp_path, "quality/csv_rejects/users")
    assert rejected["line"] == "42"


def test_other_layouts_give_the_same_rows(spark, finished, tmp_path):
    """Posts and reactions by post, clean tables by month; another window reads the same tables by post."""
    folder, settings = finished
    shutil.copytree(folder / "raw", tmp_path / "raw")
    other = replace(settings, data_dir=str(tmp_path), buckets=4, by_month=True)
    pipeline.run(spark, other, 1, 2)

    def equal(one, two, table):
        # The folder is part of the source file.
        names = [name for name in spark.read.parquet(f"{folder}/parquet/{table}").columns if name != "source_file"]
        rows = [spark.read.parquet(f"{place}/parquet/{table}").select(*names) for place in (one, two)]
        return rows[0].exceptAll(rows[1]).isEmpty() and rows[1].exceptAll(rows[0]).isEmpty()

    assert equal(folder, tmp_path, "work/engaged_posts")
    assert equal(folder, tmp_path, "aggregated/author_statistics")
    assert spark.read.parquet(f"{tmp_path}/parquet/work/by_post/likes/heavy").count() > 600
    rows = pipeline.study_rows(spark, other, "following_events")
    plain = pipeline.study_rows(spark, settings, "following_events").drop("source_file")
    assert rows.drop("source_file").exceptAll(plain).isEmpty() and rows.count() == plain.count()
    assert "month_number" in rows._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1]

    before = {path: path.stat().st_mtime_ns for path in tmp_path.glob("parquet/work/by_post/*/_manifest.json")}
    assert len(before) == 3
    shorter = replace(other, window=timedelta(days=3))
    pipeline.aggregate(spark, shorter)
    assert before == {path: path.stat().st_mtime_ns for path in before}
    shutil.copytree(folder, tmp_path / "plain")
    plain = replace(settings, data_dir=f"{tmp_path}/plain", window=timedelta(days=3))
    pipeline.aggregate(spark, plain)
    assert equal(tmp_path / "plain", tmp_path, "aggregated/post_engagement")


def test_quality_counts_are_taken_while_writing(spark, finished):
    _, settings = finished
    counted = pipeline.quality_report(spark, settings)
    assert counted.inputFiles() == []
    for row in counted.collect():
        spec = settings.tables[row["table"]]
        plain = quality_row(
            pipeline.clean_rows(spark, settings, row["table"]),
            row["table"],
            spec.timestamp_flag,
            F.lit(pipeline.rejected_rows(spark, settings, row["table"]).count()),
        )
        assert plain.first().asDict().items() <= row.asDict().items()


def test_tables_of_no_lines_and_without_manifests(spark, tmp_path):
    spec = TableSpec("t", ("t.csv",), ",", (FieldSpec("a"), FieldSpec("b")), ("a",))
    (tmp_path / "t.csv").write_text("")
    settings = Settings(str(tmp_path), "Host", {"t": spec})
    pipeline.preprocess(spark, settings)
    (row,) = pipeline.quality_report(spark, settings).collect()
    assert (row["row_count"], row["invalid_identifier_rows"], row["rejected_csv_rows"]) == (0, 0, 0)
    assert row["invalid_timestamp_rows"] is None
    (tmp_path / "t.csv").write_text("1,x\n,y\n")
    (tmp_path / "parquet/clean/t" / storage.MANIFEST).unlink()
    assert storage.version(spark, settings.clean("t")) is None
    pipeline.preprocess(spark, settings)
    (row,) = pipeline.quality_report(spark, settings).collect()
    assert (row["row_count"], row["invalid_identifier_rows"]) == (2, 1)


def test_wrong_arguments(spark, finished, tmp_path):
    _, settings = finished
    with pytest.raises(ValueError, match="steps"):
        pipeline.run(spark, settings, 4, 2)
    with pytest.raises(ValueError, match="quantile"):
        pipeline.run(spark, replace(settings, high_quantile=0.4), 3, 3)
    with pytest.raises(FileNotFoundError, match="(?s)entries1.*users"):
        pipeline.run(spark, replace(settings, data_dir=str(tmp_path)))
