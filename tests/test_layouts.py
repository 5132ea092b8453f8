"""Tables stored by key and by month against plain ones."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from tallyreach.operators.engagement import colocated_counts, windowed_counts
from tallyreach.sources import layouts
from workload.tables import table

SF = "/root/testdata/sf0.01"
BUCKETS = 8
WEEK = timedelta(days=7)


def items(spark):
    opened = datetime(2020, 1, 1)
    rows = [(k, opened + timedelta(hours=k % 50), f"t{k}") for k in range(200)]
    return spark.createDataFrame([*rows, (None, opened, "none")], "item long, opened timestamp_ntz, note string")


def reactions(spark, share):
    """``share`` of 4,000 reactions go to item 7; others to all items, to unknown ones or to none."""
    begin = datetime(2020, 1, 1)
    rows = []
    for n in range(4000):
        key = 7 if n % 100 < share else (None if n % 97 == 0 else n * 7919 % 260)
        rows.append((key, begin + timedelta(hours=n % 300)))
    return spark.createDataFrame(rows, "of long, at timestamp_ntz")


@pytest.mark.parametrize("share", [0, 33, 90])
def test_counts_by_key(spark, tmp_path, share):
    likes, notes = reactions(spark, share), reactions(spark, 0)
    posts = layouts.colocate(items(spark), f"{tmp_path}/items", "item", BUCKETS)
    stored = layouts.colocate(likes, f"{tmp_path}/likes", "of", BUCKETS)
    other = layouts.colocate(notes, f"{tmp_path}/notes", "of", BUCKETS)
    assert stored.heavy_keys == ((7,) if share else ())
    assert stored.heavy.filter("of IS NOT NULL AND of <> 7").count() == 0
    found = colocated_counts(posts, {"like": (stored, "at"), "note": (other, "at")}, "opened", WEEK)
    plain = windowed_counts(
        items(spark), {"like": (likes, "of", "at"), "note": (notes, "of", "at")}, "item", "opened", WEEK
    )
    assert spark_rows(found) == spark_rows(plain)


def test_no_exchange(spark, tmp_path):
    """Large tables, which Spark doesn't broadcast, join and are counted where they lie."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        posts = layouts.colocate(items(spark).filter("item IS NOT NULL"), f"{tmp_path}/items", "item", BUCKETS)
        stored = layouts.colocate(reactions(spark, 0), f"{tmp_path}/likes", "of", BUCKETS)
        found = colocated_counts(posts, {"like": (stored, "at")}, "opened", WEEK)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "Exchange" not in plan
        heavy = layouts.colocate(reactions(spark, 33), f"{tmp_path}/heavy", "of", BUCKETS)
        plan = colocated_counts(posts, {"like": (heavy, "at")}, "opened", WEEK)._jdf
        lines = plan.queryExecution().executedPlan().toString().splitlines()
        # The partial counts of the heavy keys alone.
        assert sum("Exchange hashpartitioning" in line for line in lines) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_buckets_are_even(spark, tmp_path):
    stored = layouts.colocate(reactions(spark, 90), f"{tmp_path}/t", "of", BUCKETS)
    rows = stored.even.groupBy(F.input_file_name()).count().collect()
    assert len(rows) <= BUCKETS
    assert max(row["count"] for row in rows) <= 2 * 4000 / BUCKETS


def test_reopened_and_replaced(spark, tmp_path):
    path = f"{tmp_path}/it's"
    layouts.colocate(reactions(spark, 33), path, "of", BUCKETS)
    again = layouts.open_colocated(spark.newSession(), path)
    both = spark_rows(again.even.unionByName(again.heavy))
    assert both == spark_rows(reactions(spark, 33))
    fewer = layouts.colocate(reactions(spark, 0).limit(10), path, "of", 2)
    assert fewer.even.count() + fewer.heavy.count() == 10
    empty = layouts.colocate(reactions(spark, 0).limit(0), path, "of", 2)
    assert empty.even.count() + empty.heavy.count() == 0


def test_refusals(spark, tmp_path):
    rows = reactions(spark, 0)
    with pytest.raises(TypeError):
        layouts.colocate(rows, f"{tmp_path}/t", "at", 2)
    with pytest.raises(ValueError):
        layouts.colocate(rows, f"{tmp_path}/t", "of", 0)
    with pytest.raises(FileNotFoundError):
        layouts.open_colocated(spark, f"{tmp_path}/t")
    one = layouts.colocate(items(spark), f"{tmp_path}/one", "item", 2)
    two = layouts.colocate(rows, f"{tmp_path}/two", "of", 4)
    with pytest.raises(ValueError):
        colocated_counts(one, {"like": (two, "at")}, "opened", WEEK)


def scanned_rows(df):
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    scans, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if "FileSourceScan" in node.getClass().getSimpleName():
            scans.append(node.metrics().get("numOutputRows").get().value())
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
    return sum(scans)


def test_window_reads_its_months(spark, tmp_path):
    path = f"{tmp_path}/by-month"
    lines = table(spark, SF, "lineitem").select("l_orderkey", "l_shipdate")
    odd = spark.createDataFrame([(1, None)], lines.schema)
    layouts.write_by_month(lines.unionByName(odd), path, "l_shipdate")
    window = layouts.read_window(spark, path, "l_shipdate", "1996-03-01", "1996-04-01")
    plain = lines.filter("l_shipdate >= '1996-03-01' AND l_shipdate < '1996-04-01'")
    assert spark_rows(window) == spark_rows(plain)
    two_months = lines.filter("l_shipdate >= '1996-03-01' AND l_shipdate < '1996-05-01'").count()
    assert 0 < scanned_rows(window) <= two_months < lines.count() / 20
    assert spark.read.parquet(path).count() == lines.count() + 1


def test_partitioned_writes_keep_writers_open_in_any_session(spark, tmp_path, monkeypatch):
    """Without open writers a task sorts all its rows by folder first; the session's setting comes back."""
    from pyspark.sql.readwriter import DataFrameWriter

    from tallyreach.sources import storage

    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet

    def noted(self, *args, **kwargs):
        seen.append(spark.conf.get(name))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    given = spark.conf.get(name)
    rows = spark.range(10).selectExpr("id", "id % 2 AS rejected")
    try:
        for setting, wanted in (("0", str(storage.OPEN_WRITERS)), ("9", "9")):
            spark.conf.set(name, setting)
            storage.write_parquet(rows, f"{tmp_path}/{setting}", ("rejected",))
            assert (seen.pop(), spark.conf.get(name)) == (wanted, setting)
            assert spark.read.parquet(f"{tmp_path}/{setting}").count() == 10
    finally:
        spark.conf.set(name, given)
