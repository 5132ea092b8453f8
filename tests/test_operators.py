import math
import random
from collections import Counter
from datetime import datetime, timedelta
from fractions import Fraction
from itertools import combinations
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from compare import spark_rows
from tallyreach.operators import quantiles
from tallyreach.operators.authors import author_statistics, degree_counts
from tallyreach.operators.categories import top_categories, with_category_group
from tallyreach.operators.dedup import first_per_key
from tallyreach.operators.engagement import windowed_counts
from tallyreach.operators.itemsets import antecedent_text, frequent_itemset_counts, itemset_counts
from tallyreach.operators.labels import thresholds, with_labels
from tallyreach.operators.quantiles import Quantile, exact_quantiles
from tallyreach.operators.rules import definition, population
from tallyreach.operators.sensitivity import sensitivity_grid
from tallyreach.sources.storage import scratch_table
from workload import queries, tables

SF = "/root/testdata/sf0.001"
DAY = datetime(2010, 8, 1)


def test_first_per_key_puts_missing_last_and_breaks_ties(spark):
    rows = spark.createDataFrame(
        [("a", None, "f", 1), ("a", 5, "g", 2), ("b", 1, "g", 3), ("b", 1, "f", 4), ("b", 1, "f", 0)],
        "k string, t int, f string, x int",
    )
    found = first_per_key(rows, ["k"], ["t", "f"]).collect()
    assert sorted((row["k"], row["x"]) for row in found) == [("a", 2), ("b", 0)]


def test_first_per_key_cuts_before_the_shuffle(spark):
    rows = queries.table(spark, SF, "lineitem")
    plan = first_per_key(rows, ["l_orderkey"], ["l_shipdate"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def _engagement_input(spark):
    items = spark.createDataFrame(
        [("a", DAY), ("b", None), ("c", DAY)], "post_id string, posted_at timestamp_ntz"
    )
    week = timedelta(days=7)
    likes = spark.createDataFrame(
        [
            ("a", DAY),
            ("a", DAY + week),
            ("a", DAY + week - timedelta(microseconds=1)),
            ("a", DAY - timedelta(seconds=1)),
            ("a", None),
            ("b", DAY),
            ("gone", DAY),
            (None, DAY),
        ],
        "post_id string, liked_at timestamp_ntz",
    )
    return items, likes


def test_window_edges(spark):
    items, likes = _engagement_input(spark)
    counted = windowed_counts(
        items,
        {"like": (likes, "post_id", "liked_at")},
        "post_id",
        "posted_at",
        timedelta(days=7),
    )
    found = {row["post_id"]: row for row in counted.collect()}
    assert len(found) == counted.count() == 3
    assert (found["a"]["like_count_recorded"], found["a"]["like_count_7d"]) == (5, 2)
    assert (found["b"]["like_count_recorded"], found["b"]["like_count_7d"]) == (1, 0)
    assert (found["c"]["like_count_recorded"], found["c"]["engagement_count_7d"]) == (0, 0)


def test_a_hot_key_is_split_and_counted_in_full(spark):
    """Half of all likes on one post, and 5,000 more posts with many each."""
    likes = spark.range(400_000).select(
        F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 5003).alias("post_id"),
        F.lit(DAY).alias("liked_at"),
    )
    items = spark.range(-1, 6000).select(F.col("id").alias("post_id"), F.lit(DAY).alias("posted_at"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        counted = windowed_counts(
            items, {"like": (likes, "post_id", "liked_at")}, "post_id", "posted_at", timedelta(days=7)
        )
        found = {row["post_id"]: row["like_count_7d"] for row in counted.collect()}
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert "skew=true" in plan
    assert found[-1] == 200_000 and sum(found.values()) == 400_000 and len(found) == 6001
    assert found[5500] == 0


def test_author_statistics_unknown_is_not_zero(spark):
    posts = spark.createDataFrame(
        [("a", DAY), ("a", None), ("b", DAY), (None, DAY)],
        "author_id string, posted_at timestamp_ntz",
    )
    people = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "author_id string")
    likes = people.select(F.col("author_id").alias("user_id"))
    services = spark.createDataFrame([("a", "s"), ("a", "s"), ("a", None)], "user_id string, service_id string")
    edges = spark.createDataFrame(
        [("x", "a"), ("x", "a"), ("y", "a"), ("a", "b")],
        "subscriber_id string, subscribed_to_id string",
    )
    events = spark.createDataFrame([("b", "x"), ("b", "x")], "followed_id string, follower_id string")
    users = spark.createDataFrame(
        [("a", "f2", "late", "text"), ("a", "f1", "early", None)],
        "user_id string, source_file string, user_type string, user_description string",
    )
    found = {
        row["author_id"]: row.asDict()
        for row in author_statistics(posts, people, likes, services, edges, events, users).collect()
    }
    assert set(found) == {"a", "b"}
    a, b = found["a"], found["b"]
    assert (a["post_count"], a["comments_written"], a["likes_given"]) == (2, 2, 2)
    assert (a["connected_service_count"], a["follower_count"], a["following_count"]) == (1, 2, 1)
    assert (a["user_type"], a["has_profile_description"]) == ("early", False)
    assert (a["first_post_at"], a["new_follower_count"]) == (DAY, 0)
    assert (b["follower_count"], b["following_count"], b["new_follower_count"]) == (1, None, 1)
    assert (b["comments_written"], b["user_type"], b["network_snapshot_available"]) == (0, None, True)


def test_degrees_share_one_shuffle_of_the_edges(spark):
    edges = tables.subscriptions(spark, SF)
    out, into = degree_counts(edges, "subscriber_id", "subscribed_to_id")
    both = out.select("out_degree").unionAll(into.select("in_degree"))
    both.collect()
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()


def test_top_categories_ties_by_name(spark):
    rows = spark.createDataFrame([(c,) for c in "bbaaccd"], "c string")
    top = top_categories(rows, "c", 2)
    assert [row["c"] for row in top.collect()] == ["a", "b"]
    grouped = with_category_group(rows, "c", "g", 2).groupBy("g").count().collect()
    assert {row["g"]: row["count"] for row in grouped} == {"a": 2, "b": 2, "Other": 3}
    assert top_categories(rows, "c", 0).count() == 1


SHAPES = {
    "ints": lambda draw: draw.randint(0, 100_000),
    "ties": lambda draw: int(draw.expovariate(1)),
    "doubles": lambda draw: draw.random() - 0.5,
    "ratios": lambda draw: draw.randint(0, 9) / draw.randint(1, 7),
    "wide": lambda draw: draw.choice([-1, 1]) * 10.0 ** draw.randint(-300, 300),
    "close": lambda draw: 1e9 + draw.randint(0, 50) * 1e-6,
    "endless": lambda draw: draw.choice([1.5, 2.5, math.inf, -math.inf]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_exact_quantiles(spark, shape):
    draw = random.Random(shape)
    numbers = [float(SHAPES[shape](draw)) for _ in range(3001)]
    rows = spark.createDataFrame([(x,) for x in numbers] + [(None,)], "x double")
    fractions = [0.01, 0.5, 0.75, 0.9, 0.95, 0.99]
    wanted = [Quantile(f"d{i}", "x", q) for i, q in enumerate(fractions)]
    wanted += [Quantile(f"c{i}", "x", q, True, 0.0) for i, q in enumerate(fractions)]
    found = exact_quantiles(rows, wanted).first()
    ordered, positive = sorted(numbers), sorted(x for x in numbers if x > 0)
    for i, q in enumerate(fractions):
        assert found[f"d{i}"] == ordered[ceil(Fraction(str(q)) * len(ordered)) - 1]
        place = (len(positive) - 1) * q
        low, high = positive[floor(place)], positive[ceil(place)]
        if low == high:
            assert found[f"c{i}"] == low
        elif math.isfinite(high):
            assert low <= found[f"c{i}"] <= high
            assert found[f"c{i}"] == pytest.approx(low * (1 - place % 1) + high * (place % 1), rel=1e-12)


def test_quantiles_of_large_whole_numbers(spark):
    numbers = [2**62 + n for n in range(101)] + [-(2**63), 2**63 - 1]
    rows = spark.createDataFrame([(n,) for n in numbers], "x bigint")
    found = exact_quantiles(rows, [Quantile("low", "x", 0.001), Quantile("mid", "x", 0.5), Quantile("high", "x", 1.0)]).first()
    assert tuple(found) == (-(2**63), 2**62 + 50, 2**63 - 1)


@pytest.mark.parametrize("ratio", [5 / 3, 7 / 6, 0.1, 1 / 49, 4 / 7])
def test_labels_keep_rows_tied_at_the_threshold(spark, ratio):
    for rows in range(2, 40, 5):
        features = spark.createDataFrame(
            [(True, 5, ratio)] * rows, "analysis_eligible boolean, engagement_count_7d bigint, reach_adjusted_engagement double"
        )
        labelled = with_labels(features, thresholds(features, 0.99))
        assert labelled.filter("high_reach_adjusted_engagement and high_engagement").count() == rows


def test_quantiles_of_one_to_hundred_and_of_nothing(spark):
    rows = spark.range(1, 101).select(F.col("id").alias("x"))
    wanted = [Quantile("d", "x", 0.99), Quantile("c", "x", 0.99, True), Quantile("m", "x", 0.5)]
    assert tuple(exact_quantiles(rows, wanted).first()) == (99.0, pytest.approx(99.01), 50.0)
    assert tuple(exact_quantiles(rows.filter("x > 100"), wanted).first()) == (None, None, None)
    empty = [Quantile("d", "x", 0.5), Quantile("n", "x", 0.5, above=100.0)]
    assert tuple(exact_quantiles(rows, empty).first()) == (50.0, None)


def test_columns_of_a_first_pass_share_one_scale(spark, monkeypatch):
    made = []
    scale = quantiles._scale
    monkeypatch.setattr(quantiles, "_scale", lambda value: made.append(value) or scale(value))
    whole = [F.when(F.col("id") % 7 != 3, F.col("id") * n - 50).alias(f"w{n}") for n in range(1, 7)]
    real = [(F.col("id") / n).alias(f"r{n}") for n in range(1, 7)]
    rows = spark.range(200).select(*whole, *real)
    found = exact_quantiles(rows, [Quantile(c, c, 0.25) for c in rows.columns]).first()
    for n in range(1, 7):
        kept = [i * n - 50 for i in range(200) if i % 7 != 3]
        assert found[f"w{n}"] == kept[ceil(Fraction(1, 4) * len(kept)) - 1]
        assert found[f"r{n}"] == 49 / n
    assert len(made) == 1


def test_thresholds_have_floors(spark):
    rows = spark.createDataFrame(
        [(True, 0, None), (True, 0, 0.0), (False, 9, 9.0)],
        "analysis_eligible boolean, engagement_count_7d bigint, reach_adjusted_engagement double",
    )
    assert tuple(thresholds(rows).first()) == (1, 0.0)
    with pytest.raises(ValueError, match="quantile"):
        thresholds(rows, 1.0)


def _naive(rows, columns, max_size):
    found = {}
    for size in range(1, max_size + 1):
        for chosen in combinations(columns, size):
            for row in rows:
                key = " AND ".join(
                    f"{c}={ {True: 'yes', False: 'no', None: 'missing'}.get(row[c], row[c]) }"
                    for c in chosen
                )
                n = found.setdefault((chosen, tuple(row[c] for c in chosen), key), [0, 0, set(), set()])
                n[0] += 1
                if row["who"] is not None:
                    n[2].add(row["who"])
                if row["hit"]:
                    n[1] += 1
                    if row["who"] is not None:
                        n[3].add(row["who"])
    return Counter((key, n, j, len(w), len(h)) for (_, _, key), (n, j, w, h) in found.items())


@pytest.mark.parametrize("max_size", [1, 2, 3])
def test_itemsets_equal_naive_counts(spark, max_size):
    draw = random.Random(1)
    columns = ["a", "b", "c", "flag"]
    data = [
        {
            "a": draw.choice(["x", "y", None, "missing"]),
            "b": draw.choice(["1", "2"]),
            "c": draw.choice(["p", None]),
            "flag": draw.choice([True, False, None]),
            "who": draw.choice([1, 1, 1, 2, 3, 4, None]),
            "hit": draw.random() < 0.3,
        }
        for _ in range(300)
    ]
    rows = spark.createDataFrame(
        [tuple(row.values()) for row in data],
        "a string, b string, c string, flag boolean, who int, hit boolean",
    )
    counts = itemset_counts(rows, columns, ["hit"], max_size, "who")
    found = Counter(
        tuple(row)
        for row in counts.select(
            antecedent_text(columns, max_size),
            "antecedent_count",
            "joint_hit",
            "entities",
            "entities_hit",
        ).collect()
    )
    assert found == _naive(data, columns, max_size)
    assert all(row["joint_hit"] <= row["antecedent_count"] for row in counts.collect())
    plain = itemset_counts(rows, columns, ["hit"], max_size)
    shared = ["set_id", "values", "antecedent_count", "joint_hit"]
    assert spark_rows(plain.select(shared)) == spark_rows(counts.select(shared))


def test_engagement_shuffles_raw_reactions_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        query = queries.post_engagement(spark, SF)
        plan = query._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The reactions and the posts for the counting join; then counts, by a struct that lets Spark
    # split the join, and the posts and their counts for the last join.
    assert plan.count("Exchange hashpartitioning(post_id") == 4
    assert plan.count("Exchange") == 5 and plan.count("l_shipdate") > 0
    # Neither the text nor any reaction column beyond key, time and kind is read.
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_shipdate:timestamp_ntz>" in (
        query._jdf.queryExecution().toString()
    )
    assert "o_totalprice" not in plan


def test_items_do_not_shuffle_with_their_entity(spark):
    rows = queries.table(spark, SF, "orders").withColumn("hit", F.col("o_totalprice") > 0)
    counts = itemset_counts(rows, ["o_orderstatus", "o_orderpriority"], ["hit"], 2, "o_custkey")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    # Collapsing, bringing an entity together, and adding up the items: three, none of them wide.
    assert plan.count("Exchange") == 3


def test_population_needs_eligible_rows_and_hits(spark):
    rows = spark.createDataFrame([(True, False), (False, True)], "analysis_eligible boolean, hit boolean")
    with pytest.raises(ValueError, match="hit"):
        population(rows, ["hit"])


def test_definition_of_unknown_category_is_missing(spark):
    rows = spark.createDataFrame(
        [("has_image", "yes"), ("has_image", "missing"), ("source_group", "Other"), ("weekday_name", "Monday")],
        "f string, c string",
    )
    found = [row[0] for row in rows.select(definition(F.col("f"), F.col("c"))).collect()]
    assert found[1] is None and found[0].startswith("Post has") and found[3].endswith("Monday")
    assert "20" in found[2]


def test_grid_keeps_empty_cells(spark):
    candidates = spark.createDataFrame(
        [("a=1", True, 10, 0.01, 0.15, 1.5), ("b=1", False, 4, 0.0005, 0.15, 1.5)],
        "antecedent string, uses_source boolean, joint_count bigint, support double, "
        "confidence double, lift double",
    )
    grid = {
        (row["min_support"], row["min_confidence"]): row
        for row in sensitivity_grid(candidates, 0.1).collect()
    }
    assert len(grid) == 16
    loose, strict = grid[0.0001, 0.02], grid[0.0001, 0.2]
    assert (loose["rules"], loose["rules_without_source"], loose["min_joint_posts"]) == (2, 1, 4)
    assert (loose["top_rule"], loose["top_lift"], loose["implied_min_lift"]) == ("a=1", 1.5, 0.2)
    assert (strict["rules"], strict["min_joint_posts"], strict["top_rule"]) == (0, 0, "")
    assert strict["top_lift"] is None


@pytest.mark.parametrize("min_count", [1, 4, 30, 10_000])
def test_frequent_sets_are_those_of_all_sets_that_are_frequent(spark, min_count):
    draw = random.Random(5)
    columns = ["a", "b", "c", "d"]
    values = {"a": "xy", "b": ["p", "q", "r", None], "c": [True, False, None], "d": "lmnop"}
    rows = [
        (*(draw.choice(values[c]) for c in columns), draw.random() < 0.3, draw.choice([None, *range(9)]))
        for _ in range(300)
    ]
    frame = spark.createDataFrame(rows, "a string, b string, c boolean, d string, hit boolean, who int")
    key = lambda r: str(tuple(r))
    for entity in ("who", None):
        every = itemset_counts(frame, columns, ["hit"], 3, entity)
        wanted = every.filter(every["antecedent_count"] >= min_count)
        found = frequent_itemset_counts(frame, columns, ["hit"], 3, min_count, entity)
        assert found.columns == wanted.columns
        assert sorted(found.collect(), key=key) == sorted(wanted.collect(), key=key)


def test_only_frequent_sets_are_extended(spark, monkeypatch):
    """Of 300 rows with a value of their own in one column, none is spread to sets with it."""
    from tallyreach.operators import itemsets

    stored = {}

    def counted(df, name):
        stored[name] = scratch_table(df, name)
        return stored[name]

    monkeypatch.setattr(itemsets, "scratch_table", counted)
    rows = [(f"own{i}", "x", "y", True) for i in range(300)]
    frame = spark.createDataFrame(rows, "own string, b string, c string, hit boolean")
    frequent_itemset_counts(frame, ["own", "b", "c"], ["hit"], 3, 10).collect()
    # Two of three single values are extended; of the pairs only b with c.
    assert stored["spread-1"].count() == 600 and stored["spread-2"].count() == 300


def test_rows_are_spread_as_numbers(spark, monkeypatch):
    """Values of any length are written once, with the item; rows of a set carry their numbers."""
    from tallyreach.operators import itemsets

    stored = {}

    def noted(df, name):
        stored[name] = scratch_table(df, name)
        return stored[name]

    monkeypatch.setattr(itemsets, "scratch_table", noted)
    rows = [(f"{'long ' * 100}{i % 2}", "y", None, i % 3 == 0, i) for i in range(60)]
    frame = spark.createDataFrame(rows, "a string, b string, c string, hit boolean, who int")
    found = frequent_itemset_counts(frame, ["a", "b", "c"], ["hit"], 3, 10, "who").collect()
    assert sorted(row["antecedent_count"] for row in found) == [30] * 8 + [60] * 3
    assert all("string" not in kind for name in ("spread-1", "spread-2") for _, kind in stored[name].dtypes)
