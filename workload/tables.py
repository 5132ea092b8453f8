"""The given tables in the roles that the operators expect.

Orders play the posts, lineitems the reactions and the follower edges, customers the users. Every
role covers its whole table; shares of rows that are odd in some way depend on status and priority.
"""

from __future__ import annotations

from datetime import timedelta
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyreach.functions.time import in_window, moment
from tallyreach.sources.specs import FieldSpec, TableSpec, TimeCheck

STUDY_START, STUDY_END = "1996-01-01", "2001-01-01"
# The order dates of the test data are days apart, so a week would hold almost no reaction.
WINDOW = timedelta(days=365)
DEFAULT_SOURCE = "in house"
TOP_SOURCES = 7


@lru_cache(maxsize=None)
def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table. The file list and schema are looked up once per session, no data is kept."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as posts, at all hours. Those of status P come twice, the earlier copy in another file."""
    orders = table(spark, sf, "orders")
    hours = F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    items = F.repeat(
        F.concat(F.lit("#"), status, F.lit(" item ")),
        F.floor(F.col("o_totalprice") / 20000).cast("int"),
    )
    text = F.concat(
        F.lit("<b>"),
        priority,
        F.lit("</b> "),
        items,
        F.when(status == "F", "see https://shop/").otherwise(""),
    )
    posts = orders.select(
        F.col("o_orderkey").alias("post_id"),
        F.col("o_custkey").alias("author_id"),
        F.when(status == "P", " ")
        .otherwise(F.concat(priority, F.lit(" "), status))
        .alias("source_name"),
        (F.col("o_orderdate") + hours).alias("posted_at"),
        F.when(priority != "5-LOW", text).alias("post_text"),
        F.when(status != "F", F.floor(F.col("o_totalprice") / 100000).cast("int")).alias(
            "image_count"
        ),
        F.when(priority == "1-URGENT", 1).when(priority == "2-HIGH", 0).alias("video_count"),
        F.lit("posts").alias("source_file"),
    )
    copies = posts.filter(F.col("source_name") == " ").withColumns(
        {
            "posted_at": F.col("posted_at") - F.lit(timedelta(days=10)),
            "source_file": F.lit("copies"),
        }
    )
    both = posts.unionByName(copies)
    return both.withColumns(
        {
            "identifier_is_valid": F.col("post_id").isNotNull() & F.col("author_id").isNotNull(),
            "timestamp_in_study_window": _in_study(F.col("posted_at")),
        }
    )


def _in_study(time: Column) -> Column:
    return in_window(time, moment(STUDY_START), moment(STUDY_END))


def comments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(
        F.col("l_orderkey").alias("entry_id"),
        F.col("l_suppkey").alias("author_id"),
        F.col("l_shipdate").alias("commented_at"),
    )


def likes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter("l_returnflag <> 'A'").select(
        F.col("l_partkey").alias("user_id"),
        F.col("l_orderkey").alias("post_id"),
        F.col("l_shipdate").alias("liked_at"),
    )


def services(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("service_id")
    )


def subscriptions(spark: SparkSession, sf: str) -> DataFrame:
    """All lineitems as edges; the followed end of the seventh of an order is not known."""
    followed = F.when(F.col("l_linenumber") != 7, F.col("l_partkey"))
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("subscriber_id"), followed.alias("subscribed_to_id")
    )


def follow_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").filter(_in_study(F.col("l_shipdate"))).select(
        F.col("l_partkey").alias("followed_id"), F.col("l_suppkey").alias("follower_id")
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    """Customers; those in debt come twice, the copy in a file that sorts first."""
    current = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.lower("c_mktsegment").alias("user_type"),
        F.when(F.col("c_acctbal") < 5000, F.col("c_name")).alias("user_description"),
        F.lit("users").alias("source_file"),
        "c_acctbal",
    )
    archived = current.filter("c_acctbal < 0").withColumns(
        {"user_type": F.lit("archived"), "source_file": F.lit("archive")}
    )
    return current.unionByName(archived).drop("c_acctbal")


LINE_FIELDS = ("post_id", "status", "price", "posted_at", "note")


def lines(spark: SparkSession, sf: str, *kept: str) -> DataFrame:
    """Orders as delimited lines; among those of status P are short, long, blank and odd ones.

    ``kept`` names columns of the orders that come along.
    """
    orders = table(spark, sf, "orders")
    key = F.col("o_orderkey").cast("string")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    whole = F.concat_ws(
        "\t",
        F.concat(F.lit(" \u00a0"), key, F.lit("\u3000 ")),
        status,
        F.col("o_totalprice").cast("string"),
        F.col("o_orderdate").cast("string"),
        F.concat(F.lit('"'), priority, F.lit(" ")),
    )
    odd = F.col("o_orderstatus") == "P"
    value = (
        F.when(odd & (priority == "1-URGENT"), F.concat_ws("\t", key, status))
        .when(odd & (priority == "2-HIGH"), F.concat(whole, F.lit("\textra")))
        .when(odd & (priority == "3-MEDIUM"), F.lit(""))
        .when(odd & (priority == "4-NOT SPECIFIED"), F.lit("\t\t\t\t"))
        .when(odd, F.concat(key, F.lit("\t\\N\tnull\tNULL\t null ")))
        .otherwise(whole)
    )
    return orders.select(value.alias("value"), F.concat(status, F.lit(".csv")).alias("source_file"), *kept)


#: Orders of one file of lines.
FILE_ORDERS = 50_000


def line_files(spark: SparkSession, sf: str, folder: str) -> None:
    """The lines as text files in ``folder``, each sorted by order key, FILE_ORDERS keys at most."""
    part = F.floor(F.col("o_orderkey") / FILE_ORDERS)
    rows = lines(spark, sf, "o_orderkey").withColumn("part", part)
    rows.repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy(
        "part"
    ).text(folder)


LINE_SPEC = TableSpec(
    "orders",
    ("orders.csv",),
    "\t",
    (
        FieldSpec("post_id"),
        FieldSpec("status"),
        FieldSpec("price", "double"),
        FieldSpec("posted_at", "timestamp"),
        FieldSpec("note", "verbatim"),
    ),
    ("post_id", "status"),
    TimeCheck("timestamp_in_study_window", "posted_at", STUDY_START, STUDY_END),
)


#: Raw tables made of the given ones: delimiter, columns (the first is the key), identifiers, time column.
RAW_TABLES = {
    "orders": (
        "\t",
        ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"),
        ("o_orderkey", "o_custkey"),
        "o_orderdate",
    ),
    "lineitem": (
        "\t",
        ("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"),
        ("l_orderkey", "l_partkey"),
        "l_shipdate",
    ),
    "events": ("\t", ("event_id", "user_id", "ts"), ("event_id", "user_id"), "ts"),
    "customer": ("|", ("c_custkey", "c_mktsegment"), ("c_custkey",), None),
    "supplier": ("|", ("s_suppkey", "s_name"), ("s_suppkey",), None),
    "part": (",", ("p_partkey", "p_size"), ("p_partkey",), None),
    "nation": (",", ("n_nationkey", "n_regionkey"), ("n_nationkey",), None),
}


def raw_specs() -> dict[str, TableSpec]:
    def check(time: str | None) -> TimeCheck | None:
        return time and TimeCheck("timestamp_in_study_window", time, STUDY_START, STUDY_END)

    return {
        name: TableSpec(
            name,
            (f"{name}.csv",),
            delimiter,
            tuple(FieldSpec(column, "timestamp" if column == time else "trimmed") for column in columns),
            required,
            check(time),
        )
        for name, (delimiter, columns, required, time) in RAW_TABLES.items()
    }


def raw_files(spark: SparkSession, sf: str, folder: str) -> None:
    """The raw tables as folders of lines. By the key's last digit, lines lack it (0), are long (1) or short (2)."""
    for name, (delimiter, columns, _, _) in RAW_TABLES.items():
        key, *others = [F.coalesce(F.col(column).cast("string"), F.lit("")) for column in columns]
        digit = F.col(columns[0]) % 10
        line = (
            F.when(digit == 0, F.concat_ws(delimiter, F.lit("\\N"), *others))
            .when(digit == 1, F.concat_ws(delimiter, key, *others, F.lit("extra")))
            .when(digit == 2, key)
            .otherwise(F.concat_ws(delimiter, key, *others))
        )
        table(spark, sf, name).select(line.alias("value")).write.text(f"{folder}/{name}.csv")


def messy_values(spark: SparkSession, sf: str) -> DataFrame:
    """Prices and dates written in ways that a cast may or may not take."""
    orders = table(spark, sf, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    price = F.col("o_totalprice").cast("string")
    date = F.col("o_orderdate").cast("string")
    number = (
        F.when(priority == "1-URGENT", F.concat(price, F.lit("d")))
        .when(priority == "2-HIGH", F.concat(F.lit(" -"), price, F.lit(" ")))
        .when(priority == "3-MEDIUM", F.concat(F.col("o_orderkey").cast("string"), F.lit(".5")))
        .when(priority == "4-NOT SPECIFIED", F.concat(price, F.lit("e9")))
        .when(status == "F", "abc")
        .when(status == "P", "1e3")
        .otherwise(price)
    )
    time = (
        F.when(priority == "1-URGENT", F.substring(date, 1, 7))
        .when(priority == "2-HIGH", F.substring(date, 1, 10))
        .when(priority == "3-MEDIUM", F.replace(date, F.lit(" "), F.lit("T")))
        .when(priority == "4-NOT SPECIFIED", F.concat(F.substring(date, 1, 5), F.lit("13-01")))
        .when(status == "F", F.concat(F.lit(" "), date))
        .when(status == "P", F.substring(date, 1, 13))
        .otherwise(F.concat(date, F.lit(".25")))
    )
    return orders.select("o_orderkey", number.alias("number"), time.alias("time"))
