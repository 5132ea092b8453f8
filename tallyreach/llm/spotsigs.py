"""SpotSigs fingerprints: chains of content words that follow common words.

Every occurrence of a common word (an anchor) gives a spot: the anchor and the next few words that are
not common. Boilerplate such as menus has few common words and leaves few spots, prose leaves many.
The set of a text's spots, as 32-bit hashes, is its fingerprint; two are compared by Jaccard. Sets
whose lengths differ too much can't be alike, so fingerprints are partitioned by length.

Everything here is built from DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyreach.llm.buckets import bucket_links
from tallyreach.llm.common import documents, texts
from tallyreach.llm.components import components
from tallyreach.sources.storage import scratch_table

CHAIN = 3
SIMILARITY = 0.8
# Common words of English, German, French and Spanish that serve as anchors.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on",
    "or", "that", "the", "this", "to", "was", "were", "with",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von", "zu",
    "au", "aux", "dans", "des", "du", "elle", "en", "est", "et", "la", "le", "les", "par", "pour",
    "que", "qui", "sur", "un", "une",
    "con", "de", "del", "el", "las", "los", "para", "por", "se", "su", "y",
)
NO_ID = -(2**63)


def _is_anchor(word: Column) -> Column:
    return word.isin(*ANCHORS)


def with_fingerprint(frame: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted distinct spots of column ``text`` as the array ``name``.

    Words are runs of letters and digits in lower case. At the end of a text a chain may be shorter. In
    a text without anchors every word begins a chain; a text without words has no spots.
    """
    words, content, places = f"{name} words", f"{name} content", f"{name} places"
    cut = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    frame = frame.withColumn(words, F.filter(cut, lambda word: word != ""))
    frame = frame.withColumns(
        {
            content: F.filter(words, lambda word: ~_is_anchor(word)),
            places: F.filter(
                F.transform(words, lambda word, at: F.when(_is_anchor(word), at)),
                lambda at: at.isNotNull(),
            ),
        }
    )
    # Before the anchor numbered n at place p stand p - n content words.
    spots = F.transform(
        places,
        lambda at, n: F.hash(F.get(words, at), F.slice(content, at - n + 1, F.lit(CHAIN))),
    )
    bare = F.transform(content, lambda word, at: F.hash(F.slice(content, at + 1, F.lit(CHAIN))))
    found = F.when(F.size(places) > 0, spots).otherwise(bare)
    return frame.withColumn(name, F.array_sort(F.array_distinct(found))).drop(words, content, places)


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints; that of two empty ones is NULL."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union)


def length_partition(fingerprint: str, threshold: float = SIMILARITY) -> Column:
    """Sets that are alike to ``threshold`` lie in the same or in neighbouring partitions."""
    # A little wider than the threshold needs, so that rounding can't put a partition in between.
    width = -math.log(threshold) * (1 + 1e-9)
    return F.floor(F.log(F.greatest(F.size(fingerprint), F.lit(1))) / width).cast("int")


def as_text(fingerprint: str) -> Column:
    """Eight hexadecimal digits for each spot."""
    digits = F.transform(
        fingerprint,
        lambda spot: F.lpad(F.hex(spot.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"),
    )
    return F.lower(F.array_join(digits, ""))


def _predecessors(rows: DataFrame) -> DataFrame:
    """doc, row, and of the row before in that order its doc, row and n_chars; the first follows the last."""
    ordered = scratch_table(
        rows.select("doc", "row", F.length("text").alias("n_chars"))
        .distinct()
        .repartitionByRange("doc", "row")
        .withColumn("part", F.spark_partition_id()),
        "order",
    )
    place = F.struct("doc", "row", "n_chars")
    # A row a partition of the range exchange, so one task holds them all.
    lasts = ordered.groupBy("part").agg(F.max(place).alias("last"))
    in_order = Window.orderBy("part")
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = lasts.select(
        "part", F.coalesce(F.lag("last").over(in_order), F.last("last").over(whole)).alias("end")
    )
    before = F.lag(place).over(Window.partitionBy("part").orderBy("doc", "row"))
    return (
        ordered.withColumn("before", before)
        .join(F.broadcast(ends), "part")
        .withColumn("before", F.coalesce("before", "end"))
        .select(
            "doc",
            "row",
            F.col("before.doc").alias("to_doc"),
            F.col("before.row").alias("to_row"),
            F.col("before.n_chars").alias("to_chars"),
        )
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """The fingerprint of each text, of its edited text, and how alike both and the next one are.

    In the edited text the last half (rounded down) of the characters is replaced by as many, or
    all, first characters of the next document in the order of doc_id; the last document is followed
    by the first. NULL texts are empty. The likeness of two texts without any word is 1 if they are
    equal and 0 if not. Rows without an id come first, rows that share one in the order of a hash of
    their texts; rows that repeat id and text give one row. A single row follows itself. An empty
    table gives no rows; other columns are ignored. Texts of any length are taken whole.
    """
    rows = texts(docs).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("row"), "text"
    )
    marked = with_fingerprint(rows, "text", "spots")
    order = scratch_table(_predecessors(rows), "predecessors")
    heads = marked.join(order, ["doc", "row"]).select(
        F.col("to_doc").alias("doc"),
        F.col("to_row").alias("row"),
        F.substring("text", F.lit(1), F.floor(F.col("to_chars") / 2).cast("int")).alias("head"),
        F.col("spots").alias("next_spots"),
        F.xxhash64("text").alias("next_row"),
    )
    both = marked.join(heads, ["doc", "row"])
    n_chars = F.length("text")
    edited = F.concat(
        F.substring("text", F.lit(1), n_chars - F.floor(n_chars / 2).cast("int")), "head"
    )
    full = with_fingerprint(both.withColumn("edited", edited), "edited", "edited_spots")
    result = full.select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"),
        n_chars.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("spots").alias("fingerprint"),
        as_text("edited_spots").alias("edited_fingerprint"),
        F.coalesce(
            likeness("spots", "edited_spots"), (F.col("text") == F.col("edited")).cast("double")
        ).alias("near_edited"),
        F.coalesce(
            likeness("spots", "next_spots"), (F.col("row") == F.col("next_row")).cast("double")
        ).alias("near_next"),
        length_partition("spots").alias("length_partition"),
        "doc",
        "row",
    )
    return result.dropDuplicates(["doc", "row"]).drop("doc", "row")


def similar_classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id and class_id: the smallest id of its class of documents with alike fingerprints.

    A class is a connected component of the links between documents whose fingerprints have a Jaccard
    similarity of at least ``threshold``. Two such sets share one of the few rarest spots of each, and
    their lengths lie in the same or in neighbouring partitions; documents that share both are
    compared. Equal fingerprints are one from the start. Documents without spots are alike. Rows that
    share an id link their texts' classes; rows without an id are left out.
    """
    rows = with_fingerprint(texts(docs.filter("doc_id IS NOT NULL")), "text", "spots")
    marked = scratch_table(rows.select("doc_id", "spots", F.xxhash64("spots").alias("same")), "spots")
    firsts = scratch_table(
        marked.groupBy("same", "spots").agg(F.min("doc_id").alias("first")), "first-spots"
    )
    copies = scratch_table(
        marked.join(firsts, ["same", "spots"]).select("doc_id", "first"), "copies"
    )
    sets = firsts.groupBy(F.col("first").alias("doc_id")).agg(F.collect_list("spots").alias("all"))
    sets = scratch_table(sets.select("doc_id", F.explode("all").alias("spots")), "sets")
    spots = sets.select("doc_id", F.size("spots").alias("n"), length_partition("spots", threshold).alias("part"), F.explode("spots").alias("spot"))
    often = scratch_table(spots.groupBy("spot").agg(F.count("*").alias("often")), "often")
    by_rarity = (
        spots.join(often, "spot")
        .groupBy("doc_id", "n", "part")
        .agg(F.array_sort(F.collect_list(F.struct("often", "spot"))).alias("order"))
    )
    rarest = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefixes = by_rarity.select(
        "doc_id", "n", "part", F.explode(F.slice("order", F.lit(1), rarest.cast("int"))).alias("at")
    )
    near = F.explode(F.array("part", F.col("part") + 1))
    keyed = prefixes.select("doc_id", F.col("n").cast("long").alias("weight"), F.col("at.spot").alias("spot"), near.alias("part"))
    keyed = keyed.select(F.xxhash64("spot", "part").alias("key"), "doc_id", "weight").distinct()
    keyed = scratch_table(keyed, "keyed")
    shared = scratch_table(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    members = scratch_table(keyed.join(shared.select("key"), "key"), "members")

    def measure(pairs: DataFrame) -> DataFrame:
        side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("spots").alias(f"{name}_spots"))
        measured = pairs.join(side("a"), "a").join(side("b"), "b").select(
            "a", "b", likeness("a_spots", "b_spots").alias("similarity"), F.lit(True).alias("exact")
        )
        return scratch_table(measured, "likeness")

    def differences(pairs: DataFrame) -> DataFrame:
        side = lambda name: sets.select(F.col("doc_id").alias(name), F.col("spots").alias(f"{name}_spots"))
        lacks = lambda one, other: F.array_except(f"{one}_spots", f"{other}_spots")
        return pairs.join(side("doc_id"), "doc_id").join(side("pivot"), "pivot").select(
            "doc_id",
            "pivot",
            F.size("doc_id_spots").alias("size"),
            F.concat(lacks("doc_id", "pivot"), lacks("pivot", "doc_id")).alias("apart"),
        )

    links = bucket_links(members, measure, differences, threshold)
    joined = links.unionAll(copies.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    classes = scratch_table(components(joined), "classes")
    known = copies.select("doc_id").distinct()
    return known.join(classes, known["doc_id"] == classes["node"], "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id")
    )


def op6_spotsigs(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprints(documents(spark, sf))
