"""Line dedup, near dedup and decontamination against plain versions."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyreach.llm.buckets import bucket_links
from tallyreach.llm.components import components
from tallyreach.llm.dartminhash import signatures
from tallyreach.llm.decontamination import align, contaminated, hashes_of, passage, without_contaminated, words_of
from tallyreach.llm.line_dedup import SPACES, drop_repeated_lines, with_lines_dropped
from tallyreach.llm.near_dedup import duplicate_classes, one_of_each_class
from tallyreach.llm.shingles import counted, weighted_jaccard, weighted_sets, word_hashes


def plain_lines(rows, least=10):
    """Kept text and counts for each row, by the definition."""
    order = lambda doc: (doc is not None, doc or 0)
    holders = defaultdict(set)
    key = lambda line: line.strip(SPACES).encode().lower().decode()
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    result = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line
            for line in lines
            if len(key(line)) < least or len(holders[key(line)]) < 2 or doc == min(holders[key(line)], key=order)
        ]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        result.append((doc, len(lines), len(lines) - len(kept), digest))
    return sorted(result, key=str)


def found_lines(frame):
    return sorted(
        (
            (r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest())
            for r in drop_repeated_lines(frame).collect()
        ),
        key=str,
    )


def test_lines_of_odd_documents(odd):
    assert found_lines(odd) == plain_lines([(r["doc_id"], r["text"]) for r in odd.collect()])


def test_a_line_in_most_documents_spreads_over_partitions(table):
    draw = random.Random(1)
    common = "A line that nearly every document has"
    rows = []
    for doc in range(900):
        lines = [f"line number {draw.randint(0, 400)} of some text" for _ in range(draw.randint(0, 4))]
        if draw.random() < 0.8:
            lines.insert(draw.randint(0, len(lines)), draw.choice(["  ", ""]) + common.upper() + "\t")
        if draw.random() < 0.3:
            lines.append(common)
        rows.append((doc * 7 % 901, "\n".join(lines)))
    assert found_lines(table(rows)) == plain_lines(rows)


def test_lines_keep_the_columns(odd, empty):
    kept = with_lines_dropped(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    ninth = kept.filter("doc_id = 9").first()
    assert (ninth["text"], ninth["n_chars"], ninth["keep"]) == ("", 0, "c")
    assert kept.filter("doc_id = 1").first()["text"] is None
    assert with_lines_dropped(empty).count() == 0 and drop_repeated_lines(empty).count() == 0


def test_signatures_agree_as_often_as_sets_are_alike():
    draw = random.Random(2)
    words = [f"w{draw.randint(0, 5000)}" for _ in range(600)]
    other = list(words)
    for place in range(0, 600, 45):
        other[place] = "changed"
    sets = weighted_sets([words, other, words * 3, ["one"], []])
    values = signatures(sets, 4096)
    for a, b in ((0, 1), (0, 2), (1, 2), (0, 3)):
        texts = [words, other, words * 3, ["one"]]
        exact = weighted_jaccard(counted(" ".join(texts[a])), counted(" ".join(texts[b])))
        assert abs((values[a] == values[b]).mean() - exact) < 0.035
    assert (values[3] != 0).all() and (values[4] == 0).all()


def plain_classes(rows, threshold=0.8):
    sets = {doc: counted(text or "") for doc, text in rows}
    label = {doc: doc for doc in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[:i]:
            if weighted_jaccard(sets[a], sets[b]) >= threshold:
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {doc: root(doc) for doc in docs}


def test_classes_of_near_copies_and_shared_passages(table):
    draw = random.Random(3)
    text = lambda n: [f"w{draw.randint(0, 9000)}" for _ in range(n)]
    passage, rows = text(70), []
    for _ in range(60):  # half of each is one passage: candidates that are no links
        rows.append(passage + text(70))
    base = text(200)
    for _ in range(60):  # a chain and a star of near copies
        copy = list(draw.choice(rows[-10:] + [base]) if draw.random() < 0.3 else base)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = "edit"
        rows.append(copy)
    rows += [rows[-1]] * 5 + [["a", "b"], ["A", "b"], [], []]
    draw.shuffle(rows)
    named = [(doc, " ".join(words)) for doc, words in enumerate(rows)]
    found = {r["doc_id"]: r["class_id"] for r in duplicate_classes(table(named)).collect()}
    assert found == plain_classes(named)


def test_classes_of_odd_documents(odd, empty):
    found = {r["doc_id"]: r["class_id"] for r in duplicate_classes(odd).collect()}
    assert found == {None: None, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 4}
    kept = one_of_each_class(odd)
    assert kept.columns == odd.columns
    assert sorted(kept.toPandas()["doc_id"].fillna(-1)) == [-1, -1, 1, 4, 5, 6, 7, 8]
    assert duplicate_classes(empty).count() == 0 and one_of_each_class(empty).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (100, 300), (7, 7)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


@pytest.fixture
def benchmark(spark):
    draw = random.Random(4)
    items = [(i, " ".join(f"q{draw.randint(0, 3000)}" for _ in range(30))) for i in range(12)]
    rows = [*items, (50, None), (51, ""), (52, "tiny one"), (0, items[0][1])]
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, score string")


def test_edited_passages_are_found(table, benchmark):
    draw = random.Random(5)
    items = {r["item_id"]: r["text"] for r in benchmark.collect() if r["text"]}
    filler = lambda n: " ".join(f"f{draw.randint(0, 3000)}" for _ in range(n))
    rows, expected = [(1000, filler(300)), (1001, None), (1002, "")], set()
    for item in range(12):
        words = items[item].split()
        for kind in range(4):
            copy = list(words)
            if kind == 1:
                copy = [w.upper() + "," for w in words]
            if kind == 2:
                for place in (5, 13, 22):
                    copy[place] = "other"
            if kind == 3:
                copy = words[:10] + ["added"] + words[10:18] + words[20:]
            doc = item * 10 + kind
            rows.append((doc, f"{filler(draw.randint(0, 80))} {' '.join(copy)} {filler(20)}"))
            expected.add((doc, item))
        rows.append((item * 10 + 5, f"{filler(40)} {' '.join(words[:8])} {filler(40)}"))
    docs = table(rows)
    found = contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == expected
    texts = dict(rows)
    for r in found:
        held = words_of(texts[r["doc_id"]])[r["first_word"] : r["end_word"]]
        own = words_of(items[r["item_id"]])
        assert r["score"] >= 0.5 and held[0] == own[0] and held[-1] == own[-1]
    left = without_contaminated(docs, benchmark)
    assert left.columns == docs.columns
    assert set(left.toPandas()["doc_id"]) == set(texts) - {doc for doc, _ in expected}


def test_edited_copies_of_a_hot_item_and_of_common_words_are_found(spark, table):
    draw = random.Random(11)
    hot = [f"hot{i}" for i in range(30)]
    common = [draw.choice(["the", "of", "and", "to", "in", "is"]) for _ in range(30)]
    items = spark.createDataFrame([(1, " ".join(hot)), (2, " ".join(common))], "item_id long, text string")
    rows, expected = [], set()
    for doc in range(400):
        text = [draw.choice(["the", "of", "and", *(f"w{i}" for i in range(300))]) for _ in range(50)]
        item = [0, 1, 1, 2][doc % 4]
        if item:
            kept = [w if draw.random() > 0.15 else f"new{draw.randrange(10**6)}" for w in [hot, common][item - 1]]
            text[20:20] = kept
        rows.append((doc, " ".join(text)))
        words = np.array(text)
        expected |= {
            (doc, number) for number, words_of_item in ((1, hot), (2, common))
            if align(np.array(words_of_item), words)[0] / 60 >= 0.5
        }
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(table(rows), items).collect()}
    assert len(expected) > 250 and found == expected


@pytest.mark.parametrize("edit", ["replaced", "missing", "added"])
def test_copies_without_three_words_in_a_row_are_found(spark, table, benchmark, edit):
    """Every third word of an item is replaced or missing, or one is added before every other word."""
    rows, expected = [], set()
    for r in benchmark.filter("item_id < 12 AND item_id > 0").collect():
        copy = []
        for place, word in enumerate(r["text"].split()):
            if edit == "added":
                copy += [word] if place % 2 else [f"new{place}", word]
            elif place % 3 != 2:
                copy.append(word)
            elif edit == "replaced":
                copy.append(f"new{place}")
        rows.append((r["item_id"], " ".join(["before"] * 9 + copy + ["after"] * 9)))
        if align(np.array(r["text"].split()), np.array(rows[-1][1].split()))[0] / 60 >= 0.5:
            expected.add((r["item_id"], r["item_id"]))
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(table(rows), benchmark).collect()}
    assert len(expected) == 11 and found == expected


@pytest.mark.parametrize("rate", [0.05, 0.1, 0.2, 0.3])
def test_recall_against_alignments_of_all_pairs(spark, table, rate):
    """Edited copies of given items within given texts: the pairs that reach the limit, of all pairs."""
    draw = random.Random(rate)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text")
    items = items.filter("text IS NOT NULL").orderBy("item_id").limit(25)
    texts = [
        " ".join(words_of(r["text"])[:60])
        for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("text IS NOT NULL").collect()
    ]
    known = {r["item_id"]: words_of(r["text"]) for r in items.collect()}
    rows = []
    for number in range(250):
        words = []
        for word in known[draw.choice(list(known))]:
            chance = draw.random() / rate
            if chance > 1:
                words.append(word)
            elif chance < 0.6:
                words.append(f"new{draw.randrange(500)}")
            elif chance > 0.8:
                words += [word, f"new{draw.randrange(500)}"]
        rows.append((number, " ".join([draw.choice(texts), *words, draw.choice(texts)])))
    expected = set()
    for number, text in rows:
        for item, words in known.items():
            if align(np.array(words), np.array(text.split()))[0] / (2 * len(words)) >= 0.5:
                expected.add((number, item))
    found = {(r["doc_id"], r["item_id"]) for r in contaminated(table(rows), items).collect()}
    assert found <= expected
    assert len(expected) > 100
    assert len(found) >= 0.98 * len(expected)


def test_decontamination_of_nothing(odd, empty, benchmark):
    assert contaminated(odd, benchmark).count() == 0
    assert contaminated(empty, benchmark).count() == 0
    assert contaminated(odd, benchmark.limit(0)).count() == 0
    assert without_contaminated(odd, benchmark).count() == odd.count()


def plain_alignment(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        best, above = max(best, *row), row
    return best


def test_alignment_is_smith_waterman():
    draw = random.Random(6)
    for _ in range(200):
        a, b = ([draw.choice("abc") for _ in range(draw.randint(1, 12))] for _ in range(2))
        assert align(word_hashes(a), word_hashes(b))[0] == plain_alignment(a, b)
    assert align(np.zeros(0, np.uint64), word_hashes(["a"])) == (0, 0, 0)


def test_texts_that_share_an_id_keep_their_links(table):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(900)]
    one, two, other = (draw.choices(words, k=300) for _ in range(3))
    near = lambda text: " ".join(["new", *text[1:]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, " ".join(other))]
    rows += [(5, near(other)), (6, " ".join(words))]
    wanted = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    for _ in range(2):
        assert dict(map(tuple, duplicate_classes(table(rows)).collect())) == wanted


def test_a_crowd_of_texts_that_are_nearly_alike(table):
    """Copies of one text of which most are somewhat below the threshold to each other."""
    draw = random.Random(8)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    rows = []
    for doc in range(80):
        text = list(base)
        for place in draw.sample(range(150), draw.choice([1, 2, 3, 4, 5])):
            text[place] = f"own{doc}x{place}"
        rows.append((doc * 3 % 241, " ".join(text)))
    sets = {doc: counted(text) for doc, text in rows}
    parent = {doc: doc for doc in sets}

    def root(doc):
        while parent[doc] != doc:
            doc = parent[doc]
        return doc

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if weighted_jaccard(sets[a], sets[b]) >= 0.8:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert dict(map(tuple, duplicate_classes(table(rows)).collect())) == {doc: root(doc) for doc in ids}


def test_a_bucket_of_unlike_copies_of_one_set_is_compared_in_few_pairs(spark):
    """Most have less than 0.8 in common with each other and with the pivot; all links among them are found."""
    draw = random.Random(9)
    base = list(range(100))
    sets = [base]
    for doc in range(1, 151):
        own = list(draw.choice(sets[-12:]) if doc % 5 == 0 else base)
        for place in draw.sample(range(100), 3 if doc % 5 == 0 else draw.randint(10, 20)):
            own[place] = 1000 * doc + place
        sets.append(own)
    frame = spark.createDataFrame([(doc, own) for doc, own in enumerate(sets)], "doc_id long, own array<long>").cache()
    side = lambda name: frame.select(F.col("doc_id").alias(name), F.col("own").alias(f"own_{name}"))
    compared = []

    def measure(pairs):
        compared.append(pairs.count())
        shared = F.size(F.array_intersect("own_a", "own_b"))
        alike = shared / (F.size("own_a") + F.size("own_b") - shared)
        return pairs.join(side("a"), "a").join(side("b"), "b").select(
            "a", "b", alike.alias("similarity"), F.lit(True).alias("exact")
        )

    def differences(pairs):
        lacks = lambda one, other: F.array_except(f"own_{one}", f"own_{other}")
        return pairs.join(side("doc_id"), "doc_id").join(side("pivot"), "pivot").select(
            "doc_id",
            "pivot",
            F.size("own_doc_id").alias("size"),
            F.concat(lacks("doc_id", "pivot"), lacks("pivot", "doc_id")).alias("apart"),
        )

    members = frame.select(F.lit(1).alias("key"), "doc_id", F.when(F.col("doc_id") == 0, 2).otherwise(1).alias("weight"))
    links = bucket_links(members, measure, differences, 0.8)
    found = {r["node"]: r["component"] for r in components(links).collect()}
    label = list(range(len(sets)))
    for a in label:
        for b in range(a):
            shared = len(set(sets[a]) & set(sets[b]))
            if shared / (200 - shared) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert 20 < len(set(label)) < 140 and any(x and label.count(x) > 1 for x in label)
    assert [found.get(doc, doc) for doc in range(len(sets))] == label
    # All pairs would be 11,325.
    assert sum(compared) < 1500


def test_words_are_hashed_alike_with_and_without_other_letters():
    texts = ["Don't stop_it -- NOW", "a\x1cb\x1f c\x00d \x7f", "", " . ", "1,000.5 e-mail", "x" * 70 + "!"]
    for text in texts:
        plain = [re.sub(r"\W+", "", word) for word in text.lower().split()]
        assert words_of(text) == [word for word in plain if word]
        expected = [xxhash.xxh64_intdigest(word) for word in words_of(text)]
        assert hashes_of(text).tolist() == expected
        assert hashes_of(text + " \u00c9t\u00e9\u2014\u0130 \u4e2d\u3002")[: len(expected)].tolist() == expected


def test_alignments_end_where_no_score_can_be_reached():
    item, other = np.arange(40, dtype=np.uint64), np.arange(100, 160, dtype=np.uint64)
    text = np.concatenate((other, item[:10], item[12:], other))
    assert align(item, text, 60.0) == align(item, text)
    # All words of the item, in reverse: by count of words they could reach the limit.
    assert align(item, item[::-1], 40.0)[0] < 40
    assert passage(item, item[::-1], [0], 0.5) == (0.0, 0, 0)
    assert passage(item, text, [60], 0.5) == passage(item, text, [60])
    assert passage(item, item[::-1], [0])[0] > 0
