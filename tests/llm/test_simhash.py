"""SimHash components against all pairs of fingerprints."""

import random
from collections import Counter

import pytest
import xxhash

from tallyreach.llm import simhash
from tallyreach.llm.components import components


def plain_fingerprint(text):
    words = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    """The smallest reachable mark of each, by comparing all with all."""
    found = {}
    for start in sorted(marks):
        if start in found:
            continue
        reached, ahead = {start}, [start]
        while ahead:
            one = ahead.pop()
            for other in marks:
                if other not in reached and (one ^ other).bit_count() <= 4:
                    reached.add(other)
                    ahead.append(other)
        found.update(dict.fromkeys(reached, start))
    return found


def expected(rows):
    marks = [plain_fingerprint(text) for _, text in rows]
    classes = plain_components(set(marks))
    names = {}
    for (doc, _), mark in zip(rows, marks):
        if doc is not None:
            names[classes[mark]] = min(names.get(classes[mark], doc), doc)
    return Counter((doc, f"{mark:016x}", names.get(classes[mark])) for (doc, _), mark in zip(rows, marks))


def found(frame, **options):
    return Counter(map(tuple, simhash.near_duplicates(frame, **options).collect()))


def test_odd_documents(odd, empty):
    assert found(odd) == expected([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert found(empty) == Counter()


def test_rows_without_any_id(table):
    rows = [(None, "one two three four five"), (None, ""), (3, None)]
    assert found(table(rows)) == expected(rows)


def test_documents_of_an_id_that_repeats(table):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "H I J K L M N"), (3, "A b c  d\te f g")]
    assert found(table(rows)) == expected(rows)


@pytest.mark.parametrize("most_variants", [simhash.MOST_VARIANTS, 20_000, 1])
def test_crowds_of_edited_copies(table, most_variants):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(4):
        base = draw.choices(words, k=400)
        for _ in range(40):
            copy = list(base)
            for _ in range(draw.randint(0, 3)):
                copy[draw.randrange(400)] = draw.choice(words)
            rows.append((len(rows) * 37 % 1009, " ".join(copy)))
    want = expected(rows)
    assert len({c for _, _, c in want}) < 150
    assert found(table(rows), most_variants=most_variants) == want


@pytest.mark.parametrize("most_variants", [simhash.MOST_VARIANTS, 50_000, 1])
def test_planted_fingerprints(spark, most_variants):
    draw = random.Random(2)
    marks = {0, 1, (1 << 64) - 1, 0b1111, 1 << 63}
    for _ in range(60):
        mark = draw.getrandbits(64)
        marks.add(mark)
        # Steps of four bits are linked, of five are not.
        for size in (4, 4, 5, 2, 1):
            for bit in draw.sample(range(64), size):
                mark ^= 1 << bit
            marks.add(mark)
    centre = draw.getrandbits(64)
    for _ in range(150):
        mark = centre
        for bit in draw.sample(range(64), draw.randint(1, 2)):
            mark ^= 1 << bit
        marks.add(mark)
    signed = lambda mark: mark - (1 << 64) if mark >> 63 else mark
    frame = spark.createDataFrame([(signed(m),) for m in marks], "mark long")
    links = simhash.near_pairs(frame, most_variants).distinct()
    assert all((a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 4 for a, b in links.collect())
    classes = {n % (1 << 64): c for n, c in components(links).collect()}
    want = plain_components(marks)
    groups = {}
    for mark in marks:
        groups.setdefault(classes.get(mark, mark), set()).add(mark)
    wanted = {}
    for mark in marks:
        wanted.setdefault(want[mark], set()).add(mark)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_long_text_counts_whole(table):
    text = "alpha beta " * 100_000 + "gamma delta epsilon"
    rows = [(1, text), (2, "alpha beta " * 100_000)]
    assert found(table(rows)) == expected(rows)
