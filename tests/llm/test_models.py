"""Language model, language, quality, personal data and fingerprints, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyreach.llm import katz, language, quality
from tallyreach.llm.personal_data import personal_data
from tallyreach.llm.spotsigs import ANCHORS, fingerprints, similar_classes
from tallyreach.llm.tokens import text_chunks


def held_out(doc, parts, remainder):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % parts == remainder


def corpus(seed, documents=250):
    draw = random.Random(seed)
    words = [f"Word{i}" for i in range(60)] + ["the"] * 20
    return [
        (doc, " ".join(draw.choice(words) for _ in range(draw.randint(0, 40)))) for doc in range(documents)
    ]


def plain_discounts(seen):
    """Katz's discounts of Good-Turing estimates under the line through the counts of counts up to 64."""
    points = sorted(r for r in seen if r <= 64)
    power = -2.0
    if len(points) > 1:
        logs = []
        for i, r in enumerate(points):
            below = points[i - 1] if i else 0
            above = points[i + 1] if i + 1 < len(points) else 2 * r - points[i - 1]
            logs.append((math.log(r), math.log(seen[r] / ((above - below) / 2))))
        power = min(float(np.polyfit(*zip(*logs), 1)[0]), -1.1)
    line = lambda r: r**power
    share = 6 * line(6) / line(1)
    good = {r: (r + 1) * line(r + 1) / line(r) / r for r in range(1, 6)}
    return np.array([1.0, *((good[r] - share) / (1 - share) for r in range(1, 6)), 1.0])


def plain_katz(rows, vocabulary):
    """Scores of every row by the formula, with tables in memory."""
    tokens = lambda text: (text or "").encode().lower().split() + [b"\n"]
    training = [tokens(text) for doc, text in rows if not held_out(doc, 5, 1)]
    count = Counter(w for t in training for w in t)
    total = sum(count.values())
    times, frequent, least = Counter(count.values()), 1, math.inf
    for n in sorted(times, reverse=True):
        if frequent + times[n] > vocabulary:
            break
        frequent, least = frequent + times[n], n
    known = {w for w in count if count[w] >= least} | {b"\n"}
    of = lambda w: w if w in known else None
    pairs, contexts = Counter(), Counter()
    for text in training:
        before = "start"
        for w in text:
            pairs[before, of(w)] += 1
            contexts[before] += 1
            before = of(w)
    d1, d2 = plain_discounts(times), plain_discounts(Counter(pairs.values()))
    lost = sum((1 - d1[r]) * r * times[r] for r in range(1, 6))
    unseen = max(lost, 0.5) / (total + 0.5)
    d1 = d1 * (1 - unseen) / (1 - lost / total)
    single = lambda w: d1[min(count[w], 6)] * count[w] / total if count[w] else unseen
    chance = {w: single(w) for w in known if w in count}
    chance[None] = 1 - sum(chance.values())
    kept, covered = defaultdict(float), defaultdict(float)
    for (before, w), n in pairs.items():
        kept[before] += d2[min(n, 6)] * n / (contexts[before] + 1)
        covered[before] += chance[w]
    after = Counter(before for before, _ in pairs)
    full = {before for before in after if after[before] == len(known) + 1}
    weight = lambda h: (1 - kept[h]) / (1 - covered[h]) if h in kept else 1.0

    def probability(before, w):
        n = pairs.get((before, of(w)), 0)
        p = d2[min(n, 6)] * n / (contexts[before] + 1) if n else weight(before) * chance[of(w)]
        p /= kept[before] if before in full else 1
        return p * (1 if w in known else single(w) / chance[None])

    # Exactly normalised: all known words, all others, and what training never saw.
    for before in list(kept)[:50]:
        assert sum(probability(before, w) for w in count) + probability(before, b"never") == pytest.approx(1, abs=1e-9)
    result = []
    for doc, text in rows:
        score, before = 0.0, "start"
        for w in tokens(text):
            score, before = score + math.log10(probability(before, w)), of(w)
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in tokens(text))
        n_known = sum(count[w] > 0 for w in tokens(text))
        result.append((doc, held_out(doc, 5, 1), len(tokens(text)), n_known, total, base, score))
    return result


@pytest.mark.parametrize("vocabulary", [1 << 18, 30, 3])
def test_katz_scores(table, vocabulary):
    rows = corpus(1) + [(1000 + i, f"rare{i} the rare{i // 2} unknown{i}") for i in range(60)]
    found = katz.katz_scores(table(rows), vocabulary).collect()
    for row, expected in zip(sorted(found, key=lambda r: r["doc_id"]), plain_katz(rows, vocabulary)):
        assert tuple(row[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")) == expected[:5]
        assert (row["base_score"], row["score"]) == pytest.approx(expected[5:], rel=1e-9)


def test_katz_tells_words_without_an_id_apart(table, monkeypatch):
    draw = random.Random(9)
    rows = corpus(1) + [(1000 + i, f"rare{i} the rare{i // 2} unknown{i} Word{i}") for i in range(60)]
    rows += [(2000 + i, " ".join(f"rare{draw.randrange(30)}" for _ in range(draw.randint(1, 9)))) for i in range(150)]
    for frequent in (30, 3):
        monkeypatch.setattr(katz, "FREQUENT", frequent)
        found = katz.katz_scores(table(rows)).collect()
        for row, expected in zip(sorted(found, key=lambda r: r["doc_id"]), plain_katz(rows, 1 << 18), strict=True):
            assert tuple(row[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")) == expected[:5]
            assert (row["base_score"], row["score"]) == pytest.approx(expected[5:], rel=1e-9)


def test_katz_keeps_pairs_of_any_number_of_words(table):
    ids = iter(doc for doc in range(3000) if not held_out(doc, 5, 1))
    held = [doc for doc in range(100) if held_out(doc, 5, 1)]
    rows = [(next(ids), " ".join(f"w{i}" for i in range(start, start + 1000))) for start in range(0, 270_000, 1000)]
    rows += [(held[0], "w5 w6"), (held[1], "w5 w9")]
    found = {r["doc_id"]: r["score"] for r in katz.katz_scores(table(rows)).collect()}
    assert found[held[0]] > found[held[1]] + 1


def test_katz_of_odd_documents(odd, empty, table):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    key = lambda r: tuple(map(str, r[:4]))
    found = [
        tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))
        for r in katz.katz_scores(odd).collect()
    ]
    for row, expected in zip(sorted(found, key=key), sorted(plain_katz(rows, 1 << 18), key=key)):
        assert row[:5] == expected[:5] and row[5:] == pytest.approx(expected[5:], rel=1e-6)
    assert katz.katz_scores(empty).count() == 0
    only = next(doc for doc in range(100) if held_out(doc, 5, 1))
    untrained = katz.katz_scores(table([(only, "nothing to learn from")])).first()
    assert untrained["train_tokens"] == 0 and untrained["n_known"] == 0 and untrained["score"] <= 0


def test_good_turing_takes_what_unseen_pairs_need():
    seen = {r: round(1e7 * r**-2.2) for r in range(1, 200)}
    found = katz.discounts(seen)
    assert all(0 < d < 1 for d in found[1:6]) and found[6] == 1
    lost = sum((1 - found[r]) * r * seen[r] for r in range(1, 6))
    assert lost == pytest.approx(seen[1], rel=1e-3)


def test_good_turing_discounts_at_every_size():
    draw = random.Random(4)
    cases = [{1: 5}, {7: 1}, {1: 1, 2: 9, 3: 50}, {1: 1_482_341, 2: 227_973, 3: 46_941, 4: 19_718, 5: 17_404, 6: 6_993}]
    cases += [{draw.randint(1, 90): draw.randint(1, 1000) for _ in range(draw.randint(1, 9))} for _ in range(200)]
    for seen in cases:
        found = katz.discounts(seen)
        assert found == pytest.approx(plain_discounts(seen), rel=1e-9)
        # More is left of larger counts.
        assert all(0 < a < b < 1 for a, b in zip(found[1:5], found[2:6])), seen


LANGUAGES = {"xx": "abcde", "yy": "defgh", "zz": "ghijk"}


def prose(draw, letters):
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(3, 60)))


def test_languages_of_held_out_texts(table):
    draw = random.Random(2)
    rows = [(doc, prose(draw, LANGUAGES[lang]), lang) for doc in range(500) for lang in [draw.choice(list(LANGUAGES))]]
    # What the model must not see: languages of held-out rows.
    masked = [(d, t, "wrong" if held_out(d, 4, 2) else lang) for d, t, lang in rows]
    found = {r["doc_id"]: r for r in language.languages_of(table(masked)).collect()}
    held = [(d, lang) for d, _, lang in rows if held_out(d, 4, 2)]
    assert len(held) > 80
    assert np.mean([found[d]["lang_pred"] == lang for d, lang in held]) > 0.97
    assert all(found[d]["held_out"] == held_out(d, 4, 2) and 0 <= found[d]["score"] <= 1 for d, _, _ in rows)


def test_languages_of_odd_documents(odd, empty, table):
    assert {(r["lang_pred"], r["score"]) for r in language.languages_of(odd).collect()} == {("und", 0.0)}
    assert language.languages_of(empty).count() == 0
    rows = [(i, "some text", "xx") for i in range(8)] + [(20, None, "xx"), (21, "12 - 3", None), (22, "text", None)]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages_of(table(rows)).collect()}
    assert found[20] == found[21] == ("und", 0.0) and found[22][0] == "xx"


def test_texts_of_signs_beyond_the_first_planes_have_no_letter(table):
    signs = ["\U0001f600\U0001f680", "\u3001\u3002", "\uff11\uff12\uff0b", "\ue000", "\U00100000"]
    rows = [(i, "some text", "xx") for i in range(8)] + [(20 + i, text, None) for i, text in enumerate(signs)]
    rows.append((30, "\u8a9e\uac00\U00020000", None))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.languages_of(table(rows)).collect()}
    assert all(found[20 + i] == ("und", 0.0) for i in range(len(signs)))
    assert found[30][0] == "xx"
    assert language.grams(signs + ["\u8a9e\uac00\U00020000"]).letters.tolist() == [0, 0, 0, 0, 0, 3]


def test_penalty_leaves_weights_at_zero():
    draw = random.Random(3)
    rows = [(prose(draw, LANGUAGES[lang]), lang) for _ in range(60) for lang in LANGUAGES]
    model = language.fit(rows, np.ones(language.BUCKETS))
    assert 0 < (model.table[:, :-1] != 0).mean() < 0.2
    assert model.predict([prose(draw, "abcde"), ""])[0] == ["xx", "und"]


def graded(draw, doc):
    text = ". ".join(prose(draw, "abcdefgh").capitalize() for _ in range(3))
    good = draw.random() < 0.7
    return doc, text if good else " ".join(f"{w}$$$" for w in text.split()), int(good)


def test_quality_of_held_out_texts(spark, table):
    draw = random.Random(4)
    rows = [graded(draw, doc) for doc in range(600)]
    labels = spark.createDataFrame(
        [(d, 1 - q if held_out(d, 4, 2) else q, 0, "x") for d, _, q in rows] + [(9999, 1, 0, "x"), (None, 0, 1, "x"), (3, None, 1, "x")],
        "doc_id long, quality int, toxic int, text string",
    )
    docs = table([(d, t) for d, t, _ in rows])
    found = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert np.mean([found[d]["predicted"] == q for d, _, q in rows if held_out(d, 4, 2)]) > 0.97
    assert all(found[d]["predicted"] == int(found[d]["score"] >= 0.7) for d, _, _ in rows)
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert set(kept.toPandas()["doc_id"]) == {d for d in found if found[d]["predicted"]}


@pytest.mark.parametrize("shown_by", ["words", "letters", "pairs of words"])
def test_quality_that_only_words_or_letter_sequences_show(shown_by):
    draw = random.Random(10)
    words = ["".join(draw.sample("abcdefgh", 6)) for _ in range(30)]

    def text(good):
        chosen = [draw.choice(words) for _ in range(40)]
        if shown_by == "pairs of words":  # the same words, each next to its own
            return " ".join(w for word in chosen[:20] for w in ([word, word[::-1]] if good else [word[::-1], word]))
        if shown_by == "words":  # the same letters
            return " ".join(word if good else "".join(sorted(word)) for word in chosen)
        return " ".join(chosen) if good else " ".join("".join(draw.sample("abcdefgh", 6)) for _ in chosen)

    rows = [(text(good), good) for good in [1, 0] * 150]
    model = quality.fit(*map(list, zip(*rows[:200])))
    assert np.mean([(model.score(t) >= quality.ACCEPT) == good for t, good in rows[200:]]) > 0.95


def test_quality_of_odd_documents(spark, odd, empty):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, 1), (7, 0), (9, 1)], "doc_id long, quality int")
    assert quality.quality_scores(odd, labels).filter("score between 0 and 1").count() == odd.count()
    assert quality.quality_scores(empty, labels).count() == 0 and quality.accepted(empty, labels).count() == 0
    unlabelled = quality.quality_scores(odd, labels.limit(0))
    assert {r["score"] for r in unlabelled.collect()} == {0.5}


def test_dual_coordinate_descent_separates():
    draw = np.random.default_rng(5)
    rows = [np.sort(draw.choice(20, 6, replace=False)) for _ in range(200)]
    labels = np.array([1 if (row < 10).sum() > 3 else -1 for row in rows])
    weights, offset = quality.dual_coordinate_descent(rows, labels, np.ones(20), np.full(200, 100.0), passes=300)
    margins = np.array([weights[row].sum() / np.sqrt(len(row)) + offset for row in rows])
    assert (np.sign(margins) == labels).mean() > 0.97


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + place % 2) for place, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(part) <= 255 for part in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def plain_spans(text):
    return sorted(
        (m.start(), at, m.end(), kind)
        for at, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text)
        if valid(kind, m[0])
    )


def check_spans(docs):
    expected, found = [], []
    for row in docs.collect():
        spans = plain_spans(row["text"] or "")
        text = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in spans)
        counts = Counter(kind for *_, kind in spans)
        expected.append((row["doc_id"], *(counts[k] for k in PATTERNS), hashlib.sha256(text.encode()).hexdigest()))
    for row in personal_data(docs).collect():
        found.append((row["doc_id"], *(row[f"n_{k}"] for k in PATTERNS), row["base_sha256"]))
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_base_spans(table):
    draw = random.Random(6)
    parts = [
        "a.b@c.de", "x@y", "a@b.c%d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "0255.001.2.3", "1.2.3",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (234) 555-0100", "+12", "+49 30 1234567 ", "+1 2", "é",
        "\U0001f600", " ", "\n", "tel ", "5", ".", "-", "@", "+", "(", "name", "12345678901234567890",
    ]
    check_spans(table([(i, "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))) for i in range(800)]))


def test_spans_of_odd_documents(odd, empty, table):
    check_spans(odd)
    assert personal_data(empty).count() == 0
    long = "a1@b.io " * 3000 + "1" * 50_000 + " " + "x." * 30_000 + "@ " + "+1 2" * 2000
    check_spans(table([(1, long)]))


def test_added_spans_touch_no_base_span(table):
    rows = [(i, f"call me at +1 ({200 + i}) 555-{1000 + i} or mail me.{i}@mail.example.com now") for i in range(300)]
    rows += [(1000 + i, f"my phone is ({300 + i}) 555-{2000 + i} these days") for i in range(40)]
    found = {r["doc_id"]: r for r in personal_data(table(rows)).collect()}
    assert all(found[i]["n_phone"] == 1 and found[i]["n_added"] == 0 for i in range(300))
    assert all(found[1000 + i]["spans"] == "phone:12:26" for i in range(40))


def spots(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    content = [w for w in words if w not in ANCHORS]
    found, before = set(), 0
    for place, word in enumerate(words):
        if word in ANCHORS:
            found.add((word, *content[place - before : place - before + 3]))
            before += 1
    return found or {tuple(content[i : i + 3]) for i in range(len(content))}


def check_fingerprints(docs):
    rows = sorted(
        {(r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()}
    )
    found = sorted(fingerprints(docs).collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    assert len(found) == len(rows)
    jaccard = lambda a, b, same: len(a & b) / len(a | b) if a | b else float(same)
    for at, (row, (there, doc, text)) in enumerate(zip(found, rows)):
        after = rows[(at + 1) % len(rows)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert row["doc_id"] == (doc if there else None)
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert len(row["fingerprint"]) == 8 * len(spots(text))
        assert row["near_edited"] == pytest.approx(jaccard(spots(text), spots(edited), text == edited))
        assert row["near_next"] == pytest.approx(jaccard(spots(text), spots(after), text == after))


def test_fingerprints(table):
    draw = random.Random(7)
    words = [f"w{i}" for i in range(40)] + list(ANCHORS[:6])
    rows = [(doc * 3, " ".join(draw.choice(words) for _ in range(draw.randint(0, 50)))) for doc in range(150)]
    rows += [(1, rows[0][1]), (2, rows[0][1])]
    check_fingerprints(table(rows))
    check_fingerprints(table([(5, "a lonely document, the only one of its kind")]))


def test_fingerprints_of_odd_documents(table, empty):
    check_fingerprints(
        table([(None, "no id"), (1, None), (2, ""), (3, "??"), (4, "the " * 20_000 + "end"), (6, "é 語 \U0001f600 the x"), (7, "7"), (7, "7")])
    )
    assert fingerprints(empty).count() == 0


def test_classes_of_alike_fingerprints(table, empty):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(3000)] + list(ANCHORS[:8]) * 200
    base = [[draw.choice(words) for _ in range(150)] for _ in range(12)]
    rows = []
    for doc in range(120):
        text = list(draw.choice(base))
        for _ in range(draw.randint(0, 12)):
            text[draw.randrange(len(text))] = draw.choice(words)
        rows.append((doc, " ".join(text)))
    rows += [(200, ""), (201, None), (202, rows[0][1])]
    sets = {doc: spots(text or "") for doc, text in rows}
    label = {doc: doc for doc in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            union = sets[a] | sets[b]
            if (len(sets[a] & sets[b]) >= 0.8 * len(union)) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {doc: low if of == high else of for doc, of in label.items()}
    found = {r["doc_id"]: r["class_id"] for r in similar_classes(table(rows)).collect()}
    assert found == label
    assert similar_classes(empty).count() == 0


def test_an_id_with_most_rows_of_a_language_counts_once(table):
    """However many rows an id has, its language is learned and no more than one text of it is taken."""
    draw = random.Random(12)
    trained = [doc for doc in range(2000) if not held_out(doc, 4, 2)]
    rows = [(trained[0], prose(draw, LANGUAGES["xx"]), "xx") for _ in range(300)]
    rows += [(doc, prose(draw, LANGUAGES["yy"]), "yy") for doc in trained[1:120]]
    frame = table(rows)
    chosen = language.sample(language.training_rows(frame), 40).collect()
    assert Counter(r["lang"] for r in chosen) == {"xx": 1, "yy": 40}
    assert {r["lang_pred"] for r in language.languages_of(frame).collect()} == {"xx", "yy"}


def test_labels_of_an_id_with_many_rows_count_once(spark, table):
    trained = [doc for doc in range(2000) if not held_out(doc, 4, 2)]
    rows = [(trained[0], f"text {i}") for i in range(200)] + [(doc, f"own {doc}") for doc in trained[1:90]]
    labels = spark.createDataFrame([(doc, i % 2) for i, doc in enumerate(trained[:90])], "doc_id long, quality int")
    chosen = quality.labelled_sample(table(rows), labels, 30).collect()
    assert Counter(r["quality"] for r in chosen) == {0: 30, 1: 30}
    every = quality.labelled_sample(table(rows), labels, 1000).collect()
    assert len(every) == len({r["doc_id"] for r in every}) == 90


def test_quality_indicators_travel_as_bytes():
    """The driver gets a text's buckets as one value, not as an object for each number."""
    texts = ["Some words, some words again.", ""]
    batch = pa.RecordBatch.from_pydict(
        {"place": [1, 2], "doc_id": [1, 2], "quality": [1, 0], "text": texts}
    )
    (found,) = quality._indicated(iter([batch]))
    assert pa.types.is_binary(found.schema.field("found").type)
    for text, value in zip(texts, found.column("found").to_pylist()):
        assert np.frombuffer(value, "<i4").tolist() == quality.indicators(text).tolist()


def test_filtering_makes_texts_strings_run_by_run():
    texts = ["a" * 600_000, None, "b", "c" * 700_000, "", "d" * 2_000_000, "e"]
    scores = {"a": 0.9, "b": 0.1, "c": 0.8, "d": 0.69, "e": 0.7, "": 0.95}
    model = type("Model", (), {"score": lambda self, text: scores[text[:1]]})()
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": pa.array(texts, pa.string())})
    kept = list(quality._accepting(model, 1)([batch, batch.slice(0, 0)]))
    assert [row["doc_id"] for part in kept for row in part.to_pylist()] == [0, 1, 3, 4, 6]
    assert all(part.schema == batch.schema for part in kept)
    # No run holds more characters than a million, unless one text does.
    runs = [some for _, some in text_chunks(batch.column("text"))]
    assert [len(some) for some in runs] == [3, 2, 1, 1]
