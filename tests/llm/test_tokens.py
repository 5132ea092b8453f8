"""Token ids, their files, and packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyreach.llm import tokens
from tallyreach.llm.packing import Step, best_fit_decreasing, pack, token_pieces
from tallyreach.llm.token_files import read_metadata, read_tokens, token_digest, write_tokens
from tallyreach.llm.tokens import Encoder
from tallyreach.sources.storage import scratch_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_ids_of_the_whole_text(plain):
    draw = random.Random(0)
    texts = ["".join(draw.choice("ab 1 \n\t.'s é\r　\x1c\x85-") for _ in range(draw.randint(0, 15))) for _ in range(3000)]
    texts += ["", " ", "a  b", "\n\n", "don't  stop\n", "<|endoftext|> x", "a\0 b", "  lead", "trail  "]
    encoder = Encoder(PATH)
    for _ in range(2):  # with and without known pieces
        ids, lengths = encoder.encode(texts)
        ends = np.cumsum(lengths)
        for text, end, length in zip(texts, ends, lengths):
            assert ids[end - length : end].tolist() == plain(text), repr(text)


def test_known_words_are_merged_once_whatever_surrounds_them(plain, monkeypatch):
    """Words of known letters go to the tokenizer's model, each different one of a call once; ids are those of the text."""
    draw = random.Random(1)
    letters = "aZé7Ωжü語가あא!?.,;'\"<|>_-~{"
    texts = [
        " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(0, 9)))
        for _ in range(2000)
    ]
    texts += ["it's we'll 'sun 'Tis I'VE they'd've", "ʼn ª² ½ ०१ Ⅳ ㎏ ß'd", " x", "x ", "<|endoftext|>", "\u0120a !\u010a"]
    encoder = Encoder(PATH)
    for given in (texts, pa.array(["before", *texts, None]).slice(1), pa.array(texts, pa.large_string())):
        ids, lengths = encoder.encode(given)
        ends = np.cumsum(lengths)
        for text, end, length in zip(texts, ends, lengths):
            assert ids[end - length : end].tolist() == plain(text), repr(text)
        assert len(lengths) == len(given)

    encoder, sent = Encoder(PATH), []
    monkeypatch.setattr(encoder, "_alone", lambda pieces, f=encoder._alone: sent.append(("alone", pieces)) or f(pieces))
    monkeypatch.setattr(encoder, "_together", lambda pieces, f=encoder._together: sent.append(("together", pieces)) or f(pieces))
    monkeypatch.setattr(encoder, "_merged", lambda words, f=encoder._merged: sent.append(("merged", words)) or f(words))
    ids, _ = encoder.encode(["Word word, word. (word) ж,ж", "word; ж. жж"])
    assert ids.tolist() == plain("Word word, word. (word) ж,ж") + plain("word; ж. жж")
    merged = [word for kind, words in sent if kind == "merged" for word in words if word]
    assert not any(pieces for kind, pieces in sent if kind != "merged")
    assert sorted(merged) == sorted(["Word", " word", "word", ",", ".", " (", ")", ";", " ж", ",", "ж", ".", " жж"])


def test_a_forgetful_encoder_gives_the_same_ids(plain, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 20)
    monkeypatch.setattr(tokens, "KEPT_PIECES", 10)
    encoder = Encoder(PATH)
    for start in range(0, 200, 20):
        texts = [f"w{n}, x{n % 7}\ty  z{n}'s é{n}" for n in range(start, start + 20)]
        ids, lengths = encoder.encode(texts)
        assert ids.tolist() == [n for text in texts for n in plain(text)]
        assert lengths.tolist() == [len(plain(text)) for text in texts]


def test_files_hold_all_ids_in_order(spark, odd, plain, tmp_path):
    path = str(tmp_path / "tokens")
    write_tokens(odd, path, PATH)
    stored = read_tokens(spark, path).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    digests = sorted(token_digest(spark, path).collect(), key=lambda r: r["start"])
    assert [d["doc_id"] for d in digests] == [doc for doc, _ in rows]
    start = 0
    for digest, (_, text) in zip(digests, rows):
        ids = [*plain(text), 2]
        assert (digest["start"], digest["n_tokens"], digest["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert sorted(len(r["input_ids"]) for r in stored) == sorted(r["n_tokens"] for r in digests)
    one = read_tokens(spark, path).filter("doc_id = 5").collect()
    assert [r["input_ids"] for r in one] == [[*plain("one two"), 2]]
    meta = {(r["doc_id"], r["start"], r["n_tokens"]) for r in read_metadata(spark, path).collect()}
    assert meta == {(d["doc_id"], d["start"], d["n_tokens"]) for d in digests}


def test_files_of_no_document(spark, empty, tmp_path):
    write_tokens(empty, str(tmp_path / "none"), PATH)
    assert token_digest(spark, str(tmp_path / "none")).count() == 0


def sequentially(lengths, capacity):
    """Best-fit decreasing, one run after another."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [room for room in rooms if room >= length]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - length)
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(25))
def test_steps_are_those_of_best_fit_decreasing(seed):
    draw = random.Random(seed)
    capacity = draw.choice([7, 10, 64, 100])
    lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 400))]
    counts = {length: lengths.count(length) for length in set(lengths)}
    filled = {}
    steps = best_fit_decreasing(counts, capacity)
    for at, step in enumerate(steps):
        after = steps[at + 1] if at + 1 < len(steps) else Step(0, 0, 0, 0, 0)
        end = after.rank if after.length == step.length else counts[step.length]
        for nth in range(end - step.rank):
            number, offset = step.bin + nth // step.per_bin, step.offset + nth % step.per_bin * step.length
            assert filled.get(number, 0) == offset
            filled[number] = offset + step.length
    assert sorted(capacity - used for used in filled.values()) == sequentially(lengths, capacity)


def test_packing_is_gapless_and_whole(odd, plain):
    rows = pack(token_pieces(odd, PATH)).collect()
    ends = {}
    for row in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert row["offset"] == ends.get(row["sequence_id"], 0)
        ends[row["sequence_id"]] = row["offset"] + row["length"]
        assert ends[row["sequence_id"]] <= 2048
    found, expected = [], []
    for doc, text in [(r["doc_id"], r["text"] or "") for r in odd.collect()]:
        ids = [*plain(text), 0]
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        expected += [(doc, p, a, b - a, crc(ids[a:b])) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    found = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(found, key=str) == sorted(expected, key=str)


def test_packing_nothing(empty):
    assert pack(token_pieces(empty, PATH)).count() == 0


def test_scratch_folder_is_the_named_one(spark):
    assert scratch_folder(spark)


def test_texts_are_made_strings_run_by_run():
    """Each run holds about ENCODED_CHARS characters, or one longer text; together they are all texts."""
    size = tokens.ENCODED_CHARS
    texts = ["", "é" * (size // 2), "b" * (size // 2), "", "c", "d" * (2 * size), "", "語"]
    column = pa.array(["before", *texts]).slice(1)
    runs = list(tokens.text_chunks(column))
    assert [text for _, run in runs for text in run] == texts
    assert [run for _, run in runs] == [texts[rows] for rows, _ in runs]
    assert [len(run) for _, run in runs] == [4, 1, 1, 2]
    assert list(tokens.text_chunks(pa.array([], pa.string()))) == []
