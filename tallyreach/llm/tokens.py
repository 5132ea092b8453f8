"""Token ids of many texts, by a public tokenizer of the tokenizers library.

A byte-level BPE tokenizer cuts a text into words before it merges bytes, and a single space or line
feed always starts a new word. So a text's ids are the ids of its
pieces between those places, put together. Pieces repeat far more often than texts do: each is
encoded once for a worker, and a text's ids are gathered from the table of pieces. Pieces are cut and
told apart as bytes; only the different ones of a run of texts become strings.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_CHARS = 4_000_000
# Of texts made strings at once.
ENCODED_CHARS = 1_000_000
# Of texts cut into pieces at once: the places of pieces and their ids take many times the memory of the texts.
CUT_CHARS = 2_000_000
MAX_PIECES = 300_000
KEPT_PIECES = 150_000

# Runs of white space leave in doubt what starts a word; then only the sure places cut.
_BLANK = re.compile(r"\s")
_OTHER_SPACE = re.compile(r"[^\S \n]")
_SURE = re.compile(r"(?<=\S)(?= \S)")
_SPACE, _FEED = 32, 10
_ASCII_BLANKS = np.zeros(256, bool)
_ASCII_BLANKS[[*range(9, 14), *range(28, 33)]] = True

# A byte-level tokenizer that cuts words by its own pattern. What the pattern cuts is told here for ASCII
# and for ranges of letters alone, none of which a version of Unicode sees otherwise.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_LETTERS = "A-Za-zÀ-ÖØ-öø-ˁΑ-ΡΣ-ώЀ-ҁҊ-ԣא-תء-غـ-يぁ-ゖァ-ヺ一-龥가-힣"
_KNOWN = re.compile(f" ?(?:[!-~]|[{_LETTERS}])+")
_WORDS = re.compile(rf"\n|'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+")
# Space, letter, digit and others; an apostrophe may begin a word within others.
_APOSTROPHE = ord("'")
_CLASSES = np.full(256, 3, np.uint8)
_CLASSES[_SPACE] = 0
_CLASSES[[c for c in range(128) if chr(c).isalpha()]] = 1
_CLASSES[[c for c in range(128) if chr(c).isdigit()]] = 2


def _byte_letters() -> dict[int, int]:
    """The letters by which a byte-level vocabulary writes bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}


_BYTE_LETTERS = _byte_letters()


def _strings(data: np.ndarray, starts: np.ndarray) -> pa.StringArray:
    """The texts that begin at ``starts`` in UTF-8 bytes, without a copy."""
    ends = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
    return pa.StringArray.from_buffers(len(starts), ends, pa.py_buffer(np.ascontiguousarray(data)))


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, and where each begins and the last ends."""
    _, ends, data = texts.buffers()
    bounds = np.frombuffer(ends or bytes(4), np.int32)[texts.offset :][: len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def _starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts between ``bounds`` begin in their UTF-8 bytes.

    Pieces give the ids of a text when encoded one by one, if spaces and line feeds are its only blanks.
    """
    space, feed = data == _SPACE, data == _FEED
    starts = space | feed
    first = np.zeros(len(data) + 1, bool)
    first[bounds] = True
    twice = np.flatnonzero(starts[1:] & starts[:-1] & ~first[1:-1])
    starts[1:] |= feed[:-1]
    if len(twice):
        unsure = np.zeros(len(bounds) - 1, bool)
        unsure[np.searchsorted(bounds, twice, "right") - 1] = True
        solid = ~_ASCII_BLANKS[data]
        sure = np.zeros(len(data), bool)
        sure[1:-1] = space[1:-1] & solid[:-2] & solid[2:] & ~first[2:-1]
        starts = np.where(np.repeat(unsure, np.diff(bounds)), sure, starts)
    return np.flatnonzero(starts | first[:-1])


def _gathered(ids: np.ndarray, ends: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the ``used`` entries of a table one after another, and how many each has."""
    lengths = ends[used + 1] - ends[used]
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    return ids[np.arange(total) + np.repeat(ends[used] - (stops - lengths), lengths)], lengths


def _sums(lengths: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate(([0], np.cumsum(lengths)))[bounds])


class Encoder:
    """Ids of texts as flat arrays. Holds about MAX_PIECES pieces between two calls."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        cutter = self.tokenizer.pre_tokenizer
        how = json.loads(cutter.__getstate__()) if cutter is not None else {}
        self.byte_level = self.tokenizer.normalizer is None and _BYTE_LEVEL.items() <= how.items()
        # Ids of tokens that begin with a space, which the vocabulary writes as this letter.
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.begins[number] = token.startswith("\u0120")
        self.places: dict[str, int] = {}
        self.blank: list[int] = []  # pieces with other white space
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _forget(self) -> None:
        """Keep the pieces that were met first, which are the frequent ones."""
        kept = dict(islice(self.places.items(), KEPT_PIECES))
        self.places = kept
        self.blank = [place for place in self.blank if place < len(kept)]
        self.ends = self.ends[: len(kept) + 1]
        self.ids = self.ids[: self.ends[-1]].copy()

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many each has."""
        if len(self.places) > MAX_PIECES:
            self._forget()
        column = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
        data, bounds = _bytes(column)
        starts = _starts(data, bounds)
        kinds, used = self._numbered(data, starts)
        if self.blank:
            blank = np.isin(kinds, self.blank)
            if blank.any():
                owners = np.unique(np.searchsorted(bounds, starts[blank[used]], "right") - 1).tolist()
                unsure = np.zeros(len(column), bool)
                unsure[owners] = True
                kept = starts[~unsure[np.searchsorted(bounds, starts, "right") - 1]]
                own = [
                    bounds[owner] + np.cumsum([0, *(len(piece.encode()) for piece in _SURE.split(column[owner].as_py())[:-1])])
                    for owner in owners
                ]
                starts = np.sort(np.concatenate([kept, *own]))
                kinds, used = self._numbered(data, starts)
        ids, lengths = _gathered(self.ids, self.ends, kinds[used])
        return ids, _sums(lengths, np.searchsorted(starts, bounds))

    def _numbered(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the different pieces that begin at ``starts``, and which of them each piece is."""
        pieces = _strings(data, starts).dictionary_encode()
        different = pieces.dictionary.to_numpy(zero_copy_only=False)
        kinds = np.fromiter(map(self.places.get, different, repeat(-1)), np.int64, len(different))
        fresh = np.flatnonzero(kinds < 0)
        if len(fresh):
            kinds[fresh] = len(self.places) + np.arange(len(fresh))
            self._learn(different[fresh], *_bytes(pieces.dictionary.take(pa.array(fresh))))
            self.places.update(zip(different[fresh], kinds[fresh].tolist()))
        return kinds, pieces.indices.to_numpy()

    def _learn(self, pieces: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> None:
        """Encode pieces, given also as bytes: word by word where it is known what the tokenizer takes for a word."""
        printable = (data > _SPACE) & (data < 127) & (data != _APOSTROPHE)
        printable[bounds[:-1]] |= data[bounds[:-1]] == _SPACE
        kinds = np.zeros(len(pieces), np.int8)
        if self.byte_level:
            kinds[np.logical_and.reduceat(printable, bounds[:-1])] = 3
        of_kind: list[list[str]] = [[], [], []]
        for at in np.flatnonzero(kinds == 0).tolist():
            piece = pieces[at]
            if self.byte_level and _KNOWN.fullmatch(piece):
                kinds[at] = 2
            elif piece[:1] == " " and len(piece) > 1 and not _BLANK.search(piece, 1):
                kinds[at] = 1
            elif _OTHER_SPACE.search(piece):
                self.blank.append(len(self.places) + at)
            of_kind[kinds[at]].append(piece)
        sizes = np.diff(bounds)
        encoded = [
            self._alone(of_kind[0]),
            self._together(of_kind[1]),
            self._by_words(of_kind[2]),
            self._by_bytes(data[np.repeat(kinds == 3, sizes)], sizes[kinds == 3]),
        ]
        # Put all kinds in the order of the pieces.
        lengths = np.zeros(len(pieces), np.int64)
        for kind, (_, found) in enumerate(encoded):
            lengths[kinds == kind] = found
        ids, kind_of = np.empty(int(lengths.sum()), np.int32), np.repeat(kinds, lengths)
        for kind, (found, _) in enumerate(encoded):
            ids[kind_of == kind] = found
        self.ids = np.concatenate((self.ids, ids))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(lengths)))

    def _alone(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.int32), lengths

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces that begin with a space and hold no other blank."""
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for start in range(0, len(pieces), 20_000):
            text = "".join(pieces[start : start + 20_000])
            ids.append(np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32))
            lengths.append(np.diff(np.append(np.flatnonzero(self.begins[ids[-1]]), len(ids[-1]))))
        return np.concatenate(ids), np.concatenate(lengths)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, which the tokenizer's model merges, and where each word's end."""
        merge = self.tokenizer.model.tokenize
        encoded = [
            [token.id for token in merge(word.encode().decode("latin-1").translate(_BYTE_LETTERS))]
            if not word.isascii()
            else [token.id for token in merge(word.replace(" ", "\u0120"))]
            for word in words
        ]
        ends = np.cumsum([0, *map(len, encoded)])
        return np.fromiter(chain.from_iterable(encoded), np.int32, int(ends[-1])), ends

    def _by_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces of ASCII and known letters, each different word once."""
        words = _WORDS.findall("".join([f"{piece}\n" for piece in pieces]))
        places = {word: at for at, word in enumerate(dict.fromkeys(words))}
        used = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
        ids, ends = self._merged([word.removesuffix("\n") for word in places])
        ids, lengths = _gathered(ids, ends, used)
        last = np.flatnonzero(used == places.get("\n", -1))
        return ids, _sums(lengths, np.concatenate(([0], last + 1)))

    def _by_bytes(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces of printable ASCII without apostrophes, at most one space before them: words end where the class of bytes does."""
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        classes = _CLASSES[data]
        begins = np.ones(len(data) + 1, bool)
        begins[1:-1] = (classes[1:] != classes[:-1]) & (classes[:-1] != _CLASSES[_SPACE])
        begins[bounds] = True
        starts = np.flatnonzero(begins[:-1])
        words = _strings(data, starts).dictionary_encode()
        ids, ends = self._merged(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, lengths = _gathered(ids, ends, words.indices.to_numpy())
        return ids, _sums(lengths, np.searchsorted(starts, bounds))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file; worker processes serve many tasks."""
    return Encoder(path)


def chunks(texts: list[str], most: int | None = None) -> Iterator[slice]:
    """Runs of at most ``most`` texts that together have about CHUNK_CHARS characters, or one longer."""
    start = size = 0
    for at, text in enumerate(texts):
        if at - start == most or (size and size + len(text) > CHUNK_CHARS):
            yield slice(start, at)
            start, size = at, 0
        size += len(text)
    if start < len(texts):
        yield slice(start, len(texts))


def column_chunks(column: pa.Array, chars: int = CUT_CHARS) -> Iterator[tuple[slice, pa.Array]]:
    """Runs of texts with about ``chars`` characters, or one longer text."""
    sizes = pc.fill_null(pc.utf8_length(column), 0)
    total = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = int(total[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + chars, "right")))
        yield slice(start, stop), column.slice(start, stop - start)
        start = stop


def text_chunks(column: pa.Array) -> Iterator[tuple[slice, list[str]]]:
    """Runs of texts with about ENCODED_CHARS characters, or one longer text, made strings run by run."""
    for rows, some in column_chunks(column, ENCODED_CHARS):
        yield rows, some.to_pylist()


def ids_crc32(ids: np.ndarray) -> int:
    """CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4"))
