"""Weighted sets of word shingles, for whole batches of texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

WORDS = 5
_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
    np.uint64,
)
_MAX_KNOWN = 150_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of SplitMix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers from 0 to 1."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class _Known(dict):
    """Hashes of the words seen, at most about _MAX_KNOWN of them."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MAX_KNOWN:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_known = _Known()


def normal_words(text: str) -> list[str]:
    return text.lower().split()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: list[str], size: int = WORDS) -> np.ndarray:
    """A hash for each run of ``size`` words; a shorter text is one run, no word gives none."""
    return run_hashes(word_hashes(words), size)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    count = max(len(hashes) - size + 1, min(len(hashes), 1))
    width = min(size, len(hashes))
    total = np.full(count, width, np.uint64)
    for place in range(width):
        total += mix(hashes[place : place + count] * _MULTIPLIERS[place])
        total = mix(total)
    return total


def gapped_hashes(hashes: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """A hash for each start of the words at ``places`` from it, as :func:`run_hashes` gives for such words in a row."""
    count = max(len(hashes) - places[-1], 0)
    total = np.full(count, len(places), np.uint64)
    for number, place in enumerate(places):
        total += mix(hashes[place : place + count] * _MULTIPLIERS[number])
        total = mix(total)
    return total


@dataclass
class WeightedSets:
    """Elements with weights; ``owner`` says which set each belongs to, in ascending order."""

    owner: np.ndarray
    element: np.ndarray
    weight: np.ndarray
    count: int

    @property
    def totals(self) -> np.ndarray:
        return np.bincount(self.owner, self.weight, self.count)


def weighted_sets(all_words: list[list[str]]) -> WeightedSets:
    """Each text's shingles, weighted by how often they occur in it."""
    owners, elements, weights = [], [], []
    for number, words in enumerate(all_words):
        element, weight = np.unique(shingle_hashes(words), return_counts=True)
        owners.append(np.full(len(element), number, np.int64))
        elements.append(element)
        weights.append(weight)
    if not owners:
        return WeightedSets(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0), 0)
    return WeightedSets(
        np.concatenate(owners),
        np.concatenate(elements),
        np.concatenate(weights).astype(np.float64),
        len(all_words),
    )


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(normal_words(text)), return_counts=True)


def tokens_of(text: str) -> np.ndarray:
    """A hash for each time that each shingle occurs, so that weighted sets are plain ones."""
    element, weight = counted(text)
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return mix(np.repeat(element, weight) + nth.astype(np.uint64) * _MULTIPLIERS[0])


def weighted_jaccard(a: tuple, b: tuple) -> float:
    """Sum of the smaller by sum of the larger weights; two empty sets are alike."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    return shared / (total - shared)
