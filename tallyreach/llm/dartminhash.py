"""DartMinHash signatures of weighted sets.

Every element owns a plane with a weight and a rank axis, on which hashing throws darts: one on
average for each unit of area, at places that depend on the element alone. A set sees the darts left
of its element's weight and below a rank limit. Each dart belongs to one of ``k`` coordinates; the
seen dart of the lowest rank is the set's value there. Two sets agree in a coordinate with the
probability of their weighted Jaccard similarity. The limit falls with the total weight, so a set sees
some k (ln k + 3) darts however long it is, and the cells of the plane that hold none are passed over.
"""

from __future__ import annotations

import math

import numpy as np

from tallyreach.llm.shingles import WeightedSets, mix, unit

# The lowest cell of the rank axis ends here; above it each cell is as wide as all below together,
# until cells reach the largest area.
LOWEST = 2.0**-7
MOST_AREA = 16.0


def _poisson_cdf(area: float) -> np.ndarray:
    terms = [math.exp(-area)]
    for n in range(1, int(area + 12 * math.sqrt(area) + 20)):
        terms.append(terms[-1] * area / n)
    return np.cumsum(terms)


def _cells(level: int, limit: float):
    """Rank intervals up to ``limit`` for the weights of a level, as (number, low, width)."""
    number, low, width = 0, 0.0, min(LOWEST, MOST_AREA / 2**level)
    while low < limit:
        yield number, low, width
        number, low = number + 1, low + width
        width = min(low, MOST_AREA / 2**level)


def _throw(sets: WeightedSets, limits: np.ndarray, k: int):
    """The darts that the sets see: owner, coordinate, rank and name."""
    owners, coordinates, ranks, names = [], [], [], []
    limit = limits[sets.owner]
    heaviest = sets.weight.max(initial=0.0)
    level = 0
    while 2**level - 1 < heaviest:
        heavy = 2.0**level
        lightest = heavy - 1
        active = np.flatnonzero((sets.weight > lightest) & (limit > 0))
        highest = limit[active].max(initial=0.0)
        for number, low, width in _cells(level, highest):
            active = active[limit[active] > low]
            cell = mix(sets.element[active] ^ mix(np.uint64([(level << 32) + number])))
            darts = np.searchsorted(_poisson_cdf(heavy * width), unit(cell), side="right")
            hit = np.flatnonzero(darts)
            darts = darts[hit]
            at = np.repeat(hit, darts)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
            name = mix(cell[at] + (nth + 1).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            other = mix(name ^ np.uint64(0xA0761D6478BD642F))
            which = active[at]
            rank = low + width * unit(name)
            seen = (rank < limit[which]) & (lightest + heavy * unit(other) < sets.weight[which])
            owners.append(sets.owner[which[seen]])
            coordinates.append(mix(other[seen]) % np.uint64(k))
            ranks.append(rank[seen])
            names.append(name[seen])
        level += 1
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(owners, np.int64), join(coordinates, np.uint64), join(ranks, float), join(names, np.uint64)


def signatures(sets: WeightedSets, k: int) -> np.ndarray:
    """``k`` values for each set; rows of empty sets are zero."""
    values = np.zeros((sets.count, k), np.uint64)
    totals = sets.totals
    with np.errstate(divide="ignore"):
        limits = np.where(totals > 0, k * (math.log(k) + 3) / totals, 0.0)
    pending = limits > 0
    while pending.any():
        owner, coordinate, rank, name = _throw(sets, np.where(pending, limits, 0.0), k)
        slot = owner * k + coordinate.astype(np.int64)
        best = np.full(sets.count * k, np.inf)
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        values.reshape(-1)[slot[first]] = name[first]
        # A coordinate without a dart: look further up in the plane.
        pending &= np.isinf(best.reshape(sets.count, k)).any(axis=1)
        limits = limits * 2
    return values
