"""Cutting a number into named, ordered bands."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bands:
    """``steps`` are (exclusive upper bound, name) in rising order.

    ``top`` names what lies above the last bound. A missing number gets ``missing``; where that is
    not set it lands in ``top``, as in a CASE that only tests upper bounds.
    """

    steps: tuple[tuple[int, str], ...]
    top: str
    missing: str | None = None

    def of(self, number: Column) -> Column:
        branches = [(number < bound, name) for bound, name in self.steps]
        if self.missing is not None:
            branches.insert(0, (number.isNull(), self.missing))
        (first, name), *rest = branches
        band = F.when(first, name)
        for condition, name in rest:
            band = band.when(condition, name)
        return band.otherwise(self.top)

    @property
    def names(self) -> list[str]:
        """All names in their natural order, the missing one first."""
        first = [] if self.missing is None else [self.missing]
        return [*first, *(name for _, name in self.steps), self.top]


# The band edges and names.
TEXT_LENGTH = Bands(((1, "empty"), (80, "short"), (200, "medium"), (500, "long")), "very_long")
TIME_OF_DAY = Bands(((6, "night"), (12, "morning"), (18, "afternoon")), "evening")
FOLLOWERS = Bands(
    ((1, "0"), (10, "1-9"), (100, "10-99"), (1000, "100-999")), "1000+", missing="unknown"
)
ACTIVITY = Bands(((10, "1-9"), (100, "10-99"), (1000, "100-999")), "1000+")


def band_rank(band: Column, bands: Bands) -> Column:
    """Position of a band name in its natural order, from 1; 0 for a name that is not a band."""
    return F.array_position(F.array(*[F.lit(name) for name in bands.names]), band)
