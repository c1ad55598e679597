"""Kinds of windows. Time is a whole number in any unit; edges are half open."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MS, SECOND, MINUTE, HOUR, DAY = 1, 1_000, 60_000, 3_600_000, 86_400_000


def _positive(*numbers: int) -> None:
    if any(n <= 0 for n in numbers):
        raise ValueError("sizes, slides and gaps of windows are positive")


@dataclass(frozen=True)
class Tumbling:
    """[k size, (k + 1) size)."""

    size: int

    def __post_init__(self):
        _positive(self.size)

    @property
    def slide(self) -> int:
        return self.size


@dataclass(frozen=True)
class Sliding:
    """[k slide, k slide + size), k from 0."""

    size: int
    slide: int

    def __post_init__(self):
        _positive(self.size, self.slide)


@dataclass(frozen=True)
class FixedBand:
    """The one window [start, start + size)."""

    start: int
    size: int

    def __post_init__(self):
        _positive(self.size)


@dataclass(frozen=True)
class Session:
    """[first, last + gap) of rows at most ``gap`` apart; time only, as are bands and punctuations."""

    gap: int

    def __post_init__(self):
        _positive(self.gap)


@dataclass(frozen=True)
class Punctuation:
    """A row for which ``matches`` holds opens a window and closes the one before; the first row opens the first."""

    matches: Column


def pattern(**fields: object) -> Column:
    """Rows whose fields are as given: a text is a regular expression that the whole field matches, None matches anything, another value is equal."""
    each = [F.col(k).cast("string").rlike(rf"\A(?:{v})\z") if isinstance(v, str) else F.col(k).eqNullSafe(F.lit(v)) for k, v in fields.items() if v is not None]
    return reduce(lambda a, b: a & b, each, F.lit(True))


@dataclass(frozen=True)
class CountTumbling(Tumbling):
    """As Tumbling, over the rows' ranks from 0; only full windows."""


@dataclass(frozen=True)
class CountSliding(Sliding):
    """As Sliding, over the rows' ranks from 0; only full windows."""


@dataclass(frozen=True)
class UserDefined:
    """``assign`` gives for the time column an array of structs (start, end)."""

    assign: Callable[[Column], Column]


@dataclass(frozen=True)
class UserContext:
    """``windows`` gives the windows (start, end) of one key from all its rows, which come in order of column ``time``."""

    windows: Callable[[pd.DataFrame], Iterable[tuple[int, int]]]


@dataclass(frozen=True)
class Added:
    """``window`` as added while a stream ran: only windows of it that start at or after ``since``."""

    window: object
    since: int
