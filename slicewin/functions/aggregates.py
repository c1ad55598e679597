"""Aggregates as lift, combine and lower: partial columns of a slice, their merge, and the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Aggregate:
    """``lift``: aggregates over rows that give the partials; ``combine``: for each partial its merge;
    ``lower``: the result from the merged partials. Without ``combine``, or where the order of rows counts,
    rows are aggregated straight. ``empty``: the value for a window without rows, if not null. ``histogram``
    (column, top, bottom): the quantile top / bottom of a column, which planners may take from counts of values."""

    name: str
    lift: tuple[Column, ...]
    combine: tuple[Callable[[Column], Column], ...]
    lower: Callable[..., Column]
    order_sensitive: bool = False
    empty: Column | None = None
    histogram: tuple[str, int, int] | None = None

    @property
    def shares_slices(self) -> bool:
        return bool(self.combine) and not self.order_sensitive


def sum_of(column: str | Column, name: str = "sum") -> Aggregate:
    return Aggregate(name, (F.sum(column),), (F.sum,), lambda s: s)


def count_rows(name: str = "count") -> Aggregate:
    return Aggregate(name, (F.count(F.lit(1)),), (F.sum,), lambda n: n, empty=F.lit(0).cast("long"))


def min_of(column: str | Column, name: str = "min") -> Aggregate:
    return Aggregate(name, (F.min(column),), (F.min,), lambda m: m)


def max_of(column: str | Column, name: str = "max") -> Aggregate:
    return Aggregate(name, (F.max(column),), (F.max,), lambda m: m)


def mean_of(column: str | Column, name: str = "mean") -> Aggregate:
    return Aggregate(name, (F.sum(column), F.count(column)), (F.sum, F.sum), lambda s, n: s / n)


def integer_mean_of(column: str, name: str = "mean") -> Aggregate:
    """The mean cut towards zero, as of integers."""
    return Aggregate(name, (F.sum(column).cast("long"), F.count(column)), (F.sum, F.sum), lambda s, n: F.try_divide(s - F.try_mod(s, n), n).cast("long"))


def quantile_of(column: str, p: float, name: str = "quantile") -> Aggregate:
    """The smallest value with at least the share ``p`` of all values at or below it; exact, from rows."""
    return Aggregate(name, (F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"),), (), lambda q: q)


def shared_quantile_of(column: str, top: int, bottom: int, name: str = "quantile") -> Aggregate:
    """As ``quantile_of`` for top / bottom, of the column's type; windows of time take it from counts of values by slice."""
    return Aggregate(name, (F.expr(f"percentile_disc({top}D / {bottom}) WITHIN GROUP (ORDER BY {column})"),), (), lambda q: q, histogram=(column, top, bottom))


def approximate_quantile_of(column: str, p: float, name: str = "quantile") -> Aggregate:
    """A value whose rank is near the share ``p``: sketches of slices are merged."""
    value = F.col(column).cast("double")
    return Aggregate(name, (F.kll_sketch_agg_double(value),), (F.kll_merge_agg_double,), lambda s: F.kll_sketch_get_quantile_double(s, F.lit(float(p))))


def reduce_of(column: str, order: str, merge: Callable[[Column, Column], Column], name: str = "reduce") -> Aggregate:
    """Any function of two values, applied from left to right in order of ``order``; bounded by a window's rows."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda r: r[column])
    return Aggregate(name, (F.reduce(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), values[0], merge),), (), lambda r: r, order_sensitive=True)


def custom(name: str, lift: tuple[Column, ...], combine: tuple[Callable[[Column], Column], ...], lower: Callable[..., Column], order_sensitive: bool = False) -> Aggregate:
    """An aggregate of the user's; ``order_sensitive`` keeps it off slices."""
    return Aggregate(name, lift, combine, lower, order_sensitive)


def pandas_of(columns: list[str], function: Callable[..., object], kind: str, name: str = "value") -> Aggregate:
    """Any function of a window's rows, given as one series for each column; all rows of a window meet in one task."""

    @F.pandas_udf(kind)
    def udf(*series: pd.Series) -> float:
        return function(*series)

    # The kind of a pandas function is read from its hints, which name a plain value for a grouped aggregate.
    return Aggregate(name, (udf(*columns),), (), lambda v: v)


@dataclass(frozen=True)
class Fold:
    """An aggregate of single values for stateful streams: lift a value, combine partials, lower the last to ``kind``.

    ``invert`` takes a value's partial out again, where that is possible; otherwise partials are made anew.
    """

    name: str
    kind: str
    lift: Callable[[object], object]
    combine: Callable[[object, object], object]
    lower: Callable[[object], object] = lambda p: p
    invert: Callable[[object, object], object] | None = None

    def of(self, values: list) -> object:
        """The aggregate of ``values`` in their order; None of none."""
        partial = None
        for v in values:
            if v is not None:
                partial = self.lift(v) if partial is None else self.combine(partial, self.lift(v))
        return None if partial is None else self.lower(partial)

    def sliding(self, values: list, size: int, slide: int) -> list[object]:
        """The aggregate of each full window of ``size`` values, every ``slide``; values leave by ``invert`` if there is one."""
        if self.invert is None or slide >= size or any(v is None for v in values):
            return [self.of(values[i : i + size]) for i in range(0, len(values) - size + 1, slide)]
        out, partial = [], None
        for i in range(0, len(values) - size + 1, slide):
            fresh = values[:size] if partial is None else values[i + size - slide : i + size]
            for v in [] if partial is None else values[i - slide : i]:
                partial = self.invert(partial, self.lift(v))
            for v in fresh:
                partial = self.lift(v) if partial is None else self.combine(partial, self.lift(v))
            out.append(self.lower(partial))
        return out


def fold_sum(name: str = "sum") -> Fold:
    return Fold(name, "long", lambda v: v, lambda a, b: a + b, invert=lambda a, b: a - b)


def fold_count(name: str = "count") -> Fold:
    return Fold(name, "long", lambda v: 1, lambda a, b: a + b, invert=lambda a, b: a - b)


def fold_min(name: str = "min") -> Fold:
    return Fold(name, "long", lambda v: v, min)


def fold_max(name: str = "max") -> Fold:
    return Fold(name, "long", lambda v: v, max)


def fold_mean(name: str = "mean") -> Fold:
    return Fold(name, "double", lambda v: (v, 1), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda p: p[0] / p[1], lambda a, b: (a[0] - b[0], a[1] - b[1]))


def fold_quantile(top: int, bottom: int, name: str = "quantile") -> Fold:
    return Fold(name, "long", lambda v: [v], lambda a, b: a + b, lambda p: sorted(p)[max(0, -(-len(p) * top // bottom) - 1)])
