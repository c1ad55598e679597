"""A query is a value: keys, time, windows and aggregates, put over any table or stream by ``df.transform(query.over)``."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from slicewin.functions.aggregates import Aggregate
from slicewin.operators.windows import Added
from slicewin.plans.planner import aggregate_windows
from slicewin.streaming.windows import stream_windows


@dataclass(frozen=True)
class WindowedQuery:
    """Each step gives a new query; without keys there is one group."""

    keys: tuple[str, ...] = ()
    time: str = "ts"
    windows: tuple = ()
    aggregates: tuple[Aggregate, ...] = ()
    order: tuple[str, ...] = ()
    lateness: int = 1_000
    options: dict = field(default_factory=dict)

    def key(self, *columns: str) -> WindowedQuery:
        return replace(self, keys=columns)

    def at(self, column: str) -> WindowedQuery:
        return replace(self, time=column)

    def ordered(self, *columns: str) -> WindowedQuery:
        """Ties between rows of one time, for windows over counts."""
        return replace(self, order=columns)

    def window(self, w, since: int | None = None) -> WindowedQuery:
        """One more window; with ``since`` only those that start at or after it."""
        return replace(self, windows=(*self.windows, w if since is None else Added(w, since)))

    def aggregate(self, *aggregates: Aggregate) -> WindowedQuery:
        return replace(self, aggregates=(*self.aggregates, *aggregates))

    def allowed_lateness(self, ms: int) -> WindowedQuery:
        """Of streams: how far behind the newest time rows still count."""
        return replace(self, lateness=ms)

    def batch(self, **options) -> WindowedQuery:
        """Options of ``aggregate_windows`` for tables: watermark, include_empty, share, late."""
        return replace(self, options=self.options | options)

    def over(self, rows: DataFrame) -> DataFrame:
        """The results for a table, or for a stream whose windows need no state of their own."""
        if not self.windows or not self.aggregates:
            raise ValueError("a query has a window and an aggregate at least")
        if rows.isStreaming:
            return stream_windows(rows, list(self.windows), list(self.aggregates), self.time, list(self.keys), self.lateness)
        return aggregate_windows(rows, list(self.windows), list(self.aggregates), self.time, list(self.keys), list(self.order), **self.options)
