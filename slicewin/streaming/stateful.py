"""Windows over streams whose edges depend on rows: punctuations, counts and sessions that late rows refine.

Each keeps the rows or partials of a key in Spark's state store until the watermark has passed them; timers on
event time give the windows out. What is kept for a key is bounded by the rows of its open windows and the lateness.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from slicewin.functions.aggregates import Fold
from slicewin.operators.windows import CountSliding, CountTumbling, Punctuation, Session, UserContext

ROWS = "ts long, tie long, mark boolean, row binary"


@dataclass
class Windowed(StatefulProcessor):
    """What all share: names, folds over columns, and output."""

    window: object
    keys: list[str]
    folds: list[tuple[str, Fold]]
    columns: list[str]
    lateness: int = 0
    handle: StatefulProcessorHandle = field(default=None)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", ROWS)
        self.last = handle.getValueState("last", "at long")

    def close(self) -> None:
        pass

    def held(self) -> list[tuple[int, int, bool, tuple]]:
        return sorted(((r[0], r[1], r[2], pickle.loads(r[3])) for r in self.rows.get()), key=lambda r: r[:2])

    def hold(self, rows: list[tuple[int, int, bool, tuple]]) -> None:
        if rows:
            self.rows.put([(t, n, m, pickle.dumps(v)) for t, n, m, v in rows])
        else:
            self.rows.clear()

    def fresh(self, batches: Iterator[pd.DataFrame]) -> list[tuple[int, int, bool, tuple]]:
        columns = [c for c, _ in self.folds]
        out = []
        for b in batches:
            b = b.set_axis(self.columns, axis=1)  # computed columns come without their names
            values = list(zip(*[b[c].tolist() for c in columns], strict=True)) if columns else [()] * len(b)
            out += list(zip(b["_ms"].tolist(), b["_tie"].tolist(), b["_mark"].tolist(), values, strict=True))
        return out

    def row(self, key: tuple, start: int, end: int, values: list) -> dict:
        return dict(zip(self.keys, key[: len(self.keys)], strict=True)) | {"start": start, "end": end} | {f.name: v for (_, f), v in zip(self.folds, values, strict=True)}

    def of(self, rows: list[tuple]) -> list:
        return [f.of([r[3][i] for r in rows]) for i, (_, f) in enumerate(self.folds)]

    def frame(self, rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.keys, "start", "end", *[f.name for _, f in self.folds]])

    def give(self, key: tuple, watermark: int) -> list[dict]:
        raise NotImplementedError

    def wake(self, rows: list[tuple]) -> set[int]:
        """The times at which something may come to its end."""
        return {r[0] for r in rows}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        fresh = [r for r in self.fresh(rows) if r[0] >= watermark]
        self.hold(self.held() + fresh)
        for t in self.wake(fresh):
            self.handle.registerTimer(max(t, watermark + 1))
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.frame(self.give(key, timerValues.getCurrentWatermarkInMs()))


class Punctuated(Windowed):
    """[mark, next mark), the first from the first row on."""

    def wake(self, rows: list[tuple]) -> set[int]:
        return {r[0] for r in rows if r[2]}

    def give(self, key: tuple, watermark: int) -> list[dict]:
        rows, out = self.held(), []
        if not rows:
            return out
        start = self.last.get()[0] if self.last.exists() else rows[0][0]
        for end in sorted({t for t, _, m, _ in rows if m and start < t <= watermark}):
            out.append(self.row(key, start, end, self.of([r for r in rows if r[0] < end])))
            rows, start = [r for r in rows if r[0] >= end], end
        self.hold(rows)
        self.last.update((start,))
        return out


class Counted(Windowed):
    """Full windows over the ranks of rows before the watermark; rows at it wait until it has passed them."""

    def wake(self, rows: list[tuple]) -> set[int]:
        """When the watermark is past the first of them; ``give`` sets the timer for what it leaves."""
        return {min(r[0] for r in rows) + 1} if rows else set()

    def give(self, key: tuple, watermark: int) -> list[dict]:
        size, slide = self.window.size, self.window.slide
        rows, out = self.held(), []
        start = self.last.get()[0] if self.last.exists() else 0
        # ``last`` is the rank of the first row held; a slide beyond the size leaves rows out first.
        base = start
        sure = [r for r in rows if r[0] < watermark]
        rest = rows[len(sure) :]
        skip = -base % slide if slide > size and base % slide >= size else 0
        sure, base = sure[skip:], base + min(skip, len(sure))
        sliding = [f.sliding([r[3][i] for r in sure], size, slide) for i, (_, f) in enumerate(self.folds)]
        n = max(0, (len(sure) - size) // slide + 1) if base % slide == 0 else 0
        for j in range(n):
            out.append(self.row(key, base + j * slide, base + j * slide + size, [s[j] for s in sliding]))
        gone = min(n * slide, len(sure))
        self.hold(sure[gone:] + rest)
        if rest:
            self.handle.registerTimer(rest[0][0] + 1)
        self.last.update((base + gone,))
        return out


class RefinedSessions(Windowed):
    """Sessions that come when the newest time has passed them, and again whenever a late row changes them.

    The stream's watermark is the newest time less the lateness: it says how long sessions are kept. A session that a
    late row merges into another is given out once more with nulls for its values, before the merged one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getListState("sessions", "first long, last long, given long, rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, gap = timerValues.getCurrentWatermarkInMs(), self.window.gap
        known = [(a, b, g, pickle.loads(r)) for a, b, g, r in self.sessions.get()]
        gone = []
        for r in sorted((r for r in self.fresh(rows) if r[0] >= watermark), key=lambda r: r[:2]):
            near = [s for s in known if s[0] - gap <= r[0] <= s[1] + gap]
            known = [s for s in known if s not in near]
            first, last = min([r[0], *[s[0] for s in near]]), max([r[0], *[s[1] for s in near]])
            gone += [(s[0], s[2]) for s in near if s[2] >= 0]
            known.append((first, last, -1, sorted([r, *[x for s in near for x in s[3]]], key=lambda x: x[:2])))
            self.handle.registerTimer(max(last + gap - self.lateness + 1, watermark + 1))
        starts = {s[0] for s in known}
        out = [self.row(key, a, e, [None] * len(self.folds)) for a, e in gone if a not in starts]
        yield self.frame(out + self.due(key, known, watermark))

    def due(self, key: tuple, known: list[tuple], watermark: int) -> list[dict]:
        """Gives out what the newest time has passed and was not given out as it is, and keeps the rest."""
        gap, out, kept = self.window.gap, [], []
        for a, b, given, held in known:
            if given < 0 and b + gap < watermark + self.lateness:
                out.append(self.row(key, a, b + gap, self.of(held)))
                given = b + gap
            kept.append((a, b, given, held))
        self.keep(kept, watermark)
        return out

    def keep(self, known: list[tuple], watermark: int) -> None:
        known = [s for s in known if s[2] < 0 or s[1] + self.window.gap >= watermark]
        if known:
            self.sessions.put([(a, b, g, pickle.dumps(r)) for a, b, g, r in known])
        else:
            self.sessions.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = [(a, b, g, pickle.loads(r)) for a, b, g, r in self.sessions.get()]
        yield self.frame(self.due(key, known, timerValues.getCurrentWatermarkInMs()))


class Contextual(Windowed):
    """The user's windows of a key's rows; those that end by the watermark come once, and the rows before the oldest open one go.

    The function is asked again and again, for the times from the start of its oldest open window on, or from the
    watermark if none is open; it must give the windows that it would give for all rows.
    """

    def wake(self, rows: list[tuple]) -> set[int]:
        found = list(self.window.windows(pd.DataFrame({"time": [r[0] for r in self.held()]})))
        return {e for _, e in found}

    def give(self, key: tuple, watermark: int) -> list[dict]:
        rows, out = self.held(), []
        done = self.last.get()[0] if self.last.exists() else -1
        found = list(self.window.windows(pd.DataFrame({"time": [r[0] for r in rows]})))
        for start, end in sorted(found, key=lambda w: (w[1], w[0])):
            if done < end <= watermark:
                out.append(self.row(key, start, end, self.of([r for r in rows if start <= r[0] < end])))
        open_ = [s for s, e in found if e > watermark]
        first = min(open_, default=watermark)
        self.hold([r for r in rows if r[0] >= first])
        self.last.update((max(done, watermark),))
        return out


def stream_stateful(rows: DataFrame, window, folds: list[tuple[str, Fold]], time: str = "ts", keys: list[str] = (), lateness: int = 1_000, tie: str | None = None) -> DataFrame:
    """keys, start, end and a value for each fold (column, fold) of each window of a stream; needs RocksDB (``use_rocksdb``).

    Punctuation, counted and UserContext windows come once (append mode); sessions come anew when late rows change them
    (update mode). ``time`` is a timestamp; start and end are milliseconds, of counted windows ranks. ``tie`` orders rows of
    one time. Rows older than the watermark, which is the newest time less ``lateness``, are dropped.
    """
    kinds = {Punctuation: Punctuated, CountTumbling: Counted, CountSliding: Counted, Session: RefinedSessions, UserContext: Contextual}
    if type(window) not in kinds:
        raise TypeError(f"not a window with state of its own: {window!r}")
    mark = F.coalesce(window.matches, F.lit(False)) if isinstance(window, Punctuation) else F.lit(False)
    columns = list(dict.fromkeys(c for c, _ in folds))
    ready = rows.withWatermark(time, f"{lateness} milliseconds")
    ready = ready.select(*keys, time, F.unix_millis(time).alias("_ms"), (F.col(tie).cast("long") if tie else F.lit(0).cast("long")).alias("_tie"), mark.alias("_mark"), *[c for c in columns if c not in keys and c != time], F.lit(0).alias("_all"))
    schema = StructType([*rows.select(*keys).schema.fields])
    for name, kind in (("start", "long"), ("end", "long"), *[(f.name, f.kind) for _, f in folds]):
        schema = schema.add(name, kind)
    # The predicate is evaluated above; a window that goes to the workers holds no column.
    bare = Punctuation(None) if isinstance(window, Punctuation) else window
    processor = kinds[type(window)](bare, list(keys), list(folds), ready.columns, lateness)
    mode = "update" if isinstance(window, Session) else "append"
    return ready.groupBy(*(list(keys) or ["_all"])).transformWithStateInPandas(processor, schema, mode, "EventTime")
