"""One plan for any number of windows and aggregates over one table.

Time windows share slices, which are cut at the edges of all windows together: rows are first aggregated by
keys and slice, and all windows are put together from slices by one explode and one aggregation, however many
there are. Sessions are put together within stretches of time first; only those near the edge of a stretch go on
to wider ones. Ranks and punctuations are found within stretches that are cut by the measured number of rows, and
carried over by small tables of one row for each key and stretch. So one key, or none, does not put all rows
into one task. A table of no more rows than one stretch holds is one stretch.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from slicewin.functions.aggregates import Aggregate, count_rows
from slicewin.functions.time import at_millis, millis
from slicewin.operators.windows import Added, CountSliding, CountTumbling, FixedBand, Punctuation, Session, Sliding, Tumbling, UserContext, UserDefined

#: Gaps in a stretch of sessions; stretches of a stretch.
STRETCH = 1024
#: Rows that a stretch holds on average, where stretches are cut by the number of rows.
ROWS = 100_000
#: Grids of edges up to which the start of a slice is one expression.
GRIDS = 16
T = "_t"


def _floor(x: Column, step: int | Column) -> Column:
    return x - F.pmod(x, F.lit(step) if isinstance(step, int) else step)


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def is_timed(w) -> bool:
    return isinstance(w, Tumbling | Sliding | FixedBand) and not isinstance(w, CountTumbling | CountSliding)


def edges(windows: list) -> list[tuple[int, int]]:
    """The grids (step, offset) on which windows start and end, without those that a finer one holds."""
    grids = set()
    for w in windows:
        if not isinstance(w, FixedBand):
            grids |= {(w.slide, 0), (w.slide, w.size % w.slide)}
    out: list[tuple[int, int]] = []
    for step, offset in sorted(grids):
        if not any(step % s == 0 and (offset - o) % s == 0 for s, o in out):
            out.append((step, offset))
    return out


class Plan:
    def __init__(self, rows: DataFrame, aggregates: list[Aggregate], keys: list[str], order: list[str]):
        self.rows, self.aggregates, self.keys, self.order = rows, aggregates, keys, order
        self.shares = all(a.shares_slices for a in aggregates)
        self._span: tuple[int, int] | None = None

    def lift(self, df: DataFrame, by: list[str | Column]) -> DataFrame:
        return df.groupBy(*by).agg(*[c.alias(f"_p{i}_{j}") for i, a in enumerate(self.aggregates) for j, c in enumerate(a.lift)])

    def merged(self) -> list[Column]:
        return [f(F.col(f"_p{i}_{j}")).alias(f"_p{i}_{j}") for i, a in enumerate(self.aggregates) for j, f in enumerate(a.combine)]

    def lower(self, df: DataFrame, spec: int | None) -> DataFrame:
        values = [a.lower(*[F.col(f"_p{i}_{j}") for j in range(len(a.lift))]).alias(a.name) for i, a in enumerate(self.aggregates)]
        which = F.col("_spec") if spec is None else F.lit(spec)
        return df.select(which.alias("spec"), *self.keys, F.col("_start").alias("start"), F.col("_end").alias("end"), *values)

    def same_keys(self, side: str = "_k") -> Column:
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{side}{i}")) for i, k in enumerate(self.keys)], F.lit(True))

    def renamed(self, side: str = "_k") -> list[Column]:
        return [F.col(k).alias(f"{side}{i}") for i, k in enumerate(self.keys)]

    # Windows of time

    def slice_start(self, windows: list) -> Column:
        """The last edge of any window at or before the row; windows that hold it hold all of its slice."""
        t = F.col(T)
        grids = edges(windows)
        at = [_floor(t - o, s) + o if o else _floor(t, s) for s, o in grids]
        if len(grids) > GRIDS:
            # So many terms make a method that the JVM does not compile; over an array they are a loop.
            table = F.array(*[F.struct(_long(s).alias("s"), _long(o).alias("o")) for s, o in grids])
            at = [F.array_max(F.transform(table, lambda g: _floor(t - g["o"], g["s"]) + g["o"]))]
        at += [F.when(t >= e, _long(e)).otherwise(_long(-(1 << 62))) for w in windows if isinstance(w, FixedBand) for e in (w.start, w.start + w.size)]
        return F.greatest(*at) if len(at) > 1 else at[0]

    def in_windows(self, cut: DataFrame, specs: list[tuple[int, object]]) -> DataFrame:
        """``cut`` (with _b, the start of a slice or the time of a row) once for each window that holds it: _spec, _start, _end."""
        b = F.col("_b")
        if all(isinstance(w, Tumbling) for _, w in specs):
            sized = self.with_specs(cut, specs)
            return sized.withColumn("_start", _floor(b, F.col("_size"))).withColumn("_end", F.col("_start") + F.col("_size"))
        sized = self.with_specs(cut, specs)
        size, slide = F.col("_size"), F.col("_slide")
        band = slide == 0
        low = F.when(band, F.col("_from")).otherwise(F.greatest(_long(0), _floor(b - size, F.greatest(slide, _long(1))) + slide))
        high = F.when(band, F.when((b >= F.col("_from")) & (b < F.col("_from") + size), F.col("_from"))).otherwise(_floor(b, F.greatest(slide, _long(1))))
        starts = F.when(low <= high, F.sequence(low, high, F.greatest(slide, _long(1))))
        return sized.withColumn("_start", F.explode(starts)).withColumn("_end", F.col("_start") + size)

    @staticmethod
    def with_specs(cut: DataFrame, specs: list[tuple[int, object]]) -> DataFrame:
        def row(i: int, w) -> list[Column]:
            band = isinstance(w, FixedBand)
            return [F.lit(i).alias("_spec"), _long(w.size).alias("_size"), _long(0 if band else w.slide).alias("_slide"), _long(w.start if band else 0).alias("_from")]

        if len(specs) == 1:
            return cut.select("*", *row(*specs[0]))
        return cut.withColumn("_s", F.explode(F.array(*[F.struct(*row(i, w)) for i, w in specs]))).select(*[c for c in cut.columns], "_s.*")

    def timed(self, specs: list[tuple[int, object]], share: bool = True) -> DataFrame:
        windows = [w for _, w in specs]
        rows = self.rows
        if all(isinstance(w, FixedBand) for w in windows):
            rows = rows.where((F.col(T) >= min(w.start for w in windows)) & (F.col(T) < max(w.start + w.size for w in windows)))
        group = ["_spec", *self.keys, "_start", "_end"]
        if not self.shares or not share or (len(specs) == 1 and isinstance(windows[0], Tumbling | FixedBand)):
            return self.lower(self.lift(self.in_windows(rows.withColumn("_b", F.col(T)), specs), group), None)
        cut = self.lift(rows.withColumn("_b", self.slice_start(windows)), [*self.keys, "_b"])
        return self.lower(self.in_windows(cut, specs).groupBy(*group).agg(*self.merged()), None)

    def with_quantiles(self, specs: list[tuple[int, object]], quantiles: list[Aggregate], share: bool) -> DataFrame:
        """Exact quantiles from counts of values by slice, summed up by window."""
        windows, group = [w for _, w in specs], ["_spec", *self.keys, "_start", "_end"]
        out = self.timed(specs, share)
        for a in quantiles:
            column, top, bottom = a.histogram
            kept = self.rows.where(F.col(column).isNotNull()).withColumn("_v", F.col(column))
            cut = kept.withColumn("_b", self.slice_start(windows)).groupBy(*self.keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
            each = self.in_windows(cut, specs).groupBy(*group, "_v").agg(F.sum("_n").alias("_n"))
            whole = Window.partitionBy(*group)
            each = each.withColumn("_upto", F.sum("_n").over(whole.orderBy("_v"))).withColumn("_all", F.sum("_n").over(whole))
            found = each.where(F.col("_upto") * bottom >= F.col("_all") * top).groupBy(*group).agg(F.min("_v").alias(a.name))
            found = found.select(F.col("_spec").alias("_s"), *self.renamed(), F.col("_start").alias("_from"), a.name)
            out = out.join(found, (F.col("spec") == F.col("_s")) & (F.col("start") == F.col("_from")) & self.same_keys(), "left").drop("_s", "_from", *[f"_k{i}" for i in range(len(self.keys))])
        return out

    # Sessions

    def session(self, w: Session, spec: int) -> DataFrame:
        """Within stretches of STRETCH gaps, then wider ones, then the whole; only sessions near an edge go on."""
        narrow, wide = w.gap * STRETCH, w.gap * STRETCH * STRETCH
        at = lambda width: F.floor(F.col("_first") / width).cast("long")

        def numbered(df: DataFrame, parts: list[str]) -> DataFrame:
            order = Window.partitionBy(*self.keys, *parts).orderBy("_first")
            new = F.coalesce(F.col("_first") - F.lag("_last").over(order) > w.gap, F.lit(True))
            return df.withColumn("_new", new.cast("long")).withColumn("_n", F.sum("_new").over(order))

        def near(width: int) -> Column:
            low = at(width) * width
            return (F.col("_first") - low < w.gap) | (F.floor(F.col("_last") / width) != at(width)) | (low + width - F.col("_last") <= w.gap)

        bounds = [F.min("_first").alias("_first"), F.max("_last").alias("_last")]
        first = self.rows.withColumn("_first", F.col(T)).withColumn("_last", F.col(T)).withColumn("_part", at(narrow))
        lifted = [c.alias(f"_p{i}_{j}") for i, a in enumerate(self.aggregates) for j, c in enumerate(a.lift)] if self.shares else []
        first = first.withColumn("_part", _long(0)) if self.small() else first
        found = numbered(first, ["_part"]).groupBy(*self.keys, "_part", "_n").agg(*bounds, *lifted)
        for width, wider in () if self.small() else ((narrow, at(wide)), (wide, _long(0))):
            parts = found.drop("_part", "_n", "_on").withColumn("_on", near(width))
            parts = parts.withColumn("_part", F.when(F.col("_on"), wider).otherwise(at(narrow)))
            found = numbered(parts, ["_on", "_part"]).groupBy(*self.keys, "_on", "_part", "_n").agg(*bounds, *(self.merged() if self.shares else []))
        found = found.withColumn("_start", F.col("_first")).withColumn("_end", F.col("_last") + w.gap)
        if self.shares:
            return self.lower(found, spec)
        each = F.sequence(at(narrow), F.floor(F.col("_last") / narrow).cast("long"))
        spans = found.select(*self.renamed(), "_start", "_end", "_last", F.explode(each).alias("_at"))
        rows = self.rows.withColumn("_in", F.floor(F.col(T) / narrow).cast("long"))
        held = rows.join(spans, self.same_keys() & (F.col("_in") == F.col("_at")) & F.col(T).between(F.col("_start"), F.col("_last")))
        return self.lower(self.lift(held, [*self.keys, "_start", "_end"]), spec)

    # Windows over the order of rows

    def span(self) -> tuple[int, int]:
        """The width of a stretch that holds ROWS rows on average, and the number of rows; one pass over the times."""
        if self._span is None:
            low, high, n = self.rows.agg(F.min(T), F.max(T), F.count(F.lit(1))).first()
            self._span = (max(1, (high - low + 1) * ROWS // n) if n else 1, n)
        return self._span

    def small(self) -> bool:
        """Whether all rows may meet in one task."""
        return self.span()[1] <= ROWS

    def stretched(self) -> DataFrame:
        return self.rows.withColumn("_at", F.floor(F.col(T) / self.span()[0]).cast("long"))

    def carried(self, x: DataFrame, per: DataFrame, *columns: str) -> DataFrame:
        """``x`` with ``columns`` of ``per``, which has a row for each key and stretch."""
        per = per.select(*self.renamed(), F.col("_at").alias("_per"), *columns)
        return x.join(per, (F.col("_at") == F.col("_per")) & self.same_keys())

    def punctuation(self, w: Punctuation, spec: int) -> DataFrame:
        """The window that is still open at the end gives no row."""
        mark = F.when(F.coalesce(w.matches, F.lit(False)), F.col(T))
        if self.small():
            x = self.rows.withColumn("_mark", mark).withColumn("_at", _long(0))
            x = x.withColumn("_zero", F.min(T).over(Window.partitionBy(*self.keys))).withColumn("_before", F.lit(None)).withColumn("_after", F.lit(None))
        else:
            x = self.stretched().withColumn("_mark", mark)
            per = x.groupBy(*self.keys, "_at").agg(F.min(T).alias("_low"), F.min("_mark").alias("_lo"), F.max("_mark").alias("_hi"))
            each = Window.partitionBy(*self.keys)
            per = per.withColumn("_zero", F.min("_low").over(each))
            per = per.withColumn("_before", F.max("_hi").over(each.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)))
            per = per.withColumn("_after", F.min("_lo").over(each.orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, -1)))
            x = self.carried(x, per, "_zero", "_before", "_after")
        within = Window.partitionBy(*self.keys, *([] if self.small() else ["_at"]))
        x = x.withColumn("_start", F.coalesce(F.max("_mark").over(within.orderBy(T).rangeBetween(Window.unboundedPreceding, 0)), "_before", "_zero"))
        # From the last row backwards: Spark goes through all rows anew for each row of a frame without an end.
        x = x.withColumn("_end", F.coalesce(F.min("_mark").over(within.orderBy(F.desc(T)).rangeBetween(Window.unboundedPreceding, -1)), "_after"))
        return self.lower(self.lift(x.where("_end IS NOT NULL"), [*self.keys, "_start", "_end"]), spec)

    def counted(self, w: CountTumbling | CountSliding, spec: int) -> DataFrame:
        whole = Window.partitionBy(*self.keys)
        if self.small():
            x = self.rows.withColumn("_b", F.row_number().over(whole.orderBy(T, *self.order)).cast("long") - 1).withColumn("_total", F.count(F.lit(1)).over(whole))
        else:
            x = self.stretched()
            per = x.groupBy(*self.keys, "_at").agg(F.count(F.lit(1)).alias("_rows"))
            per = per.withColumn("_base", F.sum("_rows").over(whole.orderBy("_at")) - F.col("_rows")).withColumn("_total", F.sum("_rows").over(whole))
            rank = F.row_number().over(Window.partitionBy(*self.keys, "_at").orderBy(T, *self.order)) - 1
            x = self.carried(x.withColumn("_rank", rank), per, "_base", "_total").withColumn("_b", F.col("_rank") + F.col("_base"))
        as_time = Tumbling(w.size) if isinstance(w, CountTumbling) else Sliding(w.size, w.slide)
        x = self.in_windows(x, [(spec, as_time)])
        return self.lower(self.lift(x.where("_end <= _total"), [*self.keys, "_start", "_end"]), spec)

    # Windows of the user's

    def user_defined(self, w: UserDefined, spec: int) -> DataFrame:
        x = self.rows.withColumn("_w", F.explode(w.assign(F.col(T)))).withColumn("_start", F.col("_w.start").cast("long")).withColumn("_end", F.col("_w.end").cast("long"))
        return self.lower(self.lift(x, [*self.keys, "_start", "_end"]), spec)

    def user_context(self, w: UserContext, spec: int) -> DataFrame:
        """The rows of a key meet in one task, as the user's function asks for them."""
        keys, order = self.keys, [T, *self.order]
        schema = StructType([*self.rows.select(*keys).schema.fields, StructField("_start", LongType()), StructField("_end", LongType())])

        def find(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(order, kind="stable")
            found = list(w.windows(rows.rename(columns={T: "time"})))
            out = pd.DataFrame(found, columns=["_start", "_end"], dtype="int64")
            for place, k in enumerate(keys):
                out.insert(place, k, rows[k].iloc[0])
            return out

        found = self.rows.groupBy(*keys).applyInPandas(find, schema).distinct().select(*self.renamed(), "_start", "_end")
        held = self.rows.join(found, self.same_keys() & (F.col(T) >= F.col("_start")) & (F.col(T) < F.col("_end")))
        return self.lower(self.lift(held, [*keys, "_start", "_end"]), spec)

    def empties(self, found: DataFrame, specs: list[tuple[int, object]], watermark: int | None) -> DataFrame:
        """``found`` with the windows without rows between a key's first and last row."""
        span = self.rows.groupBy(*self.keys).agg(F.min(T).alias("_lo"), F.max(T).alias("_hi"))
        grid = self.with_specs(span, specs)
        size, slide = F.col("_size"), F.col("_slide")
        low = F.greatest(_long(0), _floor(F.col("_lo") - size, slide) + slide)
        starts = F.when(low <= _floor(F.col("_hi"), slide), F.sequence(low, _floor(F.col("_hi"), slide), slide))
        grid = grid.withColumn("_start", F.explode(starts)).withColumn("_end", F.col("_start") + size)
        if watermark is not None:
            grid = grid.where(F.col("_end") <= watermark)
        grid = grid.select(F.col("_spec").alias("_s"), *self.renamed(), "_start", "_end")
        out = grid.join(found, (F.col("spec") == F.col("_s")) & (F.col("start") == F.col("_start")) & self.same_keys(), "left")
        values = [(F.col(a.name) if a.empty is None else F.coalesce(F.col(a.name), a.empty)).alias(a.name) for a in self.aggregates]
        return out.select(F.col("_s").alias("spec"), *[F.col(f"_k{i}").alias(k) for i, k in enumerate(self.keys)], F.col("_start").alias("start"), F.col("_end").alias("end"), *values)


def aggregate_windows(
    rows: DataFrame,
    windows: list,
    aggregates: list[Aggregate],
    time: str = "ts",
    keys: list[str] = (),
    order: list[str] = (),
    watermark: int | None = None,
    include_empty: bool = False,
    share: bool = True,
    late: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """spec (place in ``windows``), keys, start, end and the aggregates of every window that has rows.

    ``time`` is a whole number in any unit, or a timestamp, which is taken in milliseconds; rows without it take no part.
    ``order`` breaks ties between rows of one time for counted windows. With ``watermark`` only what has come to an end by
    then is returned: windows whose end is at or before it, sessions whose end is before it, and counted windows of rows
    up to it. ``include_empty`` adds tumbling and sliding windows without rows between a key's first and last row.
    ``share=False`` aggregates each window from rows. ``late`` leaves out rows that came too late (``lateness``).
    """
    keys, aggregates = list(keys), list(aggregates)
    kind = dict(rows.dtypes)[time]
    plain = [w.window if isinstance(w, Added) else w for w in windows]
    stamped = kind.startswith("timestamp") or kind == "date"
    if stamped and plain and all(isinstance(w, FixedBand) for w in plain):
        rows = rows.where((F.col(time) >= at_millis(min(w.start for w in plain), kind)) & (F.col(time) < at_millis(max(w.start + w.size for w in plain), kind)))
    rows = rows.withColumn(T, millis(F.col(time), kind) if stamped else F.col(time).cast("long")).where(f"{T} IS NOT NULL")
    rows = late(rows) if late else rows
    if watermark is not None:
        rows = rows.where(F.col(T) <= watermark)
    plan = Plan(rows, aggregates, keys, list(order))
    timed = [(i, w) for i, w in enumerate(plain) if is_timed(w)]
    quantiles = [a for a in aggregates if a.histogram]
    out = []
    if timed and quantiles and share:
        rest = Plan(rows, [a for a in aggregates if not a.histogram] or [count_rows("_any")], keys, list(order))
        out.append(rest.with_quantiles(timed, quantiles, share).select("spec", *keys, "start", "end", *[a.name for a in aggregates]))
    elif timed:
        out.append(plan.timed(timed, share))
    for i, w in enumerate(plain):
        match w:
            case CountTumbling() | CountSliding():
                out.append(plan.counted(w, i))
            case Session():
                out.append(plan.session(w, i))
            case Punctuation():
                out.append(plan.punctuation(w, i))
            case UserDefined():
                out.append(plan.user_defined(w, i))
            case UserContext():
                out.append(plan.user_context(w, i))
            case _ if not is_timed(w):
                raise TypeError(f"not a window: {w!r}")
    found = reduce(DataFrame.unionByName, out)
    if watermark is not None:
        counts = [i for i, w in enumerate(plain) if isinstance(w, CountTumbling | CountSliding)]
        sessions = [i for i, w in enumerate(plain) if isinstance(w, Session)]
        done = (F.col("end") < watermark) | ((F.col("end") == watermark) & ~F.col("spec").isin(sessions))
        found = found.where(F.col("spec").isin(counts) | done)
    empty = [(i, w) for i, w in timed if not isinstance(w, FixedBand)] if include_empty else []
    if empty:
        which = F.col("spec").isin([i for i, _ in empty])
        full = plan.empties(found.where(which), empty, watermark)
        found = full if len(empty) == len(windows) else full.unionByName(found.where(~which))
    for i, w in enumerate(windows):
        if isinstance(w, Added):
            found = found.where((F.col("spec") != i) | (F.col("start") >= w.since))
    return found
