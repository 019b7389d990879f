"""One measured quantity recorded in different units over time: level shifts and the factors that explain them.

Each source history is cut into segments of constant level by exact penalised changepoint search on the logarithm of
the recorded number (optimal partitioning with pruning, squared error). A unit that a text states is an anchor: no
segment may hold two different ones, and every number takes the unit of its segment. Where neighbouring levels differ
by the logarithm of a known factor, the recorded unit changed there, so a segment without an anchor takes the factor
of the nearest anchored one, changed by the known factors of the shifts between.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliospark.tables import cut

#: fixed values: ratios of units that are mistaken for each other
KNOWN_FACTORS = (10.0, 100.0, 1e3, 1e4, 1e5, 1e6, 1e7, 1e8, 1e9, 1e12)
#: points after which the search looks for segments that are settled, so that it holds no more than it needs
SETTLE_EVERY = 2048
TEXTS = ("field", "number", "factor", "std_unit", "currency", "assumed")


_SEP = "\u001f"
_FOUND = [T.StructField("seg", T.LongType()), T.StructField("level", T.DoubleType())]


class Search:
    """Exact penalised changepoint search over a stream of points of one history.

    The best cost of every prefix is known; a start is dropped from the search when it can never be the best again,
    or when a segment from it would hold two different anchors. What all live starts have in common is final, and
    ``settled`` hands it out, so memory follows the live starts and not the history.
    """

    def __init__(self, penalty: float):
        self.penalty = penalty
        self.origin = 0  # points handed out before those held
        self.s, self.q, self.best, self.back, self.units = [0.0], [0.0], [-penalty], [0], []
        self.live = [0]
        self.anchor = None  # the last anchor

    def push(self, y: float, unit) -> None:
        t = len(self.units) + 1
        if unit is not None:
            if self.anchor is not None and self.anchor[1] != unit:
                self.live = [j for j in self.live if j > self.anchor[0]]
            self.anchor = (t - 1, unit)
        self.units.append(unit)
        s, q, best, live = self.s, self.q, self.best, self.live
        st, qt = s[-1] + y, q[-1] + y * y
        s.append(st)
        q.append(qt)
        costs = [best[j] + max(0.0, qt - q[j] - (st - s[j]) ** 2 / (t - j)) for j in live]
        least = min(costs)
        self.back.append(live[costs.index(least)])
        best.append(least + self.penalty)
        self.live = [j for j, c in zip(live, costs) if c <= least + self.penalty] + [t]

    def _segment(self, a: int, b: int) -> tuple[int, int, float, object]:
        said = next((u for u in self.units[a:b] if u is not None), None)
        return self.origin + a, self.origin + b, (self.s[b] - self.s[a]) / (b - a), said

    def _chain(self, t: int) -> list[tuple[int, int, float, object]]:
        out = []
        while t > 0:
            out.append(self._segment(self.back[t], t))
            t = self.back[t]
        return out[::-1]

    def settled(self) -> list[tuple[int, int, float, object]]:
        """(start, end, level, anchor) of the segments that no later point can change; they are forgotten here."""
        starts = set(self.live)
        while len(starts) > 1:
            t = max(starts)
            starts.remove(t)
            starts.add(self.back[t])
        c = starts.pop()
        out = self._chain(c)
        if c:
            s0, q0 = self.s[c], self.q[c]
            self.s, self.q = [x - s0 for x in self.s[c:]], [x - q0 for x in self.q[c:]]
            self.best, self.back, self.units = self.best[c:], [max(0, x - c) for x in self.back[c:]], self.units[c:]
            self.live = [j - c for j in self.live]
            self.anchor = self.anchor and (self.anchor[0] - c, self.anchor[1])
            self.origin += c
        return out

    def rest(self) -> list[tuple[int, int, float, object]]:
        return self._chain(len(self.units))


def segments(y: Sequence[float], anchors: Sequence, penalty: float) -> list[tuple[int, int, float, object]]:
    """(start, end, level, anchor or None) of the segments with the least sum of squared errors plus ``penalty`` each, none with two anchors."""
    search, out = Search(penalty), []
    for i, (v, u) in enumerate(zip(y, anchors), 1):
        search.push(v, u)
        if i % SETTLE_EVERY == 0:
            out += search.settled()
    return out + search.rest()


def changepoints(y: Sequence[float], penalty: float) -> list[int]:
    """Starts of the segments (the first is 0) of a history without anchors."""
    return [a for a, *_ in segments(y, [None] * len(y), penalty)]


def matching_factor(shift: float, known: Sequence[float], slack: float) -> float | None:
    """The known factor, or its inverse, whose decimal logarithm is within ``slack`` of the shift; None for none."""
    k = min(known, key=lambda f: abs(abs(shift) - math.log10(f)))
    return None if abs(abs(shift) - math.log10(k)) > slack else (k if shift > 0 else 1 / k)


def points(df: DataFrame, carried: Sequence[str], needed: Sequence[str], statements: Callable) -> DataFrame:
    """Rows (carried, field, number, factor, std_unit, currency, assumed, y): the quantities that the rows of ``df`` state.

    ``statements`` gets a list of values for each of ``needed`` and yields (row, field, number, factor, std_unit,
    currency, assumed): ``factor`` is None where no text states the unit, ``assumed`` the factor to take then if the
    history tells none either. ``y`` is the decimal logarithm of the number, null where it has none.
    """
    names = [f"c{i}" for i in range(len(carried))]
    src = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)], *[F.col(c).alias(f"n{i}") for i, c in enumerate(needed)])
    out = T.StructType([src.schema[n] for n in names] + [T.StructField(t, T.StringType()) for t in TEXTS] + [T.StructField("y", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(statements(*(b.column(len(names) + i).to_pylist() for i in range(len(needed)))))
            at, *said = zip(*rows) if rows else [()] * 7
            y = []
            for n in said[1]:
                v = float(n)
                y.append(math.log10(v) if 0 < v < math.inf else None)
            kept = [b.column(i).take(pa.array(at, pa.int64())) for i in range(len(names))]
            texts = [pa.array([None if v is None else str(v) for v in c], pa.string()) for c in said]
            yield pa.RecordBatch.from_arrays([*kept, *texts, pa.array(y, pa.float64())], names=out.names)

    return src.mapInArrow(run, out).withColumnsRenamed(dict(zip(names, carried)))


class _Marks:
    """Rows of one task in order, and what the search says of them: ``seg`` (rid of the segment's first row) and ``level``; none for open rows."""

    def __init__(self, penalty: float):
        self.penalty = penalty
        self.rids: list[int] = []  # of the rows not handed out
        self.seg: list[int | None] = []  # marks of the first of them
        self.level: list[float | None] = []
        self.begin, self.search = 0, None  # where the current stretch begins

    def _settle(self, found) -> None:
        for a, b, level, _ in found:
            self.seg += [self.rids[self.begin + a]] * (b - a)
            self.level += [level] * (b - a)

    def end(self) -> None:
        """The current stretch is whole."""
        if self.search is not None:
            self._settle(self.search.rest())
            self.search = None

    def start(self) -> None:
        """A stretch starts at the next row; what lies before without a search stays open."""
        self.end()
        self.leave()
        self.begin, self.search = len(self.rids), Search(self.penalty)

    def leave(self) -> None:
        n = len(self.rids) - len(self.seg)
        self.seg += [None] * n
        self.level += [None] * n

    def push(self, rid: int, y: float, unit) -> None:
        if self.search is not None:
            if len(self.search.units) >= SETTLE_EVERY and len(self.search.units) % SETTLE_EVERY == 0:
                self._settle(self.search.settled())
            self.search.push(y, unit)
        self.rids.append(rid)

    def take(self) -> tuple[list, list, list]:
        k = len(self.seg)
        out = self.rids[:k], self.seg, self.level
        self.rids, self.seg, self.level, self.begin = self.rids[k:], [], [], self.begin - k
        return out


def _hand_out(held: list[pa.RecordBatch], marks: _Marks, more: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows that have their marks; the others stay held."""
    if marks.seg:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        rids, seg, level = marks.take()
        k = len(rids)
        held[:] = [table.slice(k)] if k < table.num_rows else []
        yield pa.RecordBatch.from_arrays([*table.slice(0, k).columns, *more(rids), pa.array(seg, pa.int64()), pa.array(level, pa.float64())], names=names)


def _search_tasks(penalty: float, far: float) -> Callable:
    """Searches rows sorted by history, those between certain borders that lie in one task; numbers all rows.

    Adds rid, tail, seg and level. The rows before a task's first certain border are open, and so are those after its
    last one that aren't settled, whose ``tail`` is true: they begin at a certain border.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        marks, held, last = _Marks(penalty), [], None
        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            hist, y, unit = b.column("hist").to_pylist(), b.column("y").to_pylist(), b.column("unit").to_pylist()
            for row in zip(hist, y, unit):
                if last is not None and (row[0] != last[0] or abs(row[1] - last[1]) > far or row[2] is not None and last[2] is not None and row[2] != last[2]):
                    marks.start()
                marks.push(rid, row[1], row[2])
                last, rid = row, rid + 1
            if marks.search is None:
                marks.leave()
            yield from _hand_out(held, marks, lambda r: (pa.array(r, pa.int64()), pa.array([False] * len(r))), [*b.schema.names, "rid", "tail", "seg", "level"])
        if held:
            begun = marks.search is not None
            marks.leave()
            yield from _hand_out(held, marks, lambda r: (pa.array(r, pa.int64()), pa.array([begun] * len(r))), [*held[0].schema.names, "rid", "tail", "seg", "level"])

    return run


def _search_stretches(penalty: float) -> Callable:
    """Searches rows sorted by (stretch, rid); adds seg and level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, held, now, names = _Marks(penalty), [], None, None
        for b in batches:
            held.append(b)
            names = [*b.schema.names, "seg", "level"]
            for stretch, rid, y, unit in zip(*(b.column(c).to_pylist() for c in ("stretch", "rid", "y", "unit"))):
                if stretch != now:
                    marks.start()
                    now = stretch
                marks.push(rid, y, unit)
            yield from _hand_out(held, marks, lambda r: (), names)
        if held:
            marks.end()
            yield from _hand_out(held, marks, lambda r: (), names)

    return run


def unit_histories(df: DataFrame, series: Sequence[str], order: Sequence[str], carried: Sequence[str], penalty: float = 0.05, known: Mapping[str, Sequence[float]] | None = None, slack: float = 0.08) -> DataFrame:
    """The points of ``df`` (see ``points``) with the units that their histories give them; nothing is dropped.

    Output: ``carried``, field, number, factor, std_unit, currency, stated (a text states the unit), segment, and shift
    (the known factor by which the level changed at this row, else null). A history is the rows of one series and
    field in the order of ``order``; equal ones go by number, factor, currency and the carried columns. Numbers
    without a logarithm (zero, negative) pass by the search, with no segment and the factor stated or assumed. Null
    series and orders sort first. An empty table gives no rows. ``known`` names the factors of a field where only these
    can be meant; any other field has ``KNOWN_FACTORS``.

    The search is exact for any length and its rows don't depend on partitions. Rows are range-partitioned, so a long
    history lies in many tasks. Two neighbours that differ by more than sqrt(8 penalty) can't share a segment (setting
    the farther one apart would save more than two penalties), nor can two with different anchors: these certain borders
    cut a history into stretches that are searched apart, in a stream that holds no more than what isn't settled. The
    borders of the tasks themselves are joined by one row a task. Shifts and fills then run over one row a segment.
    """
    names, sn, on = [f"c{i}" for i in range(len(carried))], [f"s{i}" for i in range(len(series))], [f"o{i}" for i in range(len(order))]
    given = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip([*carried, *series, *order], [*names, *sn, *on])], *TEXTS, "y")
    src = cut(given.withColumn("sid", F.monotonically_increasing_id()))
    far, head = math.sqrt(8 * penalty) * (1 + 1e-9), [*sn, "field"]
    unit = F.when(F.col("factor").isNotNull(), F.concat_ws(_SEP, "factor", F.coalesce("std_unit", F.lit("")), F.coalesce("currency", F.lit(""))))
    sortable = [n for n in names if not src.schema[n].dataType.typeName().startswith(("map", "variant"))]
    by = [*head, *on, "number", "factor", "currency", *sortable]
    ranged = src.filter("y is not null").withColumn("hist", F.xxhash64(*head)).withColumn("unit", unit).repartitionByRange(*by).sortWithinPartitions(*by).select("hist", "field", "y", "unit", "sid")
    # rid follows the sorted order over all tasks; what is above its 33rd bit is the task
    swept = cut(ranged.mapInArrow(_search_tasks(penalty, far), T.StructType([*ranged.schema.fields, T.StructField("rid", T.LongType()), T.StructField("tail", T.BooleanType()), *_FOUND])))
    task, edge = F.shiftright("rid", 33).alias("task"), F.struct("hist", "y", "unit")
    ends = swept.groupBy(task).agg(F.min("rid").alias("first"), F.min_by(edge, "rid").alias("a"), F.max_by(edge, "rid").alias("z"), F.min(F.when(F.col("tail"), F.col("rid"))).alias("tail_at"))
    tasks = Window.orderBy("task")  # one row a task
    certain = f"p is null or p.hist <> a.hist or abs(p.y - a.y) > {far!r} or coalesce(p.unit <> a.unit, false)"
    ends = ends.withColumn("p", F.lag("z").over(tasks)).withColumn("starts", F.expr(certain))
    before = F.max(F.coalesce("tail_at", F.when(F.col("starts"), F.col("first")))).over(tasks.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.withColumn("goes_on", before).select("task", "tail_at", F.when(F.col("starts"), F.col("first")).otherwise(F.col("goes_on")).alias("start"))
    stretch = F.when(F.col("tail"), F.col("tail_at")).otherwise(F.col("start"))
    opened = swept.filter("seg is null").drop("seg", "level").withColumn("task", task).join(F.broadcast(ends), "task").withColumn("stretch", stretch).drop("task", "start", "tail_at")
    closed = opened.repartition("stretch").sortWithinPartitions("stretch", "rid").mapInArrow(_search_stretches(penalty), T.StructType([*opened.schema.fields, *_FOUND]))
    marked = swept.filter("seg is not null").unionByName(cut(closed).drop("stretch"))

    segs = marked.groupBy("seg").agg(F.first("hist").alias("hist"), F.first("field").alias("field"), F.first("level").alias("level"), F.max("unit").alias("told"))
    along = Window.partitionBy("hist").orderBy("seg")
    so_far, whole = along.rowsBetween(Window.unboundedPreceding, Window.currentRow), along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    change = F.col("level") - F.lag("level").over(along)
    close = lambda ks: F.array_min(F.array(*[F.struct(F.abs(F.abs("change") - F.lit(math.log10(k))).alias("off"), F.lit(float(k)).alias("k")) for k in ks]))
    nearest = close(KNOWN_FACTORS)
    for name, factors in (known or {}).items():
        nearest = F.when(F.col("field") == name, close(factors)).otherwise(nearest)
    shift = F.when(F.col("nearest.off") <= slack, F.when(F.col("change") > 0, F.col("nearest.k")).otherwise(1 / F.col("nearest.k")))
    segs = segs.withColumn("change", change).withColumn("nearest", F.when(F.col("change").isNotNull(), nearest)).withColumn("shift", shift)
    segs = segs.withColumn("steps", F.sum(F.coalesce(F.log10("shift"), F.lit(0.0))).over(so_far)).withColumn("segment", F.row_number().over(along) - 1).withColumn("told", F.split("told", _SEP))
    # an anchor's factor and the steps up to it, in sum, stay the same along a history while only known factors change its level
    segs = segs.withColumn("base", F.when(F.col("told").isNotNull(), F.struct((F.log10(F.col("told")[0].cast("double")) + F.col("steps")).alias("at"), F.col("told")[1].alias("std_unit"), F.col("told")[2].alias("currency"))))
    segs = segs.withColumn("base", F.coalesce(F.last("base", True).over(so_far), F.first("base", True).over(whole)))
    fill = F.format_string("%.11e", F.pow(F.lit(10.0), F.col("base.at") - F.col("steps")))
    told = F.coalesce("told", F.when(F.col("base").isNotNull(), F.array(fill, "base.std_unit", "base.currency")))
    segs = segs.select("seg", told.alias("told"), "shift", "segment")
    of_rows = marked.select("sid", "rid", "seg").join(segs, "seg").select("sid", "told", F.when(F.col("rid") == F.col("seg"), F.col("shift")).alias("shift"), "segment")
    said = lambda i: F.nullif(F.col("told")[i], F.lit(""))
    return src.join(of_rows, "sid", "left").select(
        *[F.col(n).alias(c) for n, c in zip(names, carried)], "field", "number", F.coalesce(said(0), "factor", "assumed").alias("factor"), F.coalesce(said(1), "std_unit").alias("std_unit"),
        F.when(F.col("told").isNotNull(), said(2)).otherwise(F.col("currency")).alias("currency"), F.col("factor").isNotNull().alias("stated"), F.col("segment").cast("int").alias("segment"), "shift",
    )
