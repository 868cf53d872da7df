"""Continuous periods and gaps per entity from overlapping, nested or touching intervals."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import utrim
from ..session import cut


class IntervalMap:
    """Ordered disjoint intervals; touching ones belong together.

    put() finds the overlapped stretch by binary search and merges it. insert() also returns what that
    changed, so a stream can keep tables of periods and gaps up to date.
    """

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts, self.ends = list(starts or []), list(ends or [])

    def put(self, start: int, end: int) -> tuple[int, int] | None:
        """Where intervals were replaced by one, as (place, number replaced); None if nothing changed."""
        starts, ends = self.starts, self.ends
        lo, hi = bisect_left(ends, start), bisect_right(starts, end)
        if lo < hi:
            if starts[lo] <= start and ends[lo] >= end:
                return None
            start, end = min(start, starts[lo]), max(end, ends[hi - 1])
        starts[lo:hi], ends[lo:hi] = [start], [end]
        return lo, hi - lo

    def insert(self, start: int, end: int) -> list[tuple[int, str, int, int]]:
        """The changes: (-1 or 1, "period" or "gap", start, end) of what ends and what begins to hold."""
        lo, hi = bisect_left(self.ends, start), bisect_right(self.starts, end)
        old = list(zip(self.starts[lo:hi], self.ends[lo:hi], strict=True))
        before = self._gaps(max(lo - 1, 0), min(hi + 1, len(self)))
        if self.put(start, end) is None:
            return []
        after = self._gaps(max(lo - 1, 0), min(lo + 2, len(self)))
        gone = [(-1, "period", *p) for p in old] + [(-1, "gap", *g) for g in before if g not in after]
        return [*gone, (1, "period", self.starts[lo], self.ends[lo]), *((1, "gap", *g) for g in after if g not in before)]

    def _gaps(self, lo: int, hi: int) -> list[tuple[int, int]]:
        return list(zip(self.ends[lo : hi - 1], self.starts[lo + 1 : hi], strict=True))

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))

    def gaps(self) -> list[tuple[int, int]]:
        return self._gaps(0, len(self.starts))

    def __len__(self) -> int:
        return len(self.starts)


_SHAPE = pa.schema([("entity", pa.string()), ("block", pa.int64()), ("s", pa.int64()), ("e", pa.int64()), ("prev_e", pa.int64()), ("last", pa.bool_())])
_DDL = "entity string, block bigint, s bigint, e bigint, prev_e bigint, last boolean"


def _emit(maps: dict[tuple[str, int], IntervalMap]) -> pa.RecordBatch:
    cols: list[list] = [[], [], [], [], [], []]
    for (entity, block), m in maps.items():
        n = len(m)
        for c, x in zip(cols, ([entity] * n, [block] * n, m.starts, m.ends, [None, *m.ends[:-1]], [False] * (n - 1) + [True]), strict=True):
            c.extend(x)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _SHAPE, strict=True)], schema=_SHAPE)


def _fold(limit: int, sorted_input: bool):
    """Put rows into one IntervalMap per (entity, block). Unsorted: a map-side combine that hands
    on what it holds once limit intervals are in memory. Sorted: one key after the other, whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple[str, int], IntervalMap] = {}
        held, at = 0, None
        for batch in batches:
            for entity, block, s, e in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                k = (entity, block)
                if sorted_input and k != at:
                    at = k
                    if held >= limit:
                        yield _emit(maps)
                        maps, held = {}, 0
                m = maps.get(k)
                if m is None:
                    m = maps[k] = IntervalMap()
                changed = m.put(s, e)
                if changed:
                    held += 1 - changed[1]
                if not sorted_input and held >= limit:
                    yield _emit(maps)
                    maps, held = {}, 0
        if maps:
            yield _emit(maps)

    return run


def stitched(merged: DataFrame) -> DataFrame:
    """(entity, span_kind, span_start, span_end) from the disjoint intervals of each (entity, block), with
    the end before each (prev_e) and the last of its block marked.

    Only one row per block is windowed: the end that earlier blocks reach (carry) takes up the first
    intervals of a block, and the last interval of a block reaches as far as the blocks after it carry on.
    All others stand as they are.
    """
    by_entity = Window.partitionBy("entity").orderBy("block")
    heads = merged.where("last").select("entity", "block", F.col("e").alias("block_end"))
    heads = heads.select("entity", "block", F.max("block_end").over(by_entity.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"), F.max("block_end").over(Window.partitionBy("entity")).alias("top"))
    rows = merged.join(heads, ["entity", "block"]).where(F.col("carry").isNull() | (F.col("s") > F.col("carry")))
    opened = rows.select("entity", "block", "s", "e", "last", "top", F.greatest("carry", "prev_e").alias("before"))
    inner = opened.where("not last").select("entity", "s", F.col("e").alias("stop"), "before")
    # A block that opens anything opens its last interval, so the rows with last are one for each such block.
    first = opened.groupBy("entity", "block").agg(F.min_by("before", "s").alias("b"), F.max("s").alias("s"), F.max_by("before", "s").alias("before"), F.max("top").alias("top"))
    ends = first.select("entity", "s", F.coalesce(F.lead("b").over(by_entity), "top").alias("stop"), "before")
    spans = F.array(F.struct(F.lit("period").alias("span_kind"), F.col("s").alias("span_start"), F.col("stop").alias("span_end")), F.struct(F.lit("gap").alias("span_kind"), F.col("before").alias("span_start"), F.col("s").alias("span_end")))
    return inner.unionByName(ends).select("entity", F.inline(spans)).where("span_start is not null")


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, block: int = 360_000, limit: int = 100_000) -> DataFrame:
    """(entity, span_kind, span_start, span_end) over whole-number intervals, start <= end.

    Time is cut into blocks by the start of an interval. Each (entity, block) has its own ordered
    interval map, first per input partition, then per shuffled key, so an entity with a third of
    all rows is spread over its blocks and a map never holds more than block intervals. The maps are
    written once to the shared folder and stitched from block to block (see stitched).

    Null entity or end, or end before start: the row is left out. Repeated rows and ties change
    nothing; an empty input gives no rows; other columns are not touched.
    """
    narrow = df.select(F.col(entity).cast("string").alias("entity"), F.floor(F.col(start) / block).cast("bigint").alias("block"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("entity is not null and s is not null and e >= s")
    combined = narrow.mapInArrow(_fold(limit, False), _DDL).select("entity", "block", "s", "e")
    spread = combined.repartition("entity", "block").sortWithinPartitions("entity", "block", "s")
    return stitched(cut(spread.mapInArrow(_fold(limit, True), _DDL)))


def speaking_rows(segments: DataFrame) -> DataFrame:
    """Countable speaker segments with times in whole hundredths of a second."""
    cs = lambda c: F.round(F.col(c) * 100).cast("bigint")
    speaker = F.upper(utrim(F.col("speaker")))
    counts = (speaker != "") & (F.col("seg_end") > F.col("seg_start")) & ~F.isnan("seg_start") & ~F.isnan("seg_end") & F.col("recording_id").isNotNull()
    return segments.where(counts).select(F.col("recording_id").cast("bigint").alias("recording_id"), speaker.alias("speaker"), cs("seg_start").alias("start_cs"), cs("seg_end").alias("end_cs"))


def speaking_spans(segments: DataFrame) -> DataFrame:
    """Periods and gaps of each speaker of each recording: (recording_id, speaker, span_kind,
    start_cs, end_cs). Blank speakers, missing or reversed ends are left out."""
    keyed = speaking_rows(segments).withColumn("entity", F.concat_ws("\x1f", "recording_id", "speaker"))
    spans = periods_and_gaps(keyed, "entity", "start_cs", "end_cs")
    parts = F.split("entity", "\x1f", 2)
    return spans.select(parts[0].cast("bigint").alias("recording_id"), parts[1].alias("speaker"), "span_kind", F.col("span_start").alias("start_cs"), F.col("span_end").alias("end_cs"))
