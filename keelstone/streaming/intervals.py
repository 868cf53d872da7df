"""Continuous periods and gaps kept up to date over a stream of intervals."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intervals import IntervalMap, periods_and_gaps

_OUT = "entity string, block bigint, change int, span_kind string, span_start bigint, span_end bigint"
_STATE = "starts array<bigint>, ends array<bigint>"
#: Width of a block, in units of the interval; a key of the state never holds more intervals than that.
BLOCK = 360_000


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*state.get) if state.exists else IntervalMap()
    net: Counter[tuple[str, int, int]] = Counter()
    for pdf in batches:
        for s, e in zip(pdf["s"], pdf["e"], strict=True):
            for change, *span in m.insert(int(s), int(e)):
                net[tuple(span)] += change
    rows = [(*key, change, *span) for span, change in sorted(net.items()) if change]
    if rows:
        state.update((m.starts, m.ends))
        yield pd.DataFrame(rows, columns=["entity", "block", "change", "span_kind", "span_start", "span_end"])


def period_changes(stream: DataFrame, entity: str, start: str, end: str, block: int = BLOCK) -> DataFrame:
    """Changes of the periods and gaps of each (entity, block of time), as (entity, block, change, span_kind,
    span_start, span_end); change is -1 for what no longer holds and 1 for what holds now, so the sum
    over a span tells whether it stands. standing() joins blocks to the periods of the entity.

    The state of a key is an ordered map of disjoint intervals; an insertion finds what it overlaps
    by binary search and tells what it changed. Late and repeated intervals need no watermark: inserting
    is commutative and idempotent. Blocks, by the start of an interval, spread a hot entity over many
    keys and bound the state of each. Null entities or ends and reversed intervals are left out.
    """
    rows = stream.select(F.col(entity).cast("string").alias("entity"), F.floor(F.col(start) / block).cast("bigint").alias("block"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")).where("entity is not null and s is not null and e >= s")
    return rows.groupBy("entity", "block").applyInPandasWithState(_update, _OUT, _STATE, "append", "NoTimeout")


def standing(changes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(entity, span_kind, span_start, span_end) that stand after all changes: the periods of all blocks,
    joined where they meet across blocks, and the gaps between them. The same for every block width."""
    n = changes.where("span_kind = 'period'").groupBy("entity", "block", "span_start", "span_end").agg(F.sum("change").alias("n")).where("n > 0")
    return periods_and_gaps(n, "entity", "span_start", "span_end", block)
