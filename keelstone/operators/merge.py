"""Aggregates that merge what the members of a group hold into its survivor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import utf8_prefix

SEPARATOR = "\n---\n"
# Fixed value: the byte budget of merged notes.
NOTES_BUDGET = 6_800
CUT_MARKER = SEPARATOR + "[notes cut to fit; the full text is kept with the duplicates]"


def fit_notes(notes: Column, budget: int = NOTES_BUDGET, overhead: Column | None = None, marker: str = CUT_MARKER) -> Column:
    """Notes of at most budget bytes, overhead included: whole, or cut at the last separator that
    leaves room for the marker, or else at a code point boundary; the marker alone if nothing fits."""
    over = F.lit(0) if overhead is None else overhead
    room = F.lit(budget - len(marker.encode())) - over
    step = len(SEPARATOR)
    zero = F.struct(F.lit(0).alias("at"), F.lit(-1).alias("best"))
    ends = F.aggregate(F.slice(F.split(notes, SEPARATOR), 1, F.greatest(F.size(F.split(notes, SEPARATOR)) - 1, F.lit(0))), zero, lambda a, p: F.struct((a.at + F.octet_length(p) + step).alias("at"), F.when(a.at + F.octet_length(p) <= room, a.at + F.octet_length(p)).otherwise(a.best).alias("best")))
    kept = utf8_prefix(notes, F.when(ends.best >= 0, ends.best).otherwise(room))
    return F.when(F.octet_length(notes) + over <= budget, notes).when(room <= 0, F.lit(marker.lstrip())).otherwise(F.concat(kept, F.lit(marker)))
