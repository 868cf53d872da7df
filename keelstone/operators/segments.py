"""Transcripts and speakers: best overlap, pauses, change points, labels, speech markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.media import voice_pool
from ..functions.text import escape_xml
from .ordered import lag_by_block, running_sum_by_block


def best_overlap(segments: DataFrame, speakers: DataFrame, entity: str, width: float = 30.0) -> DataFrame:
    """(entity, seq, speaker) of each segment: the speaker interval with the largest overlap, the
    earliest (by speaker_seq, of any ordered type) of equal ones, null if none overlaps.

    Both sides are cut into buckets of width seconds, which makes the range condition an equi join on
    (entity, bucket); candidates are combined before they are brought together by (entity, seq), and
    a candidate found in several buckets counts once, because the best is taken. Null ends overlap
    nothing.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width).cast("bigint"), F.floor(F.col(b) / width).cast("bigint")))
    left = segments.where("seg_end >= seg_start").select(entity, "seq", F.col("seg_start").alias("a"), F.col("seg_end").alias("b"), bucket("seg_start", "seg_end").alias("bucket"))
    right = speakers.where("seg_end >= seg_start").select(entity, "speaker", "speaker_seq", F.col("seg_start").alias("c"), F.col("seg_end").alias("d"), bucket("seg_start", "seg_end").alias("bucket"))
    overlap = F.least("b", "d") - F.greatest("a", "c")
    best = left.join(right, [entity, "bucket"]).where(overlap > 0).groupBy(entity, "seq").agg(F.min_by("speaker", F.struct(-overlap, "speaker_seq")).alias("speaker"))
    return segments.join(best, [entity, "seq"], "left")


def pause_ms(gap: Column) -> Column:
    return F.least((gap * 1000).cast("bigint"), F.lit(5000))


def with_pauses(segments: DataFrame, entity: str, order: list[str], width: float = 100_000) -> DataFrame:
    """break_ms where more than half a second passes between the end of one segment and the next."""
    before, gap = F.col("end_before_"), F.col("seg_start") - F.col("end_before_")
    rows = lag_by_block(segments, entity, order, "seg_end", "end_before_", width)
    return rows.withColumn("break_ms", F.when((before > 0) & (gap > 0.5), pause_ms(gap))).drop("end_before_")


def speaker_labels(speakers: DataFrame, entity: str) -> DataFrame:
    """(entity, speaker, label): Speaker A to Z in order of the ids, then numbers."""
    ids = speakers.where("speaker is not null").select(entity, "speaker").distinct()
    r = F.row_number().over(Window.partitionBy(entity).orderBy("speaker"))
    return ids.withColumn("speaker_no", r).withColumn("label", F.concat(F.lit("Speaker "), F.when(F.col("speaker_no") <= 26, F.char(F.col("speaker_no") + 64)).otherwise(F.col("speaker_no").cast("string"))))


def change_points(segments: DataFrame, entity: str, order: list[str], speaker: str = "speaker", width: float = 100_000) -> DataFrame:
    """opens: whether a new voice begins at the segment; island: its running number from 1, 0 before the first.
    Leading segments without a speaker open nothing."""
    rows = lag_by_block(segments, entity, order, speaker, "speaker_before_", width)
    rows = rows.withColumn("opens", ~F.col(speaker).eqNullSafe(F.col("speaker_before_"))).drop("speaker_before_")
    return running_sum_by_block(rows, entity, order, F.col("opens").cast("bigint"), "island", width)


def speech_markup(segments: DataFrame, speakers: DataFrame, entity: str, lang: Column, title: Column) -> DataFrame:
    """(entity, ssml): the transcript of each recording as speech markup. A recording is one document
    and so one row; its lines are built in parallel and put in order at the end. Voices follow the
    order of the labels."""
    labels = speaker_labels(speakers, entity)
    attributed = best_overlap(segments.where(F.trim("text") != ""), speakers, entity).join(labels, [entity, "speaker"], "left")
    s = change_points(with_pauses(attributed, entity, ["seq"]), entity, ["seq"], speaker="label")
    known = labels.groupBy(entity).agg(F.transform(F.sort_array(F.collect_list(F.struct("speaker_no", "label"))), lambda x: x.label).alias("labels"))
    s = s.join(known, entity, "left")
    pool = voice_pool(lang)
    voice = F.element_at(pool, (F.pmod(F.coalesce(F.col("speaker_no"), F.lit(1)) - 1, F.lit(6)) + 1).cast("int"))
    some = F.size("labels") > 0
    opened = F.col("island") > 0
    opens = some & F.col("opens")
    was_open = some & ((F.col("island") - F.col("opens").cast("bigint")) > 0)
    indent = lambda c: F.when(c, "    ").otherwise("  ")
    lines = F.array_compact(F.array(
        F.when(F.col("break_ms").isNotNull(), F.concat(indent(was_open), F.lit('<break time="'), F.col("break_ms").cast("string"), F.lit('ms"/>'))),
        F.when(opens & was_open, "  </voice>\n"),
        F.when(opens & F.col("label").isNotNull(), F.concat(F.lit("  <!-- "), F.col("label"), F.lit(" -->"))),
        F.when(opens, F.concat(F.lit('  <voice name="'), voice, F.lit('">'))),
        F.concat(indent(some & opened), escape_xml(F.trim("text"))),
    ))
    body = s.select(entity, "seq", F.array_join(lines, "\n").alias("line"), (some & opened).alias("open"), "labels", lang.alias("lang"), title.alias("title"))
    doc = body.groupBy(entity).agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "line"))), lambda x: x.line).alias("lines"), F.max_by("open", "seq").alias("open"), F.first("labels").alias("labels"), F.first("lang").alias("lang"), F.first("title").alias("title"))
    voices = F.transform("labels", lambda label, i: F.concat(F.lit("  <!-- "), label, F.lit(": "), F.element_at(voice_pool(F.col("lang")), (i % 6 + 1).cast("int")), F.lit(" -->")))
    head = F.array(F.lit('<?xml version="1.0" encoding="UTF-8"?>'), F.lit('<speak version="1.0" xmlns="http://www.w3.org/2001/10/synthesis"'), F.lit('       xmlns:dc="http://purl.org/dc/elements/1.1/"'), F.concat(F.lit('       xml:lang="'), F.col("lang"), F.lit('">')), F.concat(F.lit("  <dc:title>"), escape_xml(F.col("title")), F.lit("</dc:title>")), F.lit(""))
    none = F.expr("cast(array() as array<string>)")
    legend = F.when(F.size("labels") > 0, F.concat(voices, F.array(F.lit("")))).otherwise(none)
    tail = F.when(F.col("open"), F.array(F.lit("  </voice>"), F.lit("</speak>"))).otherwise(F.array(F.lit("</speak>")))
    return doc.select(entity, F.array_join(F.concat(head, legend, "lines", tail), "\n").alias("ssml"))
