"""Queries of the text, markup and transcript functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup, media, text, urls, web
from ..operators import intervals, segments
from ..session import table
from .vault import _scrub, _WS

_h = text.theme_hash


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Documents equal in language and canonical text: longest first, then smallest id."""
    t = _docs(spark, d).select("doc_id", "n_chars", text.stable_digest(F.coalesce("lang", F.lit("")), text.canonical_body(F.col("text"))).alias("g"))
    order = F.struct("n_chars", -F.col("doc_id"))
    groups = t.groupBy("g").agg(F.max_by("doc_id", order).alias("kept_id"), F.count("*").alias("n_copies")).where("n_copies > 1")
    return t.join(groups, "g").select("doc_id", "kept_id", "n_copies", (F.col("doc_id") != F.col("kept_id")).alias("is_loser"))


def duplicate_stats(spark: SparkSession, d: str) -> DataFrame:
    t = _docs(spark, d).select(text.stable_digest(F.coalesce("lang", F.lit("")), text.canonical_body(F.col("text"))).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    return t.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("trashed"), F.count("*").alias("living"))


def theme_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", _h(F.col("text")).alias("theme"))


def canonical_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", _h(text.canonical_body(t)).alias("body"), _h(text.escape_xml(t)).alias("escaped"), _h(text.front_matter_body(t)).alias("front"), text.utf8_prefix(t, F.lit(100)).alias("first_bytes"))


def speech_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", _h(markup.sanitize_speech(t)).alias("sanitized"), _h(markup.strip_pitch(t)).alias("no_pitch"), _h(markup.strip_emphasis(t)).alias("no_emphasis"))


def speech_titles(spark: SparkSession, d: str) -> DataFrame:
    dc = markup.dublin_core(F.col("text"))
    rows = _docs(spark, d).select("doc_id", F.element_at(dc, "title").alias("title"), F.element_at(markup.audio_tags(dc), "artist").alias("artist"))
    return rows.where("title is not null").select("doc_id", "title", markup.file_prefix(F.col("title")).alias("prefix"), "artist")


def prompt_parts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).select("doc_id", text.first_line_value(t, "negative_prompt").alias("negative"), _h(F.when(text.first_line_value(t, "negative_prompt").isNotNull(), text.without_first_line(t, "negative_prompt")).otherwise(t)).alias("rest"))


def mime_types(spark: SparkSession, d: str) -> DataFrame:
    a = _docs(spark, d).select(F.lit("documents").alias("src"), web.guess_mime(F.col("text")).alias("mime"))
    b = table(spark, d, "sync_bodies").select(F.lit("sync_bodies").alias("src"), web.guess_mime(F.col("body")).alias("mime"))
    return a.unionByName(b).groupBy("src", "mime").agg(F.count("*").alias("n"))


def masked_bodies(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sync_bodies").select("body_id", _h(web.mask_secrets(F.col("body"), ("password", "key"), 1 << 30)).alias("masked"))


def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.length(markup.plain_text(F.col("text"))).alias("n_plain"))


def kept_headers(spark: SparkSession, d: str) -> DataFrame:
    """Custom fields read as request headers: how many of each item stay."""
    h = F.transform("custom_fields", lambda f: F.struct(text.text_or_empty(f["name"]).alias("name"), f["field_value"].alias("value")))
    return table(spark, d, "ciphers").where(F.size("custom_fields") > 0).select("pos", F.size(web.kept_headers(h)).alias("n_kept"), web.cookie_line(h, h).alias("cookie"))


def encoded_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "apple_rows")
    return rows.select("row_id", urls.encode_query(F.col("title")).alias("title"), urls.scrub_uri(F.col("url"), F.col("row_id"), F.lit(0)).alias("scrubbed"), urls.storage_folder(F.col("url")).alias("folder"))


def stamps(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    e = table(spark, d, "events")
    return e.select("event_id", media.iso8601(ts).alias("iso"), media.iso8601_archive(ts).alias("archive"), media.stamp17(ts).alias("stamp"), media.language_of(F.col("user_id")).alias("lang"))


def ident_checks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ciphers").select("pos", media.is_uuid4(F.col("id")).alias("is_uuid4"))


def _speech(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "speaker_segments")
    return s.where("recording_id is not null and seg_end >= seg_start").select("recording_id", F.col("seg_id").alias("seq"), "seg_start", "seg_end", text.utrim(F.upper("speaker")).alias("own"))


def best_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Each segment and the speaker whose continuous period overlaps it most."""
    p = intervals.speaking_spans(table(spark, d, "speaker_segments")).where("span_kind = 'period'")
    p = p.select("recording_id", "speaker", (F.col("start_cs") / 100).alias("seg_start"), (F.col("end_cs") / 100).alias("seg_end"), F.struct("start_cs", "speaker").alias("speaker_seq"))
    return segments.best_overlap(_speech(spark, d), p, "recording_id").select("recording_id", "seq", "speaker")


def pauses(spark: SparkSession, d: str) -> DataFrame:
    s = segments.with_pauses(_speech(spark, d), "recording_id", ["seg_start", "seq"], 600)
    return s.where("break_ms is not null").select("recording_id", "seq", "break_ms")


def speaker_islands(spark: SparkSession, d: str) -> DataFrame:
    s = segments.change_points(_speech(spark, d), "recording_id", ["seg_start", "seq"], "own", 600)
    return s.select("recording_id", "seq", "opens", "island")


def speaker_labels(spark: SparkSession, d: str) -> DataFrame:
    s = _speech(spark, d).where("own <> ''").withColumnRenamed("own", "speaker")
    return segments.speaker_labels(s, "recording_id").select("recording_id", "speaker", "label")


def speech_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each recording as speech markup; the text of a segment is its id."""
    s = _speech(spark, d).withColumn("text", F.concat(F.lit("segment "), F.col("seq").cast("string")))
    who = s.where("own <> ''").select("recording_id", F.col("own").alias("speaker"), F.struct("seg_start", "seq").alias("speaker_seq"), "seg_start", "seg_end")
    out = segments.speech_markup(s, who, "recording_id", F.lit("en"), F.concat(F.lit("Recording "), F.col("recording_id").cast("string")))
    return out.select("recording_id", F.length("ssml").alias("n_chars"), F.size(F.regexp_extract_all("ssml", F.lit("<voice "), 0)).alias("n_voices"))


QUERIES = {f.__name__: f for f in (exact_duplicates, duplicate_stats, theme_hashes, canonical_texts, speech_texts, speech_titles, prompt_parts, mime_types, masked_bodies, plain_texts, kept_headers, encoded_names, stamps, ident_checks, best_overlaps, pauses, speaker_islands, speaker_labels, speech_documents)}

_H = lambda x: f"substr(sha256({x}), 1, 8)"
_XML = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"
_G = f"g as (select doc_id, n_chars, coalesce(lang, '') l, {_scrub('text')} t from documents), w as (select doc_id, first_value(doc_id) over (partition by l, t order by n_chars desc, doc_id) kept_id, count(*) over (partition by l, t) n_copies from g)"
_CLEAN = "text"
for _p in (r"<\?xml[^?]*\?>", "<!DOCTYPE[^>]*>", "(?s)<metadata[^>]*>.*?</metadata>", "<voice[^>]*>", "</voice>"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'g')"
_NEG = "(?m)^negative_prompt:\\s*(.+)$"
_PADDED = "case when length(cast(row_id as varchar)) > 4 then cast(row_id as varchar) else lpad(cast(row_id as varchar), 4, '0') end"
_SPEECH = f"sp as (select recording_id, seg_id seq, seg_start, seg_end, trim(upper(speaker), {_WS}) own from speaker_segments where recording_id is not null and seg_end >= seg_start)"
from .repair import _P7  # noqa: E402

SQL = {
    "exact_duplicates": f"with {_G} select doc_id, kept_id, n_copies, doc_id <> kept_id is_loser from w where n_copies > 1",
    "duplicate_stats": f"with {_G}, s as (select l, t, count(*) n from g group by all) select cast(sum(n) as bigint) total, count(*) filter (n > 1) \"groups\", cast(sum(n - 1) as bigint) trashed, count(*) living from s",
    "theme_hashes": f"select doc_id, {_H('text')} theme from documents",
    "canonical_texts": f"select doc_id, {_H(_scrub('text'))} body, {_H(_XML)} escaped, {_H(f'''trim(case when contains(text, '---') then substr(text, instr(text, '---') + 3) else text end, {_WS})''')} front, list_aggregate(list_transform(list_filter(range(0, 101), lambda n: strlen(substr(text, 1, n)) <= 100), lambda n: substr(text, 1, n)), 'last') first_bytes from documents",
    "speech_texts": f"with c as (select doc_id, text, {_CLEAN} s from documents) select doc_id, {_H(f'''trim(case when regexp_matches(s, '<speak[^>]*>') then regexp_replace(s, '<speak[^>]*>', case when regexp_matches(s, 'xml:lang=\"[^\"]*\"') then '<speak xml:lang=\"' || regexp_extract(s, 'xml:lang=\"([^\"]*)\"', 1) || '\">' else '<speak>' end) else s end, {_WS})''')} sanitized, {_H('''regexp_replace(text, '(<prosody[^>]*)\\s+pitch=\"[^\"]*\"', '\\1', 'g')''')} no_pitch, {_H('''regexp_replace(text, '(?s)<emphasis[^>]*>(.*?)</emphasis>', '\\1', 'g')''')} no_emphasis from c",
    "speech_titles": f"with t as (select doc_id, trim(regexp_extract(text, '(?s)<dc:title>(.*?)</dc:title>', 1), {_WS}) title, case when regexp_matches(text, '(?s)<dc:creator>(.*?)</dc:creator>') then trim(regexp_extract(text, '(?s)<dc:creator>(.*?)</dc:creator>', 1), {_WS}) end artist from documents where regexp_matches(text, '(?s)<dc:title>(.*?)</dc:title>')) select doc_id, title, replace(trim(regexp_replace(title, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]', '', 'g'), {_WS}), ' ', '-') prefix, artist from t",
    "prompt_parts": f"select doc_id, nullif(regexp_extract(text, '{_NEG}', 1), '') negative, {_H(f"case when regexp_extract(text, '{_NEG}', 1) <> '' then trim(regexp_replace(text, '{_NEG}', ''), {_WS}) else text end")} rest from documents",
    "mime_types": f"with t as (select 'documents' src, trim(text, {_WS}) t from documents union all select 'sync_bodies', trim(body, {_WS}) from sync_bodies) select src, case when (t like '{{%' and t like '%}}') or (t like '[%' and t like '%]') then 'application/json' when t like '<%' then 'application/xml' else 'text/plain' end mime, count(*) n from t group by all",
    "masked_bodies": f"select body_id, {_H('''regexp_replace(regexp_replace(body, '(?s)\"password\"\\s*:\\s*\"(?:[^\"\\\\]|\\\\.)*\"', '\"password\": \"<redacted>\"', 'g'), '(?s)\"key\"\\s*:\\s*\"(?:[^\"\\\\]|\\\\.)*\"', '\"key\": \"<redacted>\"', 'g')''')} masked from sync_bodies",
    "kept_headers": "select pos, cast(len(list_filter(custom_fields, lambda f: lower(coalesce(f.name, '')) not in (" + ", ".join(f"'{h}'" for h in web.SKIPPED_HEADERS) + "))) as integer) n_kept, case when len(list_filter(custom_fields, lambda f: lower(coalesce(f.name, '')) = 'cookie')) = 0 then 'cookie: ' || array_to_string(list_filter(list_transform(custom_fields, lambda f: coalesce(f.name, '') || '=' || f.field_value), lambda x: x is not null), '; ') end cookie from ciphers where len(custom_fields) > 0",
    "encoded_names": f"select row_id, array_to_string(list_transform(string_split(title, ''), lambda c: case when ascii(c) < 33 or c in ('%', '#', '&', '+', '=') or ascii(c) > 126 then url_encode(c) else c end), '') title, case when coalesce(url, '') = '' then 'https://service' || {_PADDED} || '.example.test/0' when contains(url, '://') then case split_part(url, '://', 1) when 'androidapp' then 'androidapp://com.example.service' || {_PADDED} when 'http' then 'http://service' || {_PADDED} || '.example.test/0' else 'https://service' || {_PADDED} || '.example.test/0' end else 'com.example.opaque.service' || {_PADDED} || '.0' end scrubbed, case when url like '%/' then url else url || '/' end folder from apple_rows",
    "stamps": "select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') iso, strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z') archive, strftime(ts, '%Y%m%d%H%M%S%g') stamp, coalesce((" + "[" + ", ".join(f"'{x}'" for x in media.LANGUAGES) + "])[user_id + 1], 'en') lang from events",
    "ident_checks": "select pos, coalesce(regexp_full_match(id, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}'), false) is_uuid4 from ciphers",
    "best_overlaps": f"with {_P7}, {_SPEECH}, o as (select sp.recording_id, sp.seq, q.speaker, least(sp.seg_end, q.end_cs / 100) - greatest(sp.seg_start, q.start_cs / 100) ov, q.start_cs from sp join spans q on q.span_kind = 'period' and q.recording_id = sp.recording_id and q.start_cs / 100 < sp.seg_end and q.end_cs / 100 > sp.seg_start), x as (select recording_id, seq, speaker from o where ov > 0 qualify row_number() over (partition by recording_id, seq order by ov desc, start_cs, speaker) = 1) select sp.recording_id, sp.seq, x.speaker from sp left join x using (recording_id, seq)",
    "pauses": f"with {_SPEECH}, l as (select *, lag(seg_end) over (partition by recording_id order by seg_start, seq) b from sp) select recording_id, seq, least(cast(trunc((seg_start - b) * 1000) as bigint), 5000) break_ms from l where b > 0 and seg_start - b > 0.5",
    "speaker_islands": f"with {_SPEECH}, l as (select *, own is distinct from lag(own) over (partition by recording_id order by seg_start, seq) opens from sp) select recording_id, seq, opens, cast(sum(cast(opens as integer)) over (partition by recording_id order by seg_start, seq rows unbounded preceding) as bigint) island from l",
    "speaker_labels": f"with {_SPEECH}, i as (select distinct recording_id, own speaker from sp where own <> ''), n as (select *, row_number() over (partition by recording_id order by speaker) r from i) select recording_id, speaker, 'Speaker ' || case when r <= 26 then chr(cast(64 + r as integer)) else cast(r as varchar) end as label from n",
}
