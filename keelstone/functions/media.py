"""Small lookups and conversions: times, audio types, voices, languages, samples, identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Audio endings and their MIME types; endings that are crawled; voices and locales; language ids in order.
AUDIO_MIME = {"wav": "audio/wav", "mp3": "audio/mpeg", "mpga": "audio/mpeg", "mpeg": "audio/mpeg", "m4a": "audio/mp4", "aac": "audio/mp4", "ogg": "audio/ogg", "opus": "audio/ogg", "flac": "audio/flac", "webm": "audio/webm", "wma": "audio/x-ms-wma", "mp4": "audio/mp4"}
VOICES = ("Fenrir", "Aoede", "Orus", "Puck", "Charon", "Kore")
LOCALES = {"de": "de-DE", "en": "en-US", "es": "es-ES", "fr": "fr-FR", "ru": "ru-RU"}
LANGUAGES = """en zh de fr es ru ko ja pt tr pl ca nl ar sv it id hi fi vi he uk el ms cs ro da hu ta no th ur hr bg lt la mi ml cy sk te fa lv bn sr az sl kn et mk br eu is hy ne mn bs kk sq sw gl mr pa si
km sn yo so af oc ka be tg sd gu am yi lo uz fo ht ps tk nn mt sa lb my bo tl mg as tt haw ln ha ba jw su yue""".split()  # fmt: skip


def iso8601(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso8601_seconds(epoch: Column) -> Column:
    return iso8601(F.timestamp_seconds(epoch))


def iso8601_archive(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def stamp17(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmssSSS")


def is_uuid4(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\z"), F.lit(False))


def new_uuid() -> Column:
    return F.uuid()


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)\z", 1))


def audio_mime(path: Column) -> Column:
    out = F.lit("application/octet-stream")
    for e, mime in AUDIO_MIME.items():
        out = F.when(ending(path) == e, mime).otherwise(out)
    return out


def voice_pool(lang: Column) -> Column:
    locale = F.concat(lang, F.lit("-"), F.upper(lang))
    for k, v in LOCALES.items():
        locale = F.when(lang == k, v).otherwise(locale)
    return F.array(*[F.concat(locale, F.lit(f"-Chirp3-HD-{v}")) for v in VOICES])


def language_of(no: Column) -> Column:
    """Language by id; what has no id is English."""
    return F.coalesce(F.get(F.array(*map(F.lit, LANGUAGES)), no.cast("int")), F.lit("en"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def samples_f32(raw: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian 32-bit samples of a binary column; an incomplete tail is dropped."""
    for s in raw:
        yield s.map(lambda b: np.frombuffer(b, "<f4", len(b) // 4), na_action="ignore")


def decoded_base64(c: Column) -> Column:
    return F.try_to_binary(c, F.lit("base64"))


def videos_in(response: Column) -> Column:
    """array(struct(bytes_base64, uri)) of the first of seven known places in a JSON response text that
    holds at least one video; an entry may be wrapped in "video". Null if none does."""
    v = F.try_parse_json(response)
    paths = ("$.videos", "$.generatedVideos", "$.generateVideoResponse.videos", "$.generateVideoResponse.generatedVideos", "$.predictions", "$.generatedSamples", "$.generateVideoResponse.generatedSamples")

    def found(item: Column) -> Column:
        get = lambda p: F.try_variant_get(item, p, "string")
        places = {at: (get(f"{at}.bytesBase64Encoded"), F.coalesce(get(f"{at}.gcsUri"), get(f"{at}.uri"))) for at in ("$.video", "$")}
        wrapped = places["$.video"][0].isNotNull() | places["$.video"][1].isNotNull()
        pick = lambda k: F.when(wrapped, places["$.video"][k]).otherwise(places["$"][k])
        return F.struct(pick(0).alias("bytes_base64"), pick(1).alias("uri"))

    lists = [F.filter(F.transform(F.try_variant_get(v, p, "array<variant>"), found), lambda x: x.bytes_base64.isNotNull() | x.uri.isNotNull()) for p in paths]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
