"""URL functions over Columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import text_or_empty, utrim

# The schemes whose host is a DNS name or an address, and their default ports.
WEB_SCHEMES = {"http": "80", "https": "443", "ws": "80", "wss": "443"}
_WEB = r"(?is)\A(https?|wss?):[/\\]*([^/\\?#]*)"
_ANDROID = "androidapp://"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.transform(F.array(value), use)[0]


def _host(a: Column) -> Column:
    """Kind and token from struct(u, scheme, host, port)."""
    default = F.when(a.scheme.isin("https", "wss"), WEB_SCHEMES["https"]).otherwise(WEB_SCHEMES["http"])
    token = F.when((a.port == "") | (a.port == default), a.host).otherwise(F.concat(a.host, F.lit(":"), a.port))
    address = a.host.rlike(r"\A(?:\d{1,3}(?:\.\d{1,3}){3}|\[[0-9a-f:.]+\])\z")
    named = (a.host != "") & ~a.host.rlike(r"[\s<>^|%:\\\[\]]")
    web = F.when(a.scheme == "", None).when(address, "ip").when(named, "dns")
    package = F.regexp_extract(a.u, r"(?s)\A.{13}([^/?#]*)", 1)
    android = F.startswith(a.u, F.lit(_ANDROID))
    kind = lambda k, t: F.struct(k.alias("kind"), t.alias("token"))
    return F.when((a.u == "") | (android & (package == "")), None).when(android, kind(F.lit("android"), package)).when(web.isNotNull(), kind(web, token)).when(a.u.isNotNull(), kind(F.lit("opaque"), a.u))


def host_of(uri: Column) -> Column:
    """struct(kind, token), null for a blank URI. kind: android (package, case kept), dns (lower case) or
    ip for http, https, ws, wss, with a port that is not the default; otherwise opaque, the trimmed
    text as it is. Hosts outside ASCII are lower-cased; punycode() converts their tokens."""
    cut = lambda u: F.struct(u.alias("u"), F.lower(F.regexp_extract(u, _WEB, 1)).alias("scheme"), F.regexp_replace(F.regexp_extract(u, _WEB, 2), r"(?s)\A.*@", "").alias("where"))
    parts = lambda a: F.struct(a.u, a.scheme, F.lower(F.regexp_replace(a["where"], r":\d*\z", "")).alias("host"), F.regexp_replace(F.regexp_extract(a["where"], r":(\d*)\z", 1), r"\A0+(?=\d)", "").alias("port"))
    return bind(utrim(uri), lambda u: bind(cut(u), lambda a: bind(parts(a), _host)))


def ascii_host(host: str) -> str:
    """A host name in its ASCII form (punycode labels); what cannot be converted stays."""
    try:
        return host if host.isascii() else ".".join(p if p.isascii() else p.encode("idna").decode() for p in host.split("."))
    except UnicodeError:
        return host


@F.pandas_udf(T.StringType())
def punycode(hosts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """ascii_host over a column of tokens, for where hosts outside ASCII occur; Arrow batches."""
    for s in hosts:
        yield s.map(ascii_host, na_action="ignore")


def host_set(uris: Column) -> Column:
    """Sorted distinct hosts of an array of struct(uri, ...); empty for null."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(F.transform(uris, lambda x: host_of(x.uri)), lambda h: h.isNotNull()))), F.expr("cast(array() as array<struct<kind:string,token:string>>)"))


def scrub_uri(uri: Column, gid: Column, idx: Column) -> Column:
    """A synthetic URI of the same class: http, https, Android package, or opaque."""
    name = F.lpad(gid.cast("string"), 4, "0")
    name = F.when(F.length(gid.cast("string")) > 4, gid.cast("string")).otherwise(name)
    site = F.concat(F.lit("://service"), name, F.lit(".example.test/"), idx.cast("string"))
    scheme = F.when(F.contains(uri, F.lit("://")), F.substring_index(uri, "://", 1))
    return F.when(text_or_empty(uri) == "", F.concat(F.lit("https"), site)).when(scheme == "androidapp", F.concat(F.lit("androidapp://com.example.service"), name)).when(scheme == "http", F.concat(F.lit("http"), site)).when(scheme.isNotNull(), F.concat(F.lit("https"), site)).otherwise(F.concat(F.lit("com.example.opaque.service"), name, F.lit("."), idx.cast("string")))


def encode_query(text: Column) -> Column:
    """Percent-encode controls, space, % # & + = and what is not ASCII; {{templates}} stay readable."""
    strict = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in "!\"$'()*,/:;<>?@[\\]^`{|}~":
        strict = F.replace(strict, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return strict


def with_query(url: Column, names: Column, values: Column) -> Column:
    """url with its query parameters appended, by ? or &."""
    query = F.array_join(F.zip_with(names, values, lambda n, v: F.concat(encode_query(n), F.lit("="), encode_query(v))), "&")
    return F.when(F.size(names) <= 0, url).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?")), query))


def storage_folder(uri: Column) -> Column:
    return F.when(F.endswith(uri, F.lit("/")), uri).otherwise(F.concat(uri, F.lit("/")))
