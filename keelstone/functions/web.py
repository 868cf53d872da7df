"""HTTP archive functions: MIME types, versions, header filters, request text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_or_empty, utrim

# Request headers that clients set themselves.
SKIPPED_HEADERS = (":authority", ":method", ":path", ":scheme", "accept-encoding", "cache-control", "pragma", "sec-ch-ua", "sec-ch-ua-mobile", "sec-ch-ua-platform", "sec-fetch-dest", "sec-fetch-mode", "sec-fetch-site", "sec-fetch-user", "sec-gpc", "dnt", "priority", "upgrade-insecure-requests")
# Spellings of HTTP versions.
VERSIONS = {"http/2.0": "HTTP/2", "http/2": "HTTP/2", "h2": "HTTP/2", "h2c": "HTTP/2", "http/3.0": "HTTP/3", "http/3": "HTTP/3", "h3": "HTTP/3", "http/1.0": "HTTP/1.0", "h10": "HTTP/1.0", "http/0.9": "HTTP/1.0", "h09": "HTTP/1.0"}
# Keys whose values are secrets.
SECRET_KEYS = ("access_token", "refresh_token", "id_token", "client_secret", "MasterPasswordHash", "TwoFactorToken")


def guess_mime(text: Column) -> Column:
    t = utrim(text)
    pair = lambda a, b: F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b))
    return F.when(pair("{", "}") | pair("[", "]"), "application/json").when(F.startswith(t, F.lit("<")), "application/xml").otherwise("text/plain")


def http_version(version: Column) -> Column:
    v = F.lower(version)
    out = F.lit("HTTP/1.1")
    for spelled, means in VERSIONS.items():
        out = F.when(v == spelled, means).otherwise(out)
    return out


def kept_headers(headers: Column) -> Column:
    """Headers (array of struct(name, value)) without those that clients set themselves."""
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*SKIPPED_HEADERS))


def cookie_line(headers: Column, cookies: Column) -> Column:
    """Cookies joined by "; " if there are some and no header is a Cookie, else null."""
    there = F.coalesce(F.exists(headers, lambda h: F.lower(h["name"]) == "cookie"), F.lit(False))
    pairs = F.transform(cookies, lambda c: F.concat(c["name"], F.lit("="), c["value"]))
    return F.when(~there & (F.size(cookies) > 0), F.concat(F.lit("cookie: "), F.array_join(pairs, "; ")))


def request_text(entry: Column) -> Column:
    """The request file text of one archive entry (struct request, response)."""
    q, post = entry.request, entry.request.postData
    headers = F.transform(kept_headers(q.headers), lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    body = F.when(text_or_empty(post.text) != "", F.concat(F.lit("```"), F.when(F.contains(post.mimeType, F.lit("json")), "json").otherwise(""), F.lit("\n"), post.text, F.lit("\n```")))
    first, last = F.concat(q.method, F.lit(" "), q.url), F.concat(http_version(entry.response.httpVersion), F.lit(" "), entry.response.status.cast("string"))
    empty = F.expr("cast(array() as array<string>)")
    lines = F.concat(F.array(first), F.coalesce(headers, empty), F.array_compact(F.array(cookie_line(q.headers, q.cookies), body)), F.array(last))
    return F.concat(F.array_join(lines, "\n"), F.lit("\n"))


def mask_secrets(body: Column, keys: tuple[str, ...] = SECRET_KEYS, limit: int = 1024) -> Column:
    """JSON text with the string values of secret keys masked, cut to limit bytes at a code point."""
    from .text import utf8_prefix

    for k in keys:
        body = F.regexp_replace(body, rf'(?s)"{k}"\s*:\s*"(?:[^"\\]|\\.)*"', f'"{k}": "<redacted>"')
    return F.when(F.octet_length(body) > limit, F.concat(utf8_prefix(body, F.lit(limit)), F.lit("... (truncated)"))).otherwise(body)
