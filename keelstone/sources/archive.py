"""HTTP archives to request files and back."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.web import request_text

_PAIRS = "array<struct<name:string,value:string>>"
ENTRY = f"struct<request:struct<method:string,url:string,headers:{_PAIRS},cookies:{_PAIRS},postData:struct<mimeType:string,text:string>>,response:struct<status:bigint,httpVersion:string>>"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, entry_no, entry): entries of archives of version 1.2 or 1.3; anything else is an error."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    version = F.get_json_object("value", "$.log.version")
    checked = docs.withColumn("value", F.when(version.isin("1.2", "1.3"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no archive of version 1.2 or 1.3: "), F.col("path")))))
    log = F.from_json("value", f"log struct<entries:array<{ENTRY}>>")
    return checked.select("path", F.posexplode(log["log"]["entries"]).alias("entry_no", "entry"))


def to_request_files(entries: DataFrame, file: str = "path") -> DataFrame:
    """(file, text): the entries of each archive in order, blank lines between them. A file is one
    document and so one row."""
    lines = entries.select(file, "entry_no", request_text(F.col("entry")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("entry_no", "t"))), lambda x: x.t)
    return lines.groupBy(file).agg(F.array_join(ordered, "\n").alias("text"))


_METHOD = re.compile(r"\s*([A-Z]+)\s+(\S.*?)\s*(?:#.*)?$")
_STATUS = re.compile(r"\s*(HTTP(?:/[\d.]+)?)\s+(\d{3}|\*)\s*(?:#.*)?$")
_SECTION = re.compile(r"\s*\[(\w+)\]\s*(?:#.*)?$")
_PAIR = re.compile(r"\s*((?:[^:\\]|\\.)+?)\s*:\s*(.*?)\s*$")
_OPTIONS = {"http1.0": "HTTP/1.0", "http1.1": "HTTP/1.1", "http2": "HTTP/2", "http3": "HTTP/3"}
_QUERY_UNSAFE = re.compile(r"[\x00-\x20%#&+=\x7f]|[^\x00-\x7f]")


def _quote(s: str) -> str:
    return _QUERY_UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), s)


def _raw_body(line: str, rest: list[str]) -> tuple[str | None, int]:
    """(text, lines used) of a request body that begins at line; text is None for a file."""
    head = line.strip()
    if head.startswith("```"):
        if head.count("```") > 1:
            return head[3 : head.index("```", 3)], 0
        body = []
        for n, x in enumerate(rest):
            if x.strip().startswith("```"):
                return "".join(f"{b}\n" for b in body), n + 1
            body.append(x)
        raise ValueError("a multiline body is not closed")
    if head.startswith("`"):
        return head[1 : head.rindex("`")], 0
    for name in ("base64", "hex", "file"):
        if head.startswith(f"{name},"):
            value = head[len(name) + 1 :].rstrip(";")
            if name == "file":
                return None, 0
            raw = base64.b64decode("".join(value.split())) if name == "base64" else bytes.fromhex(value)
            try:
                return raw.decode(), 0
            except UnicodeDecodeError:
                return (base64.b64encode(raw).decode() if name == "base64" else raw.hex()), 0
    text, n = line, 0
    if head[0] in "{[\"" or head in ("true", "false", "null") or re.fullmatch(r"-?\d.*", head):
        while True:
            try:
                end = json.JSONDecoder().raw_decode(re.sub(r"\{\{[^{}]*\}\}", lambda m: "1" * len(m[0]), text.lstrip()))[1]
                return text.lstrip()[:end], n
            except ValueError:
                if n >= len(rest):
                    raise
                text, n = f"{text}\n{rest[n]}", n + 1
    while n < len(rest) and rest[n].strip() and not _STATUS.match(rest[n]):  # XML up to the response
        text, n = f"{text}\n{rest[n]}", n + 1
    return text.strip(), n


def parse_requests(text: str) -> list[dict]:
    """Entries of a request file. Request sections for query parameters, cookies and options are
    read; other sections and what follows a status line belong to the response or the client."""
    entries: list[dict] = []
    lines = text.split("\n")
    i, section, entry = 0, "", None
    while i < len(lines):
        line = lines[i].rstrip("\r")
        i += 1
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        status, named, method = _STATUS.match(line), _SECTION.match(line), _METHOD.match(line)
        if status and entry is not None:
            entry["status"], section = 0 if status[2] == "*" else int(status[2]), "response"
        elif method and (entry is None or section == "response" or not _PAIR.match(line) or re.match(r"[A-Z]+\s+(?:https?://|\{\{)", line.strip())):
            entry = {"method": method[1], "url": method[2], "headers": [], "cookies": [], "query": [], "options": [], "body": None, "has_body": False, "status": 0}
            entries.append(entry)
            section = "headers"
        elif entry is None:
            raise ValueError(f"no request before: {line[:60]}")
        elif named and section != "response":
            section = named[1]
        elif section == "response":
            continue
        elif (pair := _PAIR.match(line)) and not re.match(r"\s*[{\[<`\"]", line):
            kept = {"headers": "headers", "QueryStringParams": "query", "Query": "query", "Cookies": "cookies", "Options": "options"}.get(section)
            if kept:
                entry[kept].append((pair[1], pair[2]))
        else:
            entry["body"], used = _raw_body(line, [x.rstrip("\r") for x in lines[i:]])
            i += used
            section = "body"
    return entries


def archive_of(text: str, now: str, creator: str = "keelstone", version: str = "1.0") -> str:
    """An archive document (version 1.2) of a request file."""
    from_pair = lambda p: {"name": p[0], "value": p[1]}
    out = []
    for e in parse_requests(text):
        http = next((_OPTIONS[k] for k, v in e["options"] if k in _OPTIONS and v == "true"), "HTTP/1.1")
        url = e["url"]
        if e["query"]:
            url += ("&" if "?" in url else "?") + "&".join(f"{_quote(k)}={_quote(v)}" for k, v in e["query"])
        request = {"method": e["method"], "url": url, "httpVersion": http, "cookies": list(map(from_pair, e["cookies"])), "headers": list(map(from_pair, e["headers"])), "queryString": list(map(from_pair, e["query"])), "headersSize": -1, "bodySize": len((e["body"] or "").encode())}
        if e["body"] is not None:
            t = e["body"].strip()
            mime = "application/json" if t[:1] + t[-1:] in ("{}", "[]") and len(t) > 1 else "application/xml" if t.startswith("<") else "text/plain"
            request["postData"] = {"mimeType": mime, "text": e["body"]}
        response = {"status": e["status"], "statusText": "", "httpVersion": http, "cookies": [], "headers": [], "content": {"size": 0}, "headersSize": -1, "bodySize": -1}
        out.append({"startedDateTime": now, "time": 0.0, "request": request, "response": response, "cache": {}, "timings": {"blocked": -1.0, "dns": -1.0, "connect": -1.0, "send": 0.0, "wait": 0.0, "receive": 0.0, "ssl": -1.0}})
    return json.dumps({"log": {"version": "1.2", "creator": {"name": creator, "version": version}, "entries": out}}, ensure_ascii=False)


def to_archives(files: DataFrame, now: str, text: str = "text") -> DataFrame:
    """files with archive, the archive document of each request file. Request files have a grammar of
    their own, so this is an Arrow UDF, a document at a time; null stays null."""

    @F.pandas_udf(T.StringType())
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: archive_of(t, now), na_action="ignore")

    return files.withColumn("archive", convert(F.col(text)))
