import base64
import hashlib
import hmac
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from keelstone.functions import crypto, markup, media, text, urls, web
from keelstone.operators import merge


def one(spark, value, *columns):
    df = spark.createDataFrame([(value,)], "x string").select(*[c(F.col("x")).alias(f"c{i}") for i, c in enumerate(columns)])
    r = df.first()
    return r[0] if len(columns) == 1 else tuple(r)


@pytest.mark.parametrize(("given", "want"), [
    ("  Site (me@mail.test) ", "site"), ("Site (me)", "site (me)"), ("A (x) (b@c)", "a (x)"), ("A (b@c) tail", "a (b@c) tail"), ("(a@b)", ""), (None, ""), ("A (b(c@d)", "a (b"), ("ÉCOLE\n(a@b)", "école"), ("A (a@b\nc)", "a"),
])
def test_normalize_name(spark, given, want):
    assert one(spark, given, text.normalize_name) == want


def test_trim_and_scrub(spark):
    assert one(spark, "  a b\t\n", text.utrim) == "a b"
    assert one(spark, "a​b c﻿", text.scrub_invisible) == "ab c"
    assert one(spark, " Ärger­ ", text.normalize_note_name) == "ärger"
    assert [one(spark, x, text.is_blank) for x in (None, "", "  \t", "x")] == [True, True, True, False]


@pytest.mark.parametrize(("n", "want"), [(0, ""), (1, "a"), (2, "a"), (3, "aé"), (4, "aé"), (6, "aé"), (7, "aé😀"), (99, "aé😀")])
def test_utf8_prefix(spark, n, want):
    assert one(spark, "aé😀", lambda c: text.utf8_prefix(c, F.lit(n))) == want


def test_parts_of_a_prompt(spark):
    t = "title: x\nnegative_prompt:  no hands \nA cat\n"
    assert one(spark, t, lambda c: text.first_line_value(c, "negative_prompt")).strip() == "no hands"
    assert one(spark, t, lambda c: text.without_first_line(c, "negative_prompt")) == "title: x\n\nA cat"
    assert one(spark, "meta\n---\n body --- more", text.front_matter_body) == "body --- more"
    assert one(spark, " none ", text.front_matter_body) == "none"
    assert one(spark, "<a href=\"x\">'&", text.escape_xml) == "&lt;a href=&quot;x&quot;&gt;&apos;&amp;"
    assert one(spark, "abc", text.theme_hash) == hashlib.sha256(b"abc").hexdigest()[:8]


@pytest.mark.parametrize(("uri", "want"), [
    ("https://Example.COM/x?y", ("dns", "example.com")), ("https://example.com:443", ("dns", "example.com")), ("http://a.test:8080/", ("dns", "a.test:8080")), ("http://u:p@a.test", ("dns", "a.test")),
    ("https://10.0.0.1:9", ("ip", "10.0.0.1:9")), ("http://[::1]/", ("ip", "[::1]")), ("androidapp://Com.App/path", ("android", "Com.App")), ("androidapp://", None), ("  ", None), (None, None),
    ("myapp://Host", ("opaque", "myapp://Host")), ("com.Example.App", ("opaque", "com.Example.App")), ("WSS://a.test:443", ("dns", "a.test")),
])
def test_host_of(spark, uri, want):
    got = one(spark, uri, urls.host_of)
    assert (None if got is None else tuple(got)) == want


def test_hosts_outside_ascii(spark):
    df = spark.createDataFrame([("https://MÜNCHEN.test:81/x",), ("https://a.test",), (None,), ("https://.ü.test",)], "u string").select(urls.punycode(urls.host_of(F.col("u"))["token"]).alias("h"))
    assert rows(df) == [(None,), (".xn--tda.test",), ("a.test",), ("xn--mnchen-3ya.test:81",)]


def test_query_and_scrubbed_uris(spark):
    assert one(spark, "a b&c=d/é{{x}}", urls.encode_query) == "a%20b%26c%3Dd/%C3%A9{{x}}"
    df = spark.range(1).select(urls.with_query(F.lit("http://a?z=1"), F.array(F.lit("k")), F.array(F.lit("v+"))).alias("u"))
    assert df.first().u == "http://a?z=1&k=v%2B"
    got = [one(spark, u, lambda c: urls.scrub_uri(c, F.lit(7), F.lit(2))) for u in (None, "http://a", "androidapp://x", "ftp://x", "com.app")]
    assert got == ["https://service0007.example.test/2", "http://service0007.example.test/2", "androidapp://com.example.service0007", "https://service0007.example.test/2", "com.example.opaque.service0007.2"]


def test_speech_markup(spark):
    doc = '<?xml version="1.0"?><!DOCTYPE speak><speak version="1" xml:lang="de"><metadata><dc:title> T!  x </dc:title><dc:rights></dc:rights></metadata><voice name="a">hi</voice> <speak a="b"></speak>'
    assert one(spark, doc, markup.sanitize_speech) == '<speak xml:lang="de">hi <speak a="b"></speak>'
    assert one(spark, doc, markup.dublin_core) == {"title": "T!  x", "rights": ""}
    assert one(spark, doc, lambda c: markup.audio_tags(markup.dublin_core(c))) == {"title": "T!  x", "copyright": ""}
    assert one(spark, "Ça va? (x)", markup.file_prefix) == "Ça-va-x"
    assert one(spark, '<prosody rate="1" pitch="2"><emphasis level="a">b</emphasis>', markup.strip_pitch, markup.strip_emphasis) == ('<prosody rate="1"><emphasis level="a">b</emphasis>', '<prosody rate="1" pitch="2">b')


@pytest.mark.parametrize(("md", "want"), [
    ("", ""), ("# Head\n\ntext *em* `code` [link](http://x)", "Headtext em code link"), ("a\nb\n\n```py\nx = 1\n```\nc", "a\nbc"), ("- one\n- two", "onetwo"), ("    code\n\ntext", "codetext"), ("p\n\n    code\n\nq", "pq"), ("a  \nb", "a\nb"), ("![alt](x.png)", "alt"), ("> quote\n> more", "quote\nmore"),
])
def test_markdown(md, want):
    assert markup.markdown_text(md) == want


def test_plain_text_udf(spark):
    df = spark.createDataFrame([("**a**",), (None,)], "x string").select(markup.plain_text("x").alias("t"))
    assert rows(df) == [(None,), ("a",)]


def test_web(spark):
    assert [one(spark, x, web.guess_mime) for x in (" {} ", "[1]", "<a>", "x", "{")] == ["application/json", "application/json", "application/xml", "text/plain", "text/plain"]
    assert [one(spark, x, web.http_version) for x in ("h2", "HTTP/3.0", "h10", "zzz")] == ["HTTP/2", "HTTP/3", "HTTP/1.0", "HTTP/1.1"]
    body = '{"access_token" : "a\\"b", "x": 1, "access_token":"c"}'
    assert one(spark, body, web.mask_secrets) == '{"access_token": "<redacted>", "x": 1, "access_token": "<redacted>"}'
    assert one(spark, "é" * 600, web.mask_secrets) == "é" * 512 + "... (truncated)"


def test_media(spark):
    assert [one(spark, x, media.audio_mime) for x in ("a/b.MP3", "x.flac", "x")] == ["audio/mpeg", "audio/flac", "application/octet-stream"]
    assert one(spark, "it", media.voice_pool)[0] == "it-IT-Chirp3-HD-Fenrir"
    df = spark.createDataFrame([(bytes(5) + b"\0\0\x80\x3f",)], "b binary").select(media.samples_f32("b").alias("s"))
    assert df.first().s[0] == 0 and len(df.first().s) == 2
    assert spark.range(1).select(media.iso8601_seconds(F.lit(0)).alias("t")).first().t == "1970-01-01T00:00:00Z"
    docs = ['{"videos": [], "generatedVideos": [{"video": {"uri": "u"}}, {"x": 1}]}', '{"predictions": [{"bytesBase64Encoded": "QQ=="}]}', '{"videos": 3}', "no json", None]
    got = [one(spark, d, media.videos_in) for d in docs]
    assert [None if g is None else [tuple(x) for x in g] for g in got] == [[(None, "u")], [("QQ==", None)], None, None, None]


def test_fit_notes(spark):
    fit = lambda t, budget, over=0: one(spark, t, lambda c: merge.fit_notes(c, budget, F.lit(over), marker="\n---\n[cut]"))
    assert fit("short", 5) == "short"
    assert fit("aaaa\n---\nbbbb\n---\ncccccc", 23) == "aaaa\n---\nbbbb\n---\n[cut]"
    assert fit("aaaa\n---\nbbbb\n---\ncccccc", 22) == "aaaa\n---\n[cut]"
    assert fit("é" * 20, 21) == "é" * 5 + "\n---\n[cut]"
    assert fit("x" * 30, 10) == "---\n[cut]"
    assert fit("x" * 30, 30, 1) == "x" * 19 + "\n---\n[cut]"


def test_decrypted(spark):
    with pytest.raises(ValueError):
        crypto.master_key("p", "a@b", 1000)
    enc, mac = crypto.stretch(hashlib.sha256(b"master").digest())
    assert enc != mac and crypto.split_key(enc + mac) == (enc, mac)
    iv = bytes(range(16))
    made = spark.range(1).select(F.aes_encrypt(F.lit("grüße"), F.lit(enc), F.lit("CBC"), F.lit("PKCS"), F.lit(iv)).alias("b")).first().b
    data = bytes(made)[16:]
    b64 = lambda b: base64.b64encode(b).decode()
    good = hmac.new(mac, iv + data, hashlib.sha256).digest()
    texts = [f"2.{b64(iv)}|{b64(data)}|{b64(good)}", f"2.{b64(iv)}|{b64(data)}|{b64(bytes(32))}", f"0.{b64(iv)}|{b64(data)}", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string").select("n", crypto.decrypted(F.col("x"), crypto.constant_key((enc, mac))).alias("clear"), crypto.decrypted(F.col("x"), crypto.keys(F.lit(enc), F.lit(mac))).alias("again"))
    assert rows(df, "n", "again") == rows(df, "n", "clear") and rows(df, "n", "clear") == [(0, "grüße"), (1, None), (2, None), (3, None), (4, None)]


def test_archive_round_trip(spark, tmp_path):
    from keelstone.sources import archive

    requests = 'POST http://a.test/x?q=1\nAccept: */*\ncookie: k=v\n```json\n{"a":1}\n```\nHTTP/2 201\n\nGET http://b.test\nHTTP/1.1 200\n'
    har = {"log": {"version": "1.2", "entries": [
        {"request": {"method": "POST", "url": "http://a.test/x?q=1", "headers": [{"name": "Accept", "value": "*/*"}, {"name": "DNT", "value": "1"}], "cookies": [{"name": "k", "value": "v"}], "postData": {"mimeType": "application/json", "text": '{"a":1}'}}, "response": {"status": 201, "httpVersion": "h2"}},
        {"request": {"method": "GET", "url": "http://b.test", "headers": [], "cookies": []}, "response": {"status": 200, "httpVersion": "http/1.1"}},
    ]}}
    (tmp_path / "a.har").write_text(json.dumps(har))
    out = archive.to_request_files(archive.read_archives(spark, str(tmp_path / "a.har")))
    assert out.first().text == requests
    back = json.loads(archive.to_archives(out, "2020-01-01T00:00:00.000Z").first().archive)["log"]["entries"]
    assert [(e["request"]["method"], e["request"]["url"], e["response"]["status"]) for e in back] == [("POST", "http://a.test/x?q=1", 201), ("GET", "http://b.test", 200)]
    assert back[0]["request"]["postData"] == {"mimeType": "application/json", "text": '{"a":1}\n'}


def test_request_grammar():
    from keelstone.sources.archive import archive_of

    text = "# c\nGET {{host}}/p\nA: b\n[QueryStringParams]\nn: a b\n[Cookies]\nc: d\n[Options]\nhttp2: true\nHTTP *\n[Asserts]\nstatus == 1\nPUT http://x\nbase64,aGk=;\nPUT http://y\n{\"a\": {{v}},\n \"b\": 2}\nHTTP 204\nPUT http://z\nfile,x.bin;\n"
    e = [x["request"] | {"status": x["response"]["status"]} for x in json.loads(archive_of(text, "now"))["log"]["entries"]]
    assert [(x["url"], x["status"], x["httpVersion"]) for x in e] == [("{{host}}/p?n=a%20b", 0, "HTTP/2"), ("http://x", 0, "HTTP/1.1"), ("http://y", 204, "HTTP/1.1"), ("http://z", 0, "HTTP/1.1")]
    assert [x.get("postData", {}).get("text") for x in e] == [None, "hi", '{"a": {{v}},\n "b": 2}', None]
    assert e[0]["cookies"] == [{"name": "c", "value": "d"}]
