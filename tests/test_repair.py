"""Nested records, raw records, orphan references, intervals: brute force and edge cases."""

import json
import random
from datetime import datetime

import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from keelstone.operators import intervals, nested, ordered, orphans, records
from keelstone.queries import repair as repair_queries


# --- nested records


def shredded(spark, *bodies):
    df = spark.createDataFrame([(i, b, "clash") for i, b in enumerate(bodies)], "body_id bigint, body string, record string")
    return nested.shred(df)


def test_children_keep_their_places(spark):
    body = {"Ciphers": [None, {"Type": 1, "Login": {}, "Fields": [None, {"name": "a", "VALUE": {"x": 1}, "type": 0}], "collectionIds": "c", "passwordHistory": {"password": "p"}}, "text", {"type": 2, "fields": None}]}
    s = shredded(spark, json.dumps(body))
    assert rows(nested.child_places(s)) == [(0, 1, "collection_ids", 0), (0, 1, "fields", 1), (0, 1, "password_history", 0)]
    t = nested.tables(s)
    assert rows(nested.supertype(s, "ciphers"), "cipher_idx", "variant") == [(1, "item_login"), (3, "item_other")]
    assert rows(t["item_other"], "cipher_idx", "item_type", "raw") == [(3, 2, '{"type":2,"fields":null}')]
    assert rows(t["field_structured"], "child_idx", "name", "field_value") == [(1, "a", '{"x":1}')]
    assert rows(t["history_undated"], "password") == [("p",)]
    assert rows(t["collection_id"], "collection_id") == [("c",)]
    assert rows(t["rejected"], "cipher_idx", "error") == [(2, "the item is not an object")]


def test_bodies_that_are_no_records(spark):
    s = shredded(spark, None, "", "{", "[1]", '{"ciphers": 3}', '{"ciphers": {"type": 1}}', "[" * 100_000)
    assert rows(s, "body_id", "record") == [(1, "rejected"), (2, "rejected"), (3, "rejected"), (5, "item_other"), (6, "rejected")]
    assert nested.child_places(shredded(spark)).count() == 0


def test_long_bodies_leave_in_batches(spark):
    body = json.dumps({"ciphers": [{"type": 1, "collectionIds": [str(i) for i in range(70)]}]})
    df = spark.createDataFrame([(1, body)], "body_id bigint, body string")
    assert nested.shred(df, rows_at_once=10).count() == 71


def test_automaton_states():
    a = nested.TreeAutomaton()
    assert a.state([1, None, 2.5]) == "array" and a.state([1, "x"]) == "array_mixed"
    assert a.state({"type": 1, "login": None, "card": {}}) == "item_card"
    assert a.state({"type": 1, "value": True}) == "field_flag" and a.state({"password": "x", "lastuseddate": None}) == "history_undated"


def test_variants_are_typed_and_nothing_is_dropped(spark):
    fields = [{"type": 0, "value": True}, {"type": 1, "value": 2.5}, {"type": 3, "value": None, "linkedId": 100}, {"type": 0, "value": None}, {"type": 0, "value": "t"}, {"name": "no type"}, "text", 7, [1]]
    login = {"type": 1, "login": {"username": "u", "uris": [{"uri": "a", "match": 2}, {"uri": "b", "match": None}, "c", None], "fido2Credentials": {"credentialId": "k", "counter": "3"}}, "fields": fields}
    more = [{"type": 3, "card": {"brand": "B", "number": "4"}}, {"type": 4, "identity": {"firstName": "F", "SSN": "1"}}, {"type": 5, "sshKey": {"privateKey": "x"}}, {"type": 2, "secureNote": {"type": 0}}, {"type": 9, "revisionDate": None}]
    s = shredded(spark, json.dumps({"profile": {"email": "e", "key": "k"}, "folders": [{"id": "1", "name": "n"}, None, {"id": "2"}], "ciphers": [login, *more]}))
    t = {n: rows(df.drop("body_id")) for n, df in nested.tables(s).items()}
    assert t["field_flag"] == [(0, 0, None, 0, True)] and t["field_number"] == [(0, 1, None, 1, 2.5)] and t["field_linked"] == [(0, 2, None, 3, 100, None)] and t["field_empty"] == [(0, 3, None, 0)]
    assert [(r[1], r[-1]) for r in t["field_other"]] == [(5, '{"name":"no type"}'), (6, "text"), (7, "7"), (8, "[1]")]
    assert t["uri_matched"] == [(0, 0, "a", 2)] and t["uri_plain"] == [(0, 1, "b")] and t["uri_other"] == [(0, 2, "c", "c")] and t["credentials"] == [(0, 0, "k", None, None, "3", None)]
    assert t["item_card"][0][8:] == (None, "B", "4", None, None, None) and t["item_identity"][0][9] == "F" and t["item_ssh_key"][0][8] == "x" and t["item_note"][0][8] == 0 and len(t["item_bare"]) == 1
    assert t["profiles"] == [("e", "k")] and t["folders"] == [(0, "1", "n")] and t["folder_other"] == [(2, "2", None, '{"id":"2"}')]
    assert s.count() == sum(map(len, t.values())) == 22


def test_depth_costs_no_recursion(spark):
    deep = '{"ciphers": [{"type": 1, "login": {}, "fields": [{"type": 0, "value": ' + '{"a": [' * 1500 + "1" + "]}" * 1500 + "}]}]}"
    s = shredded(spark, deep, "[" * 1_000_000)
    r = nested.tables(s)["field_structured"].first()
    assert r.field_value.count("[") == 1500 and rows(s, "body_id", "record") == [(0, "field_structured"), (0, "item_login"), (1, "rejected")]


def test_typed_children(spark):
    df = spark.createDataFrame([(1, ["a", None, "b"]), (2, None), (3, [])], "pos bigint, c array<string>")
    assert rows(nested.typed_children(df, "pos", "c")) == [(1, 0, "a"), (1, 2, "b")]


# --- raw records


def simple_reason(record):
    """A plain walk over one record."""
    for end in ("\r\n", "\n", "\r"):
        if record.endswith(end):
            record = record[: -len(end)]
            break
    fields, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            j, value = i + 1, ""
            while True:
                if j >= n:
                    return "quoting"
                if record[j] == '"' and record[j + 1 : j + 2] == '"':
                    value, j = value + '"', j + 2
                elif record[j] == '"':
                    break
                else:
                    value, j = value + record[j], j + 1
            i = j + 1
            if i < n and record[i] != ",":
                return "quoting"
        else:
            j = record.find(",", i)
            value = record[i : j if j >= 0 else n]
            if '"' in value:
                return "quoting"
            i += len(value)
        fields.append(value)
        if i >= n:
            break
        i += 1
    if len(fields) != 6:
        return "columns"
    return fields


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='a",\r\né', max_size=200), min_size=1, max_size=8), st.sampled_from([1, 2, 7, 64]))
def test_tokenizer_matches_a_plain_walk(texts, width):
    import numpy as np

    raws = [records._without_line_end(t) for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    last, bad, rec, sep = records.tokenize(np.frombuffer(b"".join(raws), np.uint8), offsets, width)
    for i, t in enumerate(texts):
        want = simple_reason(t)
        quoting = last[i] in (records.QUOTED, records.BAD)
        assert quoting == (want == "quoting")
        if not quoting:
            assert ((rec == i).sum() == 5) == (want != "columns")
    for got, t in zip(records.judge(texts), texts, strict=True):
        want = simple_reason(t)
        assert got[0] == want if isinstance(want, str) else got[0] in ("otpauth", None) and (got[0] or list(got[2:]) == want)


@pytest.mark.parametrize(("otp", "ok"), [
    ("otpauth://totp/a?secret=ABC2", True), (" otpauth://hotp/a:b?issuer=x&secret=ab==&digits=8 ", True), ("otpauth://totp/a?secret=", False), ("otpauth://totp/a?secret=AB1", False), ("otpauth://totp/?secret=AB", False),
    ("otpauth://sotp/a?secret=AB", False), ("otpauth://totp/a?secret=AB&digits=5", False), ("otpauth://totp/a", False), ("otpauth://totp/a?issuer=x", False), ("ABCDEF", False), ("otpauth://totp/a?secret=AB&&x=1", False),
])
def test_otpauth(otp, ok):
    assert records.valid_otpauth(otp) == ok


def test_records_with_reasons(spark):
    data = [(1, None), (2, "a,b,c,d,e,"), (3, '"a\nb",b,c,d,"x ""y""",\r\n'), (4, "a,b"), (5, 'a"b,c'), (6, "a\x07,b,c,d,e,"), (7, "a,b,c,d,\x7f,"), (8, "a,b,c,d,e,x"), (9, '"' + "x" * 200_000 + '",b,c,d,e,'), (10, "a,b,c,d,e,\n\n")]
    df = spark.createDataFrame(data, "raw_id bigint, record string")
    parsed = records.parse_records(df)
    assert rows(records.rejected_rows(parsed)) == [(1, "columns", 1), (4, "columns", 2), (5, "quoting", 1), (6, "title", 0), (7, "notes", 8), (8, "otpauth", 10)]
    valid = {r.raw_id: r for r in records.valid_rows(parsed).collect()}
    assert sorted(valid) == [2, 3, 9, 10] and valid[3].title == "a\nb" and valid[3].notes == 'x "y"' and len(valid[9].title) == 200_000 and valid[2].otpauth == ""
    assert records.parse_records(df.limit(0)).count() == 0


def test_files_split_anywhere(spark):
    text = 'h1,h2\r\n"a\nb",2\r"x ""q""",3\n\nlast,"open\r\nend"'
    want = ["h1,h2", '"a\nb",2', '"x ""q""",3', "", 'last,"open\r\nend"']
    for size in (1, 2, 3, 5, 100):
        chunks = [("f", i, text[k : k + size]) for i, k in enumerate(range(0, len(text), size))]
        got = records.split_records(spark.createDataFrame(chunks, "file_name string, chunk_no bigint, text string")).orderBy("chunk_no", "record_no")
        assert [r.record for r in got.collect()] == want, size


# --- orphan references


def test_orphans(spark):
    t = lambda d: datetime(2024, 1, d)
    parents = spark.createDataFrame([("A ", t(5), None), ("a", t(7), t(9)), (None, t(1), None), ("b", None, None)], "id string, loaded_at timestamp, deleted_at timestamp")
    refs = spark.createDataFrame([(1, "a", t(6), 0), (2, " A", t(4), 0), (3, "a", t(9), 0), (4, "zz", t(4), 0), (5, " ", t(4), 0), (6, None, t(4), 0), (7, "b", t(4), 0), (8, "zz", None, 0), (4, "zz", t(4), 0)], "pos bigint, folder_id string, at timestamp, bits int")
    want = [(2, "folder_id", "late", "2024-01"), (3, "folder_id", "deleted", "2024-01"), (4, "folder_id", "missing", "2024-01"), (4, "folder_id", "missing", "2024-01"), (8, "folder_id", "missing", None)]
    for words in (1, 64, 1 << 17):  # a full filter passes everything on to the exact join
        assert rows(orphans.orphan_references(refs, "pos", "at", {"folder_id": parents}, words)) == want
    assert orphans.orphan_references(refs, "pos", "at", {"folder_id": parents.limit(0)}).count() == 7
    assert rows(orphans.orphan_report(orphans.orphan_references(refs, "pos", "at", {"folder_id": parents})))[0][-1] == 1


def test_filter_never_denies_a_parent(spark):
    keys = spark.range(3000).selectExpr("'f' ref_field", "cast(id as string) ref_key")
    words = {f: 1 << 10 for f in {r.ref_field for r in keys.select("ref_field").distinct().collect()}}
    probe = keys.withColumns(orphans._numbered(list(words), words, keys.ref_field)).withColumn("m", orphans._mask("ref_key"))
    probe = probe.withColumn("slot", orphans._slot(probe.ref_key, probe.words))
    assert [orphans.filter_words(n) for n in (0, 1, 100, 6_000_000, 10**12)] == [1, 1, 16, 1 << 20, 1 << 20]
    assert probe.join(orphans.bloom_words(keys, words), "slot", "left").where("bits is null or (bits & m) <> m").count() == 0


# --- intervals


def brute(pairs):
    out = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


PAIRS = st.lists(st.tuples(st.integers(-50, 50), st.integers(0, 30)).map(lambda t: (t[0], t[0] + t[1])), max_size=40)


@settings(max_examples=300, deadline=None)
@given(PAIRS)
def test_interval_map(pairs):
    m, gaps, periods = intervals.IntervalMap(), set(), set()
    for s, e in pairs:
        for change, kind, *span in m.insert(s, e):
            held = gaps if kind == "gap" else periods
            assert (tuple(span) in held) == (change < 0)
            held ^= {tuple(span)}
    assert m.periods() == brute(pairs) == sorted(periods) and sorted(gaps) == m.gaps() == [(a[1], b[0]) for a, b in zip(m.periods(), m.periods()[1:], strict=False)]


@pytest.mark.parametrize("block", [3, 10, 1000])
def test_periods_across_blocks(spark, block):
    rnd = random.Random(block)
    data = [(k, s, s + rnd.randint(0, 25)) for k in "abc" for s in (rnd.randint(-100, 300) for _ in range(60))] + [("a", 5, 500), (None, 1, 2), ("d", None, 3), ("e", 9, 4)]
    df = spark.createDataFrame(data, "k string, s bigint, e bigint")
    got = rows(intervals.periods_and_gaps(df.repartition(5), "k", "s", "e", block=block, limit=7))
    want = []
    for k in "abc":
        p = brute([(s, e) for x, s, e in data if x == k])
        want += [(k, "period", *x) for x in p] + [(k, "gap", a[1], b[0]) for a, b in zip(p, p[1:], strict=False)]
    assert got == sorted(want)
    assert intervals.periods_and_gaps(df.limit(0), "k", "s", "e").count() == 0


def test_speaking_rows(spark):
    df = spark.createDataFrame([(1, 1.004, 2.0, " a "), (1, 2.0, 3.0, "A"), (1, 5.0, 5.0, "A"), (1, None, 5.0, "A"), (1, 7.0, 8.0, " "), (None, 1.0, 2.0, "A"), (1, 4.0, 6.5, "a\t")], "recording_id bigint, seg_start double, seg_end double, speaker string")
    assert rows(intervals.speaking_spans(df)) == [(1, "A", "gap", 300, 400), (1, "A", "period", 100, 300), (1, "A", "period", 400, 650)]


@pytest.mark.parametrize("block", [4, 360_000])
def test_stream_of_intervals(spark, tmp_path, block):
    from keelstone.streaming.intervals import period_changes, standing

    data = [[("a", 0, 5), ("a", 10, 12), ("b", 1, 2)], [("a", 4, 10), ("a", 20, 21)], [("a", 0, 5), ("b", 0, 9), (None, 1, 2)]]
    for i, part in enumerate(data):
        spark.createDataFrame(part, "k string, s bigint, e bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        (tmp_path / f"mark{i}").touch()
    stream = spark.readStream.schema("k string, s bigint, e bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = period_changes(stream, "k", "s", "e", block).writeStream.format("memory").queryName(f"spans{block}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = rows(standing(spark.table(f"spans{block}"), block), "entity", "span_kind", "span_start", "span_end")
    assert got == [("a", "gap", 12, 20), ("a", "period", 0, 12), ("a", "period", 20, 21), ("b", "period", 0, 9)]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_lag_and_sums_by_block(spark, width):
    rnd = random.Random(width)
    data = [(k, i, rnd.choice([None, "x", "y"])) for k in "ab" for i in range(40)]
    df = spark.createDataFrame(data, "k string, seq bigint, v string").repartition(3)
    out = ordered.running_sum_by_block(ordered.lag_by_block(df, "k", ["seq"], "v", "before", width), "k", ["seq"], df["seq"] * 0 + 1, "n", width)
    for k, i, before, n in rows(out, "k", "seq", "before", "n"):
        assert n == i + 1 and before == (data[(k == "b") * 40 + i - 1][2] if i else None)


def test_both_spellings_of_a_key_count(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    body = '{"Ciphers": [{"Fields": [{"name": "a"}], "fields": [{"name": "b"}, {"name": "c"}], "collectionIds": null, "CollectionIds": ["x"]}], "ciphers": [null, {"passwordHistory": [{"password": "p"}]}]}'
    spark.createDataFrame([(1, body)], "body_id bigint, body string").write.parquet(f"{tmp_path}/sync_bodies.parquet")
    got = rows(repair_queries.p2_found(spark, str(tmp_path)), "body_id", "cipher_idx", "child", "child_idx")
    assert got == [(1, 0, "collection_ids", 0), (1, 0, "fields", 0), (1, 0, "fields", 0), (1, 0, "fields", 1), (1, 1, "password_history", 0)]
    con = duckdb.connect()
    con.execute(f"create view sync_bodies as select * from '{tmp_path}/sync_bodies.parquet/*.parquet'")
    assert sorted(con.sql(f"select body_id, cipher_idx, child, child_idx from ({repair_queries.SQL['p2_found']})").fetchall()) == got
