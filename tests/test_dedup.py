"""The deduplication engine: the golden scenario, merge rules, invariants."""

import json
import random

import pytest
from conftest import rows
from items import login, table
from pyspark.sql import functions as F

from keelstone.operators import dedup, folders, redact, segments
from keelstone.operators.passes import Config, with_groups
from keelstone.plans import exports
from keelstone.queries import vault as vault_queries
from keelstone.sources import passwords_csv, vault

NOW = "2026-02-03T04:05:06Z"


def golden(spark):
    """22 items: pairs that differ in nothing, a URI, an app URI, a match mode; a triple; what is never grouped."""
    n = lambda name, user, pw="pw", **k: {"name": name, "login": login(user, pw, **k)}
    web = [("https://a.test", None)]
    return table(
        spark,
        n("Unique", "u0"),
        n("Exact", "u1", uris=web), n("exact ", "u1", uris=web),
        n("Uri", "u2", uris=web), n("Uri (me@mail.test)", "u2", uris=[("https://b.test", None)]),
        n("App", "u3", uris=web), n("App", "u3", uris=[("androidapp://com.a", None)]),
        n("Match", "u4", uris=web), n("Match", "u4", uris=[("https://a.test", 0)]),
        n("Triple", "u5"), n("Triple", "u5"), n("Triple", "u5"),
        n("Same", "u6", "one"), n("Same", "u6", "two"),
        n("Totp", "u7", totp="SECRET"),
        n("Exact", "u1", uris=web) | {"reprompt": 1},
        n("Nothing", "", ""),
        n("Exact [duplicate]", "u1"),
        n("Exact", "u1", uris=web) | {"deleted_date": "2020-01-01T00:00:00Z"},
        {"cipher_type": 3, "name": "Card", "card": {"cardholder_name": "c", "brand": None, "card_number": "1", "exp_month": None, "exp_year": None, "card_code": None}},
        {"cipher_type": 4, "name": "Me", "ident": {"title": None, "first_name": "a", "last_name": "b"}},
        {"cipher_type": 2, "name": "Note", "secure_note": {"note_type": 0}, "notes": "n"},
    )


def test_golden_counts(spark):
    r = dedup.deduplicate(golden(spark), NOW, write_patches=True)
    s = r.stats.first()
    assert (s.total, s.skipped, s.groups, s.trashed, s.merged_uris, s.output, s.living) == (22, 7, 5, 6, 3, 22, 15)
    assert r.items.count() == 22 and dedup.living(r.items).count() == 15 and dedup.trashed(r.items).count() == 7
    assert rows(r.audit, "removed_pos", "kept_pos") == [(2, 1), (4, 3), (6, 5), (8, 7), (10, 9), (11, 9)]
    names = dict(rows(r.items, "pos", "name"))
    assert names[3] == "Uri (me@mail.test)" and names[1] == "exact "
    again = dedup.deduplicate(r.items.drop("kind", "kept_pos", "is_loser"), NOW).stats.first()
    assert again.groups == 0 and again.living == 15


def survivor(r, pos=0):
    return r.items.where(F.col("pos") == pos).first()


def test_what_a_survivor_takes_over(spark):
    h = lambda *x: [{"password": p, "last_used_date": d} for p, d in x]
    f = lambda *x: [{"name": n, "field_value": v, "field_type": t, "linked_id": i} for n, v, t, i in x]
    items = table(
        spark,
        {"name": "Site", "notes": " a ", "folder_id": "f1", "login": login(uris=[("x", None), ("x", None)], totp="OLD"), "password_history": h(("p1", "2020"), ("p2", "2019"), ("p0", None)), "custom_fields": f(("n", "v", 0, None)), "collection_ids": ["c1"], "revision_date": "2021"},
        {"name": "SITE", "notes": "b", "folder_id": "f2", "favorite": True, "login": login(uris=[("x", 0), ("y", None)], totp="NEW"), "password_history": h(("p3", "2021"), ("p1", "2020")), "custom_fields": f(("n", "v", None, -1), ("n", "v", 3, 100)), "collection_ids": ["c2", "c1"], "revision_date": "2023"},
        {"name": "Site (someone@mail.test)", "notes": "a", "folder_id": "f3", "login": login(uris=[("y", None)]), "collection_ids": ["c2", None], "revision_date": "2022"},
    )
    names = spark.createDataFrame([("f2", "Work", 1), ("f2", "Work 2", 2), ("f1", "Home", 1)], "id string, name string, pos int")
    r = dedup.deduplicate(items, NOW, names)
    k = survivor(r)
    assert k.name == "Site (someone@mail.test)" and k.favorite is True and k.login.totp == "NEW"
    assert k.notes == "[merged] originally also in folders: Work 2, f3\n a \n---\nb"
    assert [(u.uri, u.uri_match) for u in k.login.uris] == [("x", None), ("x", None), ("x", 0), ("y", None)]
    assert [(x.password, x.last_used_date) for x in k.password_history] == [("p3", "2021"), ("p1", "2020"), ("p2", "2019"), ("p0", None)]
    assert [(x.field_type, x.linked_id) for x in k.custom_fields] == [(0, None), (3, 100)]
    assert k.collection_ids == ["c1", "c2"]
    a = r.audit.where("removed_pos = 1").first()
    assert (a.totp_conflict, a.totp_kept_from_id, a.uris_merged, a.fields_merged, a.collections_merged, a.notes_merged, a.folder_note_added) == (True, "id-1", 2, 1, 1, True, True)
    assert survivor(r, 1).deleted_date == NOW and survivor(r, 1).notes == "b" and survivor(r, 1).is_loser


def test_order_of_survival(spark):
    pick = lambda *d: rows(dedup.groups(with_groups(table(spark, *d))), "kept_pos")
    one = {"name": "n", "login": login()}
    assert pick(one, one) == [(0,)]
    assert pick(one, one | {"creation_date": "2022"}, one) == [(1,)]
    assert pick(one | {"creation_date": "2030"}, one | {"revision_date": "2022"}) == [(1,)]
    assert pick(one | {"revision_date": "2030"}, one | {"password_history": [{"password": "x", "last_used_date": None}], "revision_date": None}) == [(1,)]
    note = {"cipher_type": 2, "name": "n", "notes": "b"}
    assert pick(note | {"id": "apple-csv-1", "revision_date": "2030"}, note | {"id": "x"}) == [(1,)]


def test_what_is_and_is_not_equal(spark):
    n = lambda *d, **c: dedup.groups(with_groups(table(spark, *d), Config(**c))).count()
    base = {"name": "n", "login": login()}
    assert n(base, base | {"organization_id": "o"}) == 0 and n(base, base | {"organization_id": ""}) == 1
    assert n(base, base | {"login": login("U")}) == 0 and n(base, base | {"login": login(" u ")}) == 1
    assert n(base, base | {"login": login(totp="T")}) == 1 and n(base, base | {"login": login(totp="T")}, split_divergent_totps=True) == 0
    cred = [{"credential_id": "k", "rp_id": None, "user_name": None, "counter": None, "creation_date": None}]
    assert n(base, base | {"login": login(creds=cred)}) == 0
    stub = {"name": "n", "login": login("", " ", uris=[("https://A.test/x", None)])}
    assert n(stub, stub | {"login": login("", None, uris=[("https://a.test", 1)])}) == 1 and n(stub, stub, keep_empty_password_stubs=True) == 0
    assert n({"name": "n", "login": login("", "")}, {"name": "n", "login": login("", "")}) == 0
    assert n(base, base | {"deleted_date": ""}) == 0 and n(base, base | {"archived_date": "x"}) == 0 and n(base, base | {"login": None}) == 0
    card = lambda **k: {"cipher_type": 3, "name": "c", "card": dict.fromkeys(("cardholder_name", "brand", "card_number", "exp_month", "exp_year", "card_code")) | k}
    assert n(card(), card()) == 1 and n(card(), card(brand="")) == 0
    key = {"private_key": "a", "public_key": "b", "key_fingerprint": None}
    assert n({"cipher_type": 5, "name": "x", "ssh_key": key}, {"cipher_type": 5, "name": "y", "ssh_key": key}) == 1
    assert n({"cipher_type": 2, "name": " A​", "notes": "x "}, {"cipher_type": 2, "name": "a", "notes": "x"}) == 1
    assert n(base, base | {"name": None}) == 0


def test_order_of_rows_does_not_matter(spark):
    g = golden(spark)
    shuffled = g.repartition(5).orderBy(F.rand(3))
    a, b = (rows(dedup.deduplicate(x, NOW).items, "pos", "name", "deleted_date") for x in (g, shuffled))
    assert a == b


def test_a_hot_group_and_empty_tables(spark):
    hot = table(spark, *[{"name": "n", "login": login(uris=[(f"https://{i % 7}.test", None)]), "notes": f"note {i % 5}"} for i in range(300)])
    r = dedup.deduplicate(hot, NOW)
    assert r.stats.first().trashed == 299 and len(survivor(r).login.uris) == 7 and survivor(r).notes.count("---") == 4
    empty = dedup.deduplicate(hot.limit(0), NOW)
    assert empty.items.count() == 0 and empty.stats.first().groups == 0


def test_long_notes_are_cut(spark):
    r = dedup.deduplicate(table(spark, *[{"name": "n", "login": login(), "notes": c * 3000} for c in "abc"]), NOW)
    k = survivor(r)
    assert len(k.notes.encode()) <= 6800 and k.notes.startswith("a" * 3000 + "\n---\n" + "b" * 3000) and k.notes.endswith("duplicates]")
    assert r.audit.first().notes_truncated


def test_only_as_many_notes_as_fit_are_collected(spark):
    hot = table(spark, *[{"name": "n", "login": login(), "notes": str(i)} for i in range(1500)])
    k = survivor(dedup.deduplicate(hot, NOW))
    assert k.notes.startswith("0\n---\n1\n---\n2\n") and k.notes.endswith("duplicates]") and 6700 < len(k.notes) <= 6800


def test_all_notes_are_counted_and_merged(spark, tmp_path):
    items = table(spark, *[{"name": "n", "login": login(), "notes": str(i % 1500)} for i in range(1600)])
    items.write.parquet(f"{tmp_path}/ciphers.parquet")
    spark.createDataFrame([], "id string, name string, pos int").write.parquet(f"{tmp_path}/folders.parquet")
    want = "\n---\n".join(map(str, range(1500)))
    assert rows(vault_queries.merged_notes(spark, str(tmp_path)), "n_notes", "merged_notes") == [(1500, want)]
    p = dedup.build_patches(with_groups(items)).first()
    assert (p.n_notes, p.note_bytes, p.notes_truncated) == (1500, len(want), True)


def test_folders(spark):
    f = spark.createDataFrame([("a", "Main", 0), ("b", " main​", 1), (None, "MAIN", 2), ("c", "other", 3), ("b", "again", 4)], "id string, name string, pos int")
    remap = folders.folder_remap(f)
    assert rows(remap) == [("b", "a")]
    items = table(spark, {"folder_id": "b"}, {"folder_id": "c"}, {"folder_id": None}, {"folder_id": "zz"})
    assert rows(folders.remap_folders(items, remap), "pos", "folder_id") == [(0, "a"), (1, "c"), (2, None), (3, "zz")]
    assert rows(folders.folder_names(f)) == [("a", "Main"), ("b", "again"), ("c", "other")]
    assert rows(folders.move_all(items, "m"), "folder_id") == [("m",)] * 4


def test_redaction_keeps_groups_and_winners(spark):
    g = golden(spark)
    r = redact.redacted(g)
    before, after = (rows(dedup.groups(with_groups(x)), "kind", "kept_pos", "n_members") for x in (g, r))
    assert before == after
    text = json.dumps([x.asDict(True) for x in r.drop("creation_date").collect()])
    assert not any(secret in text for secret in ("u1", "SECRET", "a.test", "mail.test", "Triple"))
    assert rows(r, "pos", "id")[:2] == [(0, "00000000-0000-0000-0000-000000000000"), (1, "00000000-0000-0000-0000-000000000001")]
    assert rows(spark.range(1).select(redact.synthetic_date(2026, F.lit(90_000)).alias("d"))) == [("2026-12-31T00:00:00Z",)]
    assert rows(r) == rows(redact.redacted(g.repartition(3)).select(r.columns))


def test_numbers_without_one_task(spark):
    keys = list(range(500))
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k * 3,) for k in keys], "k int").repartition(6)
    assert rows(redact.numbered(df, [F.col("k")], "n")) == [(k * 3, k) for k in range(500)]


def test_export_state(spark):
    items = table(spark, {}, {"organization_id": "o"}, {"deleted_date": "x"}, {"archived_date": "x"})
    assert rows(dedup.exportable(items), "pos") == [(0,), (3,)] and rows(dedup.exportable(items, True), "pos") == [(0,), (2,), (3,)]
    assert tuple(dedup.export_stats(items).first()) == (4, 1, 1, 1, 2)


# --- documents


def export_file(tmp_path, items, folders=({"id": "f", "name": "Main"},)):
    p = tmp_path / "export.json"
    p.write_text(json.dumps({"encrypted": False, "folders": list(folders), "items": items}))
    return str(p)


def test_documents_keep_unknown_fields(spark, tmp_path):
    one = {"id": "1", "type": 1, "name": "A", "novel": {"x": [1, 2]}, "login": {"username": "u", "password": "p", "uris": [{"uri": "https://a", "match": None}], "extra": 1}, "notes": None}
    two = one | {"id": "2", "folderId": "g", "login": one["login"] | {"uris": [{"uri": "https://b", "match": 1}]}}
    odd = {"id": 7, "type": "1", "name": "odd", "unknown": True}
    path = export_file(tmp_path, [one, two, odd], [{"id": "f", "name": "Main"}, {"id": "g", "name": "main"}])
    run = exports.dedup_export(spark, path, NOW)
    doc, gone = json.loads(exports.document(run)), json.loads(exports.document(run, trashed=True))
    assert [i["id"] for i in doc["items"]] == ["1", 7] and doc["items"][1] == odd and doc["folders"] == [{"id": "f", "name": "Main"}]
    kept = doc["items"][0]
    assert kept["novel"] == {"x": [1, 2]} and kept["login"]["extra"] == 1 and [u["uri"] for u in kept["login"]["uris"]] == ["https://a", "https://b"]
    assert gone["items"][0]["deletedDate"] == NOW and gone["items"][0]["folderId"] == "f"
    s = run.stats.first()
    assert (s.total, s.trashed, s.folders_deduplicated) == (3, 1, 1)
    exports.write(run, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/living")).count() == 2
    with pytest.raises(Exception):
        exports.write(run, str(tmp_path / "out"))
    with pytest.raises(ValueError):
        exports.document(run, limit=10)


@pytest.mark.parametrize("text", ["[]", "{}", '{"items": 3}', "no json"])
def test_bad_documents_fail(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception):
        vault.read_export(spark, str(tmp_path / "x.json"))[0].collect()


def test_strict_kinds(spark, tmp_path):
    path = export_file(tmp_path, [{"type": 1.5, "reprompt": "1", "favorite": "true", "name": 3, "collectionIds": [1, "c", None], "fields": {}, "login": [], "card": {"number": 1, "brand": "b"}}])
    r = vault.read_export(spark, path)[0].first()
    assert (r.cipher_type, r.reprompt, r.favorite, r.name, r.custom_fields, r.login) == (None,) * 6
    assert r.collection_ids == [None, "c", None] and (r.card.card_number, r.card.brand) == (None, "b")


def test_password_export(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text('title, URL ,Username,Password,Notes,OTPAuth,Extra\n"A ""x""",https://a,u,p,"l1\nl2",,z\n,,,,,\n,https://b\n,,,,only a note,\n')
    r = passwords_csv.read_passwords(spark, str(p))
    got = rows(r)
    assert ('A "x"', "https://a", "u", "p", "l1\nl2", "") in got and ("", "https://b", "", "", "", "") in got and len(got) == 4
    items = passwords_csv.to_items(r.withColumn("seq", F.monotonically_increasing_id()), "seq", 5, NOW)
    assert rows(items, "cipher_type", "name", "notes") == [(1, 'A "x"', "l1\nl2"), (1, "https://b", None), (2, "(unnamed)", "only a note")]
    assert rows(items, "id")[0] == ("apple-csv-0000000005-000000",)
    assert tuple(passwords_csv.row_counts(r).first()) == (4, 1, 3, 2)
    run = exports.merge_passwords(spark, export_file(tmp_path, [{"id": "1", "type": 1, "name": 'a "X"', "login": {"username": "u", "password": "p"}}]), str(p), 5, NOW)
    assert run.stats.first().groups == 1 and len(json.loads(exports.document(run))["items"]) == 3
    p.write_text("title,url\n1,2\n")
    with pytest.raises(ValueError):
        passwords_csv.read_passwords(spark, str(p))
    p.write_text('title,url,username,password,notes,otpauth\n"open,,,,,\n')
    with pytest.raises(ValueError):
        passwords_csv.read_passwords(spark, str(p))


def test_files_and_guards(spark, tmp_path):
    target = tmp_path / "doc.json"
    vault.write_document("1", str(target))
    with pytest.raises(FileExistsError):
        vault.write_document("2", str(target))
    vault.write_document("3", str(target), clobber=True)
    assert target.read_text() == "3" and target.stat().st_mode & 0o777 == 0o600 and len(list(tmp_path.iterdir())) == 1
    with pytest.raises(ValueError):
        vault.distinct_paths(str(target), str(tmp_path / "." / "doc.json"))
    vault.distinct_paths(str(target), str(tmp_path / "b"))
    (tmp_path / ".git").mkdir()
    vault.outside_repository(str(tmp_path / "x.redacted.json"))
    with pytest.raises(ValueError):
        vault.outside_repository(str(tmp_path / "x.json"))
    names = spark.createDataFrame([("v/export_2.json",), ("v/export_3.dedup.json",), ("v/export_1.json",), ("v/other_9.json",), ("v/export_4.in-folder-x.json",)], "path string")
    assert vault.latest_file(names, ("export_",), (".dedup.json",), (".in-folder-",)).first().path == "v/export_2.json"
    texts = spark.createDataFrame([("p/speech.ssml", " "), ("p/speech-2.ssml", "b"), ("p/speech-3.ssml", ""), ("p/speech-1.ssml", "a")], "path string, text string")
    assert tuple(vault.latest_text(texts, "speech.ssml", "speech-", ".ssml").first()) == ("p/speech-2.ssml", "b")
    (tmp_path / "sub").mkdir()
    for n in ("a.MP3", "sub/b.wav", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in vault.media_files(spark, str(tmp_path), ("mp3", "wav")).collect()] == ["a.MP3", "b.wav"]
    assert rows(vault.not_done(spark.range(3), spark.range(1), "id")) == [(1,), (2,)]
    paths = spark.createDataFrame([("x/vault/e_20240101000000.json",), ("x/vault/../e_20240101000000.json",), ("x/e_20240101000000.json",), ("vault/e_2024.json",)], "p string")
    assert [r[0] for r in paths.select(vault.valid_snapshot_path(F.col("p"), "e_")).collect()] == [True, False, False, False]


# --- transcripts


def test_overlap_labels_and_markup(spark):
    seg = spark.createDataFrame([(1, 0, 0.0, 1.0, "hi <b>"), (1, 1, 2.0, 3.0, "there"), (1, 2, 3.2, 99.0, "long"), (1, 3, 99.0, 99.0, "point"), (1, 4, 100.0, 101.0, " ")], "rec int, seq bigint, seg_start double, seg_end double, text string")
    who = spark.createDataFrame([(1, "y", 0, 2.0, 2.5), (1, "x", 1, 2.5, 3.0), (1, "x", 2, 50.0, 98.0), (2, "z", 0, 0.0, 9.0)], "rec int, speaker string, speaker_seq int, seg_start double, seg_end double")
    got = rows(segments.best_overlap(seg, who, "rec", width=10), "seq", "speaker")
    assert got == [(0, None), (1, "y"), (2, "x"), (3, None), (4, None)]
    assert rows(segments.speaker_labels(who, "rec"), "rec", "label", "speaker") == [(1, "Speaker A", "x"), (1, "Speaker B", "y"), (2, "Speaker A", "z")]
    doc = segments.speech_markup(seg, who, "rec", F.lit("en"), F.lit("T")).first().ssml.split("\n")
    assert doc[3:] == [
        '       xml:lang="en">', "  <dc:title>T</dc:title>", "", "  <!-- Speaker A: en-US-Chirp3-HD-Fenrir -->", "  <!-- Speaker B: en-US-Chirp3-HD-Aoede -->", "", "  hi &lt;b&gt;", '  <break time="1000ms"/>', "  <!-- Speaker B -->", '  <voice name="en-US-Chirp3-HD-Aoede">',
        "    there", "  </voice>", "", "  <!-- Speaker A -->", '  <voice name="en-US-Chirp3-HD-Fenrir">', "    long", "  </voice>", "", '  <voice name="en-US-Chirp3-HD-Fenrir">', "    point", "  </voice>", "</speak>",
    ]
    plain = segments.speech_markup(seg, who.limit(0), "rec", F.lit("en"), F.lit("T")).first().ssml
    assert "<voice" not in plain and plain.endswith("  point\n</speak>")
