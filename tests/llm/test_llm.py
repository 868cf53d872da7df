"""The training-data operators against brute force, and their edge cases."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from items import login, table

from keelstone.llm import formatting, leakage, packing, personal, quality, survivors
from keelstone.llm import queries as llm_queries

# --- survivors


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.tuples(*[st.integers(0, 4)] * 4)), min_size=1, max_size=60))
def test_undominated(data):
    data.sort(key=lambda t: (t[0], [-x for x in t[1]]))
    group, points = np.array([g for g, _ in data]), np.array([p for _, p in data])
    want = [not any(group[j] == group[i] and (points[j] >= points[i]).all() for j in range(i)) for i in range(len(data))]
    for near in (1, 3, 100):
        assert survivors.undominated(points, group, near).tolist() == want


def brute_choice(members):
    """kept, name and notes position of (pos, hist, rev, cre, name, notes)."""
    order = sorted(members, key=lambda m: m[0])
    for key in (lambda m: m[3] or "", lambda m: m[2] or "", lambda m: m[1]):
        order.sort(key=key, reverse=True)
    notes = [m[0] for m in order if (m[5] or "").strip()]
    return order[0][0], max(order, key=lambda m: len(m[4]))[0], notes[0] if notes else -1


def test_survivors_match_brute_force(spark):
    rnd = random.Random(7)
    dicts, groups = [], {}
    for pos in range(600):
        g = "hot" if rnd.random() < 0.4 else f"g{rnd.randint(0, 150)}"
        hist, rev, cre = rnd.randint(0, 3), rnd.choice([None, "", "2020", "2021-01"]), rnd.choice([None, "2019", "2020"])
        name, notes = g + " " * rnd.randint(0, 5), rnd.choice([None, "", "  ", "n1", "n2"])
        dicts.append({"name": name, "notes": notes, "revision_date": rev, "creation_date": cre, "login": login(), "password_history": None if hist == 0 else [{"password": str(i), "last_used_date": None} for i in range(hist)]})
        groups.setdefault(g, []).append((pos, hist, rev, cre, name, notes))
    items = table(spark, *dicts)
    want = sorted((m[0], *brute_choice(ms)) for ms in groups.values() if len(ms) > 1 for m in ms)
    assert rows(survivors.found(items.repartition(5))) == want
    members = survivors.login_members(items)
    for n in (7, 50):  # blocks of any size merge to the same choice
        got = survivors.choose_survivors(members, rows_at_once=n)
        assert sorted({r[:3] for r in rows(got, "kept_pos", "name_pos", "notes_pos")}) == sorted({w[1:] for w in want})


def test_dominance_layers(spark):
    rnd = random.Random(2)
    items = table(spark, *[{"name": "n", "login": login(), "revision_date": rnd.choice("abc"), "creation_date": rnd.choice("abc"), "password_history": [{"password": "x", "last_used_date": None}] * rnd.randint(0, 2)} for _ in range(60)])
    got = {p: n for _, p, n in rows(survivors.dominance_layers(survivors.login_members(items), 4, 7))}
    rest = {r.pos: (len(r.password_history), r.revision_date, r.creation_date) for r in items.collect()}
    for layer in range(1, 5):
        top = {p for p, v in rest.items() if not any(all(a >= b for a, b in zip(w, v, strict=True)) and (w != v or q < p) for q, w in rest.items() if q != p)}
        assert top == {p for p, n in got.items() if n == layer}
        rest = {p: v for p, v in rest.items() if p not in top}
    assert set(rest) == {p for p, n in got.items() if n == 5}


def test_nulls_are_filled_from_the_next_layer(spark):
    base = {"name": "n", "login": login("u")}
    items = table(spark, base | {"revision_date": "9", "creation_date": "9"}, base | {"revision_date": "1", "creation_date": "1", "folder_id": "low"}, base | {"revision_date": "5", "creation_date": "5", "folder_id": "mid"}, base | {"revision_date": "8", "creation_date": "8", "folder_id": " "})
    r = survivors.survivors(items).first()
    assert (r.kept_pos, r.n_undominated, r.n_layers, r.folder_id, r.totp) == (0, 1, 4, "mid", None)


def test_survivor_records(spark):
    base = {"login": login("u"), "name": "n"}
    items = table(spark, base | {"notes": " b", "revision_date": "3"}, base | {"notes": "a", "name": "n ", "login": login("u", totp="T"), "folder_id": "f", "revision_date": "2"}, base | {"notes": "b", "revision_date": "1"}, {"login": login("x")})
    r = survivors.survivors(items).collect()
    assert [(x.kept_pos, x.n, x.name, x.notes, x.totp, x.folder_id, x.n_notes) for x in r] == [(0, 3, "n ", "b\n---\na", "T", "f", 2)]
    many = table(spark, *[base | {"notes": f"{i:04d}" * 30} for i in range(80)])
    assert len(survivors.survivors(many).first().notes.encode()) <= 6800
    assert survivors.found(items.limit(0)).count() == 0 and survivors.survivors(items.limit(0)).count() == 0


def test_notes_beyond_the_budget_are_counted(spark):
    r = survivors.survivors(table(spark, *[{"name": "n", "login": login(), "notes": str(i % 1500)} for i in range(1600)])).first()
    assert r.n == 1600 and r.n_notes == 1500 and len(r.notes.encode()) <= 6800


def test_layers_are_exact():
    rnd = random.Random(5)
    points = sorted(((rnd.randint(0, 3), rnd.choice("abcde"), rnd.choice("abcde"), rnd.random() < 0.4, rnd.randint(1, 4)) for _ in range(400)), key=lambda p: p[:3], reverse=True)
    state, want = survivors.Layers(), []
    for i, p in enumerate(points):
        want.append(1 + max((n for q, n in zip(points[:i], want, strict=True) if all(a >= b for a, b in zip(q, p, strict=True))), default=0))
        assert state.add(p[3:], p[1], p[2]) == want[-1]
    assert max(want) > 10


def test_nulls_are_filled_from_below_the_third_layer(spark):
    own = lambda i, **k: {"name": "n", "login": login("u"), "revision_date": str(9 - i), "creation_date": str(9 - i)} | k
    held = {"collection_ids": ["c5"], "custom_fields": [{"name": "f", "field_value": "5", "field_type": 0, "linked_id": None}], "login": login("u", uris=[("https://5.test", None)]) | {"password_revision_date": "d5"}}
    items = table(spark, *[own(i) for i in range(4)], own(4, folder_id="f4"), own(5, **held), own(6, folder_id="f6", collection_ids=["c6"]))
    r = survivors.survivors(items).first()
    assert (r.kept_pos, r.n_layers, r.folder_id, r.collection_ids, r.custom_fields[0].field_value, r.uris[0].uri, r.password_revision_date) == (0, 7, "f4", ["c5"], "5", "https://5.test", "d5")
    # Layer 5 by a chain of later creations, with a longer history than layer 4.
    h = lambda n: [{"password": "x", "last_used_date": None}] * n
    chain = [own(0, revision_date="9", creation_date=c, password_history=h(3)) for c in "9876"] + [own(0, revision_date="9", creation_date="5", password_history=h(2), folder_id="layer 5")]
    low = [own(0, revision_date="8", creation_date="7", password_history=h(1), folder_id="layer 4")]
    r = survivors.survivors(table(spark, *chain, *low)).first()
    assert (r.n_layers, r.folder_id) == (5, "layer 4")


# --- formatting


def test_written_forms():
    assert formatting.written(" Ab-ç​_9\t\xad!") == "abç9" and formatting.written("“”") == ""
    f = lambda v: sorted(formatting.forms("url", v))
    assert f("HTTP://A.test/x/?b=2&a=1&&") == f("http://a.test/x?A=1&b=2") == [(0, "httpatestx"), (1, "a1"), (1, "b2")] != f("http://a.test/x?a=1&a=1&b=2")
    assert formatting.forms("exact", "") == formatting.forms("written", "--") == formatting.forms("url", None) == [] and formatting.forms("bag", None) == [(1, "")]


def test_copies(spark):
    f = lambda *names: [{"name": n, "field_value": v, "field_type": 0, "linked_id": None} for n, v in names]
    base = {"name": "My-Site", "login": login("u", "p"), "custom_fields": f(("a", "1"), ("b", "2"))}
    items = table(spark, base, base | {"name": "my site!", "custom_fields": f(("b", "2"), ("a", "1"))}, base | {"custom_fields": f(("a", "1"))}, base | {"login": login("U", "p")}, base | {"login": login("u", " ")}, base | {"notes": ""}, base | {"custom_fields": None}, base | {"custom_fields": []}, base | {"custom_fields": [None]})
    apple = spark.createDataFrame([(1, "T", "http://x?b&a", "u", "p", None, None, "x"), (2, "t.", "HTTP://X?A&&b", " U", "p", "", "", "y"), (3, " ", "", None, "p", None, None, "z"), (4, "", None, "-", "p", None, None, "z"), (5, "T", "http://x?b&a", "u", "q", None, None, "z")], "row_id bigint, title string, url string, username string, password string, notes string, otpauth string, tuple string")
    for block_rows in (1, 3):  # blocks of any size give the same sets
        assert rows(formatting.copies(formatting.encoded(items.repartition(3), apple, block_rows))) == [("apple_rows", 1, 2), ("ciphers", 0, 1), ("ciphers", 0, 5), ("ciphers", 6, 7)]
    enc = formatting.encoded(items, apple)
    assert rows(formatting.copies(enc)) == [("apple_rows", 1, 2), ("ciphers", 0, 1), ("ciphers", 0, 5), ("ciphers", 6, 7)]
    assert (("ciphers", 0, 3) in rows(formatting.sets(enc), "src_table", "first_key", "n_copies")) and formatting.sets(enc).count() == 7
    assert formatting.copies(formatting.encoded(items.limit(0), apple.limit(0))).count() == 0


# --- personal information

FOUND = [
    ("write to Rosa.B+x@mail.example.test now", "email"), ("a_1 (at) site (dot) co (dot) test", "email"), ("<mailto:A@B.TEST>", "email"), ("call (617) 555 0130", "phone"), ("tel:+12025550149", "phone"), ("0044 7700 900254", "phone"),
    ("07700 900 402", "phone"), ("01 99 00 24 71", "phone"), ("+33 1 99 00 49 43", "phone"), ("030/23125-752", "phone"), ("+34 900 000 231", "phone"), ("verified with 993-90-7536", "id_number"), ("social security no. 993 10 2996", "id_number"),
    ("NI number QQ 11 53 76 C", "id_number"), ("QQ626437C", "id_number"), ("DNI 28724578M", "id_number"), ("NIR 1 60 12 99 788 532 58", "id_number"), ("Steuer-ID 60 716 156 951", "id_number"), ("passport no. X36991913", "id_number"),
    ("driving licence DORRO489660AB9", "id_number"), ("218 Old-Mill Street, Town 00122", "address"), ("71 Juniper road in Town", "address"), ("Calle Harrow 215, 6º B, 00721 Town", "address"), ("Harrowweg 49, 00477 Town", "address"),
    ("181 bis rue de Lantern", "address"), ("Apt 29B, 184 Scan Rd, Town, ZX9 3QQ", "address"), ("Dr. Strudbrook", "person"), ("ask rosa pelkelland first", "person"), ("Dorrowby, Rosa", "person"), ("HANNAH F. QUIST", "person"), ("Hannah F.", "person"),
]
CLEAN = ["ratio was 12@131", "Icon file is logo@2x.png, do not rename.", "Ask in @team-ops first", "invoice no. 1487-813/24, paid", "part number 1-219-16-7", "Router sits at 10.0.24.148.", "Snapshot 20231503101112", "The Main Street theme looks broken", "Street view layer must be off", "coordinates 48.100, 11.10", "Amber Vault keeps its own copy", "codes follow RFC 6238", "Room 120, second desk", "ticket 900-23 is closed", "", "Build 4.17.118"]


@pytest.mark.parametrize(("text", "kind"), FOUND)
def test_finds(text, kind):
    assert {k for _, _, k in personal.find(text)} == {kind}


@pytest.mark.parametrize("text", CLEAN)
def test_leaves_alone(text):
    assert personal.find(text) == []


def test_long_texts_take_linear_time():
    import time

    began = time.time()
    for text in ("a%" * 50_000, "x" * 200_000, "ab-" * 50_000, "0 " * 50_000, "Rosa " * 20_000, "a@b.test 415-555-0184 " * 5_000, "Dr. " * 20_000):
        personal.find(text)
    assert time.time() - began < 20 and len(personal.find("a@b.test 415-555-0184 " * 500)) == 1000


def test_surrogates_are_keyed_bijections():
    s, other = personal.Surrogates("k"), personal.Surrogates("l")
    for n in (1, 2, 3):
        made = {s.shape(str(i).zfill(n), "t") for i in range(10**n)}
        assert len(made) == 10**n and all(len(m) == n and m.isdigit() for m in made)
    names = [a + b + c for a in "bcd" for b in "aei" for c in "xyz"]
    assert len({s.shape(n, "surname") for n in names}) == len(names)
    assert s.of("Rosa Dorrowby", "person") == personal.Surrogates("k").of("Rosa Dorrowby", "person") != other.of("Rosa Dorrowby", "person")
    first, last = s.of("Rosa Dorrowby", "person").split()
    assert personal.GENDER[first.lower()] == "f" and s.of("Mrs DORROWBY", "person") == f"Mrs {last.upper()}" and s.of("dorrowby, rosa", "person") == f"{last}, {first}".lower()
    assert s.of("Владимир", "person") != "Владимир" and re.fullmatch("[А-Я][а-я]{7}", s.of("Владимир", "person"))
    assert s.of("+1 (617) 555-0127", "phone").startswith("+1 (") and s.of("a.b@c.test", "email").endswith(".test") and s.of("12 Elm Street", "address").endswith(" Street")


def test_redaction_touches_nothing_else(spark):
    df = spark.createDataFrame([(1, "Call 415-555-0184, ask Rosa Marquand first.\n"), (2, None), (3, ""), (4, "x" * 100_000 + " a@b.test"), (1, "none")], "pos bigint, notes string")
    r = {(x.pos, x.n_mentions): x for x in personal.redact(df, "pos", "notes", "k").collect()}
    assert r[1, 2].placeholders == "Call [PHONE], ask [PERSON] first.\n" and re.fullmatch(r"Call \d{3}-\d{3}-\d{4}, ask [A-Z][a-z]+ [A-Z][a-z]+ first\.\n", r[1, 2].surrogates)
    assert r[2, 0].placeholders is None and r[3, 0].surrogates == "" and r[4, 1].placeholders == "x" * 100_000 + " [EMAIL]" and r[1, 0].placeholders == "none"
    assert rows(personal.kinds_found(personal.redact(df, "pos", "notes", "k"), "pos", "t")) == [("t", 1, "person"), ("t", 1, "phone"), ("t", 4, "email")]
    assert personal.collisions(personal.mentions(df, "pos", "notes", "k")).count() == 0
    bad = spark.createDataFrame([("phone", "1", "9"), ("phone", "2", "9"), ("phone", "2", "9")], "pii_kind string, mention string, surrogate string")
    assert rows(personal.collisions(bad)) == [("phone", "9", 2)]


# --- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=80))
def test_packing_places_all(sizes):
    bins = packing.pack(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    fills = [sum(sizes[i] for i in b) for b in bins]
    assert all(f <= 100 for f in fills) and sum(a + b <= 100 for a, b in combinations(fills, 2) if a and b) == 0


def test_local_search_empties_containers():
    sizes = [60, 40, 50, 50, 50, 30, 20]
    start = [[0, 5], [1, 2], [3, 6], [4]]  # 90, 90, 70, 50 of 100: three are enough
    bins = packing.local_search(start, sizes, 100)
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(7))
    assert len(packing.local_search([[0, 1], [2]], [60, 40, 10], 100)) == 2


def test_search_leaves_no_step():
    rnd = random.Random(1)
    for lo, hi, n, most in ((900, 1150, 2000, 1044), (400, 1400, 2000, 892)):  # with the caps: 1,044 and 894
        sizes = [rnd.randint(lo, hi) for _ in range(n)]
        bins = packing.pack(sizes, 2048)
        fills = [sum(sizes[i] for i in b) for b in bins]
        assert sorted(i for b in bins for i in b) == list(range(n)) and max(fills) <= 2048 and len(bins) <= most
        if len(bins) > -(-sum(sizes) // 2048):
            for a in sorted(range(len(bins)), key=fills.__getitem__)[:60]:  # by brute force, against all others
                sums = {sizes[i] for i in bins[a]} | {sizes[i] + sizes[j] for i, j in combinations(bins[a], 2)}
                for b in range(len(bins)):
                    if b != a and fills[b] < 2048 and fills[a] < 2048:
                        steps = [sizes[i] for i in bins[a]] + [s - sizes[j] for s in sums for j in bins[b]]
                        assert not any(0 < d <= 2048 - fills[b] and fills[b] + d > fills[a] for d in steps)


def test_containers(spark):
    try:
        count = packing.load_tokenizer().encode_ordinary
    except OSError:
        pytest.skip("no tokenizer here")
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["alpha", "beta", "delta", "über"]) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, "", "word " * 500, "same", "same"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, container string")
    got = packing.assign(df, capacity=128, block=50).collect()
    per_doc: dict = {}
    for r in got:
        per_doc.setdefault(r.doc_id, []).append((r.piece_no, r.token_start, r.n_tokens))
    assert sorted(per_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        n = len(count(t)) if t else 0
        pieces = sorted(per_doc[i])
        assert sum(p[2] for p in pieces) == n and len(pieces) == max(1, -(-n // 128)) and [p[1] for p in pieces] == [128 * k for k in range(len(pieces))]
    fills: dict = {}
    for r in got:
        fills[r.container] = fills.get(r.container, 0) + r.n_tokens
    assert max(fills.values()) <= 128 and len(fills) <= 1.1 * -(-sum(fills.values()) // 128)
    assert packing.assign(df.limit(0), capacity=128).count() == 0


# --- leakage


def plain_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=25))
def test_bit_parallel_distance(p, t):
    assert leakage.edit_distance(p, t) == plain_distance(p, t)


def brute_cover(item, doc, errors=0):
    """Words of the item in stretches of eight that lie within errors of some stretch of the document."""
    hit = [False] * len(item)
    for a in range(len(item) - 7):
        if plain_distance(item[a : a + 8], doc) <= errors:
            hit[a : a + 8] = [True] * 8
    return sum(hit)


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_pieces_stay_whole(errors):
    """However errors fall on a stretch of eight, wherever it begins, one aligned piece in it is untouched."""
    piece = leakage.piece_length(errors)
    for start in range(8):
        whole = [range(k, k + piece) for k in range(0, 32, piece) if start <= k and k + piece <= start + 8]
        assert len(whole) >= errors + 1


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_leaks_match_brute_force(spark, errors):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    make = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, make(rnd.randint(12, 60))) for i in range(12)]
    docs = []
    for d in range(60):
        words = make(rnd.randint(5, 60))
        for _ in range(rnd.randint(0, 3)):
            w = rnd.choice(items)[1]
            a = rnd.randint(0, len(w) - 4)
            k = rnd.randint(0, len(words))
            piece = w[a : a + rnd.randint(4, 40)]
            for _ in range(rnd.randint(0, 3)):  # edited leaks
                at = rnd.randrange(len(piece))
                piece = piece[:at] + rnd.choice([[], [rnd.choice(vocab)], [piece[at], rnd.choice(vocab)]]) + piece[at + 1 :] or ["w0"]
            words[k:k] = piece
        docs.append((d, words))
    spell = lambda w: rnd.choice([" ".join(w), "<b>" + "</b>\\n<i>".join(w), ", ".join(x.upper() for x in w), f"<p class='{'x' * 400}'>" + "\n> ".join(w)])
    ddf = spark.createDataFrame([(d, spell(w)) for d, w in docs] + [(100, None), (101, ""), (102, "w1 w2")], "doc_id bigint, text string")
    idf = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(50, None), (51, "w1")], "item_id bigint, text string")
    hits = leakage.item_hits(ddf, idf, errors=errors)
    got = {(r.doc_id, r.item_id): r.n_covered for r in hits.collect()}
    want = {(d, i): c for d, dw in docs for i, iw in items if (c := brute_cover(iw, dw, errors))}
    assert got == want and len(want) > 20
    assert rows(leakage.leaked(hits)) == sorted(k for k, c in want.items() if c * 3 >= len(dict(items)[k[1]]))
    small = leakage.item_hits(ddf, idf, errors=errors, block_chars=200, held_chars=500)  # many blocks, documents held back in many parts
    assert rows(small) == rows(hits)
    assert leakage.item_hits(ddf, idf.limit(0)).count() == 0


def test_covered():
    assert leakage.covered({0}) == (8, 8) and leakage.covered({0, 3, 20}) == (19, 11) and leakage.covered({5, 13}) == (16, 16)


def test_shared_instructions_do_not_count(spark):
    items = [(i, f"Read the passage below and answer it. Item {i} has its own words.") for i in range(4)] + [(9, "One sentence. Two."), (10, None)]
    out = {r.item_id: r.words for r in leakage.item_words(spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert out[2] == "item 2 has its own words".split() and out[9] == ["one", "sentence", "two"] and len(out) == 5


# --- quality

COMMON = {"en": frozenset("the of and to a in is it was that not but for with as on by there had we only what whether has".split()), "de": frozenset("der die das und nicht ist ein".split())}
PROSE = "Nobody noticed that the merge step had rewritten a note about the boiler, but it was not the first time. There were sixty entries left, and the vault kept only the list of cookies."


@pytest.mark.parametrize(("text", "want"), [
    (PROSE, "prose"), ("<speak>\n<p>" + PROSE + "</p>\n</speak>", "prose"), (PROSE.lower().replace(",", "").replace(".", ""), "prose"), (f"Speaker A: {PROSE}\nSpeaker B: {PROSE}", "prose"), (PROSE + "\n\n- one\n- two", "prose"),
    ("- the row\n- a title\n* other\n" * 5, "list"), ("1. first\n2. second thing\n" * 4, "list"), ("https://a.test/x\nhttps://b.test/y\n" * 4, "list"), ("owner: x\nvoice: y\n" * 6, "list"), ("GET https://a.test\nHTTP 200\n[Asserts]\nstatus == 200\n" * 3, "list"),
    ("a,b,c\n1,2,3\nx,,z\n" * 4, "table"), ("| first | second |\n|---|---|\n| 1 | 2 |\n" * 3, "table"), ("a\tb\tc\n1\t2\t3\n" * 4, "table"), ("name    size  kind\nfirst   12    x\nsecond  7     y\n" * 3, "table"),
    ("", "junk"), (" \n", "junk"), ("x", "junk"), ("2.rhq62SRmuPFAPn/gl78gVahmljrtk9bL9aF9fOPCjpQeQvP9Wh7/mgB4uOJ40BWN5GuS4Pwz+O9WBIZGnMTYtgGUriNtowVYyQ8o" * 3, "junk"), (";;;;====////\n####!!!!&&&&\n" * 9, "junk"),
    ("for the that vault had " * 40, "junk"), ("xkfzfx kmewql, lxfadrq;mnj ioakk xskxpr .xpowqenv .nxz,zsfsdz xipjcampv;z nkdajv" * 3, "junk"),
])
def test_structure(text, want):
    assert quality.structure(text, COMMON)[0] == want


def test_long_lines_take_linear_time():
    import time

    began = time.time()
    for unit in ("=", "-|", "a", "a ", "|", " ", "\t", "x=", "(#1", "<", "1.", "\n", "- \n", "https://"):
        for tail in ("", "x", "\n"):
            quality.structure(unit * 60_000 + tail, COMMON)
    assert time.time() - began < 40


def test_divergence():
    assert quality.divergence((1.0, 0.0), (0.0, 1.0)) == 1 and quality.divergence((0.5, 0.5), (0.5, 0.5)) == 0
    assert all(abs(sum(c) - 1) < 0.02 and abs(sum(w) - 1) < 0.02 for c, w in quality.PROFILES.values())


def test_quality_rows(spark):
    docs = spark.createDataFrame([(1, "One two.\nthe end", "x"), (2, None, "x"), (3, "", "x"), (1, "a" * 50_000, "x")], "doc_id bigint, text string, doc_class string")
    common = spark.createDataFrame([("en", "The"), (None, "x"), ("en", None)], "lang string, word string")
    q = quality.text_quality(docs, common)
    assert rows(quality.shares(q)) == [(1, 1, 50_000.0, 0.0, 0.0, 0.0), (1, 4, 3.0, 1 / 16, 0.5, 0.25), (2, 0, 0.0, 0.0, 0.0, 0.0), (3, 0, 0.0, 0.0, 0.0, 0.0)]
    assert {r[0] for r in rows(quality.not_prose(q))} >= {2, 3}
    assert quality.text_quality(docs.limit(0), common.limit(0)).count() == 0


def test_quality_is_whole_and_divergence_only_of_running_text(spark, tmp_path):
    docs = spark.createDataFrame([(1, "- apples and pears\n- bread and butter\n- salt and pepper"), (2, None), (3, "This is the end of the day and it was a good one for all of us.")], "doc_id bigint, text string")
    common = spark.createDataFrame([("en", w) for w in ("this", "is", "the", "and", "of", "it", "a", "for")], "lang string, word string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    common.write.parquet(f"{tmp_path}/common_words.parquet")
    assert "n_common" in llm_queries.p10_found(spark, str(tmp_path))._jdf.queryExecution().analyzed().toString()
    got = {r.doc_id: (r.doc_class, r.nearest_profile, r.divergence is None) for r in quality.text_quality(docs, common).collect()}
    assert got == {1: ("list", None, True), 2: ("junk", "empty", True), 3: ("prose", "prose:en", False)}
