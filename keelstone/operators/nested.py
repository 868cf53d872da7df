"""Deeply nested JSON records to flat typed tables that keep parent and place.

Each node of a record gets a state from a bottom-up tree automaton: leaves by their JSON kind,
arrays by the set of their elements' states, objects by rules over {lower-cased key: child state}.
The state of an object is its structural variant. A second walk, from the root, meets the nodes that
have a place (items, folders, fields, ...), and the state alone routes each to the typed table of its
variant; states without a table of their own go to the "other" table of their place, so no node is
lost. A subtype table has the keys that all variants of its place share (the supertype) and its own
typed columns, and every row carries body, item and place in the array.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Object variants, most specific first: (state, keys that must be there with one of these child states). "any" is every state, "set" every state but null.
OBJECT_RULES: list[tuple[str, dict[str, str]]] = [
    ("item_login", {"type": "num", "login": "set"}),
    ("item_note", {"type": "num", "securenote": "set"}),
    ("item_card", {"type": "num", "card": "set"}),
    ("item_identity", {"type": "num", "identity": "set"}),
    ("item_ssh_key", {"type": "num", "sshkey": "set"}),
    ("item_bare", {"type": "num", "revisiondate": "any"}),
    ("field_linked", {"type": "num", "value": "any", "linkedid": "num"}),
    ("field_structured", {"type": "num", "value": "object"}),
    ("field_flag", {"type": "num", "value": "bool"}),
    ("field_number", {"type": "num", "value": "num"}),
    ("field_text", {"type": "num", "value": "str"}),
    ("field_empty", {"type": "num", "value": "null"}),
    ("history_dated", {"password": "str", "lastuseddate": "str"}),
    ("uri_matched", {"uri": "str", "match": "num"}),
    ("uri_plain", {"uri": "str"}),
    ("credential", {"credentialid": "any"}),
    ("history_undated", {"password": "str"}),
    ("folder", {"id": "any", "name": "any"}),
    ("profile", {"key": "any"}),
]


class TreeAutomaton:
    """Deterministic bottom-up automaton over JSON trees; transitions are memoised by child states. The tree
    is walked with a stack of its own, so depth costs memory, not recursion."""

    def __init__(self, rules: list[tuple[str, dict[str, str]]] = OBJECT_RULES) -> None:
        self.rules, self.seen = rules, {}

    def state(self, node: Any) -> str:
        return self.states(node, {})

    def states(self, node: Any, of: dict[int, str]) -> str:
        """The state of node; of takes the states of all objects and arrays below it by identity."""
        if not isinstance(node, (dict, list)):
            return self.of_leaf(node)
        stack = [(node, False)]
        while stack:
            at, ready = stack.pop()
            children = at.values() if isinstance(at, dict) else at
            if not ready:
                stack.append((at, True))
                stack.extend([(c, False) for c in children if isinstance(c, (dict, list))])
                if isinstance(at, _Repeated):
                    stack.extend([(c, False) for cs in at.earlier.values() for c in cs if isinstance(c, (dict, list))])
                continue
            known = [of[id(c)] if isinstance(c, (dict, list)) else self.of_leaf(c) for c in children]
            of[id(at)] = self.of_object(frozenset(zip(at, known, strict=True))) if isinstance(at, dict) else self.of_array(frozenset(known))
        return of[id(node)]

    @staticmethod
    def of_leaf(v: Any) -> str:
        return "null" if v is None else "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "str"

    def of_array(self, children: frozenset[str]) -> str:
        return "array" if len(children - {"null"}) < 2 else "array_mixed"

    def of_object(self, children: frozenset[tuple[str, str]]) -> str:
        known = self.seen.get(children)
        if known is None:
            by_key = dict(children)
            known = self.seen[children] = next((name for name, needs in self.rules if all(self._fits(by_key.get(k), kind) for k, kind in needs.items())), "object")
        return known

    @staticmethod
    def _fits(state: str | None, kind: str) -> bool:
        if state is None or kind == "any":
            return state is not None
        if kind == "set":
            return state != "null"
        if kind == "object":
            return state not in ("null", "bool", "num", "str", "array", "array_mixed")
        return state == kind


class _Repeated(dict):
    """An object with a key that comes more than once: earlier holds its values but the last, by key."""

    earlier: dict[str, list]


def _lower_keys(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    """Keys count without regard to case; of two spellings of a key the last that is not null holds,
    the others can be had by _values."""
    out: dict[str, Any] = {}
    earlier: dict[str, list] = {}
    for k, v in pairs:
        k = k.lower()
        if v is not None or k not in out:
            if out.get(k) is not None:
                earlier.setdefault(k, []).append(out[k])
            out[k] = v
    if earlier:
        out = _Repeated(out)
        out.earlier = earlier
    return out


def _values(node: dict[str, Any], key: str) -> list:
    """The values of all spellings of a key, as written."""
    return [*(node.earlier.get(key, ()) if isinstance(node, _Repeated) else ()), node.get(key)]


def _as_array(v: Any) -> list:
    """A lone object or string stands for an array of one; anything else is no array."""
    return v if isinstance(v, list) else [v] if isinstance(v, (dict, str)) else []


def _json(v: Any) -> str:
    """Compact JSON of any depth, in the order of the record."""
    try:
        return json.dumps(v, ensure_ascii=False, separators=(",", ":"))
    except RecursionError:
        out: list[str] = []
        stack: list[Any] = [v]
        while stack:
            at = stack.pop()
            if isinstance(at, _Raw):
                out.append(at.text)
            elif isinstance(at, dict):
                parts: list[Any] = [_Raw("{")]
                for i, k in enumerate(at):
                    parts += [_Raw("," if i else ""), _Raw(json.dumps(k, ensure_ascii=False) + ":"), at[k]]
                stack.extend(reversed([*parts, _Raw("}")]))
            elif isinstance(at, list):
                parts = [_Raw("[")]
                for i, x in enumerate(at):
                    parts += [_Raw("," if i else ""), x]
                stack.extend(reversed([*parts, _Raw("]")]))
            else:
                out.append(json.dumps(at, ensure_ascii=False))
        return "".join(out)


class _Raw:
    __slots__ = ("text",)

    def __init__(self, text: str) -> None:
        self.text = text


def _text(v: Any) -> str | None:
    return v if v is None or isinstance(v, str) else _json(v)


def _whole(v: Any) -> str | None:
    return str(v) if isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63 else None


def _key(name: str, make=_text):
    return lambda node: make(node.get(name)) if isinstance(node, dict) else None


def _in(block: str, name: str, make=_text):
    def get(node):
        b = node.get(block)
        return make(b.get(name)) if isinstance(b, dict) else None

    return get


def _block(block: str, names: dict[str, str]) -> list[tuple[str, str, Callable[[Any], str | None]]]:
    return [(column, "string", _in(block, key)) for column, key in names.items()]


#: What all variants of a place share: (column, type, how it is read).
SUPERTYPES: dict[str, list[tuple[str, str, Callable[[Any], str | None]]]] = {
    "profile": [("email", "string", _key("email")), ("profile_key", "string", _key("key"))],
    "folders": [("folder_id", "string", _key("id")), ("name", "string", _key("name"))],
    "ciphers": [("item_id", "string", _key("id")), ("item_type", "bigint", _key("type", _whole)), ("organization_id", "string", _key("organizationid")), ("folder_id", "string", _key("folderid")), ("item_name", "string", _key("name")), ("revision_date", "string", _key("revisiondate")), ("notes", "string", _key("notes"))],
    "fields": [("name", "string", _key("name")), ("field_type", "bigint", _key("type", _whole))],
    "password_history": [("password", "string", lambda e: _text(e.get("password")) if isinstance(e, dict) else _text(e))],
    "collection_ids": [("collection_id", "string", lambda e: _text(e.get("id")) if isinstance(e, dict) else _text(e))],
    "uris": [("uri", "string", lambda e: _text(e.get("uri")) if isinstance(e, dict) else _text(e))],
    "fido2_credentials": [("credential_id", "string", _key("credentialid"))],
}
_RAW = [("raw", "string", _text)]
#: The subtype table of each variant, by place and state, with its own columns; None takes every other state.
SUBTYPES: dict[str, dict[str | None, tuple[str, list[tuple[str, str, Callable[[Any], str | None]]]]]] = {
    "profile": {"profile": ("profiles", []), None: ("profile_other", _RAW)},
    "folders": {"folder": ("folders", []), None: ("folder_other", _RAW)},
    "ciphers": {
        "item_login": ("item_login", [*_block("login", {"username": "username", "password": "password", "totp": "totp", "password_revision_date": "passwordrevisiondate"})]),
        "item_note": ("item_note", [("note_type", "bigint", _in("securenote", "type", _whole))]),
        "item_card": ("item_card", _block("card", {"cardholder_name": "cardholdername", "brand": "brand", "card_number": "number", "exp_month": "expmonth", "exp_year": "expyear", "card_code": "code"})),
        "item_identity": ("item_identity", _block("identity", {c: c.replace("_", "") for c in "title first_name middle_name last_name address1 address2 address3 city state postal_code country company email phone ssn username passport_number license_number".split()})),
        "item_ssh_key": ("item_ssh_key", _block("sshkey", {"private_key": "privatekey", "public_key": "publickey", "key_fingerprint": "keyfingerprint"})),
        "item_bare": ("item_bare", []),
        None: ("item_other", _RAW),
    },
    "fields": {
        "field_text": ("field_text", [("field_value", "string", _key("value"))]),
        "field_flag": ("field_flag", [("field_value", "boolean", _key("value"))]),
        "field_number": ("field_number", [("field_value", "double", _key("value"))]),
        "field_linked": ("field_linked", [("linked_id", "bigint", _key("linkedid", _whole)), ("field_value", "string", _key("value"))]),
        "field_structured": ("field_structured", [("field_value", "string", _key("value"))]),
        "field_empty": ("field_empty", []),
        None: ("field_other", _RAW),
    },
    "password_history": {"history_dated": ("history_dated", [("last_used_date", "string", _key("lastuseddate"))]), "history_undated": ("history_undated", []), None: ("history_other", _RAW)},
    "collection_ids": {"str": ("collection_id", []), None: ("collection_other", _RAW)},
    "uris": {"uri_matched": ("uri_matched", [("uri_match", "bigint", _key("match", _whole))]), "uri_plain": ("uri_plain", []), None: ("uri_other", _RAW)},
    "fido2_credentials": {"credential": ("credentials", [("rp_id", "string", _key("rpid")), ("user_name", "string", _key("username")), ("counter", "string", _key("counter")), ("creation_date", "string", _key("creationdate"))]), None: ("credential_other", _RAW)},
}
#: Arrays of an item that have tables: place -> (block or None, lower-cased key).
CHILDREN = {"fields": (None, "fields"), "password_history": (None, "passwordhistory"), "collection_ids": (None, "collectionids"), "uris": ("login", "uris"), "fido2_credentials": ("login", "fido2credentials")}
COLUMNS_OF = {name: (place, SUPERTYPES[place] + own) for place, variants in SUBTYPES.items() for name, own in variants.values()}
_DDL = "record string, item_idx bigint, child_idx bigint, variant string, cells array<string>, error string"


def tables_of(*places: str) -> list[str]:
    return [name for place in places for name, _ in SUBTYPES[place].values()]


def _shred(body: str, automaton: TreeAutomaton) -> list[tuple]:
    """Rows (table, item, place in the array, state, cells, error) of one body."""
    try:
        root = json.loads(body, object_pairs_hook=_lower_keys)
    except (ValueError, RecursionError) as e:
        return [("rejected", None, None, "text", None, f"{type(e).__name__}: {e}"[:200])]
    if not isinstance(root, dict):
        return [("rejected", None, None, automaton.state(root), None, "the body is not an object")]
    of: dict[int, str] = {}
    automaton.states(root, of)
    out: list[tuple] = []

    def route(place: str, item: int | None, at: int | None, node: Any) -> None:
        state = of[id(node)] if isinstance(node, (dict, list)) else automaton.of_leaf(node)
        variants = SUBTYPES[place]
        name, own = variants.get(state) or variants[None]
        out.append((name, item, at, state, [read(node) for _, _, read in SUPERTYPES[place]] + [read(node) for _, _, read in own], None))

    for v in _values(root, "profile"):
        if v is not None:
            route("profile", None, None, v)
    for i, v in (x for v in _values(root, "folders") for x in enumerate(_as_array(v))):
        if v is not None:
            route("folders", None, i, v)
    for i, item in (x for v in _values(root, "ciphers") for x in enumerate(_as_array(v))):
        if item is None:
            continue
        if not isinstance(item, dict):
            out.append(("rejected", i, None, automaton.state(item), None, "the item is not an object"))
            continue
        route("ciphers", i, i, item)
        for place, (block, key) in CHILDREN.items():
            for holder in _values(item, block) if block else (item,):
                if isinstance(holder, dict):
                    for j, e in (x for v in _values(holder, key) for x in enumerate(_as_array(v))):
                        if e is not None:
                            route(place, i, j, e)
    return out


def shred(bodies: DataFrame, key: str = "body_id", body: str = "body", rows_at_once: int = 20_000) -> DataFrame:
    """All nodes of all bodies that have a table, as one long table; see tables().

    One narrow pass without a shuffle: a body is parsed once, where it is read, and rows leave in
    batches of rows_at_once, so a very long body needs memory for itself only. Null bodies give no
    rows; bodies that are no JSON object, or nested deeper than the JSON parser goes, give one row with
    record "rejected" and the reason. Null array elements give no row but keep their index. Repeated
    bodies give repeated rows. If an object holds ciphers or a kind of child under several spellings, all
    arrays count, each with its own index. Values nested in a cell are JSON text, whatever their depth.
    """
    key_type = bodies.schema[key].dataType
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TreeAutomaton()
        for batch in batches:
            places: list[int] = []
            held: list[tuple] = []

            def flush() -> pa.RecordBatch:
                arrays = [batch.column(0).take(pa.array(places, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True))]
                return pa.RecordBatch.from_arrays(arrays, names=[key, "record", "item_idx", "child_idx", "variant", "cells", "error"])

            for at, text in enumerate(batch.column(1)):
                text = text.as_py()
                if text is None:
                    continue
                for row in _shred(text, automaton):
                    places.append(at)
                    held.append(row)
                    if len(held) >= rows_at_once:
                        yield flush()
                        places, held = [], []
            if held:
                yield flush()

    return bodies.select(F.col(key), F.col(body)).mapInArrow(run, f"{key} {key_type.simpleString()}, {_DDL}")


def _typed(columns: list[tuple[str, str, Any]]) -> list[Column]:
    return [(F.col("cells")[i] if t == "string" else F.expr(f"try_cast(cells[{i}] as {t})")).alias(c) for i, (c, t, _) in enumerate(columns)]


def _links(place: str) -> list[Column]:
    """Parent and place: items and folders stand in their body, children in their item."""
    if place == "profile":
        return []
    if place in ("ciphers", "folders"):
        return [F.col("child_idx").alias("cipher_idx" if place == "ciphers" else "folder_idx")]
    return [F.col("item_idx").alias("cipher_idx"), F.col("child_idx")]


def tables(shredded: DataFrame, key: str = "body_id") -> dict[str, DataFrame]:
    """The typed table of each variant, and "rejected" (write shredded once, partitioned by record, to
    parse once)."""
    out = {name: shredded.where(F.col("record") == name).select(key, *_links(place), *_typed(columns)) for name, (place, columns) in COLUMNS_OF.items()}
    return out | {"rejected": shredded.where("record = 'rejected'").select(key, F.col("item_idx").alias("cipher_idx"), "variant", "error")}


def supertype(shredded: DataFrame, place: str, key: str = "body_id") -> DataFrame:
    """All variants of a place with the keys they share, their table as variant."""
    return shredded.where(F.col("record").isin(tables_of(place))).select(key, *_links(place), F.col("record").alias("variant"), *_typed(SUPERTYPES[place]))


def child_places(shredded: DataFrame, key: str = "body_id", places: tuple[str, ...] = ("fields", "password_history", "collection_ids")) -> DataFrame:
    """(key, cipher_idx, child, child_idx): the union of the variant tables of these places, by the place
    that a table belongs to."""
    of_table = F.create_map(*[F.lit(x) for p in places for name in tables_of(p) for x in (name, p)])
    return shredded.where(F.col("record").isin(tables_of(*places))).select(key, F.col("item_idx").alias("cipher_idx"), of_table[F.col("record")].alias("child"), "child_idx")


def typed_children(ciphers: DataFrame, key: str, column: str, *fields: str) -> DataFrame:
    """The child table of a nested column that already has a type: (key, child_idx, fields...).
    Null elements are left out and keep their index; null and empty arrays give no rows."""
    out = ciphers.select(F.col(key), F.posexplode(column).alias("child_idx", "e")).where("e is not null")
    values: list[Column] = [F.col(f"e.{f}").alias(f) for f in fields] or [F.col("e").alias("element")]
    return out.select(key, F.col("child_idx").cast("bigint").alias("child_idx"), *values)
