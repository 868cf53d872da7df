"""Queries of the general data repair operators (problems 2, 3, 4, 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..operators import intervals, nested, orphans, records
from ..session import table

_WS = "||".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return nested.shred(table(spark, d, "sync_bodies"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.child_places(_bodies(spark, d))


def p2_items(spark: SparkSession, d: str) -> DataFrame:
    return nested.supertype(_bodies(spark, d), "ciphers").select("body_id", "cipher_idx", "variant", "item_id", "item_type", "item_name", "folder_id")


def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each variant table."""
    return _bodies(spark, d).groupBy("record").agg(F.count("*").alias("n_rows"))


def _variant(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return nested.tables(_bodies(spark, d))[name]

    query.__name__ = f"p2_{name}"
    query.__doc__ = f"The typed table of the variant {name}."
    return query


_VARIANTS = [_variant(n) for n in ("item_login", "item_note", "field_flag", "field_number", "field_linked", "field_structured", "history_dated", "history_undated", "uri_plain", "credentials", "folders", "profiles")]


def p2_cipher_fields(spark: SparkSession, d: str) -> DataFrame:
    return nested.typed_children(table(spark, d, "ciphers"), "pos", "custom_fields", "name", "field_value", "field_type", "linked_id")


def p2_cipher_history(spark: SparkSession, d: str) -> DataFrame:
    return nested.typed_children(table(spark, d, "ciphers"), "pos", "password_history", "password", "last_used_date")


def p2_cipher_collections(spark: SparkSession, d: str) -> DataFrame:
    return nested.typed_children(table(spark, d, "ciphers"), "pos", "collection_ids").withColumnRenamed("element", "collection_id")


def _apple(spark: SparkSession, d: str) -> DataFrame:
    return records.parse_records(table(spark, d, "apple_raw").where("line_no is null or line_no <> 1"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected_rows(_apple(spark, d)).select("raw_id", "reason")


def p3_valid_rows(spark: SparkSession, d: str) -> DataFrame:
    return records.valid_rows(_apple(spark, d))


def p3_rejected(spark: SparkSession, d: str) -> DataFrame:
    return records.rejected_rows(_apple(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(table(spark, d, "ciphers"), "pos", "loaded_at", {"folder_id": table(spark, d, "folders"), "organization_id": table(spark, d, "organizations")})


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.speaking_spans(table(spark, d, "speaker_segments"))


def p7_totals(spark: SparkSession, d: str) -> DataFrame:
    spans = p7_found(spark, d)
    return spans.groupBy("recording_id", "speaker", "span_kind").agg(F.count("*").alias("n_spans"), F.sum(F.col("end_cs") - F.col("start_cs")).alias("total_cs"))


QUERIES = {f.__name__: f for f in (p2_found, p2_items, p2_variants, *_VARIANTS, p2_cipher_fields, p2_cipher_history, p2_cipher_collections, p3_found, p3_valid_rows, p3_rejected, p4_found, p4_report, p7_found, p7_totals)}

_ITEMS = """top as (select body_id, value v from sync_bodies, json_each(body) where lower(key) = 'ciphers'),
arr as (select body_id, case when json_type(v) = 'ARRAY' then v when json_type(v) in ('OBJECT', 'VARCHAR') then json_array(v) end v from top),
items as (select body_id, cast(rowid_ as bigint) cipher_idx, e from (select body_id, unnest(cast(v as json[])) e, generate_subscripts(cast(v as json[]), 1) - 1 rowid_ from arr where v is not null) where json_type(e) = 'OBJECT')"""
# Objects as maps of their lower-cased keys, with their variant.
_NUM = "('UBIGINT', 'BIGINT', 'DOUBLE')"
_NESTED = f"""{_ITEMS},
other as (select body_id from (select body_id, unnest(cast(v as json[])) e from arr where v is not null) where json_type(e) not in ('OBJECT', 'NULL')),
item as (select *, case when json_type(o['type']) not in {_NUM} then 'item_other' when coalesce(json_type(o['login']), 'NULL') <> 'NULL' then 'item_login' when coalesce(json_type(o['securenote']), 'NULL') <> 'NULL' then 'item_note' when coalesce(json_type(o['card']), 'NULL') <> 'NULL' then 'item_card'
 when coalesce(json_type(o['identity']), 'NULL') <> 'NULL' then 'item_identity' when coalesce(json_type(o['sshkey']), 'NULL') <> 'NULL' then 'item_ssh_key' when o['revisiondate'] is not null then 'item_bare' else 'item_other' end variant
 from (select body_id, cipher_idx, map_from_entries(list((lower(k.key), k.value))) o from items, json_each(e) k group by all)),
kid as (select body_id, cipher_idx, unnest([('fields', o['fields']), ('password_history', o['passwordhistory']), ('collection_ids', o['collectionids'])]) p from item),
kids as (select body_id, cipher_idx, p[1] place, case json_type(p[2]) when 'ARRAY' then p[2] when 'OBJECT' then json_array(p[2]) when 'VARCHAR' then json_array(p[2]) end v from kid),
elements as (select body_id, cipher_idx, place, unnest(cast(v as json[])) e, generate_subscripts(cast(v as json[]), 1) - 1 i from kids where v is not null),
child as (select body_id, cipher_idx, child_idx, place, e, o, case when place = 'collection_ids' then case json_type(e) when 'VARCHAR' then 'collection_id' else 'collection_other' end
 when place = 'fields' then case when json_type(o['type']) not in {_NUM} or o['value'] is null then 'field_other' when json_type(o['linkedid']) in {_NUM} then 'field_linked' when json_type(o['value']) = 'OBJECT' then 'field_structured' when json_type(o['value']) = 'BOOLEAN' then 'field_flag'
  when json_type(o['value']) in {_NUM} then 'field_number' when json_type(o['value']) = 'VARCHAR' then 'field_text' when json_type(o['value']) = 'NULL' then 'field_empty' else 'field_other' end
 when json_type(o['password']) = 'VARCHAR' and json_type(o['lastuseddate']) = 'VARCHAR' then 'history_dated' when json_type(o['password']) = 'VARCHAR' then 'history_undated' else 'history_other' end variant
 from (select body_id, cipher_idx, place, cast(i as bigint) child_idx, e, case when json_type(e) = 'OBJECT' then (select map_from_entries(list((lower(k.key), k.value))) from json_each(case when json_type(e) = 'OBJECT' then e else '{{}}' end) k) end o from elements where e is not null and json_type(e) <> 'NULL')),
block as (select body_id, cipher_idx, (select map_from_entries(list((lower(k.key), k.value))) from json_each(case when json_type(o['login']) = 'OBJECT' then o['login'] else '{{}}' end) k) b from item where json_type(o['login']) = 'OBJECT'),
bits as (select body_id, cipher_idx, unnest([('uris', b['uris']), ('fido2_credentials', b['fido2credentials'])]) p from block),
pieces as (select body_id, cipher_idx, p[1] place, unnest(cast(p[2] as json[])) e, generate_subscripts(cast(p[2] as json[]), 1) - 1 i from bits where json_type(p[2]) = 'ARRAY'),
part as (select *, case when place = 'uris' then case when json_type(o['uri']) <> 'VARCHAR' then 'uri_other' when json_type(o['match']) in {_NUM} then 'uri_matched' else 'uri_plain' end else case when o['credentialid'] is null then 'credential_other' else 'credentials' end end variant
 from (select body_id, cipher_idx, place, cast(i as bigint) child_idx, (select map_from_entries(list((lower(k.key), k.value))) from json_each(case when json_type(e) = 'OBJECT' then e else '{{}}' end) k) o from pieces where json_type(e) = 'OBJECT')),
tops as (select body_id, value v from sync_bodies, json_each(body) where lower(key) = 'folders' and json_type(value) = 'ARRAY'),
folder as (select body_id, cast(i as bigint) folder_idx, (select map_from_entries(list((lower(k.key), k.value))) from json_each(case when json_type(e) = 'OBJECT' then e else '{{}}' end) k) o from (select body_id, unnest(cast(v as json[])) e, generate_subscripts(cast(v as json[]), 1) - 1 i from tops) where json_type(e) = 'OBJECT')"""
_SHARED = {
    "item": "cipher_idx, {s}'id'{e} item_id, cast(o['type'] as bigint) item_type, {s}'organizationid'{e} organization_id, {s}'folderid'{e} folder_id, {s}'name'{e} item_name, {s}'revisiondate'{e} revision_date, {s}'notes'{e} notes",
    "field": "cipher_idx, child_idx, {s}'name'{e} \"name\", cast(o['type'] as bigint) field_type",
    "history": "cipher_idx, child_idx, {s}'password'{e} \"password\"",
    "uri": "cipher_idx, child_idx, {s}'uri'{e} uri",
    "credential": "cipher_idx, child_idx, {s}'credentialid'{e} credential_id",
}


def _variant_sql(source: str, variant: str, shared: str, own: tuple[str, ...], block: str | None = None) -> str:
    """SELECT of one variant table: own columns are given as "key [column [type]]", read from the block if there is one."""
    cols = []
    for spec in own:
        key, name, kind = (*spec.split(), *([None, None][: 3 - len(spec.split())]))[:3]
        get = f"(select json_extract_string(max(k.value), '$') from json_each(o['{block}']) k where lower(k.key) = '{key}')" if block else f"json_extract_string(o['{key}'], '$')"
        if key == "value" and not kind:  # keys of nested objects are lower-cased
            get = f"replace(replace({get}, '\"Text\":', '\"text\":'), '\"Parts\":', '\"parts\":')"
        cols.append(f'cast({get} as {kind or "varchar"}) "{name or key}"')
    return f"with {_NESTED} select body_id, {_SHARED[shared].format(s='json_extract_string(o[', e='], chr(36))')}{''.join(', ' + c for c in cols)} from {source} where variant = '{variant}'"


_FIELD = '("(?:[^"]|"")*"|[^",]*)'
_BODY = "regexp_replace(coalesce(record, ''), '(\\r\\n|\\r|\\n)\\z', '')"
_P3 = f"""rec as (select raw_id, {_BODY} r from apple_raw where line_no is distinct from 1),
q as (select raw_id, r, regexp_full_match(r, '(?s){_FIELD}(,{_FIELD})*') well, regexp_full_match(r, '(?s){_FIELD}(,{_FIELD}){{5}}') six from rec),
x as (select *, {', '.join(f"regexp_extract(r, '(?s)^{','.join([_FIELD] * 6)}$', {i + 1}) f{i}" for i in range(6))} from q),
f as (select raw_id, well, six, {', '.join(f"case when f{i}[1] = '\"' then replace(f{i}[2:len(f{i}) - 1], '\"\"', '\"') else f{i} end {c}" for i, c in enumerate(records.COLUMNS))} from x),
o as (select *, trim(otpauth, {_WS}) otp from f),
judged as (select raw_id, {', '.join(records.COLUMNS)}, case when not well then 'quoting' when not six then 'columns'
 when regexp_matches(title, '[\\x{{FFFD}}\\x7f\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') then 'title' when regexp_matches(notes, '[\\x{{FFFD}}\\x7f\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]') then 'notes'
 when otp <> '' and not (regexp_full_match(otp, '(?s)otpauth://(totp|hotp)/[^?]+\\?[^=&]+=[^&]*(&[^=&]+=[^&]*)*') and regexp_matches(otp, '[?&]secret=[A-Za-z2-7]+=*(&|\\z)')
  and (not regexp_matches(otp, '[?&]digits=') or regexp_matches(otp, '[?&]digits=[678](&|\\z)'))) then 'otpauth' end reason from o)"""
_P7 = f"""s as (select recording_id, upper(trim(speaker, {_WS})) speaker, cast(round(seg_start * 100) as bigint) a, cast(round(seg_end * 100) as bigint) b from speaker_segments where trim(speaker, {_WS}) <> '' and seg_end > seg_start),
m as (select *, max(b) over (partition by recording_id, speaker order by a, b rows between unbounded preceding and 1 preceding) pm from s),
g as (select *, sum(case when pm is null or a > pm then 1 else 0 end) over (partition by recording_id, speaker order by a, b rows unbounded preceding) gid from m),
p as (select recording_id, speaker, gid, min(a) st, max(b) en from g group by all),
spans as (select recording_id, speaker, 'period' span_kind, st start_cs, en end_cs from p union all
 select recording_id, speaker, 'gap', en, nx from (select *, lead(st) over (partition by recording_id, speaker order by st) nx from p) where nx is not null)"""
_P4 = f"""refs as (select pos, loaded_at, 'folder_id' ref_field, lower(trim(folder_id, {_WS})) k from ciphers union all select pos, loaded_at, 'organization_id', lower(trim(organization_id, {_WS})) from ciphers),
parents as (select ref_field, k, min(loaded_at) first_loaded, min(deleted_at) first_deleted from (select 'folder_id' ref_field, lower(trim(id, {_WS})) k, loaded_at, deleted_at from folders union all select 'organization_id', lower(trim(id, {_WS})), loaded_at, deleted_at from organizations) where k <> '' group by all),
j as (select r.pos, r.ref_field, r.loaded_at, p.k is null missing, r.loaded_at < p.first_loaded late, p.first_deleted <= r.loaded_at deleted from refs r left join parents p on r.ref_field = p.ref_field and r.k = p.k where r.k <> ''),
broken as (select pos, ref_field, unnest(list_filter([case when missing then 'missing' end, case when late then 'late' end, case when deleted then 'deleted' end], lambda x: x is not null)) reason, strftime(loaded_at, '%Y-%m') period from j)"""

SQL = {
    "p2_found": f"""with {_ITEMS},
kids as (select body_id, cipher_idx, case lower(k.key) when 'fields' then 'fields' when 'passwordhistory' then 'password_history' else 'collection_ids' end child, k.value v from items, json_each(e) k where lower(k.key) in ('fields', 'passwordhistory', 'collectionids')),
ka as (select body_id, cipher_idx, child, case when json_type(v) = 'ARRAY' then v when json_type(v) in ('OBJECT', 'VARCHAR') then json_array(v) end v from kids)
select body_id, cipher_idx, child, cast(i as bigint) child_idx from (select body_id, cipher_idx, child, unnest(cast(v as json[])) e, generate_subscripts(cast(v as json[]), 1) - 1 i from ka where v is not null) where e is not null and json_type(e) <> 'NULL'""",
    "p2_items": f"""with {_NESTED} select body_id, cipher_idx, variant, json_extract_string(o['id'], '$') item_id, cast(o['type'] as bigint) item_type, json_extract_string(o['name'], '$') item_name, json_extract_string(o['folderid'], '$') folder_id from item""",
    "p2_variants": f"""with {_NESTED}, named as (select variant from item union all select variant from child union all select variant from part),
profiles as (select value v from sync_bodies, json_each(body) where lower(key) = 'profile' and json_type(value) <> 'NULL')
select variant record, count(*) n_rows from named group by all union all select 'folders', count(*) from folder having count(*) > 0 union all select 'profiles', count(*) from profiles having count(*) > 0
union all select 'rejected', count(*) from other having count(*) > 0""",
    "p2_item_login": _variant_sql("item", "item_login", "item", ("username", "password", "totp", "passwordrevisiondate password_revision_date"), block="login"),
    "p2_item_note": _variant_sql("item", "item_note", "item", ("type note_type bigint",), block="securenote"),
    "p2_field_flag": _variant_sql("child", "field_flag", "field", ("value field_value boolean",)),
    "p2_field_number": _variant_sql("child", "field_number", "field", ("value field_value double",)),
    "p2_field_linked": _variant_sql("child", "field_linked", "field", ("linkedid linked_id bigint", "value field_value")),
    "p2_field_structured": _variant_sql("child", "field_structured", "field", ("value field_value",)),
    "p2_history_dated": _variant_sql("child", "history_dated", "history", ("lastuseddate last_used_date",)),
    "p2_history_undated": _variant_sql("child", "history_undated", "history", ()),
    "p2_uri_plain": _variant_sql("part", "uri_plain", "uri", ()),
    "p2_credentials": _variant_sql("part", "credentials", "credential", ("rpid rp_id", "username user_name", "counter", "creationdate creation_date")),
    "p2_folders": f"with {_NESTED} select body_id, folder_idx, json_extract_string(o['id'], '$') folder_id, json_extract_string(o['name'], '$') \"name\" from folder",
    "p2_profiles": "with p as (select body_id, value v from sync_bodies, json_each(body) where lower(key) = 'profile'), o as (select body_id, map_from_entries(list((lower(k.key), k.value))) o from p, json_each(v) k group by all) select body_id, json_extract_string(o['email'], '$') email, json_extract_string(o['key'], '$') profile_key from o",
    "p2_cipher_fields": "select pos, cast(i - 1 as bigint) child_idx, e.name, e.field_value, e.field_type, e.linked_id from (select pos, unnest(custom_fields) e, generate_subscripts(custom_fields, 1) i from ciphers) where e is not null",
    "p2_cipher_history": "select pos, cast(i - 1 as bigint) child_idx, e.password, e.last_used_date from (select pos, unnest(password_history) e, generate_subscripts(password_history, 1) i from ciphers) where e is not null",
    "p2_cipher_collections": "select pos, cast(i - 1 as bigint) child_idx, e collection_id from (select pos, unnest(collection_ids) e, generate_subscripts(collection_ids, 1) i from ciphers) where e is not null",
    "p3_found": f"with {_P3} select raw_id, reason from judged where reason is not null",
    "p3_valid_rows": f"with {_P3} select raw_id, {', '.join(records.COLUMNS)} from judged where reason is null",
    "p4_found": f"with {_P4} select * from broken",
    "p4_report": f"with {_P4} select ref_field, period, reason, count(*) n_refs from broken group by all",
    "p7_found": f"with {_P7} select * from spans",
    "p7_totals": f"with {_P7} select recording_id, speaker, span_kind, count(*) n_spans, cast(sum(end_cs - start_cs) as bigint) total_cs from spans group by all",
}
