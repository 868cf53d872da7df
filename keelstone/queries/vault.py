"""Queries of the deduplication engine over the item tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import INVISIBLE, ODD_SPACES, WHITE_SPACE, is_blank, text_or_empty
from ..functions.urls import host_of, host_set
from ..operators import dedup, folders, redact
from ..operators.passes import with_groups
from ..session import table
from ..sources import passwords_csv, vault

NOW = "2026-01-01T00:00:00Z"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ciphers")


def _done(spark: SparkSession, d: str) -> dedup.Deduplicated:
    return dedup.deduplicate(_items(spark, d), NOW, table(spark, d, "folders"))


def item_passes(spark: SparkSession, d: str) -> DataFrame:
    return with_groups(_items(spark, d)).select("pos", F.coalesce("kind", F.lit("none")).alias("kind"))


def item_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.groups(with_groups(_items(spark, d))).select("kind", "kept_pos", "first_pos", "n_members")


def item_patches(spark: SparkSession, d: str) -> DataFrame:
    p = dedup.groups(with_groups(_items(spark, d)))
    return p.select("kept_pos", "longest_name", "any_favorite", "newest_totp", F.when(F.col("kind").isin("login", "empty_password"), F.col("totp_from_id")).alias("totp_from_id"), "totp_conflict")


def item_unions(spark: SparkSession, d: str) -> DataFrame:
    p = _done(spark, d).patches
    return p.select("kept_pos", *[F.size(f"add_{w}").cast("bigint").alias(f"n_{w}") for w in ("uri", "history", "field", "collection", "folder")])


def merged_notes(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merged_notes(with_groups(_items(spark, d)))


def folder_lines(spark: SparkSession, d: str) -> DataFrame:
    return _done(spark, d).patches.where("folder_line is not null").select("kept_pos", "folder_line")


def deduplicated_items(spark: SparkSession, d: str) -> DataFrame:
    r = _done(spark, d).items
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return r.select("pos", "kind", "kept_pos", "is_loser", "name", "favorite", "deleted_date", n("custom_fields").alias("n_fields"), n("login.uris").alias("n_uris"), n("password_history").alias("n_history"), n("collection_ids").alias("n_collections"))


def dedup_audit(spark: SparkSession, d: str) -> DataFrame:
    return _done(spark, d).audit.select("item_kind", "signal_kind", "removed_pos", "removed_id", "removed_name", "removed_revision_date", "removed_totp_present", "kept_pos", "kept_id", "kept_name", "totp_conflict")


def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    return _done(spark, d).stats


def living_items(spark: SparkSession, d: str) -> DataFrame:
    return dedup.living(_done(spark, d).items).select("pos")


def trashed_items(spark: SparkSession, d: str) -> DataFrame:
    return dedup.trashed(_done(spark, d).items).select("pos", "deleted_date")


def export_filter(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exportable(_items(spark, d)).select("pos", "id")


def export_stats(spark: SparkSession, d: str) -> DataFrame:
    return dedup.export_stats(_items(spark, d))


def folder_remap(spark: SparkSession, d: str) -> DataFrame:
    return folders.folder_remap(table(spark, d, "folders"))


def remapped_items(spark: SparkSession, d: str) -> DataFrame:
    return folders.remap_folders(_items(spark, d), folders.folder_remap(table(spark, d, "folders"))).select("pos", "folder_id")


def moved_items(spark: SparkSession, d: str) -> DataFrame:
    return folders.move_all(_items(spark, d), "main").groupBy("folder_id").agg(F.count("*").alias("n_items"))


def redacted_items(spark: SparkSession, d: str) -> DataFrame:
    r = redact.redacted(_items(spark, d), table(spark, d, "folders"))
    return r.select("pos", "id", "name", "revision_date", "creation_date", "deleted_date", F.col("login.password").alias("password"), F.coalesce(F.size("custom_fields"), F.lit(0)).alias("n_fields"))


def uri_hosts(spark: SparkSession, d: str) -> DataFrame:
    h = _items(spark, d).select("pos", F.posexplode("login.uris").alias("uri_no", "u")).select("pos", "uri_no", host_of(F.col("u.uri")).alias("h"))
    return h.select("pos", "uri_no", F.col("h.kind").alias("host_kind"), F.col("h.token").alias("host"))


def host_sets(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).where(F.size("login.uris") > 0).select("pos", F.array_join(F.transform(host_set(F.col("login.uris")), lambda h: F.concat(h["kind"], F.lit(":"), h["token"])), " ").alias("hosts"))


def csv_items(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "apple_rows")
    empty = rows.select("row_id", *[text_or_empty(F.col(c)).alias(c) for c in passwords_csv.REQUIRED])
    i = passwords_csv.to_items(empty, "row_id", 1_700_000_000, NOW)
    return i.select("pos", "id", "cipher_type", "name", "notes", F.col("login.username").alias("username"), F.col("login.totp").alias("totp"), F.coalesce(F.size("login.uris"), F.lit(0)).alias("n_uris"))


def csv_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return passwords_csv.row_counts(table(spark, d, "apple_rows"))


def merged_sources(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "apple_rows")
    items = _items(spark, d)
    more = passwords_csv.to_items(rows.select("row_id", *[text_or_empty(F.col(c)).alias(c) for c in passwords_csv.REQUIRED]), "row_id", 1_700_000_000, NOW, offset=1 << 40)
    both = passwords_csv.appended(items, more)
    return dedup.groups(with_groups(both)).groupBy("kind").agg(F.count("*").alias("n_groups"), F.sum(F.col("n_members") - 1).alias("n_losers"))


def snapshot_counts(spark: SparkSession, d: str) -> DataFrame:
    return vault.snapshot_counts(table(spark, d, "sync_bodies"))


def blank_names(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d).agg(F.count_if(is_blank(F.col("name"))).alias("n_blank_names"), F.count_if(is_blank(F.col("notes"))).alias("n_blank_notes"))


QUERIES = {f.__name__: f for f in (item_passes, item_groups, item_patches, item_unions, merged_notes, folder_lines, deduplicated_items, dedup_audit, dedup_stats, living_items, trashed_items, export_filter, export_stats, folder_remap, remapped_items, moved_items, redacted_items, uri_hosts, host_sets, csv_items, csv_row_counts, merged_sources, snapshot_counts, blank_names)}


def _chars(s: str) -> str:
    return "||".join(f"chr({ord(c)})" for c in s)


_WS, _ODD, _INV = _chars(WHITE_SPACE), _chars(ODD_SPACES), _chars(INVISIBLE)
_trim = lambda c: f"trim(coalesce({c}, ''), {_WS})"
_scrub = lambda c: f"trim(translate(coalesce({c}, ''), {_ODD}||{_INV}, '{' ' * len(ODD_SPACES)}'), {_WS})"
_norm = f"lower(rtrim(regexp_replace({_trim('name')}, '(?s)\\([^(]*@[^(]*\\)\\z', ''), {_WS}))"


def _host(u: str) -> str:
    """{kind, token} of a URI in SQL."""
    t = f"trim({u}, {_WS})"
    scheme, authority = f"lower(regexp_extract({t}, '(?is)^(https?|wss?):[/\\\\]*([^/\\\\?#]*)', 1))", f"regexp_extract({t}, '(?is)^(https?|wss?):[/\\\\]*([^/\\\\?#]*)', 2)"
    where = f"regexp_replace({authority}, '(?s)^.*@', '')"
    host, port = f"lower(regexp_replace({where}, ':\\d*$', ''))", f"ltrim(regexp_extract({where}, ':(\\d*)$', 1), '0')"
    default = f"case when {scheme} in ('http', 'ws') then '80' else '443' end"
    token = f"case when {port} = '' or {port} = {default} then {host} else {host} || ':' || {port} end"
    package = f"regexp_extract(substr({t}, 14), '(?s)^([^/?#]*)', 1)"
    android = f"starts_with({t}, 'androidapp://')"
    return f"""case when {u} is null or {t} = '' or ({android} and {package} = '') then null when {android} then {{kind: 'android', token: {package}}}
 when {scheme} <> '' and regexp_full_match({host}, '\\d{{1,3}}(\\.\\d{{1,3}}){{3}}|\\[[0-9a-f:.]+\\]') then {{kind: 'ip', token: {token}}}
 when {scheme} <> '' and {host} <> '' and not regexp_matches({host}, '[\\s<>^|%:\\\\\\[\\]]') then {{kind: 'dns', token: {token}}} else {{kind: 'opaque', token: {t}}} end"""


_HOSTS = f"list_sort(list_distinct(list_filter(list_transform(coalesce(login.uris, []), lambda x: {_host('x.uri')}), lambda h: h is not null)))"
_K = f"""b as (select *, deleted_date is null and archived_date is null and reprompt is distinct from 1 and not contains(coalesce(name, ''), '[duplicate]') ok, {_trim('login.username')} us, {_trim('login.password')} bpw, {_HOSTS} hosts, coalesce(len(login.fido2_credentials), 0) nf from ciphers),
k as (select *, case when not ok then null when cipher_type = 1 and bpw <> '' then 'login' when cipher_type = 1 and (us <> '' or len(hosts) > 0 or nf > 0) then 'empty_password' when cipher_type = 2 and {_trim('name')} <> '' then 'secure_note'
 when cipher_type = 5 and {_trim('ssh_key.public_key')} <> '' then 'ssh_key' when cipher_type = 3 and card is not null then 'card' when cipher_type = 4 and ident is not null then 'identity' end kind from b),
g as (select *, case kind when 'login' then [{_norm}, us, login.password, coalesce(login.fido2_credentials::varchar, '[]')] when 'empty_password' then [{_norm}, us, hosts::varchar, coalesce(login.fido2_credentials::varchar, '[]')] when 'secure_note' then [lower({_scrub('name')}), {_scrub('notes')}]
 when 'ssh_key' then [ssh_key::json::varchar] when 'card' then [{_norm}, card::json::varchar] when 'identity' then [{_norm}, ident::json::varchar] end || [coalesce(organization_id, '')] key,
 case kind when 'secure_note' then (case when starts_with(coalesce(id, ''), 'apple-csv-') then 0 else 1 end) when 'login' then coalesce(len(password_history), 0) when 'empty_password' then coalesce(len(password_history), 0) else 0 end pref from k),
r as (select *, row_number() over w rk, count(*) over (partition by kind, key) n, first_value(pos) over w kept_pos, min(pos) over (partition by kind, key) first_pos from g where kind is not null
 window w as (partition by kind, key order by pref desc, coalesce(revision_date, '') desc, coalesce(creation_date, '') desc, pos)),
d as (select * from r where n > 1)"""
_T = "coalesce(login.totp, '') <> ''"
_UNION = """ent as (select kept_pos, rk, 'uri' what, u.uri || chr(0) || coalesce(cast(u.uri_match as varchar), 'none') k from (select kept_pos, rk, unnest(login.uris) u from d where kind in ('login', 'empty_password')) where u.uri is not null
 union all select kept_pos, rk, 'history', coalesce(h.last_used_date, '') || chr(0) || coalesce(h.password, '') from (select kept_pos, rk, unnest(password_history) h from d where kind in ('login', 'empty_password')) where h is not null
 union all select kept_pos, rk, 'field', coalesce(f.name, '') || chr(0) || coalesce(f.field_value, '') || chr(0) || coalesce(f.field_type, 0) || chr(0) || coalesce(f.linked_id, -1) from (select kept_pos, rk, unnest(custom_fields) f from d) where f is not null
 union all select kept_pos, rk, 'collection', c from (select kept_pos, rk, unnest(collection_ids) c from d) where c is not null
 union all select kept_pos, rk, 'folder', folder_id from d where folder_id is not null),
once as (select kept_pos, what, k, min(rk) rk from ent group by all)"""
_NOTES = f"""note as (select kept_pos, {_trim('notes')} k, min(rk) rk, min_by(notes, rk) raw from d where kind <> 'secure_note' and {_trim('notes')} <> '' group by all)"""
_FN = "fn as (select id, arg_max(name, loaded_at) fname from folders where id is not null group by id)"
_REMAP = f"""fk as (select id, min_by(lower({_scrub('name')}), loaded_at) key, min(loaded_at) seen from folders where coalesce(id, '') <> '' group by id),
rm as (select id folder_id, first_value(id) over (partition by key order by seen, id) survivor_id from fk)"""
_CSV = {c: f"trim(coalesce({c}, ''), {_WS})" for c in passwords_csv.REQUIRED}
_LOGINROW = " or ".join(f"{_CSV[c]} <> ''" for c in ("url", "username", "password", "otpauth"))
_SOMEROW = f"({_LOGINROW} or {_CSV['title']} <> '' or {_CSV['notes']} <> '')"

SQL = {
    "item_passes": f"with {_K} select pos, coalesce(kind, 'none') kind from k",
    "item_groups": f"with {_K} select kind, kept_pos, first_pos, n n_members from d where rk = 1",
    "item_patches": f"""with {_K}, t as (select kept_pos, count(distinct login.totp) filter ({_T}) nt from d group by 1),
nt as (select kept_pos, login.totp, id from d where {_T} and kind in ('login', 'empty_password') qualify row_number() over (partition by kept_pos order by coalesce(revision_date, '') desc, rk) = 1)
select kept_pos, longest_name, any_favorite, nt.totp newest_totp, nt.id totp_from_id, coalesce(t.nt > 1, false) totp_conflict from (select kept_pos, min_by(name, [-length(coalesce(name, '')), rk]) longest_name, bool_or(coalesce(favorite, false)) any_favorite from d group by 1) left join nt using (kept_pos) left join t using (kept_pos)""",
    "item_unions": f"with {_K}, {_UNION} select d.kept_pos, " + ", ".join(f"cast(count(o.k) filter (o.what = '{w}' and o.rk > 1) as bigint) n_{w}" for w in ("uri", "history", "field", "collection", "folder")) + " from d left join once o on o.kept_pos = d.kept_pos where d.rk = 1 group by d.kept_pos",
    "merged_notes": f"with {_K}, {_NOTES} select kept_pos, cast(count(*) as bigint) n_notes, string_agg(raw, chr(10) || '---' || chr(10) order by rk) merged_notes from note group by kept_pos",
    "folder_lines": f"with {_K}, {_UNION}, {_FN} select kept_pos, '[merged] originally also in folder' || case when count(*) > 1 then 's' else '' end || ': ' || string_agg(coalesce(fname, k), ', ' order by rk) folder_line from once left join fn on fn.id = k where what = 'folder' and rk > 1 group by kept_pos",
    "deduplicated_items": f"""with {_K}, {_UNION}, gain as (select kept_pos, """ + ", ".join(f"count(k) filter (what = '{w}' and rk > 1) {w}" for w in ("uri", "history", "field", "collection")) + f""" from once group by 1), s as (select kept_pos, min_by(coalesce(name, ''), [-length(coalesce(name, '')), rk]) ln, bool_or(coalesce(favorite, false)) fav from d group by 1)
select k.pos, k.kind, d.kept_pos, coalesce(d.rk > 1, false) is_loser, case when d.rk = 1 then s.ln else k.name end as name, case when d.rk = 1 then s.fav else k.favorite end favorite, case when d.rk > 1 then '{NOW}' else k.deleted_date end deleted_date,
""" + ", ".join(f"cast(coalesce(len(k.{c}), 0) + case when d.rk = 1 then coalesce(gain.{w}, 0) else 0 end as bigint) n_{n}" for c, w, n in (("custom_fields", "field", "fields"), ("login.uris", "uri", "uris"), ("password_history", "history", "history"), ("collection_ids", "collection", "collections"))) + " from k left join d on d.pos = k.pos left join s on s.kept_pos = k.pos left join gain on gain.kept_pos = k.pos",
    "merged_sources": "with both_ as (select * from ciphers union all by name select row_id + 1099511627776 pos, 'apple-csv-1700000000-' || lpad(cast(row_id as varchar), 6, '0') id, cast(case when " + _LOGINROW + " then 1 else 2 end as bigint) cipher_type, 0 reprompt, case when " + f"{_CSV['title']} <> '' then title when {_CSV['url']} <> '' then {_CSV['url']} when {_CSV['username']} <> '' then {_CSV['username']} else '(unnamed)' end as name, case when {_CSV['notes']} <> '' then notes end notes, '{NOW}' creation_date, '{NOW}' revision_date, case when {_LOGINROW}" + " then {'username': nullif(username, ''), 'password': nullif(password, ''), 'totp': nullif(otpauth, ''), 'password_revision_date': null::varchar, 'uris': case when " + f"{_CSV['url']} <> '' then [" + "{'uri': " + _CSV["url"] + ", 'uri_match': null::bigint}] else [] end, 'fido2_credentials': null} end login from apple_rows where " + _SOMEROW + "), " + _K.replace("from ciphers)", "from both_)", 1) + " select kind, count(*) n_groups, cast(sum(n - 1) as bigint) n_losers from d where rk = 1 group by kind",
    "dedup_audit": f"""with {_K} select d.kind item_kind, case when d.kind = 'empty_password' then (case when p.nf > 0 then 'fido2' when len(p.hosts) > 0 then 'host' else 'username_only' end) end signal_kind, d.pos removed_pos, d.id removed_id, d.name removed_name, d.revision_date removed_revision_date, coalesce(d.login.totp, '') <> '' removed_totp_present, d.kept_pos, p.id kept_id, l.ln kept_name, l.conflict totp_conflict
from d join d p on p.pos = d.kept_pos join (select kept_pos, min_by(name, [-length(coalesce(name, '')), rk]) ln, count(distinct login.totp) filter ({_T} and kind in ('login', 'empty_password')) > 1 conflict from d group by 1) l on l.kept_pos = d.kept_pos where d.rk > 1""",
    "dedup_stats": f"""with {_K}, {_UNION}, s as (select kept_pos, kind, n, case when nf > 0 then 'fido2' when len(hosts) > 0 then 'host' else 'username_only' end signal from d where rk = 1)
select (select count(*) from ciphers) total, (select count(*) from k where kind is distinct from 'login') skipped, count(*) groups, cast(coalesce(sum(n - 1), 0) as bigint) trashed, cast(coalesce(sum(n - 1) filter (kind = 'empty_password'), 0) as bigint) empty_password_trashed,
(select count(*) from once where what = 'uri' and rk > 1) merged_uris, (select count(*) from (select kept_pos from d where {_T} and kind in ('login', 'empty_password') group by kept_pos having count(distinct login.totp) > 1)) totp_conflict_groups,
""" + ", ".join(f"count(*) filter (kind = '{p}') {p}_groups" for p in ("login", "empty_password", "secure_note", "ssh_key", "card", "identity")) + ", " + ", ".join(f"count(*) filter (kind = 'empty_password' and signal = '{x}') empty_password_by_{x}" for x in ("username_only", "host", "fido2")) + ", cast((select count(*) from ciphers where deleted_date is null) - coalesce(sum(n - 1), 0) as bigint) living, (select count(*) from ciphers) output from s",
    "living_items": f"with {_K} select pos from ciphers where coalesce(deleted_date, '') = '' and pos not in (select pos from d where rk > 1)",
    "trashed_items": f"with {_K} select pos, case when pos in (select pos from d where rk > 1) then '{NOW}' else deleted_date end deleted_date from ciphers where coalesce(deleted_date, '') <> '' or pos in (select pos from d where rk > 1)",
    "export_filter": "select pos, id from ciphers where organization_id is null and deleted_date is null",
    "export_stats": "select count(*) n_items, count(*) filter (organization_id is not null) n_org_owned, count(*) filter (organization_id is null and deleted_date is not null) n_trashed, count(*) filter (organization_id is null and deleted_date is null and archived_date is not null) n_archived, count(*) filter (organization_id is null and deleted_date is null) n_kept from ciphers",
    "folder_remap": f"with {_REMAP} select folder_id, survivor_id from rm where folder_id <> survivor_id",
    "remapped_items": f"with {_REMAP} select pos, coalesce(survivor_id, c.folder_id) folder_id from ciphers c left join rm on rm.folder_id = c.folder_id",
    "moved_items": "select 'main' folder_id, count(*) n_items from ciphers",
    "redacted_items": f"""with {_K}, e as (select pos, case when kind is null then [cast(pos as varchar)] else key end key, coalesce(kind, 'own') kind, pref, coalesce(revision_date, '') rev, coalesce(creation_date, '') cre from g),
x as (select *, min(pos) over (partition by kind, key) fp, row_number() over (partition by kind, key order by pref desc, rev desc, cre desc, pos) - 1 rk from e), y as (select *, dense_rank() over (order by fp) - 1 gid, row_number() over (order by pos) - 1 idx, greatest(86399 - rk, 0) s from x),
z as (select *, case when gid < 10000 then lpad(cast(gid as varchar), 4, '0') else cast(gid as varchar) end gs, '-12-31T' || lpad(cast(s // 3600 as varchar), 2, '0') || ':' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || ':' || lpad(cast(s % 60 as varchar), 2, '0') || 'Z' dt from y)
select z.pos, '00000000-0000-0000-0000-' || lpad(lower(to_hex(idx)), 12, '0') id, 'Example Service ' || gs as name, '2026' || dt revision_date, '2025' || dt creation_date, case when c.deleted_date is not null then '2024' || dt end deleted_date, case when c.login.password is null then null when c.login.password = '' then '' else 'redacted-password-' || gs end as "password", cast(coalesce(len(c.custom_fields), 0) as integer) n_fields from z join ciphers c on c.pos = z.pos""",
    "uri_hosts": f"select pos, cast(i - 1 as integer) uri_no, h.kind host_kind, h.token host from (select pos, i, {_host('u.uri')} h from (select pos, unnest(login.uris) u, generate_subscripts(login.uris, 1) i from ciphers))",
    "host_sets": f"select pos, array_to_string(list_transform({_HOSTS}, lambda h: h.kind || ':' || h.token), ' ') hosts from ciphers where len(login.uris) > 0",
    "csv_items": f"""select row_id pos, 'apple-csv-1700000000-' || lpad(cast(row_id as varchar), 6, '0') id, cast(case when {_LOGINROW} then 1 else 2 end as bigint) cipher_type, case when {_CSV['title']} <> '' then title when {_CSV['url']} <> '' then {_CSV['url']} when {_CSV['username']} <> '' then {_CSV['username']} else '(unnamed)' end as name, case when {_CSV['notes']} <> '' then notes end notes,
case when {_LOGINROW} then nullif(username, '') end username, case when {_LOGINROW} then nullif(otpauth, '') end totp, cast(case when {_CSV['url']} <> '' then 1 else 0 end as integer) n_uris from apple_rows where {_SOMEROW}""",
    "csv_row_counts": f"select count(*) n_rows, count(*) filter (not {_SOMEROW}) n_skipped, count(*) filter ({_SOMEROW}) n_appended, count(*) filter ({_LOGINROW}) n_logins from apple_rows",
    "snapshot_counts": "select body_id, cast(coalesce(case when json_type(c) = 'ARRAY' then json_array_length(c) end, 0) as bigint) n_ciphers, cast(coalesce(case when json_type(f) = 'ARRAY' then json_array_length(f) end, 0) as bigint) n_folders, coalesce(p, '') <> '' has_key, strlen(body) n_bytes from (select *, coalesce(json_extract(body, '$.ciphers'), json_extract(body, '$.Ciphers')) c, coalesce(json_extract(body, '$.folders'), json_extract(body, '$.Folders')) f, coalesce(json_extract_string(body, '$.profile.key'), json_extract_string(body, '$.Profile.Key')) p from sync_bodies)",
    "blank_names": f"select count(*) filter ({_trim('name')} = '') n_blank_names, count(*) filter ({_trim('notes')} = '') n_blank_notes from ciphers",
}
