"""Queries of the training-data operators (problems 1, 5, 6, 8, 9, 10), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE
from ..session import table
from . import formatting, leakage, packing, personal, quality, survivors

_WS = "||".join(f"chr({ord(c)})" for c in WHITE_SPACE)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.found(table(spark, d, "ciphers"))


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "ciphers"))


def _notes(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str]]:
    return [(table(spark, d, "ciphers"), "pos", "ciphers"), (table(spark, d, "apple_rows"), "row_id", "apple_rows")]


#: The key of the surrogates in these queries: for tests only, a real run keeps its own.
TEST_SECRET = "test key of the queries"


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    a, b = (personal.kinds_found(personal.redact(t, key, "notes", TEST_SECRET), key, name) for t, key, name in _notes(spark, d))
    return a.unionByName(b)


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    a, b = (personal.redact(t, key, "notes", TEST_SECRET).select(F.lit(name).alias("src_table"), F.col(key).alias("row_key"), "n_mentions", "placeholders", "surrogates") for t, key, name in _notes(spark, d))
    return a.unionByName(b)


def p5_collisions(spark: SparkSession, d: str) -> DataFrame:
    a, b = (personal.mentions(t, key, "notes", TEST_SECRET) for t, key, _ in _notes(spark, d))
    return personal.collisions(a.unionByName(b))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return formatting.copies(formatting.encoded(table(spark, d, "ciphers"), table(spark, d, "apple_rows")))


def p6_sets(spark: SparkSession, d: str) -> DataFrame:
    return formatting.sets(formatting.encoded(table(spark, d, "ciphers"), table(spark, d, "apple_rows"))).select("src_table", "first_key", "n_copies")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_words")))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    s = quality.shares(quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_words")))
    return s.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in s.columns[2:]])


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    q = quality.text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))
    return q.groupBy("doc_class", "nearest_profile").agg(F.count("*").alias("n_docs"), F.sum("n_words").alias("n_words"), F.round(F.avg("divergence"), 4).alias("mean_divergence"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.assign(table(spark, d, "documents"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.assign(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(leakage.item_hits(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    hits = leakage.item_hits(table(spark, d, "documents"), table(spark, d, "eval_items"))
    leaked = (F.col("n_covered") > 0) & (F.col("n_covered") * 3 >= F.col("n_item_words"))
    return hits.groupBy("item_id").agg(F.count("*").alias("n_docs_touched"), F.count_if(leaked).alias("n_docs_leaked"), F.max("n_covered").alias("most_covered"), F.max("longest_run").alias("longest_run"))


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a third of an item in stretches of eight words with at most one error each."""
    hits = leakage.item_hits(table(spark, d, "documents"), table(spark, d, "eval_items"), errors=1)
    return leakage.leaked(hits)


QUERIES = {f.__name__: f for f in (p1_found, p1_survivors, p5_found, p5_redacted, p5_collisions, p6_found, p6_sets, p8_containers, p8_fill, p9_found, p9_items, p9_edited, p10_found, p10_stats, p10_classes)}

_P1 = f"""member as (select *, regexp_replace(lower(rtrim(regexp_replace(trim(coalesce(name, ''), {_WS}), '(?s)\\([^(]*@[^(]*\\)\\z', ''), {_WS})), 'x^', '') nm, trim(coalesce(login.username, ''), {_WS}) us, login.password pw, coalesce(organization_id, '') org,
 list_sort(list_distinct(list_transform(coalesce(login.fido2_credentials, []), lambda x: coalesce(x.credential_id, '')))) cred, greatest(coalesce(len(password_history), 0), 0) h, coalesce(revision_date, '') rev, coalesce(creation_date, '') cre
 from ciphers where cipher_type = 1 and deleted_date is null and archived_date is null and reprompt is distinct from 1 and not contains(coalesce(name, ''), '[duplicate]') and trim(coalesce(login.password, ''), {_WS}) <> ''),
ranked as (select *, row_number() over (partition by nm, us, pw, org, cred order by h desc, rev desc, cre desc, pos) r, count(*) over (partition by nm, us, pw, org, cred) n, dense_rank() over (order by nm, us, pw, org, cred) g from member),
best as (select g, any_value(n) n, min_by(pos, r) kept_pos, min_by(pos, [-coalesce(length(name), 0), r]) name_pos, coalesce(min_by(pos, r) filter (trim(coalesce(notes, ''), {_WS}) <> ''), -1) notes_pos from ranked where n > 1 group by g)"""
_W = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_P6 = f"""c as (select 'ciphers' src_table, pos as key, [{_W('name')}, coalesce(login.username, ''), login.password, coalesce(notes, ''), coalesce(organization_id, '')] || list_sort(list_transform(coalesce(custom_fields, []), lambda x: cast(x as varchar))) t
 from ciphers where cipher_type = 1 and trim(coalesce(login.password, ''), {_WS}) <> ''),
u as (select *, string_split(coalesce(url, ''), '?') parts from apple_rows),
a as (select 'apple_rows' src_table, row_id as key, [{_W('title')}, {_W('username')}, {_W("parts[1]")}, coalesce(password, ''), coalesce(notes, ''), coalesce(otpauth, '')]
 || list_sort(list_filter(list_transform(string_split(array_to_string(parts[2:], '?'), '&'), lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x <> '')) t from u where {_W('title')} || {_W('url')} || {_W('username')} <> ''),
s as (select src_table, key, min(key) over (partition by src_table, t) first_key, count(*) over (partition by src_table, t) n_copies from (select * from c union all select * from a))"""

_P10 = f"""t as (select doc_id, coalesce(text, '') x, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+') w, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: rtrim(l, {_WS}||chr(28)||chr(29)||chr(30)||chr(31))), lambda l: l <> '') lines from documents),
c as (select doc_id, count(*) n_common from (select doc_id, lower(unnest(w)) v from t) where v in (select lower(word) from common_words) group by doc_id),
s as (select doc_id, len(w) n_words, coalesce(length(array_to_string(w, '')), 0) wc, length(x) n, length(regexp_replace(x, '[\\p{{L}}\\p{{N}}' || {_WS} || ']', '', 'g')) sym, len(lines) nl, len(list_filter(lines, lambda l: right(l, 1) in ('.', '!', '?', '…', ':', ';', '"', '''', '”', '»', ')'))) ne, coalesce(n_common, 0) nc from t left join c using (doc_id))"""

_WORDS = lambda c: f"regexp_extract_all(lower(regexp_replace(regexp_replace(replace(replace(replace({c}, '\\r', ' '), '\\n', ' '), '\\t', ' '), '<[/!?A-Za-z][^<>]*>', ' ', 'g'), '[\\x{{00ad}}\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{2060}}\\x{{feff}}]', '', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_P9 = f"""i0 as (select item_id, {_WORDS('text')} w, coalesce(len({_WORDS("regexp_extract(text, '^[^.!?]*[.!?]')")}), 0) n, array_to_string({_WORDS("regexp_extract(text, '^[^.!?]*[.!?]')")}, ' ') o from eval_items where text is not null),
i1 as (select item_id, case when n > 0 and count(*) over (partition by o) >= {leakage.SHARED_BY} then w[n + 1:] else w end w from i0),
ig as (select item_id, len(w) n_words, unnest(generate_series(1, len(w) - 7)) k, w from i1 where len(w) >= 8),
is_ as (select item_id, n_words, k, array_to_string(w[k:k + 7], ' ') g from ig),
dw as (select doc_id, {_WORDS('text')} w from documents where text is not null),
dg as (select distinct doc_id, array_to_string(w[k:k + 7], ' ') g from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) k from dw where len(w) >= 8)),
met as (select doc_id, item_id, n_words, k from dg join is_ using (g)),
hit as (select distinct doc_id, item_id, n_words, unnest(generate_series(k, k + 7)) wk from met),
runs as (select doc_id, item_id, n_words, count(*) n from (select *, wk - row_number() over (partition by doc_id, item_id order by wk) r from hit) group by doc_id, item_id, n_words, r),
pair as (select doc_id, item_id, n_words, sum(n) n_covered, max(n) longest from runs group by all)"""

SQL = {
    "p10_stats": f"with {_P10} select doc_id, cast(n_words as bigint) n_words, " + ", ".join(f"round(case when {b} > 0 then {a} / {b} else 0 end, 6) {name}" for name, a, b in (("mean_word_len", "wc", "n_words"), ("symbol_share", "sym", "n"), ("ended_line_share", "ne", "nl"), ("common_word_share", "nc", "n_words"))) + " from s",
    "p9_found": f"with {_P9} select doc_id, item_id from pair where n_covered * 3 >= n_words",
    "p9_items": f"with {_P9} select item_id, count(*) n_docs_touched, count_if(n_covered * 3 >= n_words) n_docs_leaked, cast(max(n_covered) as bigint) most_covered, max(longest) longest_run from pair group by all",
    "p1_found": f"with {_P1} select ranked.pos member_pos, kept_pos, name_pos, notes_pos from ranked join best using (g)",
    "p6_found": f"with {_P6} select src_table, first_key, key copy_key from s where key <> first_key",
    "p6_sets": f"with {_P6} select src_table, first_key, n_copies from s where key = first_key",
}
