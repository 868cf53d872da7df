"""Lossless deduplication of items: survivors take over what the others hold, the others go to the
trash, and every move is on record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_or_empty, utrim
from ..functions.urls import host_set
from ..session import cut
from . import merge
from .folders import folder_names
from .passes import PASSES, Config, groups, has_fido2, with_groups

_FIELDS = "array<struct<name:string,field_value:string,field_type:bigint,linked_id:bigint>>"
_HISTORY = "array<struct<password:string,last_used_date:string>>"
_URIS = "array<struct<uri:string,uri_match:bigint>>"
_LOGIN_KINDS = [p.kind for p in PASSES if p.login]
_NOTE_KINDS = [p.kind for p in PASSES if p.notes]


@dataclass(frozen=True)
class Deduplicated:
    """items: all input rows, survivors patched, losers with deleted_date = now, and kind, kept_pos,
    is_loser. patches: one row per group. audit: one row per loser. stats: one row."""

    items: DataFrame
    patches: DataFrame
    audit: DataFrame
    stats: DataFrame


def _entries(folders: DataFrame | None, only: str | None = None) -> Column:
    """What a member holds (only: of one kind), as one array of struct(what, key, value, idx); values are JSON."""

    def of(what: str, array: Column, key, value, when: Column) -> Column:
        rows = F.transform(array, lambda x, i: F.struct(F.lit(what).alias("what"), key(x).alias("key"), value(x).alias("value"), i.cast("bigint").alias("idx")))
        return F.when(when, F.filter(rows, lambda r: r.key.isNotNull()))

    kind = F.col("kind")
    login, all_kinds = kind.isin(*_LOGIN_KINDS), F.lit(True)
    one = lambda c: F.when(c.isNotNull(), F.array(c))
    text = lambda c: text_or_empty(c)
    note = F.when(text(utrim(F.col("notes"))) != "", F.col("notes"))
    display = F.coalesce(F.col("folder_name"), F.col("folder_id")) if folders is not None else F.col("folder_id")
    parts = {
        "uri": of("uri", F.col("login.uris"), lambda x: F.when(x.uri.isNotNull(), F.to_json(F.struct(x.uri.alias("u"), x.uri_match.alias("m")))), F.to_json, login),
        "history": of("history", F.col("password_history"), lambda x: F.when(x.isNotNull(), F.to_json(F.struct(text(x.last_used_date).alias("d"), text(x.password).alias("p")))), F.to_json, login),
        "field": of("field", F.col("custom_fields"), lambda x: F.when(x.isNotNull(), F.to_json(F.struct(text(x["name"]).alias("n"), text(x.field_value).alias("v"), F.coalesce(x.field_type, F.lit(0)).alias("t"), F.coalesce(x.linked_id, F.lit(-1)).alias("l")))), F.to_json, all_kinds),
        "collection": of("collection", F.col("collection_ids"), lambda x: x, lambda x: x, all_kinds),
        "note": of("note", one(note), lambda x: utrim(x), lambda x: x, kind.isin(*_NOTE_KINDS)),
        "folder": of("folder", one(F.struct(F.col("folder_id").alias("id"), display.alias("name"))), lambda x: x.id, lambda x: x["name"], all_kinds),
    }
    empty = F.expr("cast(array() as array<struct<what:string,key:string,value:string,idx:bigint>>)")
    return F.concat(*[F.coalesce(p, empty) for w, p in parts.items() if only in (None, w)])


def _distinct(grouped: DataFrame, found: DataFrame, folders: DataFrame | None = None, only: str | None = None) -> DataFrame:
    """One row per group and entry: whether the survivor has it, and its first place in rank order.
    Combined by (group, entry) before the shuffle."""
    members = grouped.where("kind is not null").join(found.select("grp", "kept_pos"), "grp")
    if folders is not None:
        members = members.join(folder_names(folders), "folder_id", "left")
    held = members.select("grp", "policy", (F.col("pos") == F.col("kept_pos")).alias("own"), F.inline(_entries(folders, only)))
    place = F.struct("policy", (-F.col("idx")).alias("neg_idx"))
    return held.groupBy("grp", "what", "key").agg(F.bool_or("own").alias("own"), F.max(place).alias("place"), F.max_by("value", place).alias("value"))


def merged_notes(grouped: DataFrame) -> DataFrame:
    """(kept_pos, n_notes, merged_notes) of every group with notes: all distinct notes in rank order,
    whatever their number and size. A group whose notes exceed what one value can hold (2 GiB) fails.
    """
    found = groups(grouped)
    notes = _distinct(grouped, found, only="note").groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("place", "value")), asc=False).alias("all"))
    return found.join(notes, "grp").select("kept_pos", F.size("all").cast("bigint").alias("n_notes"), F.array_join(F.transform("all", lambda x: x.value), merge.SEPARATOR).alias("merged_notes"))


def build_patches(grouped: DataFrame, folders: DataFrame | None = None, budget: int = merge.NOTES_BUDGET) -> DataFrame:
    """One row per group with what its survivor gains.

    Members meet their group first (unique rows, so a hot group is split by adaptive skew handling, and
    rows without a duplicate go no further), open into one long table of entries and are combined by (group, entry) before the shuffle: whether the
    survivor has the entry, and its first place in rank order. Only distinct additions are collected,
    of the notes as many as the budget can hold (add_note, for fitted_notes); n_notes and note_bytes,
    the size of all notes joined, are of all of them. For their whole text see merged_notes.
    """
    found = groups(grouped)
    distinct = _distinct(grouped, found, folders)
    # Each merged note takes a separator and at least one byte, so the first of a rank order hold all that fits the budget.
    fits = budget // (len(merge.SEPARATOR) + 1) + 1
    ranked = distinct.where("what = 'note'").withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(F.col("place").desc())))
    note = F.col("what") == "note"
    counted = distinct.where(note | ~F.col("own")).select("grp", "what", "own", "place", F.when(~note, F.col("value")).alias("value"), F.when(note, F.octet_length("value")).alias("bytes"))
    first = ranked.where(F.col("rank") <= fits).select("grp", F.lit("first").alias("what"), "own", "place", "value", F.lit(None).cast("int").alias("bytes"))
    inner = lambda w: F.when(F.col("what") == ("first" if w == "note" else w), F.struct("place", "value"))
    gains = counted.unionByName(first).groupBy("grp").agg(*[F.transform(F.sort_array(F.collect_list(inner(w)), asc=False), lambda x: x.value).alias(f"{w}_values") for w in ("uri", "history", "field", "collection", "note", "folder")], F.count_if(note & F.col("own")).alias("own_notes"), F.count_if(note).alias("all_notes"), F.sum("bytes").alias("bytes"))
    none = F.expr("cast(array() as array<string>)")
    out = found.join(gains, "grp", "left").select("*", F.coalesce("all_notes", F.lit(0)).alias("n_notes"), *[F.coalesce(f"{w}_values", none).alias(f"add_{w}") for w in ("uri", "history", "field", "collection", "note", "folder")])
    line = F.when(F.size("add_folder") > 0, F.concat(F.lit("[merged] originally also in folder"), F.when(F.size("add_folder") == 1, "").otherwise("s"), F.lit(": "), F.array_join("add_folder", ", ")))
    first_notes = F.when(F.size("add_note") > 0, F.array_join("add_note", merge.SEPARATOR))
    out = out.withColumn("folder_line", line).withColumn("first_notes", first_notes).withColumn("note_bytes", F.col("bytes") + len(merge.SEPARATOR) * (F.col("n_notes") - 1))
    overhead = F.coalesce(F.octet_length("folder_line") + 1, F.lit(0))
    many = F.col("n_notes") > F.col("own_notes")
    return out.withColumn("notes_merged", F.coalesce(many, F.lit(False))).withColumn("notes_truncated", F.coalesce(many & (F.col("note_bytes") + overhead > budget), F.lit(False))).withColumn("fitted_notes", F.when(many, merge.fit_notes(F.col("first_notes"), budget, overhead)).otherwise(F.col("first_notes"))).drop("first_notes", "all_notes", "bytes", *[f"{w}_values" for w in ("uri", "history", "field", "collection", "note", "folder")])


def apply_patches(items: DataFrame, patches: DataFrame) -> DataFrame:
    """Items with their survivors patched; a patch meets its survivor by position. Lists only change
    where something is added; TOTP, name and favorite as the group decided."""
    p = patches.select(F.col("kept_pos").alias("pos"), F.col("kind").alias("p_kind"), "longest_name", "any_favorite", "newest_totp", "add_uri", "add_history", "add_field", "add_collection", "fitted_notes", "folder_line", F.lit(True).alias("patched"))
    j = items.join(p, "pos", "left")
    on = F.coalesce("patched", F.lit(False))
    login = F.coalesce(F.col("p_kind").isin(*_LOGIN_KINDS), F.lit(False))

    def plus(own: str, add: str, ddl: str) -> Column:
        added = F.from_json(F.concat(F.lit("["), F.array_join(add, ","), F.lit("]")), ddl)
        return F.when(on & (F.size(add) > 0), F.concat(F.coalesce(F.col(own), F.expr(f"cast(array() as {ddl})")), added)).otherwise(F.col(own))

    history = plus("password_history", "add_history", _HISTORY)
    dated = F.transform(history, lambda x, i: F.struct(text_or_empty(x.last_used_date).alias("d"), (-i).alias("i"), x.alias("x")))
    newest_first = F.transform(F.sort_array(dated, asc=False), lambda x: x.x)
    notes = F.when(F.col("p_kind").isin(*_NOTE_KINDS), F.coalesce("fitted_notes", "notes")).otherwise(F.col("notes"))
    notes = F.when(F.col("folder_line").isNotNull(), F.when(text_or_empty(notes) == "", F.col("folder_line")).otherwise(F.concat("folder_line", F.lit("\n"), notes))).otherwise(notes)
    new_login = F.col("login").withField("uris", plus("login.uris", "add_uri", _URIS)).withField("totp", F.coalesce("newest_totp", "login.totp"))
    changed = {
        "name": F.when(on, text_or_empty(F.col("longest_name"))).otherwise(F.col("name")),
        "favorite": F.when(on, F.col("any_favorite")).otherwise(F.col("favorite")),
        "notes": F.when(on, notes).otherwise(F.col("notes")),
        "password_history": F.when(on & (F.size("add_history") > 0), newest_first).otherwise(F.col("password_history")),
        "custom_fields": plus("custom_fields", "add_field", _FIELDS),
        "collection_ids": F.when(on & (F.size("add_collection") > 0), F.concat(F.coalesce("collection_ids", F.expr("cast(array() as array<string>)")), "add_collection")).otherwise(F.col("collection_ids")),
        "login": F.when(on & login & F.col("login").isNotNull(), new_login).otherwise(F.col("login")),
    }
    return j.select(*[changed.get(c, F.col(c)).alias(c) for c in items.columns])


def signal_kind() -> Column:
    return F.when(has_fido2(), "fido2").when(F.size(host_set(F.col("login.uris"))) > 0, "host").otherwise("username_only")


def deduplicate(items: DataFrame, now: str, folders: DataFrame | None = None, config: Config = Config(), write_patches: bool = False) -> Deduplicated:
    """The whole pass over items with the columns of the item schema and a unique pos. Nothing is
    removed: output rows are input rows. Null or empty input tables give empty results.

    With write_patches the patches, one row per group of two or more, are written once to the shared
    folder: right where items, audit and stats are all wanted. Without, each output computes just
    what it shows of them.
    """
    grouped = with_groups(items, config)
    patches = build_patches(grouped, folders)
    if write_patches:
        patches = cut(patches)
    mark = patches.select("grp", "kept_pos")
    marked = grouped.join(mark, "grp", "left").withColumn("is_loser", F.coalesce(F.col("pos") != F.col("kept_pos"), F.lit(False)))
    trashed = marked.withColumn("deleted_date", F.when(F.col("is_loser"), F.lit(now)).otherwise(F.col("deleted_date"))).drop("grp", "policy")
    result = apply_patches(trashed, patches)

    kept = items.select(F.col("pos").alias("kept_pos"), F.col("id").alias("kept_id"), F.col("revision_date").alias("kept_revision_date"), F.col("folder_id").alias("kept_folder_id"), signal_kind().alias("signal"))
    sizes = patches.select("grp", "longest_name", "totp_conflict", F.when(F.col("kind").isin(*_LOGIN_KINDS), F.col("totp_from_id")).alias("totp_kept_from_id"), F.size("add_uri").alias("uris_merged"), F.size("add_field").alias("fields_merged"), F.size("add_collection").alias("collections_merged"), "notes_merged", "notes_truncated", F.col("folder_line").isNotNull().alias("folder_note_added"))
    audit = marked.where("is_loser").join(sizes, "grp").join(kept, "kept_pos").select(
        F.col("kind").alias("item_kind"), F.when(F.col("kind") == "empty_password", F.col("signal")).alias("signal_kind"), F.col("pos").alias("removed_pos"), F.col("id").alias("removed_id"), F.col("name").alias("removed_name"), F.col("login.username").alias("removed_username"),
        F.col("revision_date").alias("removed_revision_date"), F.col("creation_date").alias("removed_creation_date"), F.col("folder_id").alias("removed_folder_id"), (text_or_empty(F.col("login.totp")) != "").alias("removed_totp_present"),
        F.when(F.col("kind") == "secure_note", F.when(F.startswith(text_or_empty(F.col("id")), F.lit("apple-csv-")), "apple-csv").otherwise("vault")).alias("removed_source"),
        "kept_pos", "kept_id", F.col("longest_name").alias("kept_name"), "kept_revision_date", "kept_folder_id", "uris_merged", "totp_conflict", "totp_kept_from_id", "notes_merged", "notes_truncated", "fields_merged", "collections_merged", "folder_note_added",
    )
    return Deduplicated(result, patches, audit, run_stats(items, grouped, patches, kept))


def run_stats(items: DataFrame, grouped: DataFrame, patches: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of counters."""
    strict = F.coalesce(F.col("kind") == "login", F.lit(False))
    totals = grouped.agg(F.count("*").alias("total"), F.count_if(~strict).alias("skipped"), F.count_if(F.col("deleted_date").isNull()).alias("living_before"))
    per_kind = [F.count_if(F.col("kind") == p.kind).alias(f"{p.kind}_groups") for p in PASSES]
    per_signal = [F.count_if((F.col("kind") == "empty_password") & (F.col("signal") == s)).alias(f"empty_password_by_{s}") for s in ("username_only", "host", "fido2")]
    trash = F.coalesce(F.sum(F.col("n_members") - 1), F.lit(0))
    epw = F.coalesce(F.sum(F.when(F.col("kind") == "empty_password", F.col("n_members") - 1)), F.lit(0))
    g = patches.join(kept.select("kept_pos", "signal"), "kept_pos").agg(F.count("*").alias("groups"), trash.alias("trashed"), epw.alias("empty_password_trashed"), F.coalesce(F.sum(F.size("add_uri")), F.lit(0)).cast("bigint").alias("merged_uris"), F.count_if("totp_conflict").alias("totp_conflict_groups"), *per_kind, *per_signal)
    both = totals.unionByName(g, allowMissingColumns=True)
    one = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return one.withColumn("living", F.col("living_before") - F.col("trashed")).withColumn("output", F.col("total")).drop("living_before")


def living(items: DataFrame) -> DataFrame:
    """What stays in the main file: all but a deleted date that is a non-empty text."""
    return items.where(text_or_empty(F.col("deleted_date")) == "")


def trashed(items: DataFrame) -> DataFrame:
    return items.where(text_or_empty(F.col("deleted_date")) != "")


def exportable(items: DataFrame, with_trash: bool = False) -> DataFrame:
    """What an export keeps: own items (no organization), archived ones too, trashed ones on demand."""
    return items.where(F.col("organization_id").isNull() & (F.lit(with_trash) | F.col("deleted_date").isNull()))


def export_stats(items: DataFrame) -> DataFrame:
    own = F.col("organization_id").isNull()
    return items.agg(F.count("*").alias("n_items"), F.count_if(~own).alias("n_org_owned"), F.count_if(own & F.col("deleted_date").isNotNull()).alias("n_trashed"), F.count_if(own & F.col("deleted_date").isNull() & F.col("archived_date").isNotNull()).alias("n_archived"), F.count_if(own & F.col("deleted_date").isNull()).alias("n_kept"))
