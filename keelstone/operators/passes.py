"""Which items may be grouped, by which pass, and what makes them equal.

The passes exclude each other (by item type, logins by a blank or filled password), so one column
tells the pass and one digest the group, and one shuffle serves all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_body, is_blank, normalize_name, normalize_note_name, stable_digest, text_or_empty, utrim
from ..functions.urls import host_set

ORIGIN_PREFIX = "apple-csv-"


@dataclass(frozen=True)
class Config:
    """split_divergent_totps: items with different TOTP secrets stay apart. keep_empty_password_stubs:
    logins without a password are not grouped."""

    split_divergent_totps: bool = False
    keep_empty_password_stubs: bool = False


@dataclass(frozen=True)
class PassSpec:
    """A pass: who may be grouped, what they share, and what ranks them before revision and creation
    date (larger is better)."""

    kind: str
    eligible: Callable[[], Column]
    key: Callable[[Config], list[Column]]
    preferred: Callable[[], Column]
    login: bool = False
    notes: bool = True


def floor() -> Column:
    """Not archived, not in the trash (an empty date counts as one), no reprompt, not tagged."""
    return F.col("deleted_date").isNull() & F.col("archived_date").isNull() & F.coalesce(F.col("reprompt") != 1, F.lit(True)) & ~F.contains(text_or_empty(F.col("name")), F.lit("[duplicate]"))


def _type(n: int) -> Column:
    return F.coalesce(F.col("cipher_type") == n, F.lit(False)) & F.col("free_")


def history_length() -> Column:
    return F.greatest(F.coalesce(F.size("password_history"), F.lit(0)), F.lit(0)).cast("bigint")


def fido2_signature() -> Column:
    """Credentials as JSON, ordered by id; "[]" for none."""
    keyed = F.transform(F.col("login.fido2_credentials"), lambda x, i: F.struct(text_or_empty(x.credential_id).alias("id"), i.alias("i"), F.to_json(x).alias("j")))
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(keyed), lambda x: x.j), ","), F.lit("]")), F.lit("[]"))


def has_fido2() -> Column:
    return F.coalesce(F.size("login.fido2_credentials") > 0, F.lit(False))


def _org() -> Column:
    return text_or_empty(F.col("organization_id"))


def _some_signal() -> Column:
    return (F.col("user_") != "") | (F.size("hosts_") > 0) | has_fido2()


def _shared() -> dict[str, Column]:
    """What several passes look at, computed once; hosts only where a password is missing."""
    blank = is_blank(F.col("login.password"))
    return {"free_": floor(), "blank_": blank, "user_": text_or_empty(utrim(F.col("login.username"))), "name_": normalize_name(F.col("name")), "hosts_": F.when(blank, host_set(F.col("login.uris")))}


def _zero() -> Column:
    return F.lit(0).cast("bigint")


PASSES = (
    PassSpec("login", lambda: _type(1) & ~F.col("blank_"), lambda c: [F.col("name_"), F.col("user_"), F.col("login.password"), fido2_signature(), _org(), *([text_or_empty(F.col("login.totp"))] if c.split_divergent_totps else [])], history_length, login=True),
    PassSpec("empty_password", lambda: _type(1) & F.col("blank_") & _some_signal(), lambda c: [F.col("name_"), F.col("user_"), F.col("hosts_"), fido2_signature(), _org(), *([text_or_empty(F.col("login.totp"))] if c.split_divergent_totps else [])], history_length, login=True),
    PassSpec("secure_note", lambda: _type(2) & ~is_blank(F.col("name")), lambda _: [normalize_note_name(F.col("name")), _org(), canonical_body(F.col("notes"))], lambda: F.when(F.startswith(text_or_empty(F.col("id")), F.lit(ORIGIN_PREFIX)), 0).otherwise(1).cast("bigint"), notes=False),
    PassSpec("ssh_key", lambda: _type(5) & ~is_blank(F.col("ssh_key.public_key")), lambda _: [F.to_json("ssh_key"), _org()], _zero),
    PassSpec("card", lambda: _type(3) & F.col("card").isNotNull(), lambda _: [F.col("name_"), _org(), F.to_json("card")], _zero),
    PassSpec("identity", lambda: _type(4) & F.col("ident").isNotNull(), lambda _: [F.col("name_"), _org(), F.to_json("ident")], _zero),
)


def with_groups(items: DataFrame, config: Config = Config(), passes: tuple[PassSpec, ...] = PASSES) -> DataFrame:
    """items with kind (null: no pass groups it), grp (digest of kind and key) and policy, the struct
    whose largest value is the survivor: preference, revision, creation, smaller position.

    Null texts count as empty in keys and dates. Extra columns pass through.
    """
    used = [p for p in passes if not (config.keep_empty_password_stubs and p.kind == "empty_password")]
    first = F.coalesce(*[F.when(p.eligible(), F.lit(p.kind)) for p in used])
    shared = _shared()
    out = items.withColumns(shared).withColumn("kind", first)
    of = lambda make: F.coalesce(*[F.when(F.col("kind") == p.kind, make(p)) for p in used])
    policy = F.struct(F.coalesce(of(lambda p: p.preferred()), _zero()).alias("preferred"), text_or_empty(F.col("revision_date")).alias("rev"), text_or_empty(F.col("creation_date")).alias("cre"), (-F.col("pos")).alias("neg_pos"))
    return out.withColumns({"grp": of(lambda p: stable_digest(F.lit(p.kind), *p.key(config))), "policy": policy}).drop(*shared)


def groups(grouped: DataFrame) -> DataFrame:
    """One row per group of two or more. All of it combines before the shuffle, so a group with a
    third of all rows reaches its task as one row per partition."""
    totp = F.col("login.totp")
    has = text_or_empty(totp) != ""
    newest = F.struct(text_or_empty(F.col("revision_date")), "policy")
    agg = grouped.where("kind is not null").groupBy("kind", "grp").agg(
        F.count("*").alias("n_members"),
        F.max("policy").alias("top"),
        F.max_by("pos", "policy").alias("kept_pos"),
        F.min("pos").alias("first_pos"),
        F.max_by("name", F.struct(F.length(text_or_empty(F.col("name"))), "policy")).alias("longest_name"),
        F.bool_or(F.coalesce("favorite", F.lit(False))).alias("any_favorite"),
        F.max_by(F.when(has, totp), F.when(has, newest)).alias("newest_totp"),
        F.max_by(F.when(has, F.col("id")), F.when(has, newest)).alias("totp_from_id"),
        (F.min(F.when(has, totp)) != F.max(F.when(has, totp))).alias("totp_conflict"),
    )
    return agg.where("n_members > 1").withColumn("totp_conflict", F.coalesce("totp_conflict", F.lit(False)) & F.col("kind").isin("login", "empty_password"))
