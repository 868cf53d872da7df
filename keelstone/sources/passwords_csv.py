"""Password exports as CSV: header contract, rows to items, union with another source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, text_or_empty, utrim
from ..operators.passes import ORIGIN_PREFIX

REQUIRED = ("title", "url", "username", "password", "notes", "otpauth")


def check_header(names: list[str]) -> dict[str, str]:
    """Column of each required name, trimmed and in any case; extras are allowed."""
    have = {n.strip().lstrip("﻿").lower(): n for n in names}
    missing = [n for n in REQUIRED if n not in have]
    if missing:
        raise ValueError(f"the header lacks {', '.join(missing)}")
    return {n: have[n] for n in REQUIRED}


def read_passwords(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an export file with the six columns; short rows get empty texts. Quotes doubled inside
    quotes, line breaks inside quotes, any line end. An open quote at the end is an error."""
    raw = spark.read.text(path, wholetext=True)
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    if raw.where(odd).limit(1).count():
        raise ValueError(f"{path}: a quote is not closed")
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").csv(path)
    at = check_header(df.columns)
    return df.select(*[text_or_empty(F.col(f"`{c}`")).alias(n) for n, c in at.items()])


def is_login_row() -> F.Column:
    return ~(is_blank(F.col("url")) & is_blank(F.col("username")) & is_blank(F.col("password")) & is_blank(F.col("otpauth")))


def is_empty_row() -> F.Column:
    return ~is_login_row() & is_blank(F.col("title")) & is_blank(F.col("notes"))


def row_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n_rows"), F.count_if(is_empty_row()).alias("n_skipped"), F.count_if(~is_empty_row()).alias("n_appended"), F.count_if(~is_empty_row() & is_login_row()).alias("n_logins"))


def to_items(rows: DataFrame, seq: str, epoch_seconds: int, now: str, offset: int = 0) -> DataFrame:
    """Rows as items: logins if anything but title and notes is filled, else notes. seq numbers all
    rows, empty ones included; those become no item. pos is offset + seq."""
    null = lambda t: F.lit(None).cast(t)
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    name = F.when(~is_blank(F.col("title")), F.col("title")).when(~is_blank(F.col("url")), utrim(F.col("url"))).when(~is_blank(F.col("username")), utrim(F.col("username"))).otherwise("(unnamed)")
    uris = F.when(~is_blank(F.col("url")), F.array(F.struct(utrim(F.col("url")).alias("uri"), null("bigint").alias("uri_match")))).otherwise(F.expr("cast(array() as array<struct<uri:string,uri_match:bigint>>)"))
    login = F.struct(filled("username").alias("username"), filled("password").alias("password"), filled("otpauth").alias("totp"), null("string").alias("password_revision_date"), uris.alias("uris"), null("array<struct<credential_id:string,rp_id:string,user_name:string,counter:string,creation_date:string>>").alias("fido2_credentials"))
    is_login = is_login_row()
    return rows.where(~is_empty_row()).select(
        (F.col(seq) + offset).cast("bigint").alias("pos"), F.concat(F.lit(f"{ORIGIN_PREFIX}{epoch_seconds:010d}-"), F.lpad(F.col(seq).cast("string"), 6, "0")).alias("id"), F.when(is_login, 1).otherwise(2).cast("bigint").alias("cipher_type"), F.lit(0).cast("bigint").alias("reprompt"), F.lit(False).alias("favorite"), name.alias("name"),
        F.when(~is_blank(F.col("notes")), F.col("notes")).alias("notes"), F.lit(now).alias("creation_date"), F.lit(now).alias("revision_date"), F.when(is_login, login).alias("login"), F.when(~is_login, F.struct(F.lit(0).cast("bigint").alias("note_type"))).alias("secure_note"),
    )


def appended(items: DataFrame, more: DataFrame) -> DataFrame:
    """items with the new ones after them; columns that one side lacks are null."""
    return items.unionByName(more, allowMissingColumns=True).select(*items.columns)
