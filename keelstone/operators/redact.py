"""Shape-preserving redaction that keeps duplicate groups and their winners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import scrub_uri
from ..session import cut
from .passes import Config, with_groups

DAY_END = 86_399


def synthetic_id(idx: Column, block: str = "0000") -> Column:
    return F.concat(F.lit(f"00000000-0000-0000-{block}-"), F.lpad(F.lower(F.hex(idx.cast("bigint"))), 12, "0"))


def synthetic_date(year: int, rank: Column) -> Column:
    """The later the smaller the rank, from the last second of the year; ranks over a day share its first."""
    left = F.greatest(F.lit(DAY_END) - rank, F.lit(0))
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    return F.concat(F.lit(f"{year}-12-31T"), two(F.floor(left / 3600)), F.lit(":"), two(F.floor(left % 3600 / 60)), F.lit(":"), two(left % 60), F.lit("Z"))


def numbered(keys: DataFrame, by: list[Column], out: str) -> DataFrame:
    """keys (unique in by) with dense numbers from 0 in the order of by, without one task for all:
    range-partitioned, counted per partition, and shifted by the counts before. The ranged rows are
    written to the shared folder, so a lost executor cannot number them anew."""
    part = F.spark_partition_id().cast("bigint")
    ranged = cut(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("p", part).withColumn("r", F.monotonically_increasing_id() - F.shiftleft(part, 33)))
    counts = ranged.groupBy("p").agg(F.count("*").alias("n"))  # one row per partition
    before = counts.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    return ranged.join(F.broadcast(before), "p").withColumn(out, F.col("r") + F.col("shift")).drop("p", "r", "shift")


def ranks(rows: DataFrame, group: str, policy: str, key: str, out: str) -> DataFrame:
    """(key, out): the place of each row in its group from 0, best policy first. Rows are numbered over
    all groups at once and shifted by the least number of their group, so a hot group is spread."""
    n = numbered(rows.select(group, policy, key), [F.col(group), F.col(policy).desc()], "n")
    least = n.groupBy(group).agg(F.min("n").alias("least"))
    return n.join(least, group).select(key, (F.col("n") - F.col("least")).alias(out))


def redacted(items: DataFrame, folders: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """Items with everything synthetic but type, reprompt, favorite, counts, match modes and links.

    Groups get numbers in order of their first position; items that no pass groups are groups of
    one. The rank in a group follows the survivor policy of its pass, so the same item wins again.
    Unlike a redaction that blanks keys and cards, key texts and card numbers become synthetic per
    group, an empty password stays empty, and histories are gone but the order they gave is kept in
    the dates.
    """
    g = with_groups(items, config).withColumn("g", F.coalesce("grp", F.unhex(F.sha2(F.concat(F.lit("own:"), F.col("pos").cast("string")), 256))))
    first = g.groupBy("g").agg(F.min("pos").alias("first_pos"))
    ids = numbered(first, [F.col("first_pos")], "gid").select("g", "gid")
    place = numbered(items.select("pos"), [F.col("pos")], "idx")
    ranked = g.join(ranks(g, "g", "policy", "pos", "rank"), "pos").join(ids, "g").join(place, "pos")
    if folders is not None:
        f = numbered(folders.where("id is not null").select(F.col("id").alias("folder_id")).distinct(), [F.col("folder_id")], "folder_no")
        ranked = ranked.join(f, "folder_id", "left")
    else:
        ranked = ranked.withColumn("folder_no", F.lit(None).cast("bigint"))
    gid = F.when(F.length(F.col("gid").cast("string")) > 4, F.col("gid").cast("string")).otherwise(F.lpad(F.col("gid").cast("string"), 4, "0"))
    named = lambda head, c: F.when(c.isNotNull(), F.when(c == "", "").otherwise(F.concat(F.lit(head), gid)))
    login = F.col("login")
    uris = F.transform(F.col("login.uris"), lambda u, i: F.struct(scrub_uri(u.uri, F.col("gid"), i).alias("uri"), u.uri_match.alias("uri_match")))
    safe_login = F.when(login.isNotNull(), login.withField("username", F.when(F.col("login.username").isNotNull(), F.concat(F.lit("user"), gid, F.lit("@example.test")))).withField("password", named("redacted-password-", F.col("login.password"))).withField("totp", named("redacted-totp-seed-", F.col("login.totp"))).withField("password_revision_date", F.lit(None).cast("string")).withField("uris", F.when(F.size(uris) > 0, uris)).withField("fido2_credentials", F.lit(None).cast(items.schema["login"].dataType["fido2_credentials"].dataType)))

    def blanked(block: str, filled: dict[str, Column]) -> Column:
        kind = items.schema[block].dataType
        return F.when(F.col(block).isNotNull(), F.struct(*[filled.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind]))

    out: dict[str, Column] = {
        "id": synthetic_id(F.col("idx")), "organization_id": F.lit(None).cast("string"), "collection_ids": F.lit(None).cast("array<string>"), "folder_id": F.when(F.col("folder_no").isNotNull(), synthetic_id(F.col("folder_no"), "0001")),
        "reprompt": F.coalesce("reprompt", F.lit(0)).cast("bigint"), "favorite": F.coalesce("favorite", F.lit(False)), "creation_date": synthetic_date(2025, F.col("rank")), "revision_date": synthetic_date(2026, F.col("rank")),
        "deleted_date": F.when(F.col("deleted_date").isNotNull(), synthetic_date(2024, F.col("rank"))), "archived_date": F.when(F.col("archived_date").isNotNull(), synthetic_date(2026, F.col("rank"))),
        "name": F.concat(F.lit("Example Service "), gid), "notes": F.lit(None).cast("string"), "password_history": F.lit(None).cast(items.schema["password_history"].dataType), "login": safe_login,
        "custom_fields": F.when(F.size("custom_fields") > 0, F.transform("custom_fields", lambda f, i: F.struct(F.concat(F.lit("field_"), i.cast("string")).alias("name"), F.lit("REDACTED").alias("field_value"), F.coalesce(f.field_type, F.lit(0)).cast("bigint").alias("field_type"), f.linked_id.alias("linked_id")))),
        "card": blanked("card", {"cardholder_name": F.lit("REDACTED"), "card_number": F.concat(F.lit("synthetic-"), gid)}), "ident": blanked("ident", {"first_name": F.lit("REDACTED"), "last_name": F.concat(F.lit("REDACTED-"), gid)}),
        "ssh_key": blanked("ssh_key", {"public_key": F.concat(F.lit("synthetic-key-"), gid)}),
    }
    return ranked.select(*[out.get(c, F.col(c)).alias(c) for c in items.columns])
