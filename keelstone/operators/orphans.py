"""References to rows that are missing, deleted or came later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import utrim

#: Bits of a filter for each parent row: about one false positive in a hundred.
BITS_PER_KEY = 10
#: Most 64-bit words of a field's filter, sharp up to 6.7 million parents. A filter is broadcast as (slot, bits) with a long key, so this bounds what is sent: 1,048,576 rows of about 40 bytes for each referring field. Beyond that it passes more references on to the exact join and stays right.
MOST_WORDS = 1 << 20
_FIELD_BITS = 40


def reference_key(c: Column) -> Column:
    """Ids are compared trimmed and without regard to case; blank is null."""
    k = F.lower(utrim(c))
    return F.when(k != "", k)


def filter_words(n_parents: int, most: int = MOST_WORDS) -> int:
    """Words of a filter for so many parents: a power of two with BITS_PER_KEY bits a key, at most most."""
    need = max(1, -(-n_parents * BITS_PER_KEY // 64))
    return min(most, 1 << (need - 1).bit_length())


def _slot(key: Column, words: Column) -> Column:
    """Field and word in one long, so that the broadcast table has a long key."""
    return F.shiftleft(F.col("field_no"), _FIELD_BITS) + F.pmod(F.xxhash64(key), words)


def _mask(name: str) -> Column:
    """Four bits of a word, from a second hash of the key."""
    h = f"xxhash64({name}, 'bits')"
    return F.expr(" | ".join(f"shiftleft(1L, cast(shiftrightunsigned({h}, {6 * i}) & 63 as int))" for i in range(4)))


def _numbered(fields: list[str], words: dict[str, int], of: Column) -> dict[str, Column]:
    """field_no and words of each row's field, as literals chosen by name."""
    pick = lambda value: F.coalesce(*[F.when(of == f, F.lit(value(i, f)).cast("bigint")) for i, f in enumerate(fields)])
    return {"field_no": pick(lambda i, f: i), "words": pick(lambda i, f: words[f])}


def bloom_words(parents: DataFrame, words: dict[str, int]) -> DataFrame:
    """A Bloom filter whose key bits lie in one word: (slot, bits), at most words[field] rows a field."""
    keyed = parents.withColumns(_numbered(list(words), words, F.col("ref_field")))
    return keyed.select(_slot(F.col("ref_key"), F.col("words")).alias("slot"), _mask("ref_key").alias("m")).groupBy("slot").agg(F.expr("bit_or(m)").alias("bits"))


def parent_keys(ref_field: str, parents: DataFrame) -> DataFrame:
    """One row for each id: its first delivery and its first deletion. Rows without id are left out."""
    return parents.select(F.lit(ref_field).alias("ref_field"), reference_key(F.col("id")).alias("ref_key"), "loaded_at", "deleted_at").where("ref_key is not null").groupBy("ref_field", "ref_key").agg(F.min("loaded_at").alias("first_loaded"), F.min("deleted_at").alias("first_deleted"))


def orphan_references(rows: DataFrame, key: str, at: str, parents: dict[str, DataFrame], most_words: int = MOST_WORDS) -> DataFrame:
    """(key, ref_field, reason, period) for each broken reference of the columns named in parents.

    Filters are sized by the number of parent rows (which a Parquet table tells from its footers). A
    reference that the broadcast filter denies is a definite orphan and leaves without a shuffle.
    The others meet their parents in an exact join on (ref_field, ref_key); a hot parent is split by
    adaptive skew handling, because parents are unique there. Reasons: missing, late, deleted; late
    and deleted can both hold and then give two rows. Null times prove nothing, and give a null
    period. Blank references are none. Equal rows give equal results, one each.
    """
    keys = None
    for ref_field, p in parents.items():
        k = parent_keys(ref_field, p)
        keys = k if keys is None else keys.unionByName(k)
    words = {f: filter_words(p.count(), most_words) for f, p in parents.items()}
    fields = F.array(*[F.struct(F.lit(c).alias("ref_field"), F.lit(i).cast("bigint").alias("field_no"), F.lit(words[c]).cast("bigint").alias("words"), reference_key(F.col(c)).alias("ref_key")) for i, c in enumerate(parents)])
    refs = rows.select(F.col(key), F.col(at).alias("at"), F.inline(fields)).where("ref_key is not null").withColumn("slot", _slot(F.col("ref_key"), F.col("words")))
    sieved = refs.join(F.broadcast(bloom_words(keys, words)), "slot", "left").withColumn("m", _mask("ref_key")).withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(F.col("m")) == F.col("m"), F.lit(False)))
    denied = sieved.where("not maybe").select(key, "ref_field", "at", F.lit("missing").alias("reason"))
    met = sieved.where("maybe").select(key, "ref_field", "at", "ref_key").join(keys.withColumn("there", F.lit(True)), ["ref_field", "ref_key"], "left")
    reasons = F.array_compact(F.array(F.when(F.col("there").isNull(), F.lit("missing")), F.when(F.col("at") < F.col("first_loaded"), F.lit("late")), F.when(F.col("first_deleted") <= F.col("at"), F.lit("deleted"))))
    verified = met.select(key, "ref_field", "at", F.explode(reasons).alias("reason"))
    return denied.unionByName(verified).select(key, "ref_field", "reason", F.date_format("at", "yyyy-MM").alias("period"))


def orphan_report(found: DataFrame) -> DataFrame:
    """Broken references counted per field, period and reason."""
    return found.groupBy("ref_field", "period", "reason").agg(F.count("*").alias("n_refs"))
