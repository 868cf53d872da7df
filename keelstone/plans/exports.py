"""Whole runs over item exports: read, collapse folders, deduplicate, split, write, report."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import dedup, folders
from ..operators.passes import Config
from ..session import cut
from ..sources import passwords_csv, vault

#: A document as one file is assembled on the driver; larger results stay tables of JSON lines.
DOCUMENT_BYTES = 256 << 20


@dataclass(frozen=True)
class Run:
    items: DataFrame
    folders: DataFrame
    audit: DataFrame
    stats: DataFrame


def overlay(raw: str | None, known: str) -> str:
    """known fields written over the raw item; fields that the engine does not know stay."""
    new = json.loads(known)
    old = json.loads(raw) if raw else {}
    for k, v in new.items():
        if isinstance(v, dict) and isinstance(old.get(k), dict):
            old[k] = old[k] | {i: x for i, x in v.items() if x is not None or i in old[k]}
        elif v is not None or k in old:
            old[k] = v
    return json.dumps(old, ensure_ascii=False, sort_keys=True)


@F.pandas_udf(T.StringType())
def _overlaid(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for raw, known in batches:
        yield pd.Series([overlay(r, k) for r, k in zip(raw, known, strict=True)], dtype=object)


def item_lines(result: DataFrame) -> DataFrame:
    """(pos, deleted, item): the items as JSON lines. What no group touched keeps its raw text; only
    survivors, losers and new items are written anew."""
    touched = F.col("kept_pos").isNotNull() | F.col("raw").isNull() | F.col("remapped")
    known = vault.item_json(result).withColumnRenamed("item", "known")
    j = result.select("pos", "raw", touched.alias("touched"), F.col("deleted_date").alias("deleted")).join(known, "pos")
    plain = j.where("not touched").select("pos", "deleted", F.to_json("raw").alias("item"))
    anew = j.where("touched").select("pos", "deleted", _overlaid(F.to_json("raw"), F.col("known")).alias("item"))
    return plain.unionByName(anew)


def run(items: DataFrame, folder_rows: DataFrame, now: str, config: Config = Config()) -> Run:
    """Folders first: equal names collapse and items follow; then all item passes at once. The resulting
    items are written once to the shared folder, whatever is then made of them."""
    remap = folders.folder_remap(folder_rows)
    before = items.select("pos", F.col("folder_id").alias("folder_before"))
    moved = folders.remap_folders(items, remap)
    kept = folders.surviving_folders(folder_rows, remap)
    r = dedup.deduplicate(moved, now, kept, config, write_patches=True)
    out = r.items.join(before, "pos").withColumn("remapped", ~F.col("folder_id").eqNullSafe(F.col("folder_before"))).drop("folder_before")
    counts = remap.agg(F.count("*").alias("folders_deduplicated"))
    both = r.stats.unionByName(counts, allowMissingColumns=True)
    stats = cut(both.agg(*[F.max(c).alias(c) for c in both.columns]))
    return Run(cut(out), kept, cut(r.audit), stats)


def dedup_export(spark: SparkSession, path: str, now: str, config: Config = Config()) -> Run:
    items, folder_rows = vault.read_export(spark, path)
    return run(items, folder_rows, now, config)


def merge_passwords(spark: SparkSession, export: str, csv: str, epoch_seconds: int, now: str, config: Config = Config()) -> Run:
    """A password export joined to an item export, then the same run."""
    items, folder_rows = vault.read_export(spark, export)
    rows = passwords_csv.read_passwords(spark, csv).withColumn("seq", F.monotonically_increasing_id())
    more = passwords_csv.to_items(rows, "seq", epoch_seconds, now, offset=1 << 40)
    return run(passwords_csv.appended(items, more), folder_rows, now, config)


def write(r: Run, folder: str, mode: str = "errorifexists") -> None:
    """living, trashed, folders, audit and stats under folder."""
    lines = cut(item_lines(r.items))
    lines.where(F.coalesce("deleted", F.lit("")) == "").orderBy("pos").select("item").write.mode(mode).text(f"{folder}/living")
    lines.where(F.coalesce("deleted", F.lit("")) != "").orderBy("pos").select("item").write.mode(mode).text(f"{folder}/trashed")
    for name, df in (("folders", r.folders), ("audit", r.audit), ("stats", r.stats)):
        df.write.mode(mode).json(f"{folder}/{name}")


def document(r: Run, trashed: bool = False, limit: int = DOCUMENT_BYTES) -> str:
    """The export as one document, in input order, if it is at most limit bytes."""
    gone = F.coalesce("deleted", F.lit("")) != ""
    lines = cut(item_lines(r.items).where(gone if trashed else ~gone))
    size = lines.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0))).first()[0]
    if size > limit:
        raise ValueError(f"the items take {size} bytes; write() keeps them as a table")
    items = [json.loads(x.item) for x in lines.orderBy("pos").collect()]
    rows = [{"id": f.id, "name": f.name} for f in r.folders.orderBy("pos").collect()]
    return json.dumps({"encrypted": False, "folders": rows, "items": items}, ensure_ascii=False, sort_keys=True, indent=2)
