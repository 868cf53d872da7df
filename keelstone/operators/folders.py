"""Folders: collapse by normalised name, remap references, look names up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_note_name, text_or_empty


def with_position(folders: DataFrame) -> DataFrame:
    """Folders with a position, by delivery time and id, where they have none of their own."""
    return folders if "pos" in folders.columns else folders.withColumn("pos", F.struct("loaded_at", "id"))


def folder_remap(folders: DataFrame) -> DataFrame:
    """(folder_id, survivor_id) for every id that is not its own survivor: the first folder of each
    normalised name stays. Folders without id are neither remapped nor survivors; if an id is
    delivered more than once, its first delivery counts. Combined before the shuffle."""
    f = with_position(folders).where(text_or_empty(F.col("id")) != "").select("id", normalize_note_name(F.col("name")).alias("key"), "pos")
    f = f.groupBy("id").agg(F.min_by("key", "pos").alias("key"), F.min("pos").alias("pos"))
    best = f.groupBy("key").agg(F.min_by("id", "pos").alias("survivor_id"))
    return f.join(best, "key").where("id <> survivor_id").select(F.col("id").alias("folder_id"), "survivor_id")


def remap_folders(items: DataFrame, remap: DataFrame) -> DataFrame:
    """Items with folder_id led to its survivor."""
    return items.join(remap, "folder_id", "left").withColumn("folder_id", F.coalesce("survivor_id", "folder_id")).select(*items.columns)


def surviving_folders(folders: DataFrame, remap: DataFrame) -> DataFrame:
    return folders.join(remap, folders["id"] == remap["folder_id"], "left_anti")


def folder_names(folders: DataFrame) -> DataFrame:
    """(folder_id, folder_name): the name of the last delivery of each id."""
    return with_position(folders).where("id is not null").groupBy(F.col("id").alias("folder_id")).agg(F.max_by("name", "pos").alias("folder_name"))


def move_all(items: DataFrame, folder_id: str) -> DataFrame:
    return items.withColumn("folder_id", F.lit(folder_id))
