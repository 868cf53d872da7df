"""Command line: python -m keelstone dedup | merge | move | redact."""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import folders, redact
from .operators.passes import Config
from .plans import exports
from .sources import vault


def _session() -> SparkSession:
    return SparkSession.builder.appName("keelstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _audit(r: exports.Run) -> str:
    """Counters and one entry per loser; no passwords or TOTP secrets are among the columns."""
    entries = [json.loads(x) for x in r.audit.orderBy("removed_pos").toJSON().collect()]
    return json.dumps(r.stats.first().asDict() | {"entries": entries}, ensure_ascii=False, indent=2)


def _deliver(r: exports.Run, out: str, audit: str, trash: str, force: bool) -> None:
    vault.write_document(exports.document(r), out, force)
    vault.write_document(_audit(r), audit, force)
    if r.stats.first().trashed or r.items.where("deleted_date <> ''").limit(1).count():
        vault.write_document(exports.document(r, trashed=True), trash, force)
    elif os.path.exists(trash):
        os.unlink(trash)  # a stale one would claim items that are not in the trash
    print(json.dumps(r.stats.first().asDict(), indent=2))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="keelstone")
    sub = p.add_subparsers(dest="what", required=True)
    for name in ("dedup", "merge", "move", "redact"):
        s = sub.add_parser(name)
        s.add_argument("-i", "--input", required=True)
        s.add_argument("-o", "--output")
        s.add_argument("-a", "--audit")
        s.add_argument("--force", action="store_true", help="overwrite what is there")
        if name in ("dedup", "merge"):
            s.add_argument("--split-divergent-totps", action="store_true")
            s.add_argument("--keep-empty-password-stubs", action="store_true")
        if name == "merge":
            s.add_argument("--csv", required=True)
        if name == "move":
            s.add_argument("--folder", default="main")
    a = p.parse_args(argv)
    stem = a.input.removesuffix(".json")
    kind = {"dedup": "dedup", "merge": "merged", "move": f"in-folder-{getattr(a, 'folder', '')}", "redact": "redacted"}[a.what]
    out = a.output or f"{stem}.{kind}.json"
    base = out.removesuffix(".json")
    audit, trash = a.audit or f"{base}.audit.json", f"{base}.trashed.json"
    vault.distinct_paths(a.input, out, audit, trash)
    spark, now = _session(), datetime.now(UTC)
    stamp = now.strftime("%Y-%m-%dT%H:%M:%SZ")
    if a.what in ("dedup", "merge"):
        config = Config(a.split_divergent_totps, a.keep_empty_password_stubs)
        r = exports.dedup_export(spark, a.input, stamp, config) if a.what == "dedup" else exports.merge_passwords(spark, a.input, a.csv, int(now.timestamp()), stamp, config)
        _deliver(r, out, audit, trash, a.force)
        return 0
    items, folder_rows = vault.read_export(spark, a.input)
    if a.what == "move":
        name, fid = a.folder, spark.range(1).select(F.uuid()).first()[0]
        moved = folders.move_all(items, fid).withColumns({"kept_pos": F.lit(None), "remapped": F.lit(True)})
        one = spark.createDataFrame([(0, fid, name)], "pos bigint, id string, name string")
        r = exports.Run(moved, one, items.limit(0), items.limit(0))
        vault.write_document(exports.document(r), out, a.force)
    else:
        if not a.force:
            vault.outside_repository(out)
        safe = redact.redacted(items.drop("raw"), folder_rows)
        lines = [json.loads(x.item) for x in vault.item_json(safe).orderBy("pos").collect()]
        ids = redact.numbered(folder_rows.where("id is not null").select("id").distinct(), [F.col("id")], "n").orderBy("n").collect()
        named = [{"id": f"00000000-0000-0000-0001-{r.n:012x}", "name": f"Folder {r.n + 1:02}"} for r in ids]
        vault.write_document(json.dumps({"encrypted": False, "folders": named, "items": lines}, indent=2), out, a.force)
    return 0


if __name__ == "__main__":
    sys.exit(main())
