"""One surviving record per group of duplicates, by skyline selection.

Records of a group are points: completeness (length of the password history, presence of notes,
length of the name), recency (revision date) and trust (creation date). A record is dominated if
another is at least as good everywhere; between records equal in history and both dates only the
one with the smaller position can dominate. The lexicographic policy (history, revision, creation,
position) picks the survivor among the undominated ones. Its empty fields are filled from
successive dominance layers: from the first layer that has a value, and in it from the record that
the policy ranks first; layers are numbered exactly, however many there are. Notes and name length are dimensions of the skyline, because their source is
fixed by the policy alone: so it always lies in the first layer.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalize_name, stable_digest, text_or_empty, utrim
from ..operators.merge import fit_notes
from ..session import cut

FILLED = ("notes",)
#: Fields that are filled from successive layers.
LAYERED = ("totp", "folder", "uris", "custom_fields", "collection_ids", "password_revision_date")
_POINT = pa.schema([("grp", pa.binary()), ("pos", pa.int64()), ("hist", pa.int64()), ("rev", pa.string()), ("cre", pa.string()), *((f"has_{f}", pa.bool_()) for f in FILLED), ("name_len", pa.int64()), ("n", pa.int64())])
_POINT_DDL = "grp binary, pos bigint, hist bigint, rev string, cre string, " + ", ".join(f"has_{f} boolean" for f in FILLED) + ", name_len bigint, n bigint"
_CHOICE_DDL = "grp binary, n bigint, n_undominated bigint, kept_pos bigint, name_pos bigint, " + ", ".join(f"{f}_pos bigint" for f in FILLED)
_CHOICE = pa.schema([("grp", pa.binary()), ("n", pa.int64()), ("n_undominated", pa.int64()), ("kept_pos", pa.int64()), ("name_pos", pa.int64()), *((f"{f}_pos", pa.int64()) for f in FILLED)])

_LAYER_DDL = "grp binary, pos bigint, layer int"
_FILL_DDL = "grp binary, n_layers int, " + ", ".join(f"{f}_pos bigint" for f in LAYERED)
_FILL = pa.schema([("grp", pa.binary()), ("n_layers", pa.int32()), *((f"{f}_pos", pa.int64()) for f in LAYERED)])


def undominated(points: np.ndarray, group: np.ndarray, near: int = 8) -> np.ndarray:
    """Which rows of points (larger is better) no other row of their group dominates. Rows lie by
    group and, inside, by the policy, so only an earlier row can dominate a later one."""
    n = len(group)
    alive = np.ones(n, bool)
    for d in range(1, min(near, n)):
        alive[d:] &= ~((group[d:] == group[:-d]) & (points[:-d] >= points[d:]).all(1))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.empty(0, int)
    for lo, hi in zip(starts, np.r_[starts[1:], n], strict=True):
        if hi - lo > near:  # few groups are that large: each undominated row clears what it dominates
            at = lo + np.flatnonzero(alive[lo:hi])
            keep = []
            while len(at):
                keep.append(at[0])
                at = at[1:][(points[at[1:]] > points[at[0]]).any(1)]
            alive[lo:hi] = False
            alive[keep] = True
    return alive


def _skyline(batch: pa.Table) -> pa.Table:
    """Undominated rows, sorted by group and policy; n of a group's first row counts all its rows."""
    group = pc.rank(batch["grp"], tiebreaker="dense").to_numpy().astype(np.int64)
    dims = [batch["hist"].to_numpy(), pc.rank(batch["rev"], tiebreaker="dense").to_numpy(), pc.rank(batch["cre"], tiebreaker="dense").to_numpy(), *(batch[f"has_{f}"].to_numpy(zero_copy_only=False) for f in FILLED), batch["name_len"].to_numpy()]
    points = np.column_stack([d.astype(np.int64) for d in dims])
    order = np.lexsort([batch["pos"].to_numpy(), -points[:, 2], -points[:, 1], -points[:, 0], group])
    points, group = points[order], group[order]
    alive = undominated(points, group)
    counts = np.bincount(group, weights=batch["n"].to_numpy()[order]).astype(np.int64)
    kept = order[alive]
    g = group[alive]
    n = np.where(np.r_[True, g[1:] != g[:-1]], counts[g], 0)
    out = batch.take(pa.array(kept))
    return out.set_column(out.schema.get_field_index("n"), "n", pa.array(n, pa.int64()))


def _local(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from _skyline(pa.Table.from_batches(held)).combine_chunks().to_batches()
                held, n = [], 0
        if n:
            yield from _skyline(pa.Table.from_batches(held)).combine_chunks().to_batches()

    return run


def _choose(t: pa.Table) -> pa.RecordBatch:
    """The policy over the undominated rows of whole groups of two or more."""
    group = pc.rank(t["grp"], tiebreaker="dense").to_numpy().astype(np.int64)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    pos, n = t["pos"].to_numpy(), t["n"].to_numpy()[starts]
    label = np.repeat(np.arange(len(starts)), sizes)

    def first(score: np.ndarray) -> np.ndarray:
        """Position of the first row of each group with the highest score, -1 if that is 0."""
        by = np.lexsort([np.arange(len(score)), -score, label])[starts]
        return np.where(score[by] > 0, pos[by], -1)

    cols = [t["grp"].take(pa.array(starts)).combine_chunks(), pa.array(n), pa.array(sizes), pa.array(pos[starts]), pa.array(first(t["name_len"].to_numpy() + 1))]
    cols += [pa.array(first(t[f"has_{f}"].to_numpy(zero_copy_only=False).astype(np.int64))) for f in FILLED]
    out = pa.Table.from_arrays(cols, schema=_CHOICE)
    return out.filter(pc.greater(out["n"], 1))


def _merge(use):
    """use(undominated rows of whole groups). Groups arrive one after the other; of the open one only
    its skyline is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = _skyline(t if held is None else pa.concat_tables([held, t]))
            last = t["grp"][t.num_rows - 1]
            closed = pc.sum(pc.not_equal(t["grp"], last)).as_py() or 0
            if closed:
                yield from use(t.slice(0, closed)).combine_chunks().to_batches()
            held = t.slice(closed).combine_chunks()
        if held is not None:
            yield from use(held).combine_chunks().to_batches()

    return run


def _skylines(points: DataFrame, use, ddl: str, rows_at_once: int) -> DataFrame:
    """Skylines merge like partial aggregates: each input partition first drops what is dominated inside
    blocks of rows_at_once, which takes a hot group down to its few undominated rows, then one shuffle
    by group of narrow rows, merged as a stream."""
    local = points.mapInArrow(_local(rows_at_once), _POINT_DDL)
    return local.repartition("grp").sortWithinPartitions("grp").mapInArrow(_merge(use), ddl)


def login_members(ciphers: DataFrame) -> DataFrame:
    """Login items that may be grouped, with the digest of what the items of one account share."""
    ids = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col("login.fido2_credentials"), F.expr("array()")), lambda x: text_or_empty(x.credential_id))))
    may = (F.col("cipher_type") == 1) & F.col("deleted_date").isNull() & F.col("archived_date").isNull() & F.coalesce(F.col("reprompt") != 1, F.lit(True)) & ~F.contains(text_or_empty(F.col("name")), F.lit("[duplicate]")) & ~is_blank(F.col("login.password"))
    key = stable_digest(normalize_name(F.col("name")), text_or_empty(utrim(F.col("login.username"))), F.col("login.password"), text_or_empty(F.col("organization_id")), ids)
    return ciphers.where(may).withColumn("grp", key)


def _history() -> Column:
    return F.greatest(F.coalesce(F.size("password_history"), F.lit(0)), F.lit(0)).cast("bigint")


def _points(members: DataFrame, *more: Column) -> DataFrame:
    has: dict[str, Column] = {"notes": F.col("notes")}
    return members.select("grp", F.col("pos").cast("bigint").alias("pos"), _history().alias("hist"), text_or_empty(F.col("revision_date")).alias("rev"), text_or_empty(F.col("creation_date")).alias("cre"), *[(~is_blank(has[f])).alias(f"has_{f}") for f in FILLED], F.length(text_or_empty(F.col("name"))).cast("bigint").alias("name_len"), F.lit(1).cast("bigint").alias("n"), *more)


def choose_survivors(members: DataFrame, rows_at_once: int = 100_000) -> DataFrame:
    """One row per group of two or more: n, n_undominated, kept_pos, name_pos and notes_pos (-1: no
    member has notes). Null dates count as empty and lose to all others; repeated rows differ by
    position only. The order of rows does not matter, nor does rows_at_once."""
    return _skylines(_points(members), _choose, _CHOICE_DDL, rows_at_once)


class Layers:
    """Layer numbers of the points of one group, which come in the order of the policy.

    Only an earlier point dominates, and a point lies one layer below the lowest that does. A layer
    holds, for each kind (notes, name length), the stairs of its (revision, creation): what a later point
    of the layer covers is dropped, and equal points share one object. If a layer has no point that
    dominates, no lower one has, so the first such layer is found by bisection.
    """

    def __init__(self) -> None:
        self.stairs: dict[tuple, list] = {}  # kind -> layer -> None, one point or ([rev], [cre]), rev rising and cre falling
        self.top = 0
        self.last = ("", "")

    @staticmethod
    def _dominated(layer: int, rev: str, cre: str, above: list[list]) -> bool:
        for stairs in above:
            s = stairs[layer] if layer < len(stairs) else None
            if type(s) is tuple:
                if s[0] >= rev and s[1] >= cre:
                    return True
            elif s is not None:
                i = bisect_left(s[0], rev)
                if i < len(s[0]) and s[1][i] >= cre:
                    return True
        return False

    def add(self, kind: tuple, rev: str, cre: str) -> int:
        """The layer of the next point, from 1."""
        above = [s for k, s in self.stairs.items() if all(x >= y for x, y in zip(k, kind, strict=True))]
        lo, hi = 0, self.top
        if hi and self._dominated(hi - 1, rev, cre, above):
            lo = hi
        while lo < hi:
            mid = (lo + hi) // 2
            if self._dominated(mid, rev, cre, above):
                lo = mid + 1
            else:
                hi = mid
        self.top = max(self.top, lo + 1)
        if self.last != (rev, cre):
            self.last = (rev, cre)
        mine = self.stairs.setdefault(kind, [])
        mine.extend([None] * (lo + 1 - len(mine)))
        s = mine[lo]
        if s is None or type(s) is tuple and rev >= s[0] and cre >= s[1]:
            mine[lo] = self.last
            return lo + 1
        revs, cres = s if type(s) is list else ([s[0]], [s[1]])
        end = bisect_left(revs, rev)
        start = end
        while start and cres[start - 1] <= cre:
            start -= 1
        end += end < len(revs) and revs[end] == rev
        revs[start:end], cres[start:end] = [rev], [cre]
        mine[lo] = [revs, cres]
        return lo + 1


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches sorted by group and policy, with the layer of each row and whether it starts a group."""
    state, open_grp = Layers(), None
    for b in batches:
        if not b.num_rows:
            continue
        grp = b.column("grp")
        starts = np.ones(b.num_rows, bool)
        starts[0] = grp[0].as_py() != open_grp
        starts[1:] = pc.not_equal(grp.slice(1), grp.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        open_grp = grp[b.num_rows - 1].as_py()
        layers = np.ones(b.num_rows, np.int32)
        alone = np.append(starts[1:], False) & starts  # of the last row's group more may come
        at = np.flatnonzero(~alone)
        some = b.take(pa.array(at))
        kinds = zip(*(some.column(c).to_pylist() for c in (*(f"has_{f}" for f in FILLED), "name_len")), strict=True)
        for i, kind, rev, cre in zip(at.tolist(), kinds, some.column("rev").to_pylist(), some.column("cre").to_pylist(), strict=True):
            if starts[i]:
                state = Layers()
            layers[i] = state.add(kind, rev, cre)
        yield b, layers, starts


def _layer_rows(depth: int | None, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, layers, _ in _sweep(batches):
            shown = layers if depth is None else np.minimum(layers, depth + 1)
            t = pa.Table.from_arrays([b.column("grp"), b.column("pos"), pa.array(shown, pa.int32())], names=["grp", "pos", "layer"])
            yield from t.to_batches(rows)

    return run


def _fills(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per group of two or more; of one group only the best places so far are held."""
    grp, n, top = None, 0, 0
    best: list[tuple[int, int] | None] = [None] * len(LAYERED)
    for b, layers, starts in _sweep(batches):
        out: list[tuple] = []
        grps, pos, ls, firsts = b.column("grp"), b.column("pos").to_pylist(), layers.tolist(), starts.tolist()
        has = list(zip(*(b.column(f"has_{f}").to_pylist() for f in LAYERED), strict=True))
        for i, layer in enumerate(ls):
            if firsts[i]:
                if n > 1:
                    out.append((grp, top, *(x and x[1] for x in best)))
                grp, n, top, best = grps[i].as_py(), 0, 0, [None] * len(LAYERED)
            n += 1
            top = max(top, layer)
            for k, h in enumerate(has[i]):
                if h and (best[k] is None or layer < best[k][0]):  # of one layer the first by the policy stays
                    best[k] = (layer, pos[i])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FILL, strict=True)], schema=_FILL)
    if n > 1:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((grp, top, *(x and x[1] for x in best)), _FILL, strict=True)], schema=_FILL)


def _by_policy(points: DataFrame) -> DataFrame:
    order = ["grp", F.desc("hist"), F.desc("rev"), F.desc("cre"), "pos"]
    return points.repartition("grp").sortWithinPartitions(*order)


def dominance_layers(members: DataFrame, depth: int | None = None, rows_at_once: int = 100_000) -> DataFrame:
    """(grp, pos, layer) of every member: layer 1 is the skyline, layer 2 the skyline of the rest, and so
    on to the last; with a depth, what lies below it has layer depth + 1. One shuffle of narrow rows,
    swept as a stream in batches of rows_at_once; of the open group the distinct points are held."""
    return _by_policy(_points(members)).mapInArrow(_layer_rows(depth, rows_at_once), _LAYER_DDL)


def _held() -> dict[str, tuple[Column, Column]]:
    """Value and presence of each layered field."""
    text = {"totp": F.col("login.totp"), "folder": F.col("folder_id"), "password_revision_date": F.col("login.password_revision_date")}
    lists = {"uris": F.col("login.uris"), "custom_fields": F.col("custom_fields"), "collection_ids": F.col("collection_ids")}
    return {f: (text[f], ~is_blank(text[f])) if f in text else (lists[f], F.coalesce(F.size(lists[f]) > 0, F.lit(False))) for f in LAYERED}


def fill_sources(members: DataFrame) -> DataFrame:
    """(grp, n_layers, and <field>_pos of each layered field) of the groups of two or more: where the policy
    finds the field first, layer by layer; null if no member has it."""
    points = _points(members, *[has.alias(f"has_{f}") for f, (_, has) in _held().items()])
    return _by_policy(points).mapInArrow(_fills, _FILL_DDL)


def _taken(ciphers: DataFrame, chosen: DataFrame) -> DataFrame:
    """(kept_pos, name and fill_<field>): the values at the places chosen, met in one join."""
    values = {"name": F.col("name")} | {f: v for f, (v, _) in _held().items()}
    places = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_pos").alias("pos")) for f in values])
    met = chosen.select("kept_pos", F.inline(places)).where("pos is not null").join(ciphers.select("pos", *[v.alias(f"v_{f}") for f, v in values.items()]), "pos")
    return met.groupBy("kept_pos").agg(*[F.first(F.when(F.col("field") == f, F.col(f"v_{f}")), ignorenulls=True).alias("name" if f == "name" else f"fill_{f}") for f in values])


def found(ciphers: DataFrame) -> DataFrame:
    """(member_pos, kept_pos, name_pos, notes_pos) of every member of a group of two or more."""
    members = login_members(ciphers)
    chosen = choose_survivors(members).select("grp", "kept_pos", "name_pos", "notes_pos")
    return members.select("grp", F.col("pos").alias("member_pos")).join(chosen, "grp").select("member_pos", "kept_pos", "name_pos", "notes_pos")


def survivors(ciphers: DataFrame, budget: int = 6_800) -> DataFrame:
    """The surviving record of each group: longest name, merged notes, fullest history, and TOTP, folder,
    URIs, custom fields, collections and password revision filled from successive dominance layers
    where the survivor has none (null, blank or an empty list).

    Merged notes are the distinct trimmed notes in policy order, cut to budget bytes at a separator.
    Each takes at least six bytes with its separator, so the first budget / 6 of a group hold all
    that can fit; the limit is applied before the shuffle too, so no group is ever collected whole.
    n_notes counts all distinct notes of the group, cut or not.
    """
    members = login_members(ciphers)
    chosen = cut(choose_survivors(members))
    chosen = cut(chosen.join(fill_sources(members), "grp"))
    policy = F.struct((-_history()).alias("h"), text_or_empty(F.col("revision_date")).alias("rev"), text_or_empty(F.col("creation_date")).alias("cre"), "pos")
    distinct = members.where(~is_blank(F.col("notes"))).select("grp", utrim(F.col("notes")).alias("note"), policy.alias("p")).groupBy("grp", "note").agg(F.max(F.struct((-F.col("p.h")).alias("h"), "p.rev", "p.cre", (-F.col("p.pos")).alias("neg_pos"))).alias("p"))
    order = Window.partitionBy("grp").orderBy(F.col("p").desc())
    first = distinct.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= budget // 6 + 1)
    fitting = first.groupBy("grp").agg(F.concat_ws("\n---\n", F.transform(F.sort_array(F.collect_list(F.struct("rank", "note"))), lambda x: x.note)).alias("first_notes"))
    notes = fitting.join(distinct.groupBy("grp").agg(F.count("*").alias("n_notes")), "grp")
    base = ciphers.select(F.col("pos").alias("kept_pos"), "id", "login", "password_history", "revision_date", "creation_date", F.col("folder_id").alias("own_folder"), F.col("custom_fields").alias("own_fields"), F.col("collection_ids").alias("own_collections"))
    out = chosen.join(base, "kept_pos").join(_taken(ciphers, chosen), "kept_pos").join(notes, "grp", "left")
    pick = lambda own, fill: F.when(is_blank(own), fill).otherwise(own)
    filled = lambda own, fill: F.when(F.size(own) > 0, own).otherwise(F.coalesce(fill, own))
    return out.select(
        "kept_pos", "id", "n", "n_undominated", "n_layers", "name", F.col("login.username").alias("username"), fit_notes(F.col("first_notes"), budget).alias("notes"), pick(F.col("login.totp"), F.col("fill_totp")).alias("totp"),
        pick(F.col("own_folder"), F.col("fill_folder")).alias("folder_id"), "password_history", "revision_date", "creation_date", "name_pos", "notes_pos", F.coalesce("n_notes", F.lit(0)).alias("n_notes"),
        filled(F.col("login.uris"), F.col("fill_uris")).alias("uris"), filled(F.col("own_fields"), F.col("fill_custom_fields")).alias("custom_fields"), filled(F.col("own_collections"), F.col("fill_collection_ids")).alias("collection_ids"), pick(F.col("login.password_revision_date"), F.col("fill_password_revision_date")).alias("password_revision_date"),
    )
