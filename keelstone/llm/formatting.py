"""Records that differ only in how they are written, collapsed and counted.

Each column is dictionary-encoded. Rows are taken in blocks; a distinct value of a block is canonicalised
once and gets a code of the block, and the record becomes the list of its codes. The dictionaries of the
blocks are then merged: equal canonical forms of a field, compared as they are, get one integer
identifier over all data. Last, each block exchanges its codes for the identifiers, sorts them into the
record's tuple of (field, value) integers, and equal tuples are grouped. Texts are shuffled once, each
canonical form at most once per block; records travel as integers only. No hash decides equality.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..session import cut

#: Bounds of a block of one task, whichever comes first: what is held while it is encoded, and later when its codes are exchanged.
BLOCK_ROWS = 100_000
BLOCK_BYTES = 64 << 20
#: Place of the field in an identifier: the lower bits number its forms. 2^40 forms per shuffle partition.
_COUNTER_BITS = 40

_NOT_ALNUM = re.compile(r"[\W_]+")


def written(text: str) -> str:
    """The letters and digits of a text, lower-cased, in order."""
    return _NOT_ALNUM.sub("", text.lower())


def forms(kind: str, value: str | None) -> list[tuple[int, str]]:
    """The canonical forms of one value, as (part, form); what is empty has none. Parts tell apart what a
    field holds: of a url, 0 what precedes the first "?" and 1 the "&"-parts after it; of a bag, 1 null."""
    if kind == "bag":
        return [(1, "")] if value is None else [(0, value)]
    if not value:
        return []
    if kind == "exact":
        return [(0, value)]
    head, _, query = value.partition("?") if kind == "url" else (value, "", "")
    out = [(0, w)] if (w := written(head)) else []
    return [*out, *((1, w) for w in map(written, query.split("&")) if w)]


def _encode_block(batches: list[pa.RecordBatch], kinds: list[str], block: int) -> pa.RecordBatch:
    """Entries (block, field, code, form) and records (block, key, codes) of one block, in one table."""
    table = pa.Table.from_batches(batches).combine_chunks()
    codes: list[list[int]] = [[] for _ in range(table.num_rows)]
    entries: dict[tuple[int, str], int] = {}
    for no, kind in enumerate(kinds):
        column = table.column(no + 1)
        column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
        coded = (column.flatten() if kind == "bag" else column).dictionary_encode()

        def of(v: str | None, no: int = no, kind: str = kind) -> list[int]:
            return [entries.setdefault((2 * no + part, form), len(entries)) for part, form in forms(kind, v)]

        of_value = [of(v) for v in coded.dictionary.to_pylist()]
        indices = coded.indices.to_pylist()
        if kind == "bag":
            at = 0
            for r, size in enumerate(column.value_lengths().to_pylist()):
                for c in indices[at : at + (size or 0)]:
                    codes[r] += of(None) if c is None else of_value[c]
                at += size or 0
        else:
            for r, c in enumerate(indices):
                if c is not None:
                    codes[r] += of_value[c]
    n, m = len(entries), table.num_rows
    fields, texts = zip(*entries, strict=True) if n else ((), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block] * (n + m), pa.int64()),
            pa.array([*fields, *[None] * m], pa.int32()),
            pa.array([*range(n), *[None] * m], pa.int32()),
            pa.array([*(t.encode("utf-8", "surrogatepass") for t in texts), *[None] * m], pa.binary()),
            pa.concat_arrays([pa.nulls(n, table.column(0).type), table.column(0).combine_chunks() if m else pa.nulls(0, table.column(0).type)]),
            pa.array([*[None] * n, *codes], pa.list_(pa.int32())),
        ],
        names=["block", "field", "code", "form", "key", "codes"],
    )


def local_dictionaries(rows: DataFrame, key: str, fields: dict[str, tuple[str, Column]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, field, code, form, key, codes): the dictionary entries of each block, and its records as codes."""
    kinds = [k for k, _ in fields.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << _COUNTER_BITS
        held, n, size = [], 0, 0
        for b in batches:
            for at in range(0, b.num_rows, block_rows):
                part = b.slice(at, block_rows)
                held.append(part)
                n, size = n + part.num_rows, size + part.nbytes
                if n >= block_rows or size >= BLOCK_BYTES:
                    yield _encode_block(held, kinds, block)
                    held, n, size, block = [], 0, 0, block + 1
        if held:
            yield _encode_block(held, kinds, block)

    return rows.select(F.col(key).cast("bigint").alias("key"), *[c.alias(f"f{i}") for i, (_, c) in enumerate(fields.values())]).mapInArrow(run, "block bigint, field int, code int, form binary, key bigint, codes array<int>")


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by source, field and form: each distinct form takes the next identifier of its partition."""
    last, counter = None, (TaskContext.get().partitionId() << _COUNTER_BITS) - 1
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(n) for n in ("src_table", "field", "form")]
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            new[1:] |= np.asarray(pc.not_equal(k.slice(1), k.slice(0, b.num_rows - 1)))
        first = tuple(k[0].as_py() for k in keys)
        new[0] = first != last
        last = tuple(k[b.num_rows - 1].as_py() for k in keys)
        ids = counter + np.cumsum(new)
        counter = int(ids[-1])
        yield pa.RecordBatch.from_arrays([b.column("src_table"), b.column("block"), b.column("code"), pa.array(ids, pa.int64())], names=["src_table", "block", "code", "id"])


def _exchange(records: pa.Table, entries: pa.Table) -> pa.Table:
    """Codes of one block to identifiers; the tuple is the sorted identifiers, eight bytes each."""
    codes = records["codes"].combine_chunks() if records.num_rows else pa.array([], pa.list_(pa.int32()))
    sizes = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = np.zeros(entries.num_rows, np.int64)
    ids[entries["code"].to_numpy()] = entries["id"].to_numpy()
    flat = ids[codes.flatten().to_numpy(zero_copy_only=False)] if len(codes) else np.empty(0, np.int64)
    record = np.repeat(np.arange(len(sizes)), sizes)
    data = flat[np.lexsort([flat, record])].astype(">i8").tobytes()
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * 8
    tuples = pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])
    return pa.table([records["src_table"], records["key"], tuples], names=["src_table", "key", "tuple"])


def encode(tables: dict[str, tuple[DataFrame, str, dict[str, tuple[str, Column]]]], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src_table, key, tuple): the identifier tuple of each record. tables: name -> (rows, key, fields), and
    fields: name -> (kind, column) with kind written, exact, url, or bag (an array of texts in any order,
    nulls count as elements). Null texts count as empty, null arrays as no elements.

    Block dictionaries are written once to the shared folder, since codes must mean the same in both
    uses. A value that a third of all records hold is one entry per block, so merging dictionaries meets
    no hot key; codes are exchanged block by block.
    """
    local = None
    for name, (rows, key, fields) in tables.items():
        one = local_dictionaries(rows, key, fields, block_rows).select(F.lit(name).alias("src_table"), "*")
        local = one if local is None else local.unionByName(one)
    local = cut(local)
    entries = local.where("code is not null").select("src_table", "block", "field", "code", "form")
    ids = entries.repartition("src_table", "field", "form").sortWithinPartitions("src_table", "field", "form").mapInArrow(_number, "src_table string, block bigint, code int, id bigint")
    records = local.where("code is null").select("src_table", "block", "key", "codes")
    by = ["src_table", "block"]
    return records.groupBy(*by).cogroup(ids.groupBy(*by)).applyInArrow(_exchange, "src_table string, key bigint, tuple binary")


def cipher_fields(ciphers: DataFrame) -> tuple[DataFrame, str, dict[str, tuple[str, Column]]]:
    rows = ciphers.where((F.col("cipher_type") == 1) & ~is_blank(F.col("login.password")))
    element = F.transform("custom_fields", lambda x: F.to_json(x))
    fields = {"name": ("written", F.col("name")), "username": ("exact", F.col("login.username")), "password": ("exact", F.col("login.password")), "notes": ("exact", F.col("notes")), "organization_id": ("exact", F.col("organization_id")), "custom_fields": ("bag", element)}
    return rows, "pos", fields


def apple_fields(apple_rows: DataFrame) -> tuple[DataFrame, str, dict[str, tuple[str, Column]]]:
    says = F.concat_ws("", "title", "url", "username").rlike(r"[\p{L}\p{N}]")
    fields = {"title": ("written", F.col("title")), "username": ("written", F.col("username")), "url": ("url", F.col("url")), "password": ("exact", F.col("password")), "notes": ("exact", F.col("notes")), "otpauth": ("exact", F.col("otpauth"))}
    return apple_rows.where(says), "row_id", fields


def encoded(ciphers: DataFrame, apple_rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return encode({"ciphers": cipher_fields(ciphers), "apple_rows": apple_fields(apple_rows)}, block_rows)


def sets(rows: DataFrame) -> DataFrame:
    """One row per set of equal records: (src_table, tuple, first_key, n_copies). Counts are combined
    before the shuffle, so a set with a third of all rows is one row per task."""
    return rows.groupBy("src_table", "tuple").agg(F.min("key").alias("first_key"), F.count("*").alias("n_copies"))


def copies(rows: DataFrame) -> DataFrame:
    """(src_table, first_key, copy_key): the smallest key of each set with each other key. The encoded
    table (eight bytes a value) is written once to the shared folder, counted, and joined with the
    sets of two or more, which are unique by tuple, so a hot set is split by adaptive skew handling."""
    rows = cut(rows)
    several = sets(rows).where("n_copies > 1").select("src_table", "tuple", "first_key")
    return rows.join(several, ["src_table", "tuple"]).where("key <> first_key").select("src_table", "first_key", F.col("key").alias("copy_key"))
