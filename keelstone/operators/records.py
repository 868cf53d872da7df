"""Raw CSV records to typed rows and labelled errors, by a quote-aware finite-state tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WHITE_SPACE

START, PLAIN, QUOTED, CLOSED, BAD = range(5)
OTHER, QUOTE, COMMA, PAD = range(4)
# NEXT[byte class, state]: a quote may only open a field; after it closes, only a comma or its double may follow.
NEXT = np.array([
    [PLAIN, PLAIN, QUOTED, BAD, BAD],
    [QUOTED, BAD, CLOSED, QUOTED, BAD],
    [START, START, QUOTED, START, BAD],
    [START, PLAIN, QUOTED, CLOSED, BAD],
], np.uint8)
CLASS_OF = np.zeros(256, np.uint8)
CLASS_OF[ord('"')], CLASS_OF[ord(",")] = QUOTE, COMMA

COLUMNS = ("title", "url", "username", "password", "notes", "otpauth")
_UNCLEAN = re.compile("[�\x7f\x00-\x08\x0b\x0c\x0e-\x1f]")
_OTP = re.compile(r"otpauth://[th]otp/[^?]+\?([^=&]+=[^&]*(?:&[^=&]+=[^&]*)*)", re.S)
_SECRET = re.compile(r"[A-Za-z2-7]+=*")


def chunk_functions(classes: np.ndarray) -> np.ndarray:
    """For each row of byte classes, the state after it for each state before it."""
    f = np.tile(np.arange(5, dtype=np.uint8), (len(classes), 1))
    for j in range(classes.shape[1]):
        f = NEXT[classes[:, j, None], f]
    return f


def entry_states(functions: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The state before each chunk; rank is its place in its record, chunks of a record lie together.
    Functions compose from chunk to chunk; a record starts in START."""
    entry = np.full(len(functions), START, np.uint8)
    by_rank = np.argsort(rank, kind="stable")
    ends = np.cumsum(np.bincount(rank)) if len(rank) else []
    for lo, hi in zip(ends, ends[1:], strict=False):
        at = by_rank[lo:hi]
        entry[at] = functions[at - 1, entry[at - 1]]
    return entry


def tokenize(data: np.ndarray, offsets: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data: bytes of all records; offsets: where each record begins, and the end of the last.

    Returns the last state of each record, where it first turned BAD (-1: never), and all field
    separators as (record, position in data).
    """
    lengths = np.diff(offsets)
    n_chunks = np.maximum(1, -(-lengths // width))
    record = np.repeat(np.arange(len(lengths)), n_chunks)
    rank = np.arange(len(record)) - np.repeat(np.cumsum(n_chunks) - n_chunks, n_chunks)
    at = (offsets[:-1][record] + rank * width)[:, None] + np.arange(width)
    inside = at < offsets[1:][record][:, None]
    classes = np.full(at.shape, PAD, np.uint8)
    classes[inside] = CLASS_OF[data[at[inside]]]
    functions = chunk_functions(classes)
    state = entry_states(functions, rank)
    states = np.empty(classes.shape, np.uint8)
    for j in range(width):
        state = states[:, j] = NEXT[classes[:, j], state]
    last = states[np.cumsum(n_chunks) - 1, -1]
    bad = np.full(len(lengths), -1, np.int64)
    rows, cols = np.nonzero((states == BAD) & inside)
    first = np.unique(record[rows], return_index=True)
    bad[first[0]] = (at[rows, cols] - offsets[:-1][record[rows]])[first[1]]
    rows, cols = np.nonzero((classes == COMMA) & (states == START))
    return last, bad, record[rows], at[rows, cols]


def valid_otpauth(value: str) -> bool:
    """otpauth://totp/ or hotp/, label, ? and parameters with a base32 secret; digits, if given, 6, 7 or 8."""
    m = _OTP.fullmatch(value.strip(WHITE_SPACE))
    if not m:
        return False
    params = [p.split("=", 1) for p in m[1].split("&")]
    secrets = [v for k, v in params if k == "secret"]
    return bool(secrets) and all(_SECRET.fullmatch(v) for v in secrets) and all(v in ("6", "7", "8") for k, v in params if k == "digits")


def _field(raw: bytes) -> str:
    return (raw[1:-1].replace(b'""', b'"') if raw[:1] == b'"' else raw).decode("utf-8", "replace")


def _without_line_end(record: str) -> bytes:
    raw = (record or "").encode("utf-8", "replace")
    return raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\r", b"\n") else raw


def judge(records: list[str | None]) -> Iterator[tuple]:
    """(reason, error_at, title, url, username, password, notes, otpauth) of each record."""
    raws = [_without_line_end(r) for r in records]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    joined = b"".join(raws)
    last, bad, rec, sep = tokenize(np.frombuffer(joined, np.uint8), offsets)
    first_sep = np.searchsorted(rec, np.arange(len(raws) + 1))
    sep, last, bad, offsets = sep.tolist(), last.tolist(), bad.tolist(), offsets.tolist()
    none = (None,) * len(COLUMNS)
    for i in range(len(raws)):
        if last[i] in (QUOTED, BAD):
            yield "quoting", bad[i] if bad[i] >= 0 else offsets[i + 1] - offsets[i], *none
            continue
        cuts = [offsets[i] - 1, *sep[first_sep[i] : first_sep[i + 1]], offsets[i + 1]]
        if len(cuts) != len(COLUMNS) + 1:
            yield "columns", len(cuts) - 1, *none
            continue
        values = [_field(joined[a + 1 : b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        start = lambda k: cuts[k] + 1 - offsets[i]
        if _UNCLEAN.search(values[0]):
            yield "title", start(0), *none
        elif _UNCLEAN.search(values[4]):
            yield "notes", start(4), *none
        elif values[5].strip(WHITE_SPACE) and not valid_otpauth(values[5]):
            yield "otpauth", start(5), *none
        else:
            yield None, None, *values


def parse_records(raw: DataFrame, key: str = "raw_id", record: str = "record") -> DataFrame:
    """(key, reason, error_at, title, url, username, password, notes, otpauth), one row per record.

    reason is null for a valid row. error_at is the byte where quoting breaks (the end, if a quote
    stays open), the number of fields for "columns", else the byte where the bad field begins. A
    null record counts as an empty one and fails by "columns". Narrow: no shuffle, batch by batch;
    the table is tokenized in equal chunks whose transition functions compose, so one very long
    record costs as much as many short ones.
    """
    key_type = raw.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = list(zip(*judge(batch.column(1).to_pylist()), strict=True))
            arrays = [batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "reason", "error_at", *COLUMNS])

    return raw.select(key, record).mapInArrow(run, f"{key} {key_type}, reason string, error_at bigint, " + ", ".join(f"{c} string" for c in COLUMNS))


def valid_rows(parsed: DataFrame, key: str = "raw_id") -> DataFrame:
    return parsed.where("reason is null").select(key, *COLUMNS)


def rejected_rows(parsed: DataFrame, key: str = "raw_id") -> DataFrame:
    return parsed.where("reason is not null").select(key, "reason", "error_at")


_OPEN = "length(text) - length(replace(text, '\"', ''))"


def split_records(chunks: DataFrame, file: str = "file_name", chunk: str = "chunk_no", text: str = "text") -> DataFrame:
    """Records of files that come as text chunks cut anywhere: (file, chunk, record_no, record).

    Whether a chunk begins inside quotes is the composition of the transition functions of the
    chunks before it; on {outside, inside} each is the identity or a swap (an odd number of quotes),
    so the running sum of one bit per chunk composes them, and only that bit is windowed per file.
    Each chunk then cuts itself at the line ends outside quotes; the piece before its first cut is
    joined to the open ends of the chunks before it. Null chunks count as empty. Blank lines are
    records; a last line without line end is one too. A CR LF that is split between two chunks
    gives one line end, because a chunk's leading LF after a CR is dropped.
    """
    c = chunks.select(F.col(file).alias("file"), F.col(chunk).alias("chunk"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = Window.partitionBy("file").orderBy("chunk")
    facts = c.select("file", "chunk", (F.expr(_OPEN) % 2).alias("odd"), F.expr("endswith(text, '\\r')").alias("cr"))
    entry = facts.select("file", "chunk", F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)) % 2, F.lit(0)).alias("inside"), F.coalesce(F.lag("cr").over(order), F.lit(False)).alias("after_cr"))
    schema = "file string, chunk bigint, piece_no bigint, piece string, ended boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile('"|\r\n|\r|\n')
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for f, k, t, inside, after_cr in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                at, n, inside = int(after_cr and not inside and t[:1] == "\n"), 0, bool(inside)
                for m in cut.finditer(t, at):
                    if m[0] == '"':
                        inside = not inside
                    elif not inside:
                        for col, v in zip(out, (f, k, n, t[at : m.start()], True), strict=True):
                            col.append(v)
                        at, n = m.end(), n + 1
                for col, v in zip(out, (f, k, n, t[at:], False), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["file", "chunk", "piece_no", "piece", "ended"])

    pieces = c.join(entry, ["file", "chunk"]).select(F.col("file").cast("string"), F.col("chunk").cast("bigint"), "text", F.col("inside").cast("bigint"), "after_cr").mapInArrow(run, schema)
    # Inside a chunk all pieces but the first and the last are whole records. Those two carry to their neighbours.
    last = Window.partitionBy("file").orderBy("chunk", "piece_no")
    edge = pieces.where("piece_no = 0 or not ended").withColumn("rec", F.coalesce(F.sum(F.col("ended").cast("int")).over(last.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = edge.groupBy("file", "rec").agg(F.min(F.struct("chunk", "piece_no")).alias("at"), F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("chunk", "piece_no", "piece"))), lambda x: x.piece)).alias("record"), F.bool_or("ended").alias("ended"))
    whole = pieces.where("piece_no > 0 and ended").select("file", "chunk", "piece_no", F.col("piece").alias("record"))
    carried = joined.where("ended or record <> ''").select("file", F.col("at.chunk").alias("chunk"), F.col("at.piece_no").alias("piece_no"), "record")
    return whole.unionByName(carried).select(F.col("file").alias(file), F.col("chunk").alias(chunk), F.col("piece_no").alias("record_no"), "record")
