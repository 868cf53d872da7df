"""Texts into containers of a fixed number of tokens.

Sizes are counted where the texts are read. Each input partition packs its own texts best-fit
decreasing; containers that come out full are closed, the others are opened again, and their texts
alone travel, in blocks of bounded size, to a swap-based local search: documents are moved, exchanged
one for one, or two for one between underfull containers whenever that raises the sum of squared
fills, until no such step is left or the lower bound is met.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

CAPACITY = 2_048
#: Texts in one block of a packing task, and so what it holds in memory: sizes only.
BLOCK = 20_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabulary expects a text to be cut before merging.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def load_tokenizer(path: str = TOKENIZER) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
    return tiktoken.Encoding("bytes", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of places in sizes; sizes of 0 go into the first one."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, container), ascending
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        at = bisect_left(room, (s, -1)) if s else 0
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(i)
            insort(room, (free - s, b))
        elif s == 0 and bins:
            bins[0].append(i)
        else:
            bins.append([i])
            if s < capacity:
                insort(room, (capacity - s, len(bins) - 1))
    return bins


class _Open:
    """The containers with room, by free room and by the sizes of the texts they hold.

    least[t, d] is the least room of at least d in a container that holds a text of the t-th size (row
    0: in any container), so the best partner for a step is one look for each pair of sizes. It has
    sizes x capacity places.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int) -> None:
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.fill = [sum(sizes[i] for i in b) for b in bins]
        held = {b for b in range(len(bins)) if bins[b] and self.fill[b] < capacity}
        self.kinds = np.array(sorted({sizes[i] for b in held for i in bins[b]} | {0}), np.int64)
        self.row = {int(t): k for k, t in enumerate(self.kinds)}
        self.none = 2 * capacity + 1
        self.count = np.zeros((len(self.kinds), capacity + 1), np.int32)
        self.least = np.full(self.count.shape, self.none, np.int32)
        self.rooms = np.arange(capacity + 1, dtype=np.int32)
        self.holders: dict[tuple[int, int], set[int]] = {}
        for b in held:
            self._put(b)
        self._refresh(np.arange(len(self.kinds)))

    def _rows(self, b: int) -> list[int]:
        return sorted({self.row[self.sizes[i]] for i in self.bins[b]} | {0})

    def _refresh(self, rows) -> None:
        here = np.where(self.count[rows] > 0, self.rooms, self.none)
        self.least[rows] = np.minimum.accumulate(here[:, ::-1], axis=1)[:, ::-1]

    def _put(self, b: int) -> list[int]:
        free = self.capacity - self.fill[b]
        if not free or not self.bins[b]:
            return []
        rows = self._rows(b)
        self.count[rows, free] += 1
        for r in rows:
            self.holders.setdefault((r, free), set()).add(b)
        return rows

    def _take(self, b: int) -> list[int]:
        free = self.capacity - self.fill[b]
        rows = self._rows(b)
        self.count[rows, free] -= 1
        for r in rows:
            self.holders[r, free].remove(b)
        return rows

    def step(self, a: int) -> bool:
        """The best step that takes load out of a, if there is one: a move of the largest text that fits
        elsewhere, otherwise the exchange that gains most."""
        rows = self._take(a)
        self._refresh(rows)
        found = self._best(a)
        if found:
            b, out, back = found
            rows += self._take(b)
            self.bins[a] = [i for i in self.bins[a] if i not in out] + back
            self.bins[b] = [i for i in self.bins[b] if i not in back] + out
            d = sum(self.sizes[i] for i in out) - sum(self.sizes[i] for i in back)
            self.fill[a] -= d
            self.fill[b] += d
            if not self.fill[a]:  # texts of 0 tokens go along
                self.bins[b] += self.bins[a]
                self.bins[a] = []
            rows += self._put(b)
        self._refresh(sorted({*rows, *self._put(a)}))
        return found is not None

    def _best(self, a: int) -> tuple[int, list[int], list[int]] | None:
        one = {self.sizes[i]: [i] for i in sorted(self.bins[a], key=lambda i: (-self.sizes[i], i)) if self.sizes[i]}
        for s, out in one.items():  # move
            free = int(self.least[0, s])
            if free < self.none and self.capacity - free + s > self.fill[a]:
                return min(self.holders[0, free]), out, []
        mine = sorted((i for i in self.bins[a] if self.sizes[i]), key=lambda i: (-self.sizes[i], i))
        groups = dict(one)
        for k, i in enumerate(mine):
            for j in mine[k + 1 :]:
                groups.setdefault(self.sizes[i] + self.sizes[j], [i, j])
        sums = np.array(list(groups), np.int64)
        best = (0, 0, 0, 0)
        kinds = np.arange(1, len(self.kinds))
        for lo in range(0, len(sums), 256):  # one for one, two for one
            d = sums[lo : lo + 256, None] - self.kinds[None, 1:]
            free = np.where((d > 0) & (d <= self.capacity), self.least[kinds[None, :], np.clip(d, 0, self.capacity)], self.none)
            gain = np.where(free < self.none, d * (self.capacity - free + d - self.fill[a]), 0)
            if gain.size and gain.max() > best[0]:
                g, k = divmod(int(gain.argmax()), gain.shape[1])
                best = (int(gain.max()), int(sums[lo + g]), k + 1, int(free[g, k]))
        gain, s, kind, free = best
        if not gain:
            return None
        b = min(self.holders[kind, free])
        return b, groups[s], [next(i for i in self.bins[b] if self.sizes[i] == self.kinds[kind])]


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Raise the sum of squared fills until a container is empty, again and again. The emptiest is
    attacked first, as long as it has a step; every open container is a partner and every pair of
    texts a candidate. Ends at the lower bound, or after a round in which no container had a step.
    Every step raises the sum by at least 2, so that it ends."""
    bins = [list(b) for b in bins]
    state = _Open(bins, sizes, capacity)
    fill = state.fill
    least = -(-sum(fill) // capacity)
    used = sum(map(bool, bins))
    changed = True
    while changed and used > least:
        changed = False
        for a in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (fill[b], b)):
            while used > least and bins[a] and fill[a] < capacity and state.step(a):
                changed = True
                used -= not bins[a]
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit_decreasing(sizes, capacity), sizes, capacity)


_DDL = "piece_no bigint, token_start bigint, n_tokens bigint, bin bigint"


def _sized(key_type: str, key: str, capacity: int, block: int, tokenizer: str):
    names = [key, "piece_no", "token_start", "n_tokens", "bin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_tokenizer(tokenizer).encode_ordinary
        held: list[pa.Array] = []
        sizes: list[int] = []
        done: list[tuple] = []
        used = 0

        def flush() -> pa.RecordBatch:
            nonlocal used
            bins = best_fit_decreasing(sizes, capacity)
            of = [None] * len(sizes)
            for b in bins:
                if sum(sizes[i] for i in b) == capacity:
                    for i in b:
                        of[i] = used
                    used += 1
            keys = pa.concat_arrays(held)
            rows = [(at, k, k * capacity, n, of[i] if i >= 0 else whole) for at, k, n, i, whole in done]
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names=names)

        offset = 0
        for batch in batches:
            held.append(batch.column(0))
            for at, t in enumerate(batch.column(1).to_pylist()):
                n = len(count(t)) if t else 0
                k = 0
                while n > capacity:  # pieces of an oversized text: full ones need no company
                    done.append((offset + at, k, capacity, -1, used))
                    used, n, k = used + 1, n - capacity, k + 1
                done.append((offset + at, k, n, len(sizes), None))
                sizes.append(n)
            offset += batch.num_rows
            if len(sizes) >= block:
                yield flush()
                held, sizes, done, offset = [], [], [], 0
        if done:
            yield flush()

    return run


def assign(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, piece_no, token_start, n_tokens, container): a container for every text, or for each piece
    of one that alone is larger than capacity.

    Null and empty texts have 0 tokens and get a container too. Repeated texts are texts of their
    own. Texts are tokenized once, whole, where they are read; the sizes (40 bytes a text) are
    written to the shared folder. A container is full, or belongs to one block of the search, so at
    most a few per block of 20,000 texts have room left. No cap: every text is placed.
    """
    key_type = documents.schema[key].dataType.simpleString()
    sized = documents.select(key, text).mapInArrow(_sized(key_type, key, capacity, block, tokenizer), f"{key} {key_type}, {_DDL}")
    sized = cut(sized.withColumn("part", F.spark_partition_id().cast("bigint")).withColumn("row", F.monotonically_increasing_id()))
    full = sized.where("bin is not null").select(key, "piece_no", "token_start", "n_tokens", F.concat_ws("-", F.lit("f"), "part", "bin").alias("container"))
    open_ = sized.where("bin is null")
    n_blocks = max(1, -(-open_.count() // block))
    names = [key, "piece_no", "token_start", "n_tokens", "container"]

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("row", "ascending")])
        sizes = table["n_tokens"].to_pylist()
        of = [0] * len(sizes)
        for no, b in enumerate(pack(sizes, capacity)):
            for i in b:
                of[i] = no
        prefix = f"s-{table['block'][0].as_py()}-"
        return table.select(names[:-1]).append_column("container", pa.array([f"{prefix}{no}" for no in of]))

    # Blocks by a hash of the row, not of the key or the text, so that copies spread evenly.
    blocked = open_.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks))).select(key, "piece_no", "token_start", "n_tokens", "row", "block")
    searched = blocked.groupBy("block").applyInArrow(search, f"{key} {key_type}, piece_no bigint, token_start bigint, n_tokens bigint, container string")
    return full.unionByName(searched)


def fill_report(assigned: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, mean fill."""
    bins = assigned.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    return bins.agg(F.count("*").alias("n_containers"), F.sum("fill").alias("n_tokens"), F.ceil(F.sum("fill") / capacity).alias("least_containers"), F.max("fill").alias("most_in_one"), F.round(F.avg("fill") / capacity, 6).alias("mean_fill"))
