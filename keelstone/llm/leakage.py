"""Test items inside training documents, by pigeonhole seeds and bit-parallel edit distance.

Texts are compared word by word: lower case, no punctuation, no markup. What counts are stretches of
eight words of an item that the document holds with at most so many errors (words changed, left out or
put in; 0 where "in a row" means letter by letter). An item is cut into pieces of (8 + 1) // (errors + 2)
words: a stretch of eight then holds at least errors + 1 whole pieces wherever it begins, and so many
errors leave one of them untouched. All pieces are searched at once with an Aho-Corasick automaton;
around each hit, every stretch of eight with the piece in it is judged by Myers' bit-parallel edit
distance, on words: it counts if the distance is within the budget, and nothing else decides. A
document counts for an item if its stretches together cover a third of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 8
#: Items go to the tasks in blocks of about this many characters, one automaton (some 64 bytes a character) in memory at a time.
BLOCK_CHARS = 4_000_000
#: With more than one block, a task holds back documents of so many characters and meets them with one block after the other.
HELD_CHARS = 30_000_000
#: An opening sentence that at least this many items share is an instruction and does not count.
SHARED_BY = 3

_WORD = re.compile(r"[^\W_]+")
_MARKUP = re.compile(r"<[/!?A-Za-z][^<>]*>")
_DROPPED = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")
_SENTENCE = re.compile(r"[^.!?]*[.!?]")


def words_of(text: str) -> list[str]:
    """The words by which texts are compared."""
    if "\\" in text:
        text = text.replace("\\r", " ").replace("\\n", " ").replace("\\t", " ")
    if "<" in text:
        text = _MARKUP.sub(" ", text)
    if not text.isascii():
        text = _DROPPED.sub("", text)
    return _WORD.findall(text.lower())


def opening_of(text: str) -> list[str]:
    """The words of the first sentence."""
    m = _SENTENCE.match(text)
    return words_of(m[0]) if m else []


def piece_length(errors: int) -> int:
    """Words of a piece, so that errors + 1 whole ones lie in any stretch of eight."""
    if not 0 <= errors <= RUN - 1:
        raise ValueError("errors must lie between 0 and 7")
    return max(1, (RUN + 1) // (errors + 2))


def edit_distance(pattern: list[str], text: list[str]) -> int:
    """Myers: the least edit distance of pattern to any stretch of text, a bit per pattern word."""
    m = len(pattern)
    if not m:
        return 0
    at: dict[str, int] = {}
    for i, w in enumerate(pattern):
        at[w] = at.get(w, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text:
        eq = at.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = (minus | ~(xh | plus)) & full, plus & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv
        if score < best:
            best = score
    return best


def build(items: list[tuple[int, list[str]]], piece: int) -> ahocorasick.Automaton | None:
    """Automaton over all pieces; the value of a piece lists the (item, word) places it stands for."""
    places: dict[str, list[tuple[int, int]]] = {}
    for no, (_, words) in enumerate(items):
        for k in range(0, len(words) - piece + 1, piece):
            places.setdefault(f" {' '.join(words[k : k + piece])} ", []).append((no, k))
    if not places:
        return None
    machine = ahocorasick.Automaton()
    for text, at in places.items():
        machine.add_word(text, at)
    machine.make_automaton()
    return machine


def stretches(words: list[str], joined: str, machine: ahocorasick.Automaton, items: list[tuple[int, list[str]]], piece: int, errors: int) -> dict[int, tuple[set[int], int]]:
    """For each item found: the first words of its stretches within the budget, and the least distance."""
    out: dict[int, tuple[set[int], int]] = {}
    failed: set[tuple[int, int, int]] = set()
    word_no, before = 0, 0
    for end, at in machine.iter(joined):
        # end is the blank after the last word of the piece: count the blanks before it.
        word_no += joined.count(" ", before, end)
        before = end
        p = word_no - piece
        for no, k in at:
            item = items[no][1]
            for w in range(max(0, k + piece - RUN), min(k, len(item) - RUN) + 1):
                known = out.get(no)
                if known and w in known[0] and not (errors and known[1]):
                    continue
                a = p - (k - w)
                if (no, w, a) in failed:
                    continue
                d = edit_distance(item[w : w + RUN], words[max(0, a - errors) : max(0, a + RUN + errors)])
                if d > errors:
                    failed.add((no, w, a))
                elif known:
                    known[0].add(w)
                    out[no] = known[0], min(known[1], d)
                else:
                    out[no] = {w}, d
    return out


def covered(starts: set[int]) -> tuple[int, int]:
    """Words that stretches of eight with these first words cover together, and the most of them in a row."""
    total = longest = run = end = 0
    for a in sorted(starts):
        new = a + RUN - max(a, end)
        run = run + new if a <= end and total else new
        total, longest, end = total + new, max(longest, run), a + RUN
    return total, longest


def item_words(eval_items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(key, words): items as words, without an opening sentence that SHARED_BY items or more share. Openings
    are counted over all items, so no split into blocks changes them. Null keys and texts are left out."""
    kind = eval_items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            words = [words_of(t) for t in texts]
            opening = [opening_of(t) for t in texts]
            cols = [batch.column(0), pa.array(words, pa.list_(pa.string())), pa.array(map(" ".join, opening), pa.string()), pa.array(map(len, opening), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "words", "opening", "n_opening"])

    rows = eval_items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, words array<string>, opening string, n_opening bigint")
    shared = rows.where("n_opening > 0").groupBy("opening").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED_BY).select("opening", F.lit(True).alias("is_shared"))
    rest = F.when(F.col("is_shared"), F.expr("slice(words, cast(n_opening as int) + 1, size(words))")).otherwise(F.col("words"))
    return rows.join(shared, "opening", "left").select(key, rest.alias("words"))


def _blocks(items: DataFrame, key: str, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    block, size = [], 0
    for r in items.where(F.size("words") >= RUN).orderBy(key, "words").toLocalIterator():
        block.append((r[0], r[1]))
        size += sum(map(len, r[1]))
        if size >= most:
            yield block
            block, size = [], 0
    if block:
        yield block


def item_hits(documents: DataFrame, eval_items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", errors: int = 0, block_chars: int = BLOCK_CHARS, held_chars: int = HELD_CHARS) -> DataFrame:
    """(doc_key, item_key, n_item_words, n_covered, longest_run, least_distance) for every document and
    item that share a stretch of eight words with at most so many errors.

    The stated set of items goes to the documents, in blocks of a fixed size. The documents are read
    once, whole, and nothing is shuffled: with several blocks a task holds back a bounded number of
    characters and meets them with one block after the other. The result does not depend on block_chars
    or held_chars. Null texts and items of less than eight words give no hit; repeated documents or
    items give a row each.
    """
    spark = documents.sparkSession
    types = documents.schema[doc_key].dataType.simpleString(), eval_items.schema[item_key].dataType.simpleString()
    ddl = f"{doc_key} {types[0]}, {item_key} {types[1]}, n_item_words bigint, n_covered bigint, longest_run bigint, least_distance bigint"
    piece = piece_length(errors)
    sent = [spark.sparkContext.broadcast(block) for block in _blocks(item_words(eval_items, item_key, text), item_key, block_chars)]
    if not sent:
        return spark.createDataFrame([], ddl)

    def meet(keys: pa.Array, texts: list[str | None], items, machine) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for at, t in enumerate(texts):
            if not t:
                continue
            words = words_of(t)
            for no, (starts, least) in stretches(words, f" {' '.join(words)} ", machine, items, piece, errors).items():
                rows.append((at, items[no][0], len(items[no][1]), *covered(starts), least))
        if rows:
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), *map(pa.array, cols[1:])], names=[doc_key, item_key, "n_item_words", "n_covered", "longest_run", "least_distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(sent) == 1:
            items = sent[0].value
            machine = build(items, piece)
            for batch in batches:
                yield from meet(batch.column(0), batch.column(1).to_pylist(), items, machine)
            return

        def all_blocks(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in sent:
                items = block.value
                machine = build(items, piece)
                for batch in held:
                    yield from meet(batch.column(0), batch.column(1).to_pylist(), items, machine)
                del items, machine
                block._value = None  # read again from its file when it is next wanted

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= held_chars:
                yield from all_blocks(held)
                held = []
        if held:
            yield from all_blocks(held)

    return documents.select(doc_key, text).mapInArrow(run, ddl)


def leaked(hits: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """Documents whose stretches cover at least a third of an item."""
    return hits.where((F.col("n_covered") > 0) & (F.col("n_covered") * 3 >= F.col("n_item_words"))).select(doc_key, item_key)
