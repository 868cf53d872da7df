"""Text quality statistics per document, and the structural class of texts that are no prose.

A text is cut into stretches of one layout (marked items, pairs, cells, loose fragments, running
text). What runs like text gets two distributions: of its characters over classes, and of its words
over function words, the most frequent other word, and the rest. Each is compared by Jensen-Shannon
divergence with the prose profile of every language and with profiles of encoded, symbolic and
mashed junk; the nearest profile holds. The class of the document is the one that has most of its
characters; prose wins if it has at least half of those that are no white space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: common_words is a table of a few hundred rows; more than this is refused rather than broadcast.
MOST_COMMON_WORDS = 20_000
#: A text with fewer letters and digits than this is next to empty.
LEAST_CHARS = 20

# Character classes: a lower case, A upper case, e other letters, 0 digit, blank white space, . sentence punctuation, " quotes and brackets, # other ASCII, x other.
CHAR_CLASSES = "aAe0 .\"#x"
WORD_CLASSES = ("function", "top", "rest")
# Profiles: shares of the character classes above, then of the word classes; rounded means over running text.
PROFILES: dict[str, tuple[tuple[float, ...], tuple[float, ...]]] = {
    "prose:en": ((0.800, 0.012, 0.000, 0.003, 0.165, 0.018, 0.002, 0.000, 0.000), (0.46, 0.04, 0.50)),
    "prose:de": ((0.790, 0.040, 0.012, 0.003, 0.135, 0.020, 0.002, 0.000, 0.000), (0.45, 0.04, 0.51)),
    "prose:fr": ((0.775, 0.012, 0.030, 0.003, 0.155, 0.023, 0.002, 0.000, 0.000), (0.44, 0.05, 0.51)),
    "prose:es": ((0.785, 0.012, 0.025, 0.003, 0.160, 0.015, 0.002, 0.000, 0.000), (0.42, 0.05, 0.53)),
    "junk:encoded": ((0.400, 0.410, 0.000, 0.155, 0.005, 0.000, 0.000, 0.030, 0.000), (0.01, 0.05, 0.94)),
    "junk:hex": ((0.260, 0.000, 0.000, 0.420, 0.320, 0.000, 0.000, 0.000, 0.000), (0.10, 0.10, 0.80)),
    "junk:symbols": ((0.000, 0.000, 0.000, 0.000, 0.050, 0.250, 0.100, 0.600, 0.000), (0.00, 0.00, 1.00)),
    "junk:pictures": ((0.000, 0.000, 0.000, 0.000, 0.350, 0.000, 0.000, 0.000, 0.650), (0.00, 0.00, 1.00)),
    "junk:mashed": ((0.800, 0.000, 0.000, 0.000, 0.130, 0.070, 0.000, 0.000, 0.000), (0.03, 0.02, 0.95)),
    "junk:damaged": ((0.480, 0.010, 0.200, 0.002, 0.100, 0.010, 0.002, 0.000, 0.196), (0.05, 0.15, 0.80)),
    "junk:salad": ((0.820, 0.000, 0.010, 0.000, 0.170, 0.000, 0.000, 0.000, 0.000), (0.76, 0.23, 0.01)),
}

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<[^<>\n]{1,200}>")
_LETTERS = re.compile(r"[^\W\d_]+")
_LAYOUT = re.compile(
    r"""(?P<blank>\s*\Z)
      |(?P<marked>\s*(?:[-*+•‣◦▪●–—]\ (?!\ )|\[[ xX]\]\s|\(?\d{1,3}[.)]\s|\(?[A-Za-z][.)]\s)|\#\#\ \d[\d.]*\s*\Z|.*\(\#\d+\)\s*\Z)
      |(?P<pair>\s*(?:https?://\S+\s*\Z|(?:GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\ \S+\s*\Z|HTTP(?:/[\d.]+)?\ (?:\d{3}|\*)\s*\Z|\[\w+\]\s*\Z|(?:jsonpath|xpath|header|status|body|cookie|duration)\b.{0,80}\Z|[\w$.-]{1,40}\s?[:=]\s?[^.!?]{1,80}\Z))
      |(?P<cells>\s*\|.*\|\s*\Z|(?=.*[-=]{3})[\s=+|-]+\Z)""",
    re.X,
)
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_SENTENCE_BREAK = re.compile(r"[^\W\d_][.!?;][\"'”»)]? +[\"'“«(¿¡]?[A-ZÀ-Þ\d]")
_ENDS = tuple(".!?…:;\"'”»)")


def _char_table() -> dict[int, str]:
    table = {}
    for i in range(0x250):
        c = chr(i)
        table[i] = "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "0" if c.isdigit() else " " if c.isspace() and i != 0x85 and i != 0xA0 else "." if c in ".,;:!?" else '"' if c in "\"'()[]{}«»" else "#" if 32 < i < 127 else "e" if c.isalpha() else "x"
    return table | {ord(c): '"' for c in "“”„‘’‹›"} | {ord(c): "." for c in "…–—"} | {0xA0: " "}


_CHAR = _char_table()


def divergence(p: tuple[float, ...], q: tuple[float, ...]) -> float:
    """Jensen-Shannon divergence in bits, 0 to 1."""
    d = 0.0
    for a, b in zip(p, q, strict=True):
        m = (a + b) / 2
        if a:
            d += a * log2(a / m) / 2
        if b:
            d += b * log2(b / m) / 2
    return d


def char_shares(text: str) -> tuple[float, ...]:
    if text.isascii():
        counts = Counter(text.translate(_CHAR))
    else:
        counts = Counter()
        for c, n in Counter(text).items():
            counts[_CHAR.get(ord(c)) or ("e" if c.isalpha() else " " if c.isspace() else "x")] += n
    n = len(text) or 1
    return tuple(counts[c] / n for c in CHAR_CLASSES)


def nearest(text: str, common: dict[str, frozenset[str]]) -> tuple[str, float]:
    """The nearest profile of a running text and its divergence (of characters and words, 0 to 2)."""
    words = Counter(_LETTERS.findall(text.lower()))
    n = sum(words.values())
    chars = char_shares(text)
    function = {lang: sum([k for w, k in words.items() if w in s]) for lang, s in common.items()}
    lang = max(function, key=function.get, default="en")
    own = common.get(lang, frozenset())
    top = max([k for w, k in words.items() if w not in own], default=0)
    f = function.get(lang, 0)
    shares = (f / n, top / n, (n - f - top) / n) if n else (0.0, 0.0, 1.0)
    score = {name: divergence(chars, c) + divergence(shares, w) for name, (c, w) in PROFILES.items()}
    best = min(score, key=score.get)
    return best, score[best]


def _wraps(lines: list[str]) -> bool:
    """Whether the lines look like text wrapped at one width: the next first word would not have fitted."""
    width = max(map(len, lines))
    full = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width - 1 for a, b in zip(lines, lines[1:], strict=False) if b.strip())
    return full * 2 > len(lines) - 1


def _cells(lines: list[str]) -> bool:
    """Whether a stretch of lines is rows of delimited or aligned cells."""
    n = len(lines)
    if n < 2:
        return False
    for d in "\t;,|":
        k, rows = Counter(x.count(d) for x in lines).most_common(1)[0]
        if k >= 2 and rows >= 0.7 * n and (d in "\t|" or sum(x.count(d + " ") for x in lines) * 2 < k * n):
            return True
        if d == "\t" and k == 1 and rows >= 0.9 * n and not any("  " in x for x in lines):
            return True
    starts = Counter(m.end() for x in lines for m in _GAP.finditer(x))
    return n >= 3 and bool(starts) and starts.most_common(1)[0][1] >= 0.5 * n


def _fragments(lines: list[str]) -> bool:
    """Whether loose lines are one-line fragments: short, mostly letters, not wrapped at one width."""
    if len(lines) < 3 or sum(map(len, lines)) > 60 * len(lines):
        return False
    if sum(x[-1:].isspace() or "\t" in x or "  " in x.lstrip() for x in lines) * 4 > len(lines):  # broken spacing, not items
        return False
    joined = "".join(lines)
    if sum(map(str.isalpha, joined)) * 2 < len(joined) - joined.count(" "):
        return False
    if sum(len(_SENTENCE_BREAK.findall(x)) for x in lines) * 400 > len(joined):  # sentences begin inside lines
        return False
    return not _wraps([x.rstrip() for x in lines])


def structure(text: str, common: dict[str, frozenset[str]]) -> tuple[str, str | None, float | None]:
    """(class, nearest profile, divergence) of a text; class is prose, list, table or junk. Profile and
    divergence are those of its running text: None without any, so for a mere list or table; a text
    next to empty has the profile "empty" and no divergence."""
    mass: Counter[str] = Counter()
    best: str | None = None
    distance: float | None = None
    runs: list[list[str]] = []
    kind_before = ""
    for line in text.split("\n"):
        kind = _LAYOUT.match(line)
        kind = kind.lastgroup if kind else "running"
        if kind in ("marked", "pair", "cells") and len(line) > 400 or kind == "marked" and line[:1].isalpha() and line[1:2] == "." and len(line) > 160:
            kind = "running"
        if kind == "blank":
            kind_before = ""
            continue
        if kind != kind_before:
            runs.append([kind])
            kind_before = kind
        runs[-1].append(line)
    loose: list[str] = []
    for kind, *lines in runs:
        n = sum(len(x) - x.count(" ") for x in lines)
        if kind == "cells":
            mass["table"] += n
        elif kind != "marked" and len(lines) > 1 and _cells(lines):
            mass["table"] += n
        elif kind == "marked" or kind == "pair":
            mass["list"] += n
        elif _fragments(lines):
            mass["list"] += n
        else:
            loose.append("\n".join(lines))
    if loose:
        running = "\n".join(loose)
        plain = _TAG.sub(" ", running)
        best, distance = nearest(plain if plain.strip() else running, common)
        mass["prose" if best.startswith("prose") else "junk"] += len(running) - running.count(" ") - running.count("\n")
    total = sum(mass.values())
    if sum(map(str.isalnum, text[:4_000])) < LEAST_CHARS and sum(map(str.isalnum, text)) < LEAST_CHARS:
        return "junk", "empty", None
    if mass["prose"] * 2 >= total:
        return "prose", best, distance
    del mass["prose"]
    return mass.most_common(1)[0][0], best, distance


_STATS = [("n_chars_seen", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_lines", pa.int64()), ("n_lines_ended", pa.int64()), ("n_common", pa.int64()), ("doc_class", pa.string()), ("nearest_profile", pa.string()), ("divergence", pa.float64())]


def _counts(text: str, every: frozenset[str]) -> tuple[int, ...]:
    words = _WORD.findall(text)
    lines = [x.rstrip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    joined = sum(map(len, words))
    spaces = len(text) - len("".join(text.split()))
    lower = Counter(map(str.lower, words))
    return len(text), len(words), joined, len(text) - joined - spaces, len(lines), sum([x.endswith(_ENDS) for x in lines]), sum([n for w, n in lower.items() if w in every])


def common_word_sets(common_words: DataFrame) -> dict[str, frozenset[str]]:
    rows = common_words.where("lang is not null and word is not null").limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError("common_words has too many rows to be sent to every task")
    langs = sorted({r.lang for r in rows})
    return {lang: frozenset(r.word.lower() for r in rows if r.lang == lang) for lang in langs}


def text_quality(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, doc_class, nearest_profile and its divergence (see structure).

    One narrow pass over whole texts, no shuffle. Null texts count as empty, which is junk; repeated
    rows give repeated rows; without common words a text can still be told from symbols and cells.
    """
    common = common_word_sets(common_words)
    every = frozenset().union(*common.values())
    key_type = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*_counts(t, every), *structure(t, common)) for t in (x or "" for x in batch.column(1).to_pylist())]
            if rows:
                arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _STATS, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *(n for n, _ in _STATS)])

    ddl = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'string' if t == pa.string() else 'double'}" for n, t in _STATS)
    return documents.select(key, text).mapInArrow(run, f"{key} {key_type}, {ddl}")


def not_prose(quality: DataFrame, key: str = "doc_id") -> DataFrame:
    return quality.where("doc_class <> 'prose'").select(key, "doc_class")


def shares(quality: DataFrame, key: str = "doc_id") -> DataFrame:
    """The usual per-document statistics; shares of nothing are 0."""
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return quality.select(key, "n_words", per("word_chars", "n_words").alias("mean_word_len"), per("n_symbols", "n_chars_seen").alias("symbol_share"), per("n_lines_ended", "n_lines").alias("ended_line_share"), per("n_common", "n_words").alias("common_word_share"))
