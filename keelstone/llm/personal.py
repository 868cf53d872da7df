"""Personal information in free text: find it, and put surrogates or placeholders in its place.

Surrogates are keyed and of the same kind as what they replace: a phone number keeps its country
and grouping, a street its type, an address its order, an e-mail address its top-level domain, a
person their title, gender, script and spelling in capitals. Letters and digits are permuted by a
format-preserving Feistel network, vowels among vowels, consonants among consonants, digits among
digits, so distinct values of one shape get distinct surrogates by construction, and a name gets
the same one wherever and however it is written. A permuted word that would meet a listed name, a title
or a street type is permuted again until it does not, which keeps distinct words distinct; collisions()
checks that over all data. People are found by the model of persons.py, all else by patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import persons
from .persons import FEMALE, GENDER, MALE, TITLES

KINDS = ("email", "id_number", "phone", "address", "person")

_FILE_ENDINGS = frozenset("png jpg jpeg gif svg webp bmp ico pdf css js html xml json csv txt zip".split())

_EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]*\w\s?(?:@|[(\[{]\s?(?:at|AT)\s?[)\]}]\s?)(?:[\w-]+(?:\.|\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?))+([A-Za-z]{2,24})(?![\w-])")
_IDS = re.compile(
    r"""(?<![\w+-])(?:
      (?:passport|passeport|pasaporte|reisepass)(?:\s?(?:no|nr|nº|n°|number)\b\.?)?:?\s?(?=[A-Z0-9]*\d)[A-Z0-9]{6,12}
    | (?:driving\ licen[cs]e|driver'?s?\ licen[cs]e|führerschein|permis\ de\ conduire|permiso\ de\ conducir)(?:\s?(?:no|nr|nº|n°)\b\.?)?:?\s?(?=[A-Z0-9]*\d)[A-Z0-9]{7,18}
    | (?:social\ security(?:\ no\.?|\ number)?|ssn|tin|itin)\s?:?\s?\d{3}[-\ .]?\d{2}[-\ .]?\d{4}
    | (?:steuer-?id|steuernummer|tax\ id)(?:\s?(?:no|nr)\b\.?)?:?\s?\d{2}[\ ]?\d{3}[\ ]?\d{3}[\ ]?\d{3}
    | (?:ni\ number|ni\ no\.?|nino)\s?:?\s?[A-Z]{2}[\ ]?\d{2}[\ ]?\d{2}[\ ]?\d{2}[\ ]?[A-D]
    | (?:dni|nie|nif)\s?:?\s?[XYZ]?\d{7,8}-?[A-Z]
    | nir\s?:?\s?[12]\s?\d{2}\s?\d{2}\s?\d[\dAB]\s?\d{3}\s?\d{3}(?:\s?\d{2})?
    | (?-i:\d{3}([-\ ])\d{2}\1\d{4}
    | [A-Z]{2}[\ ]?\d{2}[\ ]?\d{2}[\ ]?\d{2}[\ ]?[A-D]
    | \d{8}[A-Z] | [XYZ]\d{7}[A-Z] | X\d{8}
    | [12]\ \d{2}\ \d{2}\ \d[\dAB]\ \d{3}\ \d{3}(?:\ \d{2})? | [12]\d{2}(?:0[1-9]|1[0-2])\d[\dAB]\d{3}\d{3}\d{2}
    | \d{2}\ \d{3}\ \d{3}\ \d{3}
    | [A-Z9]{5}\d{6}[A-Z]{2}\d[A-Z]{0,2}
    | [CFGHJK](?=[0-9CFGHJ-NPRTV-Z]{8}\b)(?=(?:\w*\d){3})[0-9CFGHJ-NPRTV-Z]{8}))(?![\w-]|/\d|\.\d)""",
    re.X | re.I,
)
_PHONE = re.compile(
    r"""(?<![\w+@.-])(?:
      (?:\+1[\ .-]?|001[\ .-]?)?\(\d{3}\)\ ?\d{3}[-.\ ]\d{4}
    | 1(?P<one>[-.])\d{3}(?P=one)\d{3}(?P=one)\d{4}
    | (?:\+1[\ .-]?|001[\ .-]?)?\d{3}(?P<sep>[-.])\d{3}(?P=sep)\d{4}
    | (?:\+1[\ .-]?|001[\ .-]?|(?<!\d[\ /]))\d{3}[-.\ ]\d{3}[-.\ ]\d{4}
    | \+[1-9]\d{8,13}
    | (?:\+|00)44[\ .-]?(?:\(0\)\ ?)?\d{2,5}[\ .-]?\d{3,6}(?:[\ .-]\d{3,4})?
    | (?:\+|00)33[\ .-]?(?:\(0\)\ ?)?[1-9](?:[\ .-]?\d{2}){4}
    | (?:\+|00)(?:34|351)[\ .-]?\d{3}[\ .-]?\d{3}[\ .-]?\d{3}
    | (?:\+|00)(?:49|39|43|41|31|32|353)[\ .-]?(?:\(0\)\ ?)?\d{1,4}[\ /-]?\d{3,8}(?:[-\ ]\d{2,4})?
    | 0[1-9](?:[\ .]\d{2}){4}
    | 07\d{3}[\ ]?\d{3}[\ ]?\d{3}
    | 0\d{2,4}[/-]\d{3,8}(?:[-\ ]\d{1,5})?
    | (?<!\d[\ /])[679]\d{2}\ \d{3}\ \d{3}
    )(?![\w-]|[./]\d)""",
    re.X,
)
_TOWN = r"[^\W\d_]+(?:[-'][^\W\d_]+)*"
# A word of a street name: with a capital, and neither an article nor the type of a street.
_CAPITAL = r"(?-i:(?!The\b|Street\b|Road\b)[A-ZÀ-Þ])[^\W\d_]*(?:-[^\W\d_]+)*"
_SEP = r"(?:,\s*|\s*\n\s*)"
_NAME = r"[^\W\d_]+(?:-[^\W\d_]+)*"
_ADDRESS = re.compile(
    rf"""(?<![\w.:/-])(?:
      (?:(?:apt|apartment|flat|unit|suite)\.?\ \w{{1,5}}{_SEP})?\d{{1,5}}[a-z]?\ (?:{_CAPITAL}\ ){{1,2}}(?:street|road|avenue|lane|row|drive|court|place|square|boulevard|terrace|close|way|blvd|ave|rd|st|ln|dr)\b\.?
        (?:,?\sin\s{_TOWN}|{_SEP}{_TOWN}(?:(?:,\s*|\s)(?:[A-Z]{{1,2}}\d{{1,2}}\ \d[A-Z]{{2}}|\d{{5}}))?(?=\W|$))?
    | (?:calle|avenida|avda\.?|plaza|paseo|camino|carrer|c/)\ (?:(?:de|del|la|las|los)\ )?{_NAME}(?:\ {_NAME})?,?\ \d{{1,4}}(?:{_SEP}\d{{1,2}}[º°ª]\ ?[A-Z]?\b)?(?:{_SEP}\d{{5}}\s{_TOWN})?
    | \d{{1,4}}(?:\ (?:bis|ter|quater))?,?\ (?:rue|avenue|boulevard|place|chemin|quai|impasse|allée|cours)\ (?:(?:de\ la|de|du|des)\ |de\ l'|d')?{_NAME}(?:{_SEP}\d{{5}}\s{_TOWN})?
    | {_NAME}(?:straße|strasse|str\.?|weg|gasse|platz|allee|ufer|damm|ring)\ \d{{1,4}}[a-z]?(?:{_SEP}\d{{5}}\s{_TOWN})?
    )""",
    re.X | re.I,
)
_WORD = re.compile(r"[^\W\d_]+")


def find(text: str, names: persons.Model | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what is found, in order, without overlaps; earlier kinds win. names is the
    fitted model of names, the one of the sample if not given."""
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(text))

    def free(a: int, b: int) -> bool:
        return used.find(1, a, b) < 0

    def take(a: int, b: int, kind: str) -> None:
        if free(a, b):
            used[a:b] = b"\1" * (b - a)
            taken.append((a, b, kind))

    if "@" in text or "at" in text.lower():
        for m in _EMAIL.finditer(text):
            if m[1].lower() not in _FILE_ENDINGS:
                take(*m.span(), "email")
    if any(map(str.isdigit, text)):
        for kind, pattern in (("id_number", _IDS), ("phone", _PHONE), ("address", _ADDRESS)):
            for m in pattern.finditer(text):
                take(*m.span(), kind)
    for a, b in persons.find(text, names or persons.model(), free):
        take(a, b, "person")
    return sorted(taken)


class Surrogates:
    """Keyed, bijective, shape-preserving replacements."""

    ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", "áàâäãåæéèêëíìîïóòôöõøúùûüýœ", "çñšžčćðłřß", "".join(map(chr, range(0x3B1, 0x3C2))), "".join(map(chr, range(0x430, 0x450))))
    CLASS = {c: (i, k) for i, a in enumerate(ALPHABETS) for k, c in enumerate(a)}
    #: Words that carry the kind and the form of a mention, not the person.
    KEPT = TITLES | frozenset("""apt apartment flat unit suite street road avenue lane row drive court place square boulevard terrace close way blvd ave rd st ln in calle avenida avda
        plaza paseo camino carrer rue bis ter quater chemin quai impasse allée cours de la du des del las los le passport passeport pasaporte reisepass no nr number driving licence license
        führerschein social security ssn tin itin steuer id steuernummer tax ni nino dni nie nif nir permis conduire permiso conducir at dot mailto""".split())  # fmt: skip

    def __init__(self, key: str) -> None:
        self.key = key.encode()[:64]
        self.names = {g: dict(zip(sorted(p), sorted(p, key=lambda n: self._hash(f"name:{n}")), strict=True)) for g, p in (("f", FEMALE), ("m", MALE))}

    def _hash(self, text: str) -> int:
        return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=16, key=self.key).digest(), "big")

    def permute(self, digits: list[int], radix: int, tweak: str) -> list[int]:
        """A bijection on digit strings of one length (Feistel, eight rounds)."""
        n = len(digits)
        if n == 1:
            return [(digits[0] + self._hash(f"{tweak}:1:{radix}")) % radix]
        u = n // 2
        number = lambda ds: sum(d * radix**i for i, d in enumerate(ds))
        a, b, na, nb = number(digits[:u]), number(digits[u:]), u, n - u
        for r in range(8):
            a, b, na, nb = b, (a + self._hash(f"{tweak}:{r}:{n}:{radix}:{b}")) % radix**na, nb, na
        out = []
        for x, k in ((a, na), (b, nb)):
            for _ in range(k):
                x, d = divmod(x, radix)
                out.append(d)
        return out

    def shape(self, text: str, tweak: str) -> str:
        """Each class of characters permuted among itself; case, order and other characters stay."""
        low = text.lower() if len(text.lower()) == len(text) else text
        out = list(text)
        for no, alphabet in enumerate(self.ALPHABETS):
            at = [i for i, c in enumerate(low) if c in self.CLASS and self.CLASS[c][0] == no]
            if at:
                for i, d in zip(at, self.permute([self.CLASS[low[i]][1] for i in at], len(alphabet), f"{tweak}:{no}"), strict=True):
                    c = alphabet[d]
                    out[i] = c.upper() if text[i].isupper() and len(c.upper()) == 1 else c
        return "".join(out)

    def walk(self, text: str, tweak: str, taken) -> str:
        """shape() on the words that taken denies: it is applied again until the result is one of them, which
        keeps it a bijection there, and no result is a word with a meaning of its own."""
        out = self.shape(text, tweak)
        while taken(out.lower()):
            out = self.shape(out, tweak)
        return out

    def _cased(self, like: str, name: str) -> str:
        return name.upper() if like.isupper() and len(like) > 1 else name.title() if like[0].isupper() else name

    def of(self, text: str, kind: str) -> str:
        if kind == "email":
            end = re.search(r"[A-Za-z]+\Z", text).start()
            # " (at) " and " (dot) " are spelling, not content.
            return "".join(self.shape(p, "email") if i % 2 == 0 else p for i, p in enumerate(re.split(r"(\s?[(\[{]\s?(?:at|AT|dot|DOT)\s?[)\]}]\s?)", text[:end]))) + text[end:]
        if kind == "phone":
            head = re.match(r"(?:\+|00)(?:1(?=\D|\d{10}\b)|44|33|49|34|351|39|43|41|31|32|353)\D*|0[1-9]?|", text).end()
            return text[:head] + self.shape(text[head:], "phone")
        if kind == "person":
            return _WORD.sub(lambda m: self._name(m[0]), text)
        return re.sub(r"[^\W_]+", lambda m: m[0] if m[0].lower() in self.KEPT else self._street(m[0]) if kind == "address" else self.walk(m[0], kind, self.KEPT.__contains__), text)

    def _street(self, word: str) -> str:
        m = re.search(r"(?:straße|strasse|str|weg|gasse|platz|allee|ufer|damm|ring)\Z", word, re.I)
        cut = m.start() if m else len(word)
        return (self.walk(word[:cut], "address", self.KEPT.__contains__) if cut else "") + word[cut:]

    def _name(self, word: str) -> str:
        low = word.lower()
        if low in TITLES:
            return word
        if low in GENDER:
            return self._cased(word, self.names[GENDER[low]][low])
        return self.walk(word, "surname", lambda w: w in GENDER or w in TITLES)


def canonical(text: str, kind: str) -> str:
    """What a mention names, however it is written."""
    if kind == "person":
        words = [w.lower() for w in _WORD.findall(text) if w.lower() not in TITLES]
        return " ".join(sorted(words))
    if kind == "email":
        return re.sub(r"\s?[(\[{]\s?at\s?[)\]}]\s?", "@", re.sub(r"\s?[(\[{]\s?dot\s?[)\]}]\s?", ".", text.lower())).strip()
    return re.sub(r"\s+", " ", text.lower())


def replace(text: str, spans: list[tuple[int, int, str]], of) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], of(text[a:b], kind)]
        at = b
    return "".join([*out, text[at:]])


def mentions(rows: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """(row_key, pii_kind, mention, canonical, surrogate), one row per mention. Narrow. Null and empty
    texts have none; repeated rows give repeated mentions; whole texts are read, however long. secret is
    the key of the surrogates and has no default: who knows it can undo them."""
    ddl = "row_key bigint, pii_kind string, mention string, canonical string, surrogate string"
    names = persons.model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(secret)
        for batch in batches:
            out = [(k, kind, t[a:b], canonical(t[a:b], kind), keyed.of(t[a:b], kind)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for a, b, kind in find(t, names)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.string()] * 4), strict=True)], names=["row_key", "pii_kind", "mention", "canonical", "surrogate"])

    return rows.select(F.col(key).cast("bigint"), F.col(text)).mapInArrow(run, ddl)


def redact(rows: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """(key, n_mentions, kinds, placeholders, surrogates): the text with each mention as [KIND], and with
    keyed surrogates; all else is untouched. kinds are the kinds found, each once. Null stays null."""
    key_type = rows.schema[key].dataType.simpleString()
    names = persons.model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Surrogates(secret)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            spans = [find(t, names) if t else [] for t in texts]
            kinds = [sorted({kind for *_, kind in s}) for s in spans]
            held = [replace(t, s, lambda _, kind: f"[{kind.upper()}]") if s else t for t, s in zip(texts, spans, strict=True)]
            changed = [replace(t, s, keyed.of) if s else t for t, s in zip(texts, spans, strict=True)]
            arrays = [batch.column(0), pa.array(map(len, spans), pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(held, pa.string()), pa.array(changed, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "n_mentions", "kinds", "placeholders", "surrogates"])

    return rows.select(key, text).mapInArrow(run, f"{key} {key_type}, n_mentions bigint, kinds array<string>, placeholders string, surrogates string")


def kinds_found(redacted: DataFrame, key: str, source: str) -> DataFrame:
    """(src_table, row_key, pii_kind) of a redacted table: one row for each record and kind."""
    return redacted.select(F.lit(source).alias("src_table"), F.col(key).cast("bigint").alias("row_key"), F.explode("kinds").alias("pii_kind"))


def collisions(found: DataFrame) -> DataFrame:
    """(pii_kind, surrogate, n_originals) of surrogates that stand for several originals. Counted over
    distinct pairs, combined before the shuffle. Empty unless the bijection is broken."""
    pairs = found.select("pii_kind", F.lower("mention").alias("original"), F.lower("surrogate").alias("surrogate")).distinct()
    return pairs.groupBy("pii_kind", "surrogate").agg(F.count("*").alias("n_originals")).where("n_originals > 1")
