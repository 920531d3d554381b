"""Personal data behind disguises: texts are rewritten to plain form with a map of offsets, searched, and mapped back."""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteforge.llm.common import text_or_empty
from noteforge.llm.tokens import small_batches

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,value:string>>"

# Letters of other scripts that look like Latin ones; compatibility forms (full width, mathematical, ...) follow from Unicode.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "ԁ": "d", "ɡ": "g", "ո": "n", "ս": "u",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
# Spoken digits from 0 to 9, by language.
DIGITS = (
    "zero one two three four five six seven eight nine",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)
DIGIT_OF = {w: str(i) for words in DIGITS for i, w in enumerate(words.split())} | {"oh": "0"}
AT = "at|arroba|arobase"
DOT = "dot|punkt|punto|point"
OPEN, CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"

# --- plain detection ---------------------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ENDING = re.compile(r"\.[A-Za-z]{2,}$")
LUHN = {c: (int(c), int(c) * 2 - 9 * (c > "4")) for c in "0123456789"}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses, by their @: no run of characters is read twice, however long it is."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        else:
            end = at + 1
        at = text.find("@", max(end, at + 1))


def luhn(digits: str) -> bool:
    return sum(LUHN[c][i % 2] for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of everything that stands undisguised."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


# --- transducers -------------------------------------------------------------------------------------------------------


@lru_cache(1)
def lookalikes() -> dict[str, str]:
    """ASCII characters by what looks like them; invisible characters are empty."""
    table = LOOKALIKES | dict.fromkeys(INVISIBLE, "")
    for i in range(0x80, min(sys.maxunicode, 0x1FFFF) + 1):
        c = chr(i)
        plain = unicodedata.normalize("NFKC", c)
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            table[c] = str(digit)
        elif len(plain) == 1 and plain.isascii():
            table[c] = plain
    return table


def plain_characters(text: str) -> list[tuple[int, int, str, str]]:
    """Pieces for the characters of a text that look like others."""
    table = lookalikes()
    there = set(text) & table.keys() if not text.isascii() else ()
    if not there:
        return []
    return [(m.start(), m.end(), table[m[0]], "char") for m in re.finditer("[" + re.escape("".join(sorted(there))) + "]", text)]


def patterns() -> dict[str, re.Pattern]:
    """The words of disguise in a text without lookalikes. A lone digit word means nothing; three in a row are a number,
    and one to three between four dots are part of an address. A bare `at` counts in front of a domain with a word for
    its dot."""
    word = "|".join(sorted(map(re.escape, DIGIT_OF), key=len, reverse=True))
    run = rf"\b(?:{word})(?:(?:\s*,\s*|[\s-]+)(?:{word}))"
    said = rf"(?:{OPEN}(?:{DOT}|\.){CLOSE}|\s+(?:{DOT})\s+)"
    octet = rf"(?:[0-9]{{1,3}}|\b(?:{word})(?:[\s-]+(?:{word})){{0,2}})"
    name = r"[A-Za-z0-9-]+"
    flags = re.IGNORECASE
    return {
        "ip": re.compile(rf"(?<![A-Za-z0-9.]){octet}(?:(?:{said}|\.){octet}){{3}}(?![A-Za-z0-9])", flags),
        "digits": re.compile(rf"(?:\bplus[\s-]+)?{run}{{2,}}\b", flags),
        "at": re.compile(rf"(?<=[A-Za-z0-9._%+-])(?:{OPEN}(?:{AT}|@){CLOSE}(?=[A-Za-z0-9])|\s+(?:{AT})\s+(?={name}(?:\.{name})*{said}{name}))", flags),
        "dot": re.compile(rf"(?<=[A-Za-z0-9]){said}(?=[A-Za-z0-9])", flags),
    }


SIGNS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
BRACKETS = re.compile(rf"[\[({{<]\s*(?:{AT}|{DOT}|[@.])\s*[\])}}>]")
DOT_WORD = re.compile(rf"\s(?:{DOT})\s")


def hinted(text: str) -> bool:
    """Whether a text may hold disguises by words: brackets around at or dot, a bare word for a dot, or three digit words
    in a row, of which the middle one stands between separators and the others may touch a sign."""
    low = text.lower()
    if BRACKETS.search(low) or any(w in low for w in DOT.split("|")) and DOT_WORD.search(low):
        return True
    words = low.replace(",", " ").replace("-", " ").split()
    if DIGIT_OF.keys().isdisjoint(words):
        return False
    return any(b in DIGIT_OF and a.lstrip(SIGNS) in DIGIT_OF and c.rstrip(SIGNS) in DIGIT_OF for a, b, c in zip(words, words[1:], words[2:], strict=False))


PATTERNS = patterns()
WORD = re.compile(r"[^\W\d_]+|[0-9]+")


def spoken(said: str) -> str:
    return "".join(DIGIT_OF.get(w.lower(), w) for w in WORD.findall(said))


class Rewritten:
    """A text after transducers, and where each of its characters comes from. Pieces: (start, end) in the text before,
    the output, a mark of what was rewritten."""

    def __init__(self, text: str, pieces: list[tuple[int, int, str, str]], before: Rewritten | None = None):
        self.before, self.pieces = before, pieces
        out, self.starts, at, length = [], [], 0, 0
        for start, end, plain, _ in pieces:
            out += [text[at:start], plain]
            self.starts.append(length + start - at)
            length, at = length + start - at + len(plain), end
        self.text = "".join([*out, text[at:]])

    def source(self, place: int, end: bool) -> int:
        """The source offset of a character's start, or of its end where place is just behind it."""
        i = bisect_right(self.starts, place - end) - 1
        if i >= 0:
            a, b, plain, _ = self.pieces[i]
            off = place - self.starts[i]
            inside = off <= len(plain) if end else off < len(plain)
            place = (b if end else a) if inside and plain else b + off - len(plain)
        return self.before.source(place, end) if self.before else place

    def marks(self, start: int, end: int) -> list[str]:
        """What was rewritten between two places of the text."""
        own, i = [], bisect_right(self.starts, start - 1)
        while i < len(self.pieces) and self.starts[i] < end:
            if self.pieces[i][2] or self.starts[i] > start:
                own.append(self.pieces[i][3])
            i += 1
        if self.before is None:
            return own
        return own + self.before.marks(self.local(start, False), self.local(end, True))

    def local(self, place: int, end: bool) -> int:
        """source() by this step alone."""
        before, self.before = self.before, None
        place = self.source(place, end)
        self.before = before
        return place


def step(before: Rewritten, found: list[tuple[int, int, str, str]]) -> Rewritten:
    return Rewritten(before.text, found, before) if found else before


def rewritten(text: str) -> Rewritten | None:
    """The text in plain form, None where nothing is disguised: first characters, then words for digits, then at and dot."""
    out = Rewritten(text, [])
    out = step(out, plain_characters(text))
    if hinted(out.text):
        ips = [(m.start(), m.end(), m[0]) for m in PATTERNS["ip"].finditer(out.text)]
        ips = [(a, b, ".".join(spoken(p) for p in re.split(rf"{OPEN}(?:{DOT}|\.){CLOSE}|\s+(?:{DOT})\s+|\.", x, flags=re.IGNORECASE)), "ip") for a, b, x in ips]
        out = step(out, [x for x in ips if out.text[x[0] : x[1]] != x[2]])
        digits = [(m.start(), m.end(), "+" * (m[0][:4].lower() == "plus") + spoken(m[0][4 * (m[0][:4].lower() == "plus") :]), "digits") for m in PATTERNS["digits"].finditer(out.text)]
        out = step(out, digits)
        both = sorted([(m.start(), m.end(), "@", "at" if m[0].strip()[0] in "[({<" else "bare at") for m in PATTERNS["at"].finditer(out.text)] + [(m.start(), m.end(), ".", "dot" if m[0].strip()[0] in "[({<" else "bare dot") for m in PATTERNS["dot"].finditer(out.text)])
        out = step(out, [x for i, x in enumerate(both) if i == 0 or both[i - 1][1] <= x[0]])
    return out if out.before else None


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of what the rewritten text shows besides plain, in source offsets: spans in which
    something was rewritten and that lie in no plain span of their kind. An address has to end in letters, and a bare
    word for its dot counts only if its @ was disguised as well."""
    out, view = [], rewritten(text)
    if view is None:
        return out
    known = [[(x, y) for x, k, y in plain if k == kind] for kind in range(len(KINDS))]
    for a, kind, b in plain_spans(view.text):
        marks = view.marks(a, b)
        start, end = view.source(a, False), view.source(b, True)
        i = bisect_right(known[kind], (start, sys.maxsize)) - 1
        if not marks or i >= 0 and end <= known[kind][i][1]:
            continue
        if kind == 0 and (not ENDING.search(view.text[a:b]) or "bare dot" in marks and not {"at", "bare at"} & set(marks)):
            continue
        out.append((start, kind, end, view.text[a:b]))
    return out


def private_spans(text: str) -> list[dict]:
    """All spans of a text in order, as rows of SPANS."""
    plain = plain_spans(text)
    rows = [(a, k, b, True, text[a:b]) for a, k, b in plain] + [(a, k, b, False, v) for a, k, b, v in disguised_spans(text, plain)]
    return [{"kind": KINDS[k], "start": a, "end": b, "base": base, "value": v} for a, k, b, base, v in sorted(rows)]


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans of each row of docs: kind, start and end in code points of the source text (end exclusive), base
    (it stands undisguised) and value, the identifier in plain form; sorted by start, kind and end. No shuffle.

    Plain spans are the leftmost ones of each kind that don't overlap: addresses, IPs with parts up to 255, cards of 14
    to 19 digits that pass Luhn, phones of 10 to 15 digits behind a +. The others were written with letters of other
    scripts, invisible characters, digits in words or words for @ and dot; such a span may hold a plain one and more, and
    is listed besides. A null or empty text has no spans; very long texts are read whole, in linear time; repeated rows
    and null ids stay rows; an empty table gives none; other columns play no part."""
    small_batches(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([private_spans(t) for t in texts])

    return docs.select(docs[id_col].alias("doc_id"), spans(text_or_empty(docs[text_col])).alias("spans"))


def is_kind(kind: str):
    return lambda s: s["kind"] == kind


def op13_private_spans(spark, sf_dir: str) -> DataFrame:
    """n_<kind> counts all spans listed, base_<kind> those that stand undisguised."""
    out = find_private(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def counts(spans, prefix):
        return [F.size(F.filter(spans, is_kind(k))).cast("long").alias(f"{prefix}_{k}") for k in KINDS]

    return out.select("doc_id", *counts(F.col("spans"), "n"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), *counts(base, "base"))
