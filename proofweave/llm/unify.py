"""One form for text that looks the same.

A quick check on the JVM side isolates the texts that hold any unstable character; all others pass unchanged
and never leave the JVM. Whether a character is stable is derived from the form itself (:func:`stable`): its
normalization quick-check property is Yes (it neither decomposes nor composes with what stands before it),
it is no mark, no step of the form rewrites it and it cannot become part of a mixed word. In a flagged text
only the unstable segments (the words or single characters around such a character, so that a mark always
has its base and a look-alike letter its word) are normalised and spliced back into the unchanged rest.

The form: full-width forms become ASCII; ligature and other compatibility letters of the Latin block are
taken apart; marks are composed with their base (NFC); invisible characters vanish; every space separator
becomes U+0020; Cyrillic or Greek letters that look Latin, with or without accents, become Latin inside words
that also hold Latin letters. Words wholly in another script, accents composed in one character and line
breaks stay. The form is idempotent, and invisible characters put into a text at any place do not change it.

Null stays null, an empty text stays empty; texts of any length are handled whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Look-alike letters of other scripts and their Latin twins.
TWINS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Һ": "H",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}

# Characters that take no room.
INVISIBLE = "\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufeff\uffa0"

# Compatibility letters that are taken apart.
COMPATIBLE = "\uff01-\uff5e\ufb00-\ufb06\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3"

#: Kinds that make a text a case; ``other`` marks changes beyond them.
KINDS = ("fullwidth", "mark", "invisible", "space", "mixed")


@lru_cache(maxsize=1)
def stable() -> bytes:
    """Of every character of the basic plane, 1 if the form never changes it nor anything beside it.

    Characters beyond the plane all count as unstable, which costs time and changes nothing.
    """
    changed = regex.compile(rf"[{INVISIBLE}{COMPATIBLE}\p{{M}}\p{{Greek}}\p{{Cyrillic}}\p{{Cs}}]|(?! )\p{{Zs}}")
    seconds = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # jamo that compose by rule
    out = bytearray(unicodedata.is_normalized("NFC", chr(code)) for code in range(1 << 16))
    for m in changed.finditer("".join(map(chr, range(1 << 16)))):
        out[m.start()] = 0
    for code in range(0xC0, 1 << 16):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            seconds.add(int(parts[1], 16))
    for code in seconds:
        if code < len(out):
            out[code] = 0
    return bytes(out)


@lru_cache(maxsize=1)
def _stable_ranges() -> list[tuple[int, int]]:
    table, out, first = stable() + b"\0", [], None
    for code, is_stable in enumerate(table):
        if is_stable and first is None:
            first = code
        elif not is_stable and first is not None:
            out.append((first, code - 1))
            first = None
    return out


@lru_cache(maxsize=1)
def unstable_java() -> str:
    """Java pattern of any unstable character. What is ASCII is ruled out before the ranges are looked at."""
    return r"[\x{80}-\x{10FFFF}&&[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in _stable_ranges() if b > 0x7F) + "]]"


@lru_cache(maxsize=1)
def _patterns() -> dict:
    return {
        "unstable": regex.compile("[^" + "".join(rf"\u{a:04x}-\u{b:04x}" for a, b in _stable_ranges()) + "]"),
        "fullwidth": regex.compile(r"[\uff01-\uff5e]"),
        "mark": regex.compile(r"\p{M}"),
        "invisible": regex.compile(rf"[{INVISIBLE}]"),
        "space": regex.compile(r"(?! )\p{Zs}"),
        "word": regex.compile(r"[\p{L}\p{N}\p{M}]+"),
        "latin": regex.compile(r"\p{Latin}"),
        "foreign": regex.compile(r"[\p{Greek}\p{Cyrillic}]"),
        "compat": regex.compile(rf"[{COMPATIBLE}]+"),
    }


@lru_cache(maxsize=1 << 12)
def _latin(char: str) -> str:
    """The Latin twin of a letter with its accents, or the letter itself."""
    base, *marks = unicodedata.normalize("NFD", char)
    return unicodedata.normalize("NFC", TWINS[base] + "".join(marks)) if base in TWINS else char


def _fold_word(match) -> str:
    p = _patterns()
    word = match.group(0)
    if p["foreign"].search(word) and p["latin"].search(word):
        return p["foreign"].sub(lambda m: _latin(m.group(0)), word)
    return word


def _fix_segment(segment: str, kinds: set) -> str:
    p = _patterns()
    out = segment
    if p["mark"].search(out):
        kinds.add("mark")
    if p["foreign"].search(out) and any(p["foreign"].search(w) and p["latin"].search(w) for w in p["word"].findall(out)):
        kinds.add("mixed")
    if p["invisible"].search(out):
        kinds.add("invisible")
        out = p["invisible"].sub("", out)
    if p["space"].search(out):
        kinds.add("space")
        out = p["space"].sub(" ", out)
    if p["compat"].search(out):
        if p["fullwidth"].search(out):
            kinds.add("fullwidth")
        out = p["compat"].sub(lambda m: unicodedata.normalize("NFKC", m.group(0)), out)
    if not unicodedata.is_normalized("NFC", out):
        out = unicodedata.normalize("NFC", out)
    return p["word"].sub(_fold_word, out) if p["foreign"].search(out) else out


@lru_cache(maxsize=1 << 16)
def _reach(char: str) -> int:
    """1 for characters that belong to a word, 2 for unstable ones (both: 3)."""
    p = _patterns()
    inside = unicodedata.category(char)[0] in "LNM" or bool(p["invisible"].match(char))
    return inside + 2 * bool(p["unstable"].match(char))


def _segments(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that must be normalised: words around an unstable character, and such characters alone; a
    mark takes the sign before it along."""
    last, n = 0, len(text)
    for m in _patterns()["unstable"].finditer(text):
        start, end = m.span()
        if start < last:
            continue
        while end < n and _reach(text[end]):
            end += 1
        while start > last and _reach(text[start - 1]) & 1:
            start -= 1
        if start == m.start() > last and unicodedata.category(text[start])[0] == "M" and not text[start - 1].isspace():
            start -= 1
        yield start, end
        last = end


def unify_text(text: str | None) -> tuple[str | None, list[str]]:
    """The text in its one form and the kinds of change it needed."""
    if not text or text.isascii() or not _patterns()["unstable"].search(text):
        return text, []
    kinds: set[str] = set()
    pieces, last = [], 0
    for start, end in _segments(text):
        pieces.append(text[last:start])
        pieces.append(_fix_segment(text[start:end], kinds))
        last = end
    pieces.append(text[last:])
    out = "".join(pieces)
    # Neighbours can meet when an invisible character between them vanishes or a letter becomes Latin.
    if not unicodedata.is_normalized("NFC", out):
        out = unicodedata.normalize("NFC", out)
    if not kinds and out != text:
        kinds.add("other")
    return out, sorted(kinds)


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


@F.pandas_udf(_RESULT)
def _unify(texts: pd.Series) -> pd.DataFrame:
    done = [unify_text(t) for t in texts]
    return pd.DataFrame({"text": [t for t, _ in done], "kinds": [k for _, k in done]})


def unstable(text: Column) -> Column:
    """The quick check: whether the text must be looked at; false for null."""
    return F.coalesce(text.rlike(r"[^\x{0}-\x{7F}]") & text.rlike(unstable_java()), F.lit(False))


def unified(rows: DataFrame, text: str, out: str = "unified", kinds: str = "kinds") -> DataFrame:
    """``rows`` with the text's one form and the kinds of change. Only unstable texts reach Python.

    The rows are split by the quick check and united again, so no shuffle is needed.
    """
    flagged = rows.where(unstable(F.col(text))).withColumn("__u", _unify(F.col(text)))
    changed = flagged.withColumn(out, F.col("__u.text")).withColumn(kinds, F.col("__u.kinds")).drop("__u")
    same = rows.where(~unstable(F.col(text))).withColumn(out, F.col(text)).withColumn(kinds, F.array().cast("array<string>"))
    return same.unionByName(changed)


def lookalikes(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose text needed a change of one of :data:`KINDS`, with ``unified`` and ``kinds``."""
    flagged = rows.where(unstable(F.col(text))).withColumn("__u", _unify(F.col(text)))
    named = flagged.withColumn("unified", F.col("__u.text")).withColumn("kinds", F.array_intersect(F.col("__u.kinds"), F.array(*[F.lit(k) for k in KINDS]))).drop("__u")
    return named.where(F.size("kinds") > 0)
