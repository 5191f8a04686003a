"""Template residue, filler, error pages and script notices.

Three regularised logistic classifiers on hashed features are trained on a bounded sample of weakly labelled
rows, and they alone decide:

* the *part* model scores the sentences and lines of a text by their hashed word n-grams and length;
* the *page* model scores a text by the n-grams of its title, its length, how far it repeats itself, how many
  function words it has and which share of its words the part model finds in residue;
* the *slot* model scores every bracketed or ruled construct by hashed n-grams of the words around it, its inner
  words, its shape and whether it stands in a quotation.

Weak labels come from response-status wording, known phrases, template grammars and wording that reports a
marker. They are used for training and validation only: a rule never adds or removes a row of the result, except
that a construct inside quotation marks is quoted by definition.
All models are validated on hosts (``source``) that the training never saw.

Texts are split, hashed and scored batch by batch with Arrow and numpy; only texts that hold a construct are
searched for slots one by one.

Defined results: null, empty and blank texts are no cases; texts of any length are scored whole; repeated
rows give one result. If no row of the table is weakly labelled as residue, nothing is residue.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofweave.llm.neardup import Words, _mix
from proofweave.session import materialize

#: Bound of the training sample: rows of each label, and parts drawn from each of them.
SAMPLE, PARTS = 3_000, 8
#: Hashed features, training steps, regularisation.
BUCKETS, STEPS, L2 = 1 << 16, 150, 1e-5
#: Share of validation hosts, as one of this many.
HOLD_OUT = 5
#: Score from which a text, part or slot is residue.
AT = 0.5

# Wording of error pages, script notices and filler, without letter case.
STATUS = r"""
    \b(?:error|erreur|fehler|errore|status|http|code)\s*(?:code)?\s*[:#]?\s*[45]\d\d(?!\d) | \b[45]\d\d\s+(?:not\s+found|bad\s+gateway|forbidden|internal|unavailable|gateway|service|unauthorized)
    | \(\s*[45]\d\d\s*\) | \[\s*[45]\d\d\s*\] | \bpage\s+not\s+found | \bnot\s+found\s+on\s+this\s+server\b | \binternal\s+server\s+error\b | \bserver\s+error\b | \bgateway\s+time-?out | \bbad\s+gateway\b
    | \b(?:temporarily\s+)?unavailable | \bcould\s+not\s+be\s+(?:delivered|displayed|found|loaded|opened|rendered|converted)\b | \bsomething\s+(?:broke|went\s+wrong)\b | \bsign-?in\s+required | \A\W*gone\s*(?:[-–.:\n]|\Z) | \baccess\s+(?:to\s+\S+\s+is\s+)?(?:denied|forbidden)\b
    | \boops\b | \bpermission\s+to\s+(?:view|access|open)\b | \brequest\s+access\b | \bretry\s+after\b | \btimed\s+out\b | \b(?:is|link)\s+broken\b | \bslow\s+down | \btoo\s+many\s+requests\b | \bno\s+está\s+disponible\b | \bnon\s+(?:è\s+)?disponibile\b | \bindisponible\b | \btry\s+again\s+later\b | \bcould\s+not\s+open\b | \bconversion\s+failed\b | \bunsupported\s+file\s+type\b | \bsession\s+(?:has\s+)?expired\b | \bintrouvable\b | \bnicht\s+angezeigt\b | \bno\s+(?:se\s+)?encontrad[oa]\b | \bpágina\s+no\b | \bpagina\s+non\b"""
SCRIPTS = r"\bjava\s?script\b|\bscripts?\s+(?:enabled|to\s+run|and\s+cookies|is|are|must)\b|\b(?:active\s+)?scripting\b|<noscript|\bchecking\s+your\s+browser\b|\bbrowser\s+settings\b|\bscripts\s+enabled\b"
FILLER = r"\blorem\b|\bipsum\b|\bdolor\s+sit\b|\bconsectetur\b|\badipiscing\b|\beiusmod\b|\b(?:asdf|qwer|jkl)\w*\b|\bgoes\s+here\b|\bplaceholder\s+text\b|\bdummy\s+text\b|\bsample\s+text\b|\b[xX]{3,}(?:\s+[xX]{3,}){2,}|\bblind(?:er)?\s*text\b|\btexte?\s+factice\b"
_WORDING = (re.compile(STATUS, re.I | re.X), re.compile(SCRIPTS, re.I), re.compile(FILLER, re.I))

# Constructs that can be template slots.
SLOT = re.compile(
    r"\{\{[^{}]*\}\}|\{%[^\n%]*%\}|\$\{[^{}]*\}|%%[^%\n]+%%|\[\[[^\[\]]*\]\]|<<[^<>]*>>|@@[^@\n]+@@|##?[A-Z][A-Z0-9_]{2,}##?|«[^»\n]*»|‹[^›\n]*›"
    r"|\[[^\[\]]*\]|<[A-Za-z][^<>]*>|\{[A-Za-z_][^{}]*\}|_{2,}(?:/_{2,})*|£[X_][X_,.]*|\b[X]{2}/[X]{2}/(?:[X]{4}|20[X]{2})\b"
    r"|\((?:complete|insert|delete|fill|tbc|to\s+be)\b[^()]*\)"
)
#: What every construct holds; texts without it are not searched.
_SLOT_SIGN = r"[\[{<«‹#@%_]|£X|XX/|\((?:complete|insert|delete|fill|tbc|to\s)"
_OPEN = re.compile(
    r"^(?:\{\{.*\}\}|\{%.*%\}|\$\{.*\}|%%.*%%|\[\[.*\]\]|<<.*>>|@@.*@@|#.*#|«.*»|‹.*›|_{2,}.*|£[X_].*|[X]{2}/.*|\((?:complete|insert|delete|fill|tbc|to\s+be).*\)"
    r"|\[\s*(?:insert|tbc|tba|tbd|delete|drafting|note\s+to|name|date|surname|first\s+name|address|amount|sum|figure|party|client|witness|court|claim\s+no|signature|title|●|•|…|\.{3}|_+|[X/.\s\d]*X[X/.\s\d]*)[^\]]*\]"
    r"|(?-i:\[[A-Z][A-Z _/-]{3,}\])|<(?:insert|enter|client|name|date|amount|party|address|your)[^>]*>|\{[a-z_]+\})$",
    re.I | re.S,
)
_MARKER_BEFORE = re.compile(r"(?:literal\s+text|the\s+(?:words?|marker|placeholder|token|tag|field|string|code|text|message|notice|legend|label)s?|explains?\s+that|reads?|read\s+out|printed\s+with|quot\w+|called|named|cited\s+at|so-called)\s*[:\"“'‘]?\s*$", re.I)
_MARKER_AFTER = re.compile(r"^\s*[\"”'’]?\s*(?:is|was|are|were|being|stands?|in\s+place\s+of|instead\s+of|appears?|appeared|had\s+been|as\s+a)\b[^.]*?(?:\b(?:marker|placeholder|token|tag|field|slot|template|never\s+filled|left\s+in|in\s+place)\b|\ba\s+name\b)", re.I)
_QUOTED = r"\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|‘[^’\n]*’"
_QUOTES = re.compile(_QUOTED)
# Wording by which a text reports such wording.
_REPORTING = re.compile(r"\b(?:told|showed|shows|displayed\s+the|lists|listed|repeats|repeated|photographed|printed|wrote|left\s+the\s+words?|the\s+words|according\s+to|reported|complained|recorded|as\s+the\s+expected|in\s+evidence)\b", re.I)
# Function words without which no known language runs on. (Words that invented filler also has
# are left out.)
_GRAMMAR = frozenset(
    "the of and to in that was is by for on with which as at from not it be had has have were been an or this no under after before because a"
    " le la les des du un une et est qui dans pour par sur avec pas ne au aux ce en il sont avait der die das den dem des ein eine und ist nicht mit für von zu im am auf bei nach vor"
    " el los las del una y es con no se al su en por para il lo gli di della del che è non per alla nel".split()
)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_SEGMENT = re.compile(r"[^\n]+?(?:[.!?](?=\s|$)|\n|$)")


def _words(text: str) -> list[str]:
    return [("0" if t[0].isdigit() else t.lower()) for t in _TOKEN.findall(text)]


@lru_cache(maxsize=1 << 16)
def _bucket(feature: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(feature) % BUCKETS


def outside_quotes(text: str) -> str:
    """The text without what it quotes."""
    return _QUOTES.sub(" ", text) if any(q in text for q in '"“„‘') else text


def repeated_share(text: str) -> float:
    """Share of the segments that are the commonest one, if it occurs at least three times."""
    parts = Counter(" ".join(_words(m.group(0))) for m in _SEGMENT.finditer(text) if m.group(0).strip())
    top = max(parts.values(), default=0)
    return top / sum(parts.values()) if top >= 3 else 0.0


def without_grammar(text: str) -> bool:
    """Whether running Latin text has no function word of any known language, as invented filler has."""
    if any(c.isdigit() or c == "|" for c in text):
        return False
    found = re.findall(r"[^\W\d_]+", text)
    small = [w for w in found if w.islower()]
    if len(found) < 5 or len(small) < 0.6 * len(found) or not "".join(small).isascii():
        return False
    return not any(w in _GRAMMAR for w in (x.lower() for x in found))


@lru_cache(maxsize=1)
def _grammar_words() -> np.ndarray:
    return np.sort(Words().hashes(pa.array(sorted(_GRAMMAR)))[0])


@dataclass
class Cut:
    """A batch of texts in parts. ``words`` are hashes, digits made equal; ``of_part`` are the offsets of every
    part in them, ``of_text`` the offsets of every text in the parts."""

    words: np.ndarray
    of_part: np.ndarray
    of_text: np.ndarray


def cut(texts: pa.Array, words: Words) -> tuple[Cut, pa.Array]:
    """Texts without what they quote, split into sentences and lines, and these parts."""
    plain = pc.replace_substring_regex(pc.fill_null(texts.cast(pa.string()), ""), _QUOTED, " ")
    plain = pc.replace_substring_regex(pc.replace_substring_regex(plain, "[0-9]", "0"), r"([.!?])\s", "\\1\n")
    parts = pc.split_pattern(plain, "\n")
    flat, bounds = words.hashes(parts.flatten())
    return Cut(flat, bounds.astype(np.int64), parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()), parts.flatten()


@dataclass
class Sparse:
    """Rows of hashed features: buckets, values and the offsets of every row."""

    buckets: np.ndarray
    values: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, n: int, *groups: tuple[np.ndarray, np.ndarray, bool]) -> Sparse:
        """From ``(row, hash, scaled)``; features of a row count once, those of a scaled group share unit length."""
        rows, buckets, values = [], [], []
        for row, hashes, scaled in groups:
            both = np.unique(row.astype(np.int64) * BUCKETS + (hashes % np.uint64(BUCKETS)).astype(np.int64))
            rows.append(both // BUCKETS)
            buckets.append(both % BUCKETS)
            size = np.bincount(rows[-1], minlength=n)
            values.append((1 / np.sqrt(np.maximum(size, 1)) if scaled else np.ones(n))[rows[-1]])
        row, bucket, value = np.concatenate(rows), np.concatenate(buckets), np.concatenate(values)
        order = np.argsort(row, kind="stable")
        return cls(bucket[order], value[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]))

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.buckets[self.offsets[k] : self.offsets[k + 1]], self.values[self.offsets[k] : self.offsets[k + 1]]


def _named(name: str, numbers: np.ndarray) -> np.ndarray:
    """Hashes of a feature's values."""
    seed = int.from_bytes(name.encode(), "big") * 0x9E3779B97F4A7C15 % (1 << 64)
    return _mix(numbers.astype(np.uint64) + np.uint64(seed))


def _grams(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of words and of adjacent pairs."""
    if not len(words):
        return row, words
    inner = row[1:] == row[:-1]
    return np.concatenate([row, row[1:][inner]]), np.concatenate([words, _mix(words[:-1] * np.uint64(31) + words[1:])[inner]])


def _log2(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(n + 1.0)).astype(np.int64)


def part_features(c: Cut) -> Sparse:
    """Features of every part: n-grams and length."""
    n = len(c.of_part) - 1
    size = np.diff(c.of_part)
    row, grams = _grams(c.words, np.repeat(np.arange(n), size))
    return Sparse.of(n, (row, grams, True), (np.arange(n), _named("len", _log2(size)), False))


def page_features(c: Cut, part_scores: np.ndarray) -> Sparse:
    """Features of every text: its title, its length, repetition, function words, and residue among its parts."""
    n = len(c.of_text) - 1
    size = np.diff(c.of_part)
    text_of_part = np.repeat(np.arange(n), np.diff(c.of_text))
    total = np.bincount(text_of_part, size, n)
    residue = np.bincount(text_of_part, size * (part_scores >= AT), n) / np.maximum(total, 1)
    # The title is the first part that holds a word.
    filled = np.flatnonzero(size)
    first = filled[np.concatenate([[True], text_of_part[filled][1:] != text_of_part[filled][:-1]])] if len(filled) else filled
    titles = size[first]
    inside = np.repeat(c.of_part[:-1][first] - (np.cumsum(titles) - titles), titles) + np.arange(titles.sum())
    row, grams = _grams(c.words[inside], np.repeat(text_of_part[first], titles))
    body = total - np.bincount(text_of_part[first], titles, n)
    in_body = residue * total - np.bincount(text_of_part[first], titles * (part_scores[first] >= AT), n)
    # Parts are told apart by the sum of their words' hashes.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(c.words, dtype=np.uint64)])
    marks = np.stack([text_of_part[filled].astype(np.uint64), sums[c.of_part[1:]][filled] - sums[c.of_part[:-1]][filled]])
    kinds, times = np.unique(marks, axis=1, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, kinds[0].astype(np.int64), times)
    parts = np.bincount(text_of_part[filled], minlength=n)
    repeated = np.where(most >= 3, most / np.maximum(parts, 1), 0)
    known = _grammar_words()
    at = np.searchsorted(known, c.words)
    is_known = known[np.minimum(at, len(known) - 1)] == c.words
    grammar = np.bincount(np.repeat(text_of_part, size), is_known, n) / np.maximum(total, 1)
    every = np.arange(n)
    steps = lambda share, k: np.ceil(share * k - 1e-9).astype(np.int64)
    dense = [
        ("residue", steps(residue, 8)), ("inbody", steps(in_body / np.maximum(body, 1), 8) + 20 * (body == 0)), ("repeated", steps(repeated, 4)), ("grammar", np.where(total >= 5, steps(np.minimum(grammar, 0.4), 20), 99)),
        ("len", _log2(total)), ("mostly", (residue >= 0.5).astype(np.int64)), ("rep+gram", steps(repeated, 2) * 100 + np.where(total >= 5, (grammar > 0.05).astype(np.int64), 9)),
    ]
    return Sparse.of(n, (row, _mix(grams + np.uint64(7)), True), *[(every, _named(name, values), False) for name, values in dense])


def slot_shape(slot: str) -> str:
    """The construct with its inner words replaced by their kind."""
    return re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", lambda m: "A" if m.group(0).isupper() else "a", slot))


def slot_features(text: str, start: int, end: int, quotes: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a construct and their values: its words and shape, the six words on either side (each of
    the two groups of unit length), and whether it stands in a quotation."""
    slot = text[start:end]
    before, after = _words(text[max(0, start - 80) : start])[-6:], _words(text[end : end + 80])[:6]
    quoted = any(a < start and end < b for a, b in quotes)
    own = {"S:" + slot_shape(slot), "O:" + slot[:2], "C:" + slot[-2:], *("I:" + w for w in _words(slot))}
    around = {"B:" + w for w in before} | {"A:" + w for w in after}
    around |= {"BB:" + a + " " + b for a, b in zip(before, before[1:], strict=False)} | {"AA:" + a + " " + b for a, b in zip(after, after[1:], strict=False)}
    groups = [(own, len(own) ** -0.5), (around, max(len(around), 1) ** -0.5), ({f"Q:{quoted}"}, 1.0)]
    cells = {_bucket(f): v for group, v in groups for f in sorted(group)}
    return np.fromiter(cells, np.int32, len(cells)), np.fromiter(cells.values(), float, len(cells))


class Linear:
    """Logistic regression on sparse rows."""

    def __init__(self, weights: np.ndarray, bias: float) -> None:
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], steps: int = STEPS, l2: float = L2) -> Linear:
        """Full-batch gradient descent with per-weight step sizes; classes are weighted to equal mass."""
        y = np.asarray(labels, float)
        flat, values = np.concatenate([r for r, _ in rows]), np.concatenate([v for _, v in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r) for r, _ in rows])
        mass = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        w, b, seen, seen_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
        for _ in range(steps):
            z = np.bincount(owner, values * w[flat], len(rows)) + b
            error = mass * (1 / (1 + np.exp(-z.clip(-30, 30))) - y)
            grad = np.bincount(flat, values * error[owner], BUCKETS) + l2 * w
            seen += grad**2
            w -= 0.5 * grad / np.sqrt(seen)
            seen_b += error.sum() ** 2
            b -= 0.5 * error.sum() / np.sqrt(seen_b)
        return cls(w.astype(np.float32), float(b))

    def scores(self, rows: Sparse) -> np.ndarray:
        """Probability of the positive label of every row."""
        sums = np.concatenate([[0.0], np.cumsum(self.weights[rows.buckets] * rows.values, dtype=np.float64)])
        z = sums[rows.offsets[1:]] - sums[rows.offsets[:-1]] + self.bias
        return 1 / (1 + np.exp(-z.clip(-30, 30)))

    def score(self, buckets: np.ndarray, values: np.ndarray) -> float:
        """Probability of the positive label of one row."""
        z = float(self.weights[buckets] @ values) + self.bias
        return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def reported(text: str, start: int, end: int, quotes: list[tuple[int, int]]) -> bool:
    """Whether a construct is quoted or spoken about rather than left open."""
    if any(a < start and end < b for a, b in quotes):
        return True
    return bool(_MARKER_BEFORE.search(text[max(0, start - 60) : start]) or _MARKER_AFTER.search(text[end : end + 90]))


def slots(text: str) -> Iterator[tuple[int, int, bool]]:
    """``start, end, reported`` of every construct that can be a slot."""
    found = list(SLOT.finditer(text))
    if not found:
        return
    quotes = [m.span() for m in _QUOTES.finditer(text)]
    for m in found:
        yield m.start(), m.end(), reported(text, m.start(), m.end(), quotes)


def weak_slot(text: str, start: int, end: int, is_reported: bool) -> int:
    """The weak label of a construct."""
    return int(not is_reported and bool(_OPEN.match(text[start:end])))


def wording(part: str) -> bool:
    """Whether a segment itself has the wording of residue rather than reporting it."""
    plain = outside_quotes(part)
    return any(p.search(plain) for p in _WORDING) and not _REPORTING.search(part)


def whole_filler(text: str) -> bool:
    """Whether a text repeats one sentence or has no grammar."""
    return repeated_share(text) >= 0.6 or without_grammar(text.split("\n\n", 1)[-1])


def residue_share(text: str) -> float:
    """Weak label: share of the letters of a text, without title and portal frame, that lie in segments with
    residue wording. Filler that repeats one sentence or has no grammar counts whole."""
    total = hit = 0
    if whole_filler(text):
        return 1.0
    for k, m in enumerate(m for m in _SEGMENT.finditer(text) if m.group(0).strip()):
        part = m.group(0)
        is_residue = wording(part)
        if not is_residue and (frame(part) or (k == 0 and len(part) <= 60)):
            continue
        n = sum(c.isalpha() for c in part)
        total += n
        hit += n * is_residue
    return hit / total if total else 0.0


# Parts of a portal frame.
_FRAME = re.compile(r"^\W*(?:home|menu|login|privacy|terms|help|matters|back\s+to\s+\w+|document\s+portal|skip\s+to\s+\w+|contact(?:\s+support)?|incident\s+\d+|(?:\w+\s*\|\s*)+\w+)\W*$", re.I)


def frame(part: str) -> bool:
    """Whether a line only belongs to a portal frame."""
    return bool(_FRAME.match(part.strip()))


def weak_page(text: str) -> int | None:
    """The weak label of a text; None where the wording is mixed."""
    share = residue_share(text)
    first = next((m.group(0) for m in _SEGMENT.finditer(text) if m.group(0).strip() and not frame(m.group(0))), "")
    if share >= 0.4 or (share >= 0.1 and wording(first) and not _REPORTING.search(text)):
        return 1
    return 0 if share <= 0.05 else None


def _sample(docs: DataFrame, pattern: str, wanted: bool, bound: int) -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of the text, that match the pattern or do not."""
    hit = F.coalesce(F.col("text").rlike(pattern), F.lit(False))
    rows = docs.where((F.length(F.trim("text")) > 0) & (hit if wanted else ~hit))
    return rows.withColumn("__h", F.xxhash64("text")).orderBy("__h").limit(bound).select("text", F.coalesce("source", F.lit("")).alias("source"))


#: Java pattern that prepares the sample: wording of pages.
_PAGE_JAVA = r"(?i)(error|erreur|fehler|status|not found|unavailable|gateway|scripts?\b|javascript|lorem|ipsum|goes here|placeholder|asdf|sign-in|forbidden|could not be|xxxx)"


def _held_out(source: str) -> bool:
    import xxhash

    return xxhash.xxh32_intdigest(source, seed=7) % HOLD_OUT == 0


_CASES = "model string, source string, buckets array<int>, values array<double>, label int"


def _cases(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], names=["model", "source", "buckets", "values", "label"])


def _weakly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their weak label, and whether it goes for all their parts alike."""
    for batch in batches:
        texts = batch.column(0).to_pylist()
        labels = [weak_page(t) for t in texts]
        whole = [not y or whole_filler(t) for t, y in zip(texts, labels, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.int32()), pa.array(whole, pa.bool_())], names=["text", "source", "label", "whole"])


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weakly labelled parts and constructs of texts. Parts of a text are labelled with it; of a residue text
    only those with wording of their own or, where it is repeated or has no grammar, all."""
    words = Words()
    for batch in batches:
        out: list[tuple] = []
        c, parts = cut(batch.column(0), words)
        rows = part_features(c)
        for k, (text, source, label, whole) in enumerate(zip(*(x.to_pylist() for x in batch.columns), strict=True)):
            if label is not None:
                filled = c.of_text[k] + np.flatnonzero(np.diff(c.of_part[c.of_text[k] : c.of_text[k + 1] + 1]))
                chosen = filled[np.argsort(_mix((filled - c.of_text[k]).astype(np.uint64)))].tolist()
                if not whole:
                    chosen = [p for p in chosen if wording(parts[p].as_py())]
                out.extend(("part", source, *rows.row(p), label) for p in chosen[:PARTS])
            quotes = [m.span() for m in _QUOTES.finditer(text)]
            for a, b, said in slots(text):
                out.append(("slot", source, *slot_features(text, a, b, quotes), weak_slot(text, a, b, said)))
        yield _cases(out)


def _label_pages(part: Linear):
    """Weakly labelled texts, given the part model."""

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            c, _ = cut(batch.column(0), words)
            rows = page_features(c, part.scores(part_features(c)))
            yield _cases([("page", s, *rows.row(k), y) for k, (s, y) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)) if y is not None])

    return label


def _fit(cases: list[tuple], name: str) -> tuple[Linear | None, tuple]:
    """A model fitted on the hosts that are not held out (on all hosts if those show only one label), and its
    validation row."""
    cases = sorted((c for c in cases if c[0] == name), key=lambda c: (c[1], c[4], c[2].tobytes()))  # independent of the order of arrival
    fit, check = [c for c in cases if not _held_out(c[1])], [c for c in cases if _held_out(c[1])]
    if len({c[4] for c in fit}) < 2:
        fit, check = cases, []
    if len({c[4] for c in fit}) < 2:
        return None, (name, len(fit), 0, 0, 0, 0)
    model = Linear.fit([(c[2], c[3]) for c in fit], [c[4] for c in fit])
    sizes = [len(c[2]) for c in check]
    guess = model.scores(Sparse(np.concatenate([c[2] for c in check]), np.concatenate([c[3] for c in check]), np.concatenate([[0], np.cumsum(sizes)]))) >= AT if check else np.empty(0, bool)
    y = np.asarray([c[4] for c in check], bool)
    return model, (name, len(fit), len(check), int((guess & y).sum()), int((guess & ~y).sum()), int((~guess & y).sum()))


def _collected(cases: DataFrame) -> list[tuple]:
    """The labelled sample on the driver; its size is bounded by :data:`SAMPLE`."""
    got = cases.toArrow()
    sides = [got[k].combine_chunks() for k in ("buckets", "values")]
    flat = [x.values.to_numpy(zero_copy_only=False) for x in sides]
    bounds = sides[0].offsets.to_numpy()
    return [(m, s, flat[0][bounds[k] : bounds[k + 1]], flat[1][bounds[k] : bounds[k + 1]], y) for k, (m, s, y) in enumerate(zip(got["model"].to_pylist(), got["source"].to_pylist(), got["label"].to_pylist(), strict=True))]


@dataclass
class Models:
    part: Linear | None
    page: Linear | None
    slot: Linear | None


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[Models, list[tuple[str, int, int, int, int, int]]]:
    """The models and their validation: rows ``(model, n_train, n_valid, true positive, false positive, false
    negative)`` against the weak labels of unseen hosts."""
    base = docs.select("text", "source")
    page_like = _sample(base, _PAGE_JAVA, True, sample).unionByName(_sample(base, _PAGE_JAVA, False, sample))
    sampled = page_like.unionByName(_sample(base, _SLOT_SIGN, True, sample))
    # The sample is labelled and turned into features by the workers; the driver gets sets of small numbers.
    spread = materialize(sampled.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(_weakly, "text string, source string, label int, whole boolean"), "sample")
    cases = _collected(spread.mapInArrow(_label, _CASES))
    part, part_row = _fit(cases, "part")
    slot, slot_row = _fit(cases, "slot")
    page, page_row = (None, ("page", 0, 0, 0, 0, 0)) if part is None else _fit(_collected(spread.mapInArrow(_label_pages(part), _CASES)), "page")
    return Models(part, page, slot), [part_row, page_row, slot_row]


def found(texts: pa.Array, models: Models, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of every text, whether it holds an open slot and whether it consists of residue."""
    n = len(texts)
    open_slot, page = np.zeros(n, bool), np.zeros(n, bool)
    if models.page is not None:
        c, _ = cut(texts, words)
        page = (models.page.scores(page_features(c, models.part.scores(part_features(c)))) >= AT) & (np.bincount(np.repeat(np.arange(n), np.diff(c.of_text)), np.diff(c.of_part), n) > 0)
    if models.slot is not None:
        for k in np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _SLOT_SIGN), False).to_numpy(zero_copy_only=False)):
            text = texts[int(k)].as_py()
            at = [m.span() for m in SLOT.finditer(text)]
            quotes = [m.span() for m in _QUOTES.finditer(text)] if at else []
            # A construct inside a quotation is quoted by definition; all others are the model's to judge.
            open_slot[k] = any(models.slot.score(*slot_features(text, a, b, quotes)) >= AT for a, b in at if not any(c < a and b < d for c, d in quotes))
    return open_slot, page


def by_rules(text: str | None) -> tuple[bool, bool]:
    """What the weak labels say of a text: an open slot, residue. For comparison with the models only."""
    if not text or not text.strip():
        return False, False
    return any(weak_slot(text, a, b, said) for a, b, said in slots(text)), weak_page(text) == 1


def residue(docs: DataFrame, key: str = "doc_id", sample: int = SAMPLE, with_rules: bool = False) -> DataFrame:
    """``key, open_slot, residue_page`` of every document that is to be left out; ``with_rules`` adds
    ``rule_slot, rule_page`` and the documents that only these name."""
    models, _ = train(docs, sample)
    sent = docs.sparkSession.sparkContext.broadcast(models)
    kind = next(f.dataType.simpleString() for f in docs.schema if f.name == key)
    names = [key, "open_slot", "residue_page"] + ["rule_slot", "rule_page"] * with_rules

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            marks = list(found(batch.column(1), sent.value, words))
            if with_rules:
                marks += list(np.asarray([by_rules(t) for t in batch.column(1).to_pylist()], bool).reshape(-1, 2).T)
            out = pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m) for m in marks]], names=names)
            yield out.filter(pa.array(np.logical_or.reduce(marks)))

    return docs.select(key, "text").mapInArrow(look, ", ".join([f"{key} {kind}"] + [f"{n} boolean" for n in names[1:]])).distinct()
