"""Cutting oversized items at natural boundaries.

Items longer than a limit are cut into pieces of at most ``limit`` code points; every piece after the first
starts exactly ``overlap`` code points before the end of the piece before it. Dynamic programming over the
boundary positions minimises the sum of cut penalties (paragraph end, sentence end, clause, comma, blank,
within a word) and of the pieces' imbalance.

Defined results: null and short items are left out (they need no cut); a text without any blank is cut
within the word, never between a base and its combining mark while another place exists; texts of any
length are processed whole; repeated rows of an item give its pieces once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1_200
OVERLAP = 120
#: Characters from which a whole document counts as oversized.
DOCUMENT_LIMIT = 15_000

# Penalty of a cut by what ends there.
PENALTY = {"line": 0.0, "sentence": 1.0, "clause": 3.0, "comma": 5.0, "blank": 8.0, "word": 30.0}
#: Weight of the squared imbalance, and the cost of one more piece.
BALANCE, PER_PIECE = 12.0, 4.0
#: A stretch without blanks longer than this gets cut places inside the word, this far apart.
STRETCH = 60

_BOUNDARY = re.compile(r"(?P<line>\n)|(?P<sentence>[.!?…。！？][\"'”’)\]]*(?=\s|$))|(?P<clause>[;:](?=\s))|(?P<comma>,(?=\s))|(?P<blank>\s)")


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a piece may end, ascending, with their penalties; the text's end is the last."""
    where, cost = [], []
    last = 0
    for m in _BOUNDARY.finditer(text):
        at = m.end() if m.lastgroup != "blank" else m.start()
        _stretch(text, last, at, where, cost)
        last = max(last, m.end())
        if 0 < at < len(text):
            where.append(at)
            cost.append(PENALTY[m.lastgroup])
    _stretch(text, last, len(text), where, cost)
    where.append(len(text))
    cost.append(0.0)
    at, index = np.unique(np.asarray(where), return_inverse=True)
    best = np.full(len(at), np.inf)
    np.minimum.at(best, index, np.asarray(cost))
    return at, best


def _stretch(text: str, start: int, end: int, where: list, cost: list) -> None:
    if end - start <= STRETCH:
        return
    import unicodedata

    for at in range(start + STRETCH, end, STRETCH):
        where.append(at)
        cost.append(PENALTY["word"] + 10 * bool(unicodedata.combining(text[at])))


def split_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces; one piece if the text is within the limit."""
    if not 0 <= overlap < limit - STRETCH:
        raise ValueError("overlap must leave room for a stretch of text in every piece")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    at, penalty = boundaries(text)
    step = limit - overlap
    pieces = -(-(n - overlap) // step)
    ideal = (n - overlap) / pieces
    best = np.full(len(at), np.inf)
    back = np.full(len(at), -1)
    first = at <= limit
    best[first] = penalty[first] + PER_PIECE + BALANCE * ((at[first] - overlap - ideal) / limit) ** 2
    lows = np.searchsorted(at, at - step)
    for j in range(int(first.sum()), len(at)):
        low = lows[j]
        span = at[low:j]
        # A piece must end beyond the overlap it repeats, else nothing is gained.
        total = best[low:j] + BALANCE * ((at[j] - span - ideal) / limit) ** 2
        k = int(np.argmin(total))
        best[j] = total[k] + penalty[j] + PER_PIECE
        back[j] = low + k
    ends, j = [], len(at) - 1
    while j >= 0:
        ends.append(int(at[j]))
        j = int(back[j])
    ends.reverse()
    return [(0 if k == 0 else ends[k - 1] - overlap, end) for k, end in enumerate(ends)]


def oversized(docs: DataFrame, limit: int = LIMIT, document_limit: int = DOCUMENT_LIMIT) -> DataFrame:
    """``doc_id, pos, text`` of the paragraphs over ``limit`` and, at ``pos`` -1, of the documents over
    ``document_limit`` (paragraph texts joined with one line feed; null texts are left out)."""
    paragraphs = docs.select("doc_id", F.posexplode("paragraphs").alias("pos", "p")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("p.text").alias("text"))
    whole = docs.select("doc_id", F.lit(-1).cast("long").alias("pos"), F.array_join(F.transform("paragraphs", lambda p: p["text"]), "\n").alias("text"))
    long = paragraphs.where(F.length("text") > limit).unionByName(whole.where(F.length("text") > document_limit))
    return long.dropDuplicates(["doc_id", "pos"])


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, pos, piece_no, start_at, end_at, text`` for items ``doc_id, pos, text``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, poss, texts = (batch.column(k).to_pylist() for k in ("doc_id", "pos", "text"))
            out: dict[str, list] = {k: [] for k in ("doc_id", "pos", "piece_no", "start_at", "end_at", "text")}
            held = 0
            for doc, pos, text in zip(docs, poss, texts, strict=True):
                for k, (a, b) in enumerate(split_points(text or "", limit, overlap)):
                    for name, value in zip(out, (doc, pos, k, a, b, (text or "")[a:b]), strict=True):
                        out[name].append(value)
                    held += b - a
                if held > 4_000_000:
                    yield _piece_batch(out)
                    out, held = {k: [] for k in out}, 0
            if out["doc_id"]:
                yield _piece_batch(out)

    return items.select("doc_id", "pos", "text").mapInArrow(cut, "doc_id string, pos long, piece_no long, start_at long, end_at long, text string")


def _piece_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))
