"""Near-duplicate records with small edits.

Similarity is the Jaccard share of the sets of adjacent word pairs. Every text gets a fingerprint of
``BLOCKS * WIDTH`` slots, minimum hashes over its word pairs, cut into :data:`BLOCKS` disjoint blocks. By the
pigeonhole principle two fingerprints that differ in fewer than ``BLOCKS`` slots agree on a whole block; two
that agree on a share ``s`` of their slots do so with probability ``1 - (1 - s ** WIDTH) ** BLOCKS``. Texts are
joined on equal blocks. With a block travel :data:`CHECKED` further bits, one of each of as many unweighted
minimum hashes, in which texts of similarity ``s`` differ at ``CHECKED * (1 - s) / 2`` places on average;
candidates must lie within the Hamming distance :data:`RADIUS` (which keeps 94 of 100 pairs right at the
threshold 0.5, and 999 of 1,000 from 0.6 on), and a check of the word pairs themselves follows.

Word pairs in more than :data:`RARE` of all texts weigh less, by the fourth root of their frequency, so that
phrases common to unrelated texts seldom decide a block. In a family of near copies that makes up a large
share of all rows the common word pairs are the family's own. Such families are seen by their *frequent
blocks*: blocks of unweighted slots that occur in at least :data:`FREQUENT` of all texts. Texts with such a
block also take part in an exact prefix join: their word pairs are put in one global order, rarest first, and
the first ``size - ceil(threshold * size) + 1`` of them are joined on, so that no pair among them is missed.

Frequencies are counted over all texts in sketches of fixed size, so what is broadcast does not grow with the
data; they steer only which candidates arise, never what counts as similar. A block or word pair with very
many texts is split into pieces that meet pairwise in different tasks (:data:`CROWD`).

Entries travel as packed binary columns, one row per task and target partition, and are sorted and joined
in numpy. Texts that are equal are folded before they are paired. Recall is measured by bands of similarity
and against all pairs in ``tests/llm/test_neardup.py``.

Defined results: null parts count as empty; texts of fewer than two words have no word pairs and so no near
copies; repeated rows of an id count once; equal texts under different ids are near copies of each other.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofweave.llm.unify import stable, unify_text
from proofweave.operators.graph import components
from proofweave.session import materialize, shuffle_width

#: Blocks of the fingerprint and slots of a block.
BLOCKS, WIDTH = 27, 4
#: Bits that travel with a block, and at how many places they may differ.
CHECKED, RADIUS = 64, 21
#: Share of all texts from which a word pair loses weight.
RARE = 0.01
#: Unweighted slots and the blocks drawn from them by which frequent families are seen.
PLAIN, PLAIN_BLOCKS, PLAIN_WIDTH = 100, 80, 5
#: Share (and least number) of all texts from which a plain block is frequent.
FREQUENT, FREQUENT_LEAST = 0.001, 8
#: Parities of a text's signature in the prefix join.
SIGNATURE = 256
#: Counters of each frequency sketch (4 MiB of one byte each when broadcast).
SKETCH = 1 << 22
#: Bits per candidate of the filter that keeps other texts from the verification, and the most bits it takes.
FILTER_EACH, FILTER_MOST = 16, 1 << 28
#: Similarity from which a pair is a near copy in the evidence table.
THRESHOLD = 0.5
#: Pairs of entries that are compared at once.
AT_ONCE = 500_000
#: Entries that one logical partition should hold, and entries of a key from which it is split.
ENTRIES, CROWD = 1_000_000, 200_000
#: One in this many texts is looked at to find crowded blocks; steers only how they are split.
GLANCE = 16

_ADDRESS = np.uint64((1 << 40) - 1)
_RANGES = 16
_rng = np.random.default_rng(20240607)
_SLOT_MULTIPLIERS = _rng.integers(1, 1 << 31, BLOCKS * WIDTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLAIN_MULTIPLIERS = _rng.integers(1, 1 << 31, PLAIN, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: Texts whose slots are computed at once, so that the arrays stay in the processor's cache.
_STRETCH = 1_000
_PLAIN_SLOTS = np.stack([_rng.permutation(PLAIN)[:PLAIN_WIDTH] for _ in range(PLAIN_BLOCKS)])
#: Slack for rounding in the bounds, which may only let more candidates pass.
_SLACK = 1e-6


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every character of the basic plane: its lower case, and a class: 1 for letters and digits, plus 2
    if the one text form may change it (halves of characters beyond the plane among them)."""
    lower, kind = np.arange(1 << 16, dtype=np.uint16), np.where(np.frombuffer(stable(), np.uint8), 0, 2).astype(np.uint8)
    for c in range(1 << 16):
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
        kind[c] += unicodedata.category(chr(c))[0] in "LN"
    return lower, kind


class Words:
    """Hashed words of batches of texts. A batch is handled as one array of characters; a word's hash is a
    polynomial over them, read off prefix sums, so no word is ever made into an object.

    Letters beyond the basic plane are rare enough to be spelled out (``u1d400``) before.
    """

    _BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.powers = self.inverse = np.empty(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 20)
            self.powers = np.cumprod(np.full(n, self._BASE, np.uint64), dtype=np.uint64)
            self.inverse = np.cumprod(np.full(n, pow(self._BASE, -1, 1 << 64), np.uint64), dtype=np.uint64)

    @staticmethod
    def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Characters of all texts, each closed by a 0, and the places of these."""
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-16-le", "surrogatepass"), np.uint16)
        ends = np.flatnonzero(points == 0)
        return (points, ends) if len(ends) == len(texts) else Words._points([t.replace("\0", " ") for t in texts])

    @staticmethod
    def _settled(text: str) -> str:
        text = unify_text(text)[0]
        if any(ord(c) > 0xFFFF for c in text):
            text = "".join(f"u{ord(c):x}" if ord(c) > 0xFFFF and c.isalnum() else c for c in text)
        return text

    def hashes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, and the offsets of every text in them."""
        held = pc.fill_null(texts, "").to_pylist()
        if not held:
            return np.empty(0, np.uint64), np.zeros(1, np.int64)
        lower, kind = _characters()
        points, ends = self._points(held)
        kinds = kind[points]
        odd = np.flatnonzero(kinds >= 2)
        if len(odd):
            for k in np.unique(np.searchsorted(ends, odd)):
                held[k] = self._settled(held[k])
            points, ends = self._points(held)
            kinds = kind[points]
        is_word = (kinds & 1).view(bool)
        # The array ends in a 0, which is no word, so changes come in pairs.
        change = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
        if is_word[0]:
            change = np.concatenate([[0], change])
        first, last = change[::2], change[1::2]
        self._grow(len(points))
        sums = lower[points] * self.powers[: len(points)]
        np.cumsum(sums, out=sums)
        words = _mix((sums[last - 1] - sums[first] + lower[points[first]] * self.powers[first]) * self.inverse[first] + (last - first).astype(np.uint64))
        return words, np.concatenate([[0], np.searchsorted(first, ends)])

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of adjacent word pairs, the offsets of every text in them, and a key of every text's word
        sequence (0 for texts of fewer than two words)."""
        words, offsets = self.hashes(texts)
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(offsets[:-1], n).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(words + place * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
        keys = _mix((sums[offsets[1:]] - sums[offsets[:-1]]) + n.astype(np.uint64)) | np.uint64(1)
        keys[n < 2] = 0
        inner = row[1:] == row[:-1]
        both = _mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[inner] if len(words) > 1 else np.empty(0, np.uint64)
        return both, np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))]), keys


def _buckets(pairs: np.ndarray) -> np.ndarray:
    return (pairs >> np.uint64(42)).astype(np.int64)


def _sparse(counts: np.ndarray, least: float = 1) -> list[bytes]:
    """The counters of at least ``least``, range by range: places, then values."""
    out, wide = [], len(counts) // _RANGES
    for k in range(_RANGES):
        part = counts[k * wide : (k + 1) * wide]
        at = np.flatnonzero(part >= max(least, 1)).astype(np.uint32)
        out.append(at.tobytes() + part[at].astype(np.uint32).tobytes())
    return out


def _add(table: pa.Table) -> pa.Table:
    """The sum of sparse counters of one range of one sketch."""
    total = np.zeros(SKETCH // _RANGES, np.uint64)
    for blob in table["blob"]:
        raw = np.frombuffer(blob.as_buffer(), np.uint32)
        half = len(raw) // 2
        total[raw[:half]] += raw[half:]
    at = np.flatnonzero(total).astype(np.uint32)
    blob = at.tobytes() + np.minimum(total[at], 0xFFFFFFFF).astype(np.uint32).tobytes()
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "blob": pa.array([blob], pa.binary()), "n": pa.array([pc.sum(table["n"]).as_py()], pa.int64())})


def _summed(sketches: DataFrame, how_many: int) -> tuple[list[np.ndarray], int]:
    """Dense counters of ``how_many`` sketches given as ``part, blob, n``, and the sum of ``n``."""
    wide = SKETCH // _RANGES
    out, n = [np.zeros(SKETCH, np.float64) for _ in range(how_many)], 0
    for r in sketches.groupBy("part").applyInArrow(_add, "part int, blob binary, n long").toLocalIterator():
        raw = np.frombuffer(r["blob"], np.uint32)
        half, at = len(raw) // 2, r["part"] % _RANGES * wide
        out[r["part"] // _RANGES][at + raw[:half]] = raw[half:]
        n += r["n"]
    return out, n


def _minima(pairs: np.ndarray, starts: np.ndarray, multipliers: np.ndarray, scale: np.ndarray | None = None) -> np.ndarray:
    """Minimum hashes (multipliers x rows) of the stretches of ``pairs`` that begin at ``starts``, none empty."""
    out = np.empty((len(multipliers), len(starts)), np.uint32)
    ends = np.append(starts, len(pairs))
    for at in range(0, len(starts), _STRETCH):
        first, last = ends[at], ends[min(at + _STRETCH, len(starts))]
        small = (pairs[first:last] >> np.uint64(20)).astype(np.uint32)
        begin = starts[at : at + _STRETCH] - first
        for k, m in enumerate(multipliers):
            value = small * m
            if scale is not None:
                value = np.multiply(value, scale[first:last], dtype=np.float32, casting="unsafe")
            out[k, at : at + _STRETCH] = np.minimum.reduceat(value, begin).view(np.uint32)
    return out


def plain_slots(pairs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have word pairs, and their unweighted slots (``PLAIN`` x rows)."""
    rows = np.flatnonzero(np.diff(offsets) > 0)
    return rows, _minima(pairs, offsets[:-1][rows], _PLAIN_MULTIPLIERS)


def plain_blocks(slots: np.ndarray) -> np.ndarray:
    """The counters of the unweighted blocks (``PLAIN_BLOCKS`` x rows)."""
    at = np.empty((PLAIN_BLOCKS, slots.shape[1]), np.int64)
    for b, chosen in enumerate(_PLAIN_SLOTS):
        key = np.full(slots.shape[1], b + 1, np.uint64)
        for k in chosen:
            key = (key ^ (key >> np.uint64(29)) ^ slots[k]) * np.uint64(0x9E3779B97F4A7C15)
        at[b] = (_mix(key) % np.uint64(SKETCH)).astype(np.int64)
    return at


def _survey(base: DataFrame) -> tuple[np.ndarray, np.ndarray, int, DataFrame]:
    """A frequency class per counter of word pairs (0: the pair occurs once; else 8 classes per doubling), which
    counters of plain blocks are frequent, the number of texts, and the membership ``class_id, id``; all from
    one pass."""
    names = ["part", "blob", "n", "class_id", "id"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, plain, n = Words(), np.zeros(SKETCH, np.int64), np.zeros(SKETCH, np.int64), 0
        for batch in batches:
            pairs, offsets, keys = words.pairs(batch.column(1))
            counts += np.bincount(_buckets(pairs), minlength=SKETCH)
            plain += np.bincount(plain_blocks(plain_slots(pairs, offsets)[1]).ravel(), minlength=SKETCH)
            n += int((keys != 0).sum())
            nothing = pa.nulls(len(keys))
            yield pa.RecordBatch.from_arrays([nothing.cast(pa.int32()), nothing.cast(pa.binary()), nothing.cast(pa.int64()), pa.array(keys.view(np.int64)), batch.column(0)], names=names)
        # What a task leaves out lowers no sum by more than an eighth of the bound for frequent blocks.
        blobs = _sparse(counts) + _sparse(plain, FREQUENT * n / 8)
        sizes = [n] + [0] * (2 * _RANGES - 1)
        yield pa.RecordBatch.from_arrays([pa.array(range(2 * _RANGES), pa.int32()), pa.array(blobs, pa.binary()), pa.array(sizes, pa.int64()), pa.nulls(2 * _RANGES, pa.int64()), pa.nulls(2 * _RANGES, pa.string())], names=names)

    both = materialize(base.mapInArrow(count, "part int, blob binary, n long, class_id long, id string"), "survey")
    members = both.where("class_id <> 0").select("class_id", "id").distinct()
    (counts, plain), n = _summed(both.where("part is not null").select("part", "blob", "n"), 2)
    classes = np.rint(8 * np.log2(np.maximum(counts, 1))).clip(0, 255)
    classes[counts < 2] = 0
    return classes.astype(np.uint8), np.packbits(plain >= max(7 / 8 * FREQUENT * n, FREQUENT_LEAST)), n, members


def fingerprints(pairs: np.ndarray, offsets: np.ndarray, classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a fingerprint, and their slots (``BLOCKS * WIDTH`` x rows, unsigned 32 bit). Word pairs
    that occur once in the corpus cannot be shared and are left out; ``n`` is the number of all texts."""
    kinds = classes[_buckets(pairs)]
    above = np.maximum(np.arange(256) / 8 - np.log2(max(RARE * n, 1.0)), 0)
    scale = np.power(2.0, above / 4).astype(np.float32)[kinds]
    shared = kinds > 0
    kept = np.concatenate([[0], np.cumsum(shared)])[offsets]
    rows = np.flatnonzero(np.diff(kept) > 0)
    pairs, scale, starts = pairs[shared], scale[shared], kept[:-1][rows]
    return rows, _minima(pairs, starts, _SLOT_MULTIPLIERS, scale)


def block_keys(slots: np.ndarray) -> Iterator[np.ndarray]:
    """The keys of every block of fingerprints, block by block."""
    for b in range(BLOCKS):
        key = np.full(slots.shape[1], b + 1, np.uint64)
        for k in range(b * WIDTH, (b + 1) * WIDTH):
            key = (key ^ (key >> np.uint64(29)) ^ slots[k]) * np.uint64(0x9E3779B97F4A7C15)
        yield _mix(key)


def _crowded(base: DataFrame, classes, n: int) -> np.ndarray:
    """Pieces of every hashed block key (``SKETCH`` small numbers, mostly 1)."""
    names = ["part", "blob", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), np.zeros(SKETCH, np.int64)
        for batch in batches:
            pairs, offsets, _ = words.pairs(batch.column(1))
            for key in block_keys(fingerprints(pairs, offsets, classes.value, n)[1]):
                counts += np.bincount((key % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
        yield pa.RecordBatch.from_arrays([pa.array(range(_RANGES), pa.int32()), pa.array(_sparse(counts, 2), pa.binary()), pa.array([0] * _RANGES, pa.int64())], names=names)

    seen = base.where(F.pmod(F.xxhash64("id"), F.lit(GLANCE)) == 0)
    (counts,), _ = _summed(seen.mapInArrow(count, "part int, blob binary, n long"), 1)
    return np.ceil(counts * GLANCE / CROWD).clip(1, 255).astype(np.uint8)


def prefixes(pairs: np.ndarray, offsets: np.ndarray, classes: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """What is joined on: word pairs, and of each its row and its place in the row's order; then, for all
    rows, the numbers of different word pairs and the signatures (rows x ``SIGNATURE / 64``)."""
    n = len(offsets) - 1
    row, kinds = np.repeat(np.arange(n), np.diff(offsets)), classes[_buckets(pairs)]
    order = np.lexsort((pairs, row * 256 + kinds))
    pairs, row, kinds = pairs[order], row[order], kinds[order]
    first = np.ones(len(pairs), bool)
    first[1:] = (pairs[1:] != pairs[:-1]) | (row[1:] != row[:-1])
    pairs, row, kinds = pairs[first], row[first], kinds[first]
    sizes = np.bincount(row, minlength=n).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(pairs)) - starts[row]
    some = np.flatnonzero(sizes)
    signs = np.zeros((n, SIGNATURE // 64), np.uint64)
    if len(some):
        bit, word = np.uint64(1) << (pairs & np.uint64(63)), (pairs >> np.uint64(6)) % np.uint64(SIGNATURE // 64)
        for k in range(SIGNATURE // 64):
            signs[some, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), starts[some])
    length = sizes - np.ceil(threshold * sizes - _SLACK).astype(np.int64) + 1
    joined = (place < length[row]) & (kinds > 0)
    return pairs[joined], row[joined], place[joined], sizes, signs


def _bits(slots: np.ndarray) -> np.ndarray:
    """One bit of each of the first ``CHECKED`` slots, packed into 64 bits."""
    out = np.zeros(slots.shape[1], np.uint64)
    for k in range(CHECKED):
        out |= ((slots[k] * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint64) << np.uint64(k)
    return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of packed bits."""
    return np.bitwise_count(a ^ b)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of 64-bit values as a byte matrix."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _unpack(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : raw.shape[1]] = raw
    return wide.view("<u8").ravel()


def _in_cells(key: np.ndarray, packed: np.ndarray, address: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of split keys, repeated into every cell in which their piece meets another (or itself)."""
    if (pieces <= 1).all():
        return key, packed
    split = np.flatnonzero(pieces > 1)
    g = pieces[split].astype(np.int64)
    at = np.repeat(split, g)
    other = np.arange(len(at)) - np.repeat(np.cumsum(g) - g, g)
    own = (_mix(address[at]) % np.repeat(g, g).astype(np.uint64)).astype(np.int64)
    cell = np.minimum(own, other) * 256 + np.maximum(own, other) + 1
    whole = pieces <= 1
    return np.concatenate([key[whole], _mix(key[at] + cell.astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53))]), np.concatenate([packed[whole], packed[at]])


def _candidates(base: DataFrame, classes: np.ndarray, frequent: np.ndarray, n: int, threshold: float) -> DataFrame:
    """``a, b``: addresses (40 bits of the text key) of texts that share a block and lie within the radius, or
    that the prefix join of texts with frequent blocks cannot tell apart."""
    spark = base.sparkSession
    parts = max(4 * shuffle_width(spark), -(-BLOCKS * n // ENTRIES))
    sent = spark.sparkContext.broadcast(classes)
    often, pieces = spark.sparkContext.broadcast(frequent), spark.sparkContext.broadcast(_crowded(base, sent, n))

    def by_blocks(pairs: np.ndarray, offsets: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        rows, slots = fingerprints(pairs, offsets, sent.value, n)
        address = keys[rows] & _ADDRESS
        tail = np.hstack([_pack(address, 5), _pack(bits[rows], 8)])
        for key in block_keys(slots):
            key, rest = _in_cells(key, tail, address, pieces.value[(key % np.uint64(SKETCH)).astype(np.int64)])
            yield (key % np.uint64(parts)).astype(np.int64), np.hstack([_pack(key >> np.uint64(40), 3), rest])

    def by_prefixes(pairs: np.ndarray, offsets: np.ndarray, keys: np.ndarray, rows: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        chosen = rows[((often.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).any(0)]
        if not len(chosen):
            return
        wanted = np.zeros(len(keys), bool)
        wanted[chosen] = True
        inside, bounds, keys = pairs_of(pairs, offsets, keys, wanted)
        joined, row, place, sizes, signs = prefixes(inside, bounds, sent.value, threshold)
        key, address = _mix(joined), (keys & _ADDRESS)[row]
        packed = np.hstack([_pack(address, 5), signs[row].view(np.uint8), _pack(sizes[row], 4), _pack(place, 4)])
        often_met = np.ceil(np.power(2.0, sent.value[_buckets(joined)] / 8) / CROWD).clip(1, 255).astype(np.uint8)
        key, packed = _in_cells(key, packed, address, often_met)
        yield (key % np.uint64(parts)).astype(np.int64) + parts, np.hstack([_pack(key >> np.uint64(40), 3), packed])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, few = Words(), [], []
        for batch in batches:
            pairs, offsets, keys = words.pairs(batch.column(1))
            rows, plain = plain_slots(pairs, offsets)
            bits = np.zeros(len(keys), np.uint64)
            bits[rows] = _bits(plain)
            held.extend(by_blocks(pairs, offsets, keys, bits))
            few.extend(by_prefixes(pairs, offsets, keys, rows, plain_blocks(plain)))
            for some in (held, few):
                if sum(len(p) for p, _ in some) > 1_500_000:
                    yield _by_part(some)
                    some.clear()
        for some in (held, few):
            if some:
                yield _by_part(some)

    def join(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), np.uint8) for x in table["blob"]]
        make = _same_blocks if table["part"][0].as_py() < parts else _same_prefixes
        a, b = make(np.concatenate(blobs), threshold)
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.uint64)
        return pa.table({"a": pa.array(pairs[:, 0].astype(np.int64)), "b": pa.array(pairs[:, 1].astype(np.int64))})

    packed = base.mapInArrow(entries, "part int, blob binary").repartition(max(shuffle_width(spark), parts // 4), "part")
    return packed.groupBy("part").applyInArrow(join, "a long, b long").distinct()


def _same_blocks(raw: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Addresses of texts that share a block and lie within the Hamming radius."""
    raw = raw.reshape(-1, 16)
    key, address, bits = _unpack(raw[:, :3]), _unpack(raw[:, 3:8]), _unpack(raw[:, 8:])
    order = np.lexsort((address, key))
    key, address, bits = key[order], address[order], bits[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (address[1:] != address[:-1])  # equal texts once
    key, address, bits = key[first], address[first], bits[first]
    met = np.searchsorted(key, key, "right") - np.arange(len(key)) - 1
    left, right = [], []
    for at, other in _meetings(np.arange(1, len(key) + 1), met):
        near = _distance(bits[at], bits[other]) <= RADIUS
        left.append(address[at[near]])
        right.append(address[other[near]])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _meetings(begins: np.ndarray, met: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of every entry and of the ``met`` entries from ``begins`` on that it meets, a bounded number at once."""
    ends = np.concatenate([[0], np.cumsum(met)])
    done = 0
    while done < ends[-1]:
        which = np.arange(done, min(done + AT_ONCE, ends[-1]))
        at = np.searchsorted(ends, which, "right") - 1
        yield at, begins[at] + which - ends[at]
        done += len(which)


def _same_prefixes(raw: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Addresses of texts that share a word pair of their prefixes and that no bound separates."""
    wide = SIGNATURE // 8
    raw = raw.reshape(-1, wide + 16)
    both, signs = _unpack(raw[:, :3]) << np.uint64(40) | _unpack(raw[:, 3:8]), np.ascontiguousarray(raw[:, 8 : wide + 8]).view(np.uint64)
    sizes, place = _unpack(raw[:, wide + 8 : wide + 12]).astype(np.int64), _unpack(raw[:, wide + 12 :]).astype(np.int64)
    order = np.lexsort((place, signs[:, 0], both))
    same = (both[order[1:]] == both[order[:-1]]) & (signs[order[1:]] == signs[order[:-1]]).all(1)
    order = order[np.concatenate([[True], ~same])] if len(order) else order  # equal texts once, at the first place
    order = order[np.lexsort((sizes[order], both[order] >> np.uint64(40)))]
    both, signs, sizes, rest = both[order], signs[order], sizes[order], (sizes - place)[order]
    address, common = both & _ADDRESS, threshold / (1 + threshold)
    # An entry meets the entries of its word pair that come after it, up to the greatest size that its place allows.
    most = np.maximum(rest / common - sizes + _SLACK, 0).astype(np.uint64)
    key = (both >> np.uint64(40)) << np.uint64(40)
    begins = np.arange(1, len(key) + 1)
    met = np.maximum(np.searchsorted(key + sizes.astype(np.uint64), key + most, "right") - begins, 0)
    left, right = [], []
    for at, other in _meetings(begins, met):
        least = common * (sizes[at] + sizes[other]) - _SLACK  # common word pairs of texts at the threshold
        near = np.minimum(rest[at], rest[other]) >= least
        at, other, least = at[near], other[near], least[near]
        differ = np.bitwise_count(signs[at] ^ signs[other]).sum(1, dtype=np.int64)
        near = differ <= sizes[at] + sizes[other] - 2 * least
        left.append(np.minimum(address[at[near]], address[other[near]]))
        right.append(np.maximum(address[at[near]], address[other[near]]))
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _by_part(held: list) -> pa.RecordBatch:
    part = np.concatenate([p for p, _ in held])
    rows = np.concatenate([r for _, r in held])
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    ends = np.concatenate([starts[1:], [len(part)]]).astype(np.int64) if len(part) else starts
    blobs = [rows[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _filter(pairs: DataFrame) -> tuple[np.ndarray, int]:
    """A bit per hashed address that occurs in ``pairs``, and the number of pairs. A full filter would let more
    texts through, never fewer."""
    n = pairs.count()
    bits = min(1 << max(FILTER_EACH * n, 1 << 16).bit_length(), FILTER_MOST)
    wide = bits // _RANGES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.uint32)]
        for batch in batches:
            held.extend(_place(batch.column(k).to_numpy(), bits).astype(np.uint32) for k in (0, 1))
        at = np.unique(np.concatenate(held))
        ends = np.searchsorted(at, np.arange(_RANGES + 1) * wide)
        blobs = [(at[ends[k] : ends[k + 1]] - np.uint32(k * wide)).tobytes() for k in range(_RANGES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(_RANGES), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    def merge(table: pa.Table) -> pa.Table:
        marked = np.zeros(wide, bool)
        for blob in table["blob"]:
            marked[np.frombuffer(blob.as_buffer(), np.uint32)] = True
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "blob": pa.array([np.packbits(marked).tobytes()], pa.binary())})

    out = np.zeros(bits // 8, np.uint8)
    for r in pairs.select("a", "b").mapInArrow(mark, "part int, blob binary").groupBy("part").applyInArrow(merge, "part int, blob binary").toLocalIterator():
        out[r["part"] * wide // 8 : (r["part"] + 1) * wide // 8] = np.frombuffer(r["blob"], np.uint8)
    return out, n


def _place(address: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(address.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)


def gram_sets(pairs: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different word pairs of every text, 32 bits each and sorted, and their offsets."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    both = np.unique((row << np.uint64(32)) | (pairs >> np.uint64(32)))
    return (both & np.uint64(0xFFFFFFFF)).astype(np.uint32), np.searchsorted(both >> np.uint64(32), np.arange(len(offsets)))


def shares(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """Jaccard shares of two columns of sets; 0 where both are empty."""
    n = len(of_a) - 1
    keyed = [(np.repeat(np.arange(n, dtype=np.uint64), np.diff(o)) << np.uint64(32)) | s for s, o in ((a, of_a), (b, of_b))]
    every = np.sort(np.concatenate(keyed), kind="stable")
    common = np.bincount((every[1:][every[1:] == every[:-1]] >> np.uint64(32)).astype(np.int64), minlength=n)
    return common / np.maximum(np.diff(of_a) + np.diff(of_b) - common, 1)


def jaccard(texts_a: pa.Array, texts_b: pa.Array, words: Words) -> np.ndarray:
    """Share of common word pairs of two columns of texts; 0 where both have none."""
    return shares(*gram_sets(*words.pairs(texts_a)[:2]), *gram_sets(*words.pairs(texts_b)[:2]))


def pairs_of(pairs: np.ndarray, offsets: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word pairs, offsets and keys of the wanted rows."""
    length = np.diff(offsets)
    return pairs[np.repeat(wanted, length)], np.concatenate([[0], np.cumsum(length[wanted])]), keys[wanted]


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets of a binary column and their offsets."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(np.uint32) if data is not None and len(column) else np.empty(0, np.uint32)
    return flat, (ends - ends[0]) // 4


def class_links(records: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Pairs between classes of equal texts, and membership.

    Returns ``(links, members)``: ``links`` holds ``class_a, class_b, share`` with ``class_a < class_b`` for
    different texts with a share of at least ``threshold``; ``members`` holds ``class_id, id`` for every
    record with word pairs. Class ids are 64-bit keys of the word sequence.
    """
    base = records.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    classes, frequent, n, members = _survey(base)
    pairs = materialize(_candidates(base, classes, frequent, n, threshold), "pairs")
    marked, n_pairs = _filter(pairs)
    bits, sent = 8 * len(marked), base.sparkSession.sparkContext.broadcast(marked)
    wide = max(shuffle_width(base.sparkSession), -(-n_pairs // ENTRIES))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            pairs, offsets, keys = words.pairs(batch.column(1))
            place = _place(keys & _ADDRESS, bits)
            wanted = ((sent.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1) & (keys != 0)
            pairs, offsets, keys = pairs_of(pairs, offsets, keys, wanted)
            sets, ends = gram_sets(pairs, offsets)
            grams = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer((4 * ends).astype(np.int32).tobytes()), pa.py_buffer(sets.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array((keys & _ADDRESS).view(np.int64)), pa.array(keys.view(np.int64)), grams], names=["address", "class_id", "grams"])

    # One shuffle of the texts that occur in a candidate; both sides of the pair join reuse it.
    texts = base.mapInArrow(look, "address long, class_id long, grams binary").repartition(wide, "address").dropDuplicates(["address", "class_id"])
    side = {s: texts.select(F.col("address").alias(s), F.col("class_id").alias(f"class_{s}"), F.col("grams").alias(f"grams_{s}")) for s in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b").select("class_a", "class_b", "grams_a", "grams_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = shares(*_sets(batch.column(2)), *_sets(batch.column(3)))
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(share)], names=["class_a", "class_b", "share"])
            yield out.filter(pa.array((share >= threshold) & (a != b)))

    return both.mapInArrow(verify, "class_a long, class_b long, share double"), members


def pairs_of_ids(links: DataFrame, members: DataFrame) -> DataFrame:
    """``id_a, id_b`` with ``id_a < id_b``: all pairs of near copies, equal texts included."""
    left = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    right = members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    across = links.select("class_a", "class_b").join(left, "class_a").join(right, "class_b").select("x", "y")
    several = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("class_id")
    copied = members.join(several, "class_id")
    within = copied.select("class_id", F.col("id").alias("x")).join(copied.select("class_id", F.col("id").alias("y")), "class_id").where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``id, class_id, group_id, n_links``: every record with word pairs, the class of its text, the group of
    texts connected by links (the smallest class id of it) and the links of its text to other texts."""
    ends = links.select("class_a", "class_b").select(F.explode(F.array("class_a", "class_b")).alias("class_id"))
    n_links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    group = components(links.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))).select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
    joined = members.join(n_links.join(group, "class_id"), "class_id", "left")
    return joined.select("id", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def evidence_text(evidence: DataFrame) -> DataFrame:
    """``id, text``: assertion, a blank and quote of the evidence table; null parts as empty."""
    return evidence.select("id", F.concat(F.coalesce("assertion", F.lit("")), F.lit(" "), F.coalesce("quote", F.lit(""))).alias("text"))
