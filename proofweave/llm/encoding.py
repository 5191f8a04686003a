"""Encoding of the whole corpus with a public byte-level BPE tokenizer.

Byte-level BPE never merges across the words of its split pattern, so every distinct word is encoded once:
Spark splits the texts, the distinct words become a table ``word -> ids`` in the shared folder, and the ids
are joined back by position. If that table is within :data:`MAP_SIDE_WORDS` and :data:`MAP_SIDE_BYTES`
(checked on the written table) it is sent to the tasks and joined map-side without any shuffle of the
corpus; beyond that bound the join is a shuffle join in which the commonest words, a bounded list, are
broadcast. Decoding joins ids to the fixed piece table of the tokenizer.

Defined results: null and empty texts have no ids (an empty list, a size of 0); repeated rows give one
result each; very long texts are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofweave.session import materialize

#: Where the rank file of the public tokenizer lies; a parameter of every function.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Bounds up to which the word table is joined map-side.
MAP_SIDE_WORDS = 1_500_000
MAP_SIDE_BYTES = 96 << 20
#: Words that the shuffle join broadcasts, at most.
COMMON_WORDS = 2_048

_SPACE = r"\t-\r\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Fixed value: the tokenizer's split pattern, its white space written out for Java.
SPLIT_JAVA = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    """The vocabulary: bytes of a piece to its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}


def split_words(text) -> F.Column:
    """The words of a text as the tokenizer splits it; empty for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(SPLIT_JAVA), F.lit(0)), F.array().cast("array<string>"))


def word_table(docs: DataFrame, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``word, ids, n, in_docs``: every distinct word encoded once, written to the shared folder."""
    words = docs.select(F.explode(F.array_distinct(split_words(F.col(text)))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("in_docs"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        bpe = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(ranks), special_tokens={})
        for batch in batches:
            ids = [bpe._encode_single_piece(w) for w in batch["word"]]
            yield pd.DataFrame({"word": batch["word"], "ids": ids, "n": [len(x) for x in ids], "in_docs": batch["in_docs"]})

    return materialize(words.mapInPandas(encode, "word string, ids array<int>, n int, in_docs long"), "words")


def fits_map_side(words: DataFrame) -> bool:
    """Whether the word table is small enough to be sent to every task."""
    size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("word") + 4 * F.col("n") + 16), F.lit(0)).alias("b")).first()
    return size["n"] <= MAP_SIDE_WORDS and size["b"] <= MAP_SIDE_BYTES


def _lookup(spark: SparkSession, words: DataFrame):
    """The word table as a broadcast (words, flat ids, offsets)."""
    local = words.select("word", "ids").toPandas()
    flat = np.concatenate([np.asarray(x, np.int32) for x in local["ids"]]) if len(local) else np.empty(0, np.int32)
    ends = np.cumsum([len(x) for x in local["ids"]], dtype=np.int64) if len(local) else np.empty(0, np.int64)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("word", pa.string())])) as out:
        out.write_table(pa.table({"word": pa.array(local["word"], pa.string())}))
    return spark.sparkContext.broadcast((sink.getvalue().to_pybytes(), flat, np.concatenate([[0], ends]).astype(np.int64)))


def _join_batch(words: pa.Array, table: pa.Array, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of a list array, and the number of ids of each list."""
    values, offsets = words.flatten(), np.asarray(words.offsets, np.int64)
    row = np.asarray(pc.index_in(values, value_set=table).to_numpy(zero_copy_only=False), np.int64)
    size = starts[row + 1] - starts[row]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    # Position of every id in the flat table: start of its word plus its place within the word.
    take = np.arange(total, dtype=np.int64) - np.repeat(ends - size, size) + np.repeat(starts[row], size)
    bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
    return flat[take], bounds


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS, counts_only: bool = False, map_side: bool | None = None) -> DataFrame:
    """``key, ids`` (or ``key, n_tokens``) for every row of ``docs``.

    ``map_side`` forces one of the two joins in tests; None checks the word table's size.
    """
    base = docs.select(key, text)
    words = word_table(base, text, ranks)
    if map_side is None:
        map_side = fits_map_side(words)
    if not map_side:
        return _encode_by_shuffle(base, words, key, text, counts_only)
    lookup = _lookup(docs.sparkSession, words)
    kind = next(f.dataType.simpleString() for f in base.schema if f.name == key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, flat, starts = lookup.value
        table = pa.ipc.open_stream(raw).read_all()["word"].combine_chunks()
        for batch in batches:
            # Lists are handled in slices, so that one batch of long texts stays small in memory.
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, bounds = _join_batch(_plain(part.column(1)), table, flat, starts)
                if counts_only:
                    out = pa.array(np.diff(bounds), pa.int64())
                else:
                    out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[key, "out"])

    split = base.select(key, split_words(F.col(text)).alias("words"))
    if counts_only:
        return split.mapInArrow(join, f"{key} {kind}, out long").withColumnRenamed("out", "n_tokens")
    return split.mapInArrow(join, f"{key} {kind}, out array<int>").withColumnRenamed("out", "ids")


def _plain(lists: pa.Array) -> pa.ListArray:
    return lists if isinstance(lists, pa.ListArray) else lists.cast(pa.list_(pa.string()))


def _encode_by_shuffle(base: DataFrame, words: DataFrame, key: str, text: str, counts_only: bool) -> DataFrame:
    """Join by position through the shuffle. The commonest words, a bounded list, are joined by broadcast, so
    no word of the rest is frequent; rows are told apart by a row number, not by the key."""
    rows = base.withColumn("__row", F.monotonically_increasing_id())
    rows = materialize(rows, "rows")
    common = words.orderBy(F.desc("in_docs"), "word").limit(COMMON_WORDS).select("word", F.lit(True).alias("common"))
    tagged = materialize(words.join(F.broadcast(common), "word", "left"), "tagged")
    frequent, rare = tagged.where("common").select("word", "ids"), tagged.where("common is null").select("word", "ids")
    spread = rows.select("__row", F.posexplode(split_words(F.col(text))).alias("pos", "word"))
    near = spread.join(F.broadcast(frequent.withColumnRenamed("ids", "near")), "word", "left")
    far = near.where(F.col("near").isNull()).drop("near").join(rare, "word").select("__row", "pos", "ids")
    both = near.where(F.col("near").isNotNull()).select("__row", "pos", F.col("near").alias("ids")).unionByName(far)
    if counts_only:
        per_row = both.groupBy("__row").agg(F.sum(F.size("ids")).cast("long").alias("n_tokens"))
        return rows.select("__row", key).join(per_row, "__row", "left").select(key, F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"))
    per_row = both.groupBy("__row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "ids"))), lambda x: x["ids"])).alias("ids"))
    return rows.select("__row", key).join(per_row, "__row", "left").select(key, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", ranks: str = RANKS) -> DataFrame:
    """``key, text``: ids joined to the piece table. The table has a fixed size (the vocabulary), so it is
    held by every task and joined by position in the id; ids outside it raise an error."""
    kind = next(f.dataType.simpleString() for f in encoded.schema if f.name == key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = read_ranks(ranks)
        table = [b""] * (max(vocabulary.values()) + 1)
        for piece, rank in vocabulary.items():
            table[rank] = piece
        pieces = pa.array(table, pa.binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                offsets = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
                taken = pc.take(pieces, lists.flatten())
                if isinstance(taken, pa.ChunkedArray):
                    taken = taken.combine_chunks()
                ends = np.concatenate([[0], np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False), dtype=np.int64)])
                joined = b"".join(taken.to_pylist())
                bounds = ends[offsets]
                texts = [joined[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(join, f"{key} {kind}, text string")
