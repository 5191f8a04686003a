"""Encoding against the tokenizer itself, both joins, and the way back."""

import os

import pytest

from proofweave.llm import encoding as E
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.exists(E.RANKS), reason="no tokenizer files here")

TEXTS = [
    None, "", " ", "\n\n", "Plain words, and it's fine.", "tabs\tand  runs   of blanks \n next", "é ё 你好 ﷽ 🙂👩‍💻", "£1,971,296.39 on 21/08/2019", "I'll we've they'd 'tis", "x" * 3_000,
    " nbsp em　wide", "\r\n\r\ncarriage", "á combining", "<|endoftext|> is ordinary", "!!!'s", "١٢٣ Ⅷ ½", "end with blanks   ", "the the the",
]


def plain():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=E.read_ranks(), special_tokens={})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "x")], "doc_id long, text string, words string")


@pytest.mark.parametrize("map_side", [True, False])
def test_ids(docs, map_side, monkeypatch):
    monkeypatch.setattr(E, "COMMON_WORDS", 3)
    bpe = plain()
    got = E.encode(docs, map_side=map_side).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert list(r["ids"]) == bpe.encode_ordinary(TEXTS[r["doc_id"]] or ""), TEXTS[r["doc_id"]]


@pytest.mark.parametrize("map_side", [True, False])
def test_counts(docs, map_side):
    bpe = plain()
    want = sorted((i, len(bpe.encode_ordinary(t or ""))) for i, t in enumerate(TEXTS))
    assert rows(E.encode(docs, counts_only=True, map_side=map_side).distinct()) == sorted(want, key=lambda t: tuple((False, "<class 'int'>", str(x)) for x in t))


def test_way_back(docs):
    assert dict(rows(E.decode(E.encode(docs)).distinct())) == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty(spark, docs):
    assert E.encode(docs.limit(0)).count() == 0
    assert E.decode(E.encode(docs.limit(0))).count() == 0


def test_size_is_checked(docs, monkeypatch):
    words = E.word_table(docs)
    assert E.fits_map_side(words)
    monkeypatch.setattr(E, "MAP_SIDE_WORDS", 2)
    assert not E.fits_map_side(words)
