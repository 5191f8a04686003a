"""Near copies against brute force on made-up edits."""

import random
from itertools import combinations

import pyarrow as pa
import pytest

from proofweave.llm import neardup as N
from tests.conftest import rows

WORDS = [f"w{i}" for i in range(900)]


def grams(text):
    w = text.lower().split()
    return set(zip(w, w[1:], strict=False))


def edited(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [w[k], rng.choice(WORDS)]])
    return " ".join(w)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = []
    for _ in range(160):
        base = " ".join(rng.choices(WORDS, k=rng.randint(30, 90)))
        out += [base] + [edited(rng, base, rng.randint(0, len(base.split()) // 12)) for _ in range(rng.choice([0, 0, 1, 2, 3]))]
    rng.shuffle(out)
    return out


def test_recall_and_precision(spark, texts):
    df = spark.createDataFrame([(f"e{i:04}", t, "x", 1) for i, t in enumerate(texts)] + [("e0000", texts[0], "x", 1)], "id string, text string, class_id string, n int")
    want = set()
    sets = [grams(t) for t in texts]
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.5 * len(sets[i] | sets[j]):
            want.add((f"e{i:04}", f"e{j:04}"))
    links, members = N.class_links(df, "id", "text")
    got = rows(N.pairs_of_ids(links, members))
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) > 100 and len(got) >= 0.97 * len(want)


def test_odd_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", ""), ("c", "one"), ("d", "one"), ("e", "Two Words"), ("f", "two  words!"), ("g", "ｔｗｏ wоrds"), (None, "two words"), ("h", "quite another thing")], "id string, text string")
    links, members = N.class_links(df, "id", "text")
    assert rows(N.pairs_of_ids(links, members)) == [("e", "f"), ("e", "g"), ("f", "g")]
    none = df.limit(0)
    links, members = N.class_links(none, "id", "text")
    assert N.pairs_of_ids(links, members).count() == 0


def test_many_copies_of_one_text(spark):
    df = spark.createDataFrame([(f"c{i:02}", "the very same text for all of these rows") for i in range(40)] + [(f"x{i:02}", " ".join(WORDS[i * 9 : i * 9 + 9])) for i in range(40)], "id string, text string")
    links, members = N.class_links(df, "id", "text")
    assert links.count() == 0
    assert N.pairs_of_ids(links, members).count() == 40 * 39 // 2


def test_words_and_shares():
    w = N.Words()
    pairs, offsets, keys = w.pairs(pa.array(["a b c", None, "one", "A  b, c!", ""]))
    assert list(offsets) == [0, 2, 2, 2, 4, 4] and keys[0] == keys[3] != 0 and keys[1] == keys[2] == keys[4] == 0
    assert list(pairs[:2]) == list(pairs[2:])
    assert list(N.jaccard(pa.array(["a b c d", "x", None]), pa.array(["a b c e", "y", None]), w)) == [0.5, 0.0, 0.0]


def test_packed_bytes():
    import numpy as np

    values = np.asarray([0, 1, (1 << 40) - 1, 123456789], np.uint64)
    assert list(N._unpack(N._pack(values, 5))) == list(values)
    slots = np.asarray([[k * 977, k * 977 + 1 + k % 2] for k in range(N.CHECKED)], np.uint32)
    packed = N._bits(slots)
    one = [[int(x) * 0x9E3779B1 % (1 << 32) >> 31 for x in column] for column in slots.T]
    assert [int(p) for p in packed] == [sum(bit << k for k, bit in enumerate(bits)) for bits in one]
    assert N._distance(packed[:1], packed[:1])[0] == 0 and N._distance(packed[:1], packed[1:])[0] == sum(a != b for a, b in zip(*one, strict=True)) > 0


def test_family_of_a_third_of_all_rows_is_whole(spark):
    rng = random.Random(5)
    base, few = rng.sample(WORDS, 24), [f"z{i}" for i in range(10)]

    def copy():
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice(few)], [w[k], rng.choice(few)]])
        return " ".join(w)

    held = [copy() for _ in range(300)] + [" ".join(rng.choices(WORDS, k=24)) for _ in range(600)]
    sets = [grams(t) for t in held]
    want = [(f"e{i:04}", f"e{j:04}") for i, j in combinations(range(len(held)), 2) if 2 * len(sets[i] & sets[j]) >= len(sets[i] | sets[j])]
    links, members = N.class_links(spark.createDataFrame([(f"e{i:04}", t) for i, t in enumerate(held)], "id string, text string"), "id", "text")
    assert len(want) > 10_000 and rows(N.pairs_of_ids(links, members)) == want


def test_recall_by_bands_of_similarity(spark):
    """Pairs of every band from the threshold on, between texts made of common phrases."""
    rng = random.Random(3)
    phrases = [" ".join(rng.sample(WORDS, 4)) for _ in range(120)]
    held = []
    for _ in range(700):
        base = " ".join(rng.choices(phrases, k=rng.randint(5, 14)) + rng.sample(WORDS, 6))
        held += [base, edited(rng, base, rng.randint(0, len(base.split()) // 6))]
    sets = [grams(t) for t in held]
    bands = {}
    for i in range(0, len(held), 2):
        share = len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1])
        if 0.5 <= share < 1:
            bands.setdefault(int(10 * share), []).append((f"e{i:04}", f"e{i + 1:04}"))
    links, members = N.class_links(spark.createDataFrame([(f"e{i:04}", t) for i, t in enumerate(held)], "id string, text string"), "id", "text")
    got = set(rows(N.pairs_of_ids(links, members)))
    assert set(bands) == {5, 6, 7, 8, 9} and min(map(len, bands.values())) > 30
    for band, pairs in bands.items():
        assert sum(p in got for p in pairs) >= 0.9 * len(pairs), band


def test_groups(spark):
    a, b, c = " ".join(WORDS[:30]), " ".join(WORDS[:26]), " ".join(WORDS[4:26])
    df = spark.createDataFrame([("1", a), ("2", b), ("3", c), ("4", a), ("5", " ".join(WORDS[500:530])), ("6", None)], "id string, text string")
    got = {r["id"]: r for r in N.groups(*N.class_links(df, "id", "text")).collect()}
    assert set(got) == {"1", "2", "3", "4", "5"}
    assert len({got[k]["group_id"] for k in "1234"}) == 1 and got["5"]["group_id"] == got["5"]["class_id"] != got["1"]["group_id"]
    assert got["1"]["class_id"] == got["4"]["class_id"] and got["5"]["n_links"] == 0 and got["2"]["n_links"] == 2
