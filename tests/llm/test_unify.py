"""One form for text that looks the same."""

import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofweave.llm import unify as U
from tests.conftest import rows


def test_forms():
    cases = {
        "ｔｈｅ ｐｌａｔｅ": ("the plate", ["fullwidth"]),
        "Pérouse": ("Pérouse", ["mark"]),
        "Cran​es and so­ft": ("Cranes and soft", ["invisible"]),
        "a b c　d": ("a b c d", ["space"]),
        "Сранеѕ аррeal": ("Cpaнes appeal".replace("Cpaнes", "Сранеѕ"), ["mixed"]),
        "marked Δελφοί Вектор": ("marked Δελφοί Вектор", []),
        "Zoë £5 – “so” Ölvarsen": ("Zoë £5 – “so” Ölvarsen", []),
        "ﬁne": ("fine", ["other"]),
        "": ("", []),
        None: (None, []),
        "e​́": ("é", ["invisible", "mark"]),
        "line\nbreak\ttab": ("line\nbreak\ttab", []),
    }
    for text, want in cases.items():
        assert U.unify_text(text) == want, repr(text)


def test_equal_looking_texts_meet():
    plain = "The hull coating plant at the Orlesby works"
    disguised = "Ｔｈｅ hu‍ll соating plant at the Оrlеѕby works"
    assert U.unify_text(disguised)[0] == plain


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aZé́​ ｋ．οсЯ \n12ﬁ", max_size=30))
def test_settled_and_stable(text):
    once, kinds = U.unify_text(text)
    assert U.unify_text(once)[0] == once
    assert unicodedata.is_normalized("NFC", once)
    assert (once != text) <= bool(kinds)


def test_rows(spark):
    df = spark.createDataFrame([(1, "plain"), (2, "x​y"), (3, None), (4, ""), (2, "x​y")], "id int, t string").selectExpr("id", "t", "'x' as kinds")
    got = U.unified(df, "t")
    assert rows(got, "id", "unified") == [(1, "plain"), (2, "xy"), (2, "xy"), (3, None), (4, "")]
    assert rows(U.lookalikes(df, "t").select("id").distinct()) == [(2,)]
    assert U.lookalikes(df.limit(0), "t").count() == 0


def test_long_text():
    text = "word​ " * 200_000
    assert U.unify_text(text)[0] == "word " * 200_000


def test_every_character_settles():
    """Idempotent, and blind to invisible characters, for every character of the basic plane in a word, after a
    sign and beside marks and letters of other scripts."""
    hidden = "\u200b"
    for code in range(1 << 16):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        for text in (c, f"a{c}e", f"={c}\u0338", f"{c}\u0301x", f"\u0430{c}", f"\uac00{c}"):
            form = U.unify_text(text)[0]
            assert U.unify_text(form)[0] == form, (hex(code), text)
            assert U.unify_text(hidden.join(text))[0] == form, (hex(code), text)


def test_quick_check_holds():
    """No text of stable characters changes."""
    stable = [chr(c) for c in range(1 << 16) if U.stable()[c]]
    assert len(stable) > 40_000
    for k in range(0, len(stable), 500):
        text = "".join(stable[k : k + 500])
        assert unicodedata.is_normalized("NFC", text) and U.unify_text(text) == (text, []) and U.unify_text(text[::-1]) == (text[::-1], [])


def test_letters_taken_apart_and_accented_twins():
    assert U.unify_text("\u0132sland")[0] == U.unify_text("\u0132s\u200bland")[0] == "IJsland"
    assert U.unify_text("No\u0451l Pr\u03ccu")[0] == "No\u00ebl Pr\u00f3u"


def test_quick_check_on_the_jvm_side(spark):
    chars = [chr(c) for c in range(1, 1 << 16) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(ord(c), c) for c in chars], "code int, t string").where(~U.unstable(F.col("t")))
    assert {r["code"] for r in df.collect()} == {ord(c) for c in chars if U.stable()[ord(c)]}
