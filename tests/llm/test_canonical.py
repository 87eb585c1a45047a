from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engramlake.llm.canonical import Transducer, build_map, check_map, look_alike_pairs, transducer, with_canonical

SAME = [
    ("Ｈｅｌｌｏ！", "Hello!"), ("a b", "a b"), ("a　b", "a b"), ("co­op", "coop"), ("zero​width", "zerowidth"), ("caf́e".replace("f́e", "fé"), "café"),
    ("usеr", "user"), ("Ηello", "Hello"), ("ﬁne", "fine"), ("non‑stop", "non-stop"), ("ﾒﾓ", "メモ"), ("ё", "ë"), ("ａ́", "á"),
]
DIFFER = [("Hello", "hello"), ("café", "cafe"), ("l", "1"), ("O", "0"), ("a  b", "a b"), ("a-b", "a–b"), ("x²", "x2"), ("خواهم‌", "خواهم‌م"), ("می‌خ", "میخ"), ("👨‍👩", "👨👩"), ("“a”", '"a"')]


@pytest.mark.parametrize("a,b", SAME)
def test_look_the_same(a, b):
    assert transducer()(a) == transducer()(b) == b


@pytest.mark.parametrize("a,b", DIFFER)
def test_look_different(a, b):
    assert transducer()(a) != transducer()(b)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aéеοｈ ​‍　́-‑中，ё👨ﬁ\n", max_size=15))
def test_a_form_is_its_own_form(text):
    once = transducer()(text)
    assert transducer()(once) == once


@pytest.mark.parametrize("a,b", [
    ("\u3164x", "x"), ("a\u2065b", "ab"), ("字\ufe00", "字"), ("a\U000e0041b", "ab"), ("1\u22122", "1-2"), ("5\u201212", "5-12"), ("ν", "v"), ("Ү", "Y"), ("Ꭺ", "A"), ("ꓮ", "A"), ("µ", "μ"), ("Ⅳ", "IV"),
    ("e\u200b\u0301", "é"), ("a\u0302\u0323", "ậ"), ("a\u0323\u0302", "ậ"), ("â\u0323", "ậ"), ("\u0430\u0301", "á"), ("ｶﾞ", "ガ"), ("\u1100\u1161\u11a8", "각"), ("가\u11a8", "각"), ("Å", "Å"), ("x\u0301\u0323", "x\u0323\u0301"),
])
def test_more_of_unicode(a, b):
    assert transducer()(a) == b


@pytest.mark.parametrize("text", ["❤\ufe0f", "🏴\U000e0067\U000e007f", "👨\u200d👩", "a–b", "ı", "x\u0301"])
def test_visible_things_stay(text):
    assert transducer()(text) == text


def test_many_texts_are_read_as_each_alone():
    texts = ["", "\u0301a", "ｅ", "\u0301", "x\x00\u0301", "plain", "а\u0301"]
    assert transducer().many(texts) == [transducer()(t) for t in texts]


def test_clusters_against_normalisation():
    """Any order and mixture of bases, accents and invisible characters gives what normalising the whole would give."""
    import random
    import unicodedata

    rng, to = random.Random(3), transducer()
    for _ in range(5000):
        text = "".join(rng.choice("aeоеïñ\u0301\u0323\u0302\u0308\u0327\u200b\u00adｅﬁ中xν각각") for _ in range(rng.randrange(1, 9)))
        plain = unicodedata.normalize("NFC", "".join(c for c in text if to.table.get(c) != ""))
        assert to(text) == unicodedata.normalize("NFC", "".join(to.table.get(c, c) for c in unicodedata.normalize("NFD", plain)))


def test_conflicts_are_found():
    with pytest.raises(ValueError):
        check_map({"а": "b", "ｂ": "а"})
    with pytest.raises(ValueError):
        check_map({"a": "b"})
    check_map(build_map())
    assert Transducer({"а": "a"})("а") == "a"


def test_pairs(spark):
    rows = [(1, "user", "s"), (2, "usеr", "s"), (2, "usеr", "s"), (3, "user", "s"), (4, None, "s"), (5, "", "s"), (6, "​", "s"), (7, "User", "s"), (None, "usеr", "s"), (8, "user", "t"), (9, "x" * 200_000, "s")]
    df = spark.createDataFrame(rows, "form bigint, text string, src string")
    got = [tuple(r) for r in look_alike_pairs(df, "form", "text", by=["src"]).collect()]
    assert len(got) == len(set(got)) and set(got) == {("s", 1, 2), ("s", 2, 3), ("s", 5, 6)}
    assert look_alike_pairs(df.limit(0), "form", "text").collect() == []
    assert [r.canonical for r in with_canonical(df.where("form = 2"), "text").collect()] == ["user", "user"]


def test_a_hot_group_of_copies(spark):
    df = spark.range(3000).selectExpr("id", "CASE WHEN id = 7 THEN 'оk' ELSE 'ok' END AS text")
    assert look_alike_pairs(df, "id", "text").count() == 2999
