"""The one form of texts, and the pairs that share it."""

import unicodedata
from collections import defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm.lookalike import LOOKALIKE, fold_array, found, same_look_pairs, seen_texts

DATA = "/root/testdata/sf0.01"


def fold(*texts):
    return fold_array(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize("a, b", [
    ("ＡＢ１２", "AB12"), ("é", "é"), ("á̧", "á̧"), ("Brit‌ra‍n", "Britran"), ("a b", "a b"), ("a　 b", "a b"), ("Ѕіnglе", "Single"), ("Κелvin".replace("ел", "el"), "Kelvin"),
    ("K", "K"), ("⼀⽂", "一文"), ("a‑b", "a-b"), ("a－b", "a-b"), ("ﬁx", "fix"), ("Ⅳ", "IV"), ("﻿a­", "a"), (" a\tb ", "a b"), ("ё", "ë"), ("ｶﾞ", "ガ"), ("한", "한"), ("ϲ", "c"),
])
def test_same_look(a, b):
    assert fold(a) == fold(b) == [unicodedata.normalize("NFC", b)]


@pytest.mark.parametrize("a, b", [("a", "A"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("ab", "a b"), ("naïve", "naive"), ("l", "1"), ("，", "。"), ("a-b", "a–b")])
def test_other_look(a, b):
    assert fold(a) != fold(b)


def test_nulls_and_empty():
    assert fold(None, "", "a", None, " ") == [None, "", "a", None, ""]
    assert fold() == []
    long = "é " * 400_000
    assert fold(long, "x") == [("é " * 400_000).strip(), "x"]
    assert fold("a" + "́" * 3000)[0] == "á" + "́" * 2999


CANONICAL = [chr(x) for x in [*range(0x41, 0x5B), *range(0xC0, 0x130), *range(0x300, 0x330), *range(0x1E00, 0x1F00), 0xAC00, 0xAC01, 0x1100, 0x1161, 0x11A8] if chr(x) not in LOOKALIKE and unicodedata.category(chr(x)) != "Cn"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=CANONICAL, max_size=12), max_size=5))
def test_composes_like_the_standard(texts):
    assert fold(*texts) == [unicodedata.normalize("NFC", t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable(text):
    text = text.encode("utf-8", "ignore").decode()
    once = fold(text)
    assert fold(*once) == once


def test_pairs_against_brute_force(spark):
    texts = {(r.kind, r.grp, r.id, r.text) for r in seen_texts(spark, DATA).collect()}
    groups = defaultdict(set)
    for kind, grp, number, text in texts:
        groups[kind, grp, fold(text)[0]].add((number, text))
    want = {(kind, min(a, b), max(a, b)) for (kind, *_), rows in groups.items() for a, x in rows for b, y in rows if a != b and x != y}
    got = [tuple(r) for r in found(spark, DATA).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_pairs_corner_cases(spark):
    rows = [("p", "g", i, "Top") for i in range(40)] + [("p", "g", 100, "Ｔop"), ("p", "g", 101, "Тор"), ("p", "g", 101, "Тор"), ("p", "h", 102, "Ｔop"), ("q", "g", 103, "Ｔop"), ("p", "g", 104, None), ("p", "g", 105, ""), ("p", "g", None, "Ｔop")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "kind string, grp string, id long, text string, extra int")
    got = [tuple(r) for r in same_look_pairs(frame, chunk=7).collect()]
    want = {("p", i, j) for i in range(40) for j in (100, 101)} | {("p", 100, 101)}
    assert len(got) == len(want) and set(got) == want
    assert same_look_pairs(frame.limit(0)).count() == 0
