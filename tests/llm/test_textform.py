import unicodedata

import pytest

from gradeloom.llm.textform import common_forms, look_alike_pairs, look_groups, normalize_texts, slices


@pytest.mark.parametrize(
    ("a", "b"),
    [("ﬁne", "fine"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("é", "é"), ("a​b", "ab"), ("a b", "a b"), ("соре", "cope"), ("Α", "A"), ("q̣̇", "q̣̇"), ("⼀", "一"), ("ё", "ë"), ("a\r\nb", "a\nb"), ("각", "각")],
)
def test_same_look(a, b):
    assert common_forms([a]) == common_forms([b])


@pytest.mark.parametrize(("a", "b"), [("\u0475\u0474", "vV"), ("\u04cf", "l"), ("\u057d\u0578", "un"), ("\u03bd", "v"), ("\u13a1\u13c0", "RG"), ("\u03dc", "F"), ("\u13cf", "b"), ("\u054d", "U"), ("\u1d22", "z"), ("\ua4e0\ua4f3", "NO")])
def test_same_look_in_more_scripts(a, b):
    assert common_forms([a]) == [b]


@pytest.mark.parametrize(("a", "b"), [("a", "A"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("₂", "2"), ("a b", "a  b"), ("a\nb", "a b"), ("å", "a"), ("0", "O")])
def test_different_look(a, b):
    assert common_forms([a]) != common_forms([b])


def test_idempotent_and_like_nfkc_where_that_keeps_the_look():
    texts = ["", "plain", "ﬃ é ñ ｶﾞ", "가각", "ẛ̣", "x" * 50_000 + "é" * 50_000]
    forms = common_forms(texts)
    assert common_forms(forms) == forms
    assert forms[2] == unicodedata.normalize("NFKC", texts[2])
    assert len(forms[5]) == 100_000


def test_column_keeps_rows_nulls_and_other_columns(frame):
    df = frame([(1, "ｘ", "k"), (2, None, "k"), (3, "", "k")], "id long, text string, text_form string")
    out = {r.id: r.text_form for r in normalize_texts(df).collect()}
    assert out == {1: "x", 2: None, 3: ""}
    assert normalize_texts(df.limit(0)).count() == 0


def test_pairs(frame):
    rows = [(1, "naïve"), (2, "naïve"), (3, "naive"), (4, "naïve"), (5, None), (6, ""), (7, ""), (2, "naïve"), (None, "naïve")]
    df = frame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, look string, key int")
    assert sorted(map(tuple, look_alike_pairs(df).collect())) == [(1, 2), (2, 4)]
    assert look_alike_pairs(df.limit(0)).count() == 0


def test_slices():
    assert list(slices([])) == [] and list(slices([5, 5, 5], 10)) == [(0, 2), (2, 3)] and list(slices([50, 1, 50], 10)) == [(0, 1), (1, 2), (2, 3)]
    texts = ["é" * n for n in (3, 700_000, 1, 0, 900_000, 2)]
    assert common_forms(texts) == ["é" * n for n in (3, 700_000, 1, 0, 900_000, 2)]


def test_hangul_is_composed_whatever_else_a_text_holds():
    assert common_forms(["각가"]) == common_forms([unicodedata.normalize("NFD", "각가")]) == ["각가"]
    assert common_forms([unicodedata.normalize("NFD", "각 é")]) == ["각 é"]


def test_groups(frame):
    rows = [(1, "naïve"), (2, "nai\u0308ve"), (3, "naive"), (4, "naïve"), (5, None), (6, ""), (2, "nai\u0308ve"), (None, "x")]
    out = {r.doc_id: (r.documents, r.forms) for r in look_groups(frame([(*r, "z") for r in rows], "doc_id long, text string, look string")).collect()}
    assert out == {1: (3, 2), 2: (3, 2), 3: (1, 1), 4: (3, 2)}
