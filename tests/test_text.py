import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import boxes, canonical, text
from gradeloom.functions.questions import normal_question
from gradeloom.functions.ruler import SubsetRuler, grade


def one(frame, value, f):
    return frame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("  What  is\t$x$?", "what is x ?"), ("\\left( a\\,b \\right)", "( a b )"), ("ＡＢＣ　ﬁ Straße", "abc fi strasse"), ("a\\quad b\\qquad c\\!d", "a b c d"), ("\\leftarrow x", "\\leftarrow x"), (None, ""), ("", "")],
)
def test_normal_question(raw, want):
    assert normal_question(raw) == want


def test_template(frame):
    got = one(frame, "if x=3.5 and y12 then -4e10 z", text.template)
    assert got == "if <var> = <num> and <var> 1 <num> then <num> <var>"


def test_char_ngrams_and_jaccard(frame):
    rows = frame([("",), ("abc",), ("abcdef",), ("aaaaaaaa",), (None,)], "t string")
    got = [r[0] for r in rows.select(text.char_ngrams(F.col("t"))).collect()]
    assert got == [[], ["abc"], ["abcde", "bcdef"], ["aaaaa"], None]
    sets = frame([([], []), (["a"], []), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r[0] for r in sets.select(text.jaccard(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 1 / 3]


@pytest.mark.parametrize(
    ("q", "want"),
    [
        (None, "empty_question"), (" \n", "empty_question"), ("Prove that x is odd.", "proof_problem"), ("Pick:\nA) 1\nB) 2", "multiple_choice"), ("one a) x b) y c) z", "multiple_choice"),
        ("See the figure.", "diagram_dependent"), ("Find an example of a ring.", "non_unique_answer"), ("The answer is 4; why?", "answer_leakage_cue"), ("Compute 2+2.", None),
    ],
)
def test_question_reject_reason(frame, q, want):
    assert one(frame, q, text.question_reject_reason) == want


@pytest.mark.parametrize(
    ("s", "want"),
    [
        (None, "empty_solution"), ("so \\boxed{1", "truncated_or_unbalanced_box"), ("no box", "boxed_count_not_one"), ("\\boxed{1} and \\boxed{2}", "boxed_count_not_one"),
        ("\\boxed{1} as wished", "text_after_boxed_answer"), ("```x``` \\boxed{1}", "tool_residue"), ("this line is long enough to count\n" * 3 + "\\boxed{1}.", "repetition_loop"), ("fine: $\\boxed{\\frac{1}{2}}$.", None),
    ],
)
def test_solution_reject_reason(frame, s, want):
    assert one(frame, s, boxes.solution_reject_reason) == want


def test_loops():
    words = " ".join(f"w{i}" for i in range(20))
    assert text.loops(" ".join([words] * 3)) and not text.loops(" ".join([words] * 2)) and not text.loops(None)
    assert not text.loops("short\n" * 9)


def test_boxes():
    assert boxes.spans(None) == [] and boxes.spans("\\boxed{a{b}c} \\fbox {d} \\boxed{e") == [(0, 13), (14, 23)]
    assert boxes.without_inner_boxes("\\boxed{1} then \\boxed{2}") == ("1 then \\boxed{2}", 1)
    nested = "\\boxed{a \\boxed{b}}"
    assert boxes.without_inner_boxes(nested) == (nested, 0)
    assert boxes.last_box("\\boxed{3} and \\boxed{4") == "\\boxed{3}" and boxes.last_box("none") is None
    assert boxes.box_content("x \\boxed{ 3 }") == "3" and boxes.box_content("") == ""


def test_box_lost(frame):
    rows = frame([("x \\boxed{1} y", 4), ("x \\boxed{1} y", 11), ("none", 1), (None, 1)], "t string, n int")
    assert [r[0] for r in rows.select(boxes.box_lost(F.col("t"), F.col("n"))).collect()] == [True, False, False, False]


def test_final_section(frame):
    draft = "long\n**Final Answer**\n\n12\n\nPolished solution.\n\nMore."
    assert boxes.final_section(draft) == ("Polished solution.\n\nMore.", 1, "12", 5)
    assert boxes.final_section("no heading") is None and boxes.final_section("final answer:\n\n" + "x" * 201 + "\n\ny") is None
    assert one(frame, draft, boxes.final_answer_section)["marker_count"] == 1
    assert one(frame, None, boxes.final_answer_section)["content"] is None


@pytest.mark.parametrize(
    ("t", "want"),
    [("Final answer: $3$", ("$3$", "explicit_cue")), ("There is no final answer here at all", ("", "none")), ("so\nx=2", ("x=2", "standalone_last_line")), ("some prose only", ("", "none")), ("", ("", "none")), (None, ("", "none")), ("Thus we see that it holds", ("", "none"))],
)
def test_terminal_answer(t, want):
    assert boxes.terminal_answer(t) == want


def test_ruler_cases():
    r = SubsetRuler()
    ok = lambda g, p: r.is_correct(r.parse_strict(g), r.parse_fallback(p))
    cases = [
        ("$\\boxed{\\frac{1}{2}}$", "so \\boxed{\\frac{1}{2}}", True), ("$\\boxed{0.5}$", "\\boxed{\\frac{1}{2}}", True), ("$\\boxed{2}$", "\\boxed{3}", False),
        ("$\\boxed{\\sqrt{2}}$", "\\boxed{2^{1/2}}", True), ("$\\boxed{(0,1)}$", "\\boxed{(0,1)}", True), ("$\\boxed{12}$", "there is no boxed answer here", False),
    ]
    assert [ok(g, p) for g, p, _ in cases] == [w for *_, w in cases]
    assert r.parse_strict("Final answer: $\\frac{1}{2}$") is None and ok("\\boxed{1/2}", "Final answer: $\\frac{1}{2}$")
    assert r.parse_fallback("We considered 50 degrees in an intermediate step.\nNo final answer was given.") is None
    assert not ok("\\boxed{2}", "Intermediate: $2$.\nFinal answer: $3$")
    assert ok("\\boxed{\\{1,2\\}}", "\\boxed{\\{2,1\\}}") and not ok("\\boxed{(0,1)}", "\\boxed{[0,1]}") and ok("\\boxed{50\\%}", "\\boxed{0.5}") and ok("\\boxed{1,000}", "\\boxed{1000}")


def test_grade_contract(frame):
    rows = frame([("\\boxed{2}", "\\boxed{2}"), ("\\boxed{2}", "Answer: 2"), ("\\boxed{2}", None), (None, "\\boxed{2}")], "g string, t string")
    got = [tuple(r[0]) for r in rows.select(grade(F.col("g"), F.col("t"))).collect()]
    assert got == [(1, 1, 0, "boxed", "gradeloom-subset-v1"), (0, 1, 0, "explicit_cue", "gradeloom-subset-v1"), (0, 0, 1, "none", "gradeloom-subset-v1"), (0, 0, 0, "boxed", "gradeloom-subset-v1")]

    class Lenient(SubsetRuler):
        def is_correct(self, gold, answer):
            return True

    with pytest.raises(ValueError):
        grade(F.col("g"), F.col("t"), Lenient())


def test_canonical_json(frame):
    rows = frame([(1.0, None, "é\"\\", 3), (1e16, "x", "", None)], "d double, a string, s string, n int")
    want = [canonical.canonical_json({"d": r[0], "a": r[1], "s": r[2], "n": r[3]}) for r in rows.collect()]
    assert [r[0] for r in rows.select(canonical.canonical_object(["d", "a", "s", "n"])).collect()] == want
    assert [r[0] for r in rows.select(canonical.canonical_struct("s", "n", "a")).collect()] == [canonical.canonical_json({"a": r[1], "s": r[2], "n": r[3]}) for r in rows.collect()]
    assert [r[0] for r in rows.select(canonical.canonical_tuple(F.col("a"), F.col("n"))).collect()] == ["[null,3]", '["x",null]']
    assert canonical.digest("a") == hashlib.sha256(b"a").hexdigest()


def test_token_functions(frame):
    rows = frame([([1, 2, 3, 4], [7, 9, 5]), ([], [1])], "p array<long>, c array<long>")
    got = rows.select(text.keep_last(F.col("p"), 2), text.expected_bos(F.col("p"), 2), text.train_ids(F.col("p"), F.col("c"), 6), text.train_labels(F.col("p"), F.col("c"), 6), text.stop_position(F.col("c"), [9]), text.count_id(F.col("p"), 2)).collect()
    assert tuple(got[0]) == ([3, 4], 0, [1, 2, 3, 4, 7, 9], [-100] * 4 + [7, 9], 2, 1) and tuple(got[1]) == ([], 1, [1], [1], 1, 0)


def test_small_functions(frame):
    assert one(frame, "The <think>x</THINK > y", text.strip_think_tags) == "The x y"
    assert one(frame, " 5 ", text.gold_boxed) == "\\boxed{5}" and one(frame, "\\boxed{5}", text.gold_boxed) == "\\boxed{5}" and one(frame, None, text.gold_boxed) == "\\boxed{}"
    assert one(frame, "Some/Model Name!", text.slug) == "some-model-name" and len(one(frame, "x" * 99, text.capped_slug)) == 64
    assert one(frame, "\n a \n b\n", text.first_line) == "a" and one(frame, "\n a \n b\n", text.last_line) == "b" and one(frame, "", text.last_line) is None
    assert one(frame, "q", lambda c: text.prompt_version()) == "28557dc5b760"
    assert text.data_tag("corpus-a b/c.", "corpus-") == "a-b-c" and text.data_tag("") == "run" and len(text.data_tag("x" * 30)) == 20
    assert text.run_slug([("dm-", "tag"), ("lr", 2e-05), ("s", 42)]) == "dm-tag-lr2e-05-s42"
    with pytest.raises(ValueError):
        text.run_slug([("", "x" * 65)])
    ids = frame([([1, 2, 3],), ([1, 9, 3],), ([1],)], "c array<long>")
    assert [r[0] for r in ids.select(text.hit_limit(F.col("c"), [9], 3)).collect()] == [1, 0, 0]
    rng = random.Random(1)
    values = [rng.uniform(0, 10) for _ in range(50)]
    got = frame([(v,) for v in values], "v double").select(text.difficulty_bucket(F.col("v"))).collect()
    assert [r[0] for r in got] == [f"{int(v * 2) / 2:.1f}" for v in values]
