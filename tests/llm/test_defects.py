import pytest

from gradeloom.llm import defects as D
from gradeloom.llm.language import language

SOLVED = "Expanding $x^{2}+3$ gives a stable ring of rank $4$. We compare both sides and obtain $y=3$. Therefore the answer is $\\boxed{12}$."
QUESTION = "Consider the open ring defined by $x^{2}+3$, where the last entry is fixed. What is the exact value of the rank of the attached complex?"


@pytest.fixture(scope="module")
def model():
    steps = ["Note that the degree is additive, so both parts can be handled together.", "Expanding $x^{2}+7y$ gives a stable ring of rank $9$.", "The tame part contributes $4$, while the rest contributes $7$.", "Die Summe über alle Graphen ist gleich $z+1$."]
    ends = ["We conclude that the value is 12.", "**Answer:** 7", "So the result equals $\\boxed{9}$", "This gives a total of 3, as required.", "Thus we get \\[ \\boxed{5} \\]"]
    return D.TerminalModel.fit([" ".join(steps[(i + j) % 4] for j in range(3)) + " " + ends[i % 5] for i in range(600)])


@pytest.mark.parametrize("text", ["What is $2+2$?", "Find x: 3x=9.", "Wie viele?", "求 $x$ 的值。"])
def test_short_copy(text, model):
    assert D.defect(text, text, model) == D.defect(text, "Question: " + text, model) == "copied_question"
    assert D.defect(text, "4", model) is None and D.defect(text, text + " It is 4.", model) is None


def test_copy_of_a_part_and_of_several(model):
    last = "What is the exact value of the rank of the attached complex?"
    assert D.defect(QUESTION, last, model) == D.defect(QUESTION, QUESTION + "\n" + QUESTION, model) == "copied_question"
    assert D.defect(QUESTION, "the rank", model) != "copied_question" and D.defect(QUESTION, "$x^{2}+3$", model) is None


def test_long_box_is_a_result(model):
    assert D.defect(QUESTION, SOLVED[:-14] + "is $\\boxed{" + "+".join(f"x_{{{i}}}" for i in range(80)) + "}$", model) is None
    assert D.defect(QUESTION, "We get $\\boxed{\\{1, 2\\}}$ and note that the " + "very " * 60 + "la", model) is None


@pytest.mark.parametrize("answer", ["I'm sorry, but I can't help with question 12.", "I cannot answer what $x^{2}+3$ is."])
def test_refusal_that_quotes_the_question(answer, model):
    assert D.defect(QUESTION, answer, model) == "refusal"


@pytest.mark.parametrize("answer", ["Quindi il valore della somma è uguale al risultato che si trova nella seconda riga, e non dei gradi.", "Portanto o valor não é igual ao resultado que encontramos, e assim temos uma resposta para cada linha.", "したがって答えは三です。", "따라서 답은 삼입니다."])
def test_further_languages(answer, model):
    assert D.defect(QUESTION, answer, model) == "other_language"


@pytest.mark.parametrize("answer", [None, "", "  \n", "​", "﻿ ", "null", "N/A", "(none)", "...", "$$", "\\boxed{}", "-", "TBD", "<answer></answer>"])
def test_empty(answer, model):
    assert D.defect(QUESTION, answer, model) == "empty"


@pytest.mark.parametrize("answer", ["." * 61, "- " * 500, "_" * 20_000, "\\boxed{\\text{}} " * 30, "<p></p>\n" * 40, '<div style="' + "margin: 0; " * 30 + '">\n</div>', "N/A" + "." * 100])
def test_empty_at_any_length(answer, model):
    assert D.defect(QUESTION, answer, model) == "empty"


@pytest.mark.parametrize("answer", ["." * 200 + "7", "<The set of all the numbers " + "that we have looked at so far " * 5 + ">"])
def test_long_answers_that_say_something(answer):
    assert not D.says_nothing(answer)


@pytest.mark.parametrize("answer", ["0", "1", "$\\boxed{1}$", "-3", "$\\infty$", "\\boxed{\\emptyset}", "No.", SOLVED])
def test_sound(answer, model):
    assert D.defect(QUESTION, answer, model) is None


@pytest.mark.parametrize("answer", ["I'm sorry, but I can't help with this request.", "Ich kann diese Aufgabe nicht beantworten.", "Je préfère ne pas donner de solution.", "Prefiero no dar una solución.", "Я не могу помочь с этим запросом.", "我无法回答这个问题。"])
def test_refusal(answer, model):
    assert D.defect(QUESTION, answer, model) == "refusal"


def test_talk_of_not_being_able_is_no_refusal(model):
    assert D.defect(QUESTION, "We cannot answer it by $x$ alone. I am unable to simplify $y$ any further. " + SOLVED, model) is None


@pytest.mark.parametrize("wrap", ["{}", "Question: {}", '"{}"', "{}...", "  {}\n"])
def test_copy(wrap, model):
    assert D.defect(QUESTION, wrap.format(QUESTION), model) == "copied_question"
    assert D.defect(QUESTION, wrap.format(QUESTION.replace("$", "")), model) == "copied_question"


def test_restating_is_no_copy(model):
    assert D.defect(QUESTION, "Recall the task: " + QUESTION + "\n\n" + SOLVED, model) is None


def test_other_language(model):
    german = "Wir vergleichen beide Seiten und finden $x=3$. Damit sinkt die Länge auf $7$, während die übrigen Graphen unverändert bleiben. Also ist das Ergebnis $\\boxed{3}$."
    assert D.defect(QUESTION, german, model) == "other_language"
    assert D.defect("Für alle Graphen gilt, dass die Länge höchstens 7 ist. Wie viele Bäume gibt es?", german, model) is None
    assert language("$x$ 12") is None and language(None) is None and language("现在代入，再把树合并") == "zh"


@pytest.mark.parametrize("answer", ["Note that the degree is additive, so both pa", "Expanding $x^{2}+7y$ gives a stable ring of rank $9$. The tame part contributes $4", "The tame part contributes $4$, while the rest"])
def test_truncated(answer, model):
    assert D.defect(QUESTION, answer, model) == "truncated"


def test_table(frame):
    rows = [(1, QUESTION, SOLVED), (2, QUESTION, None), (2, QUESTION, None), (3, QUESTION, QUESTION), (4, None, SOLVED), (None, QUESTION, ""), (5, QUESTION, "I must decline to answer this."), (6, QUESTION, SOLVED * 3000)]
    df = frame([(*r, "z") for r in rows], "train_idx long, question string, answer string, defect string")
    assert {tuple(r) for r in D.defects(df).collect()} == {(2, "empty"), (3, "copied_question"), (5, "refusal")}
    assert D.defects(df.limit(0)).count() == 0
