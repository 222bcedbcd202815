"""Expressions against their rules, on hand-made edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gradelake.functions import grading as G
from gradelake.functions import text as T


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def one(spark, values, make, kind="string"):
    return [r[0] for r in column(spark, values, kind).select(make(F.col("x"))).collect()]


def chunks_brute(content, size=1100, overlap=140):
    out, cur = [], ""
    for s in re.split(r"(?<=[.!?])\s+", (content or "").strip()):
        if not s.strip():
            continue
        if cur and len(cur) + len(s) + 1 > size:
            out.append(cur.strip())
            cur = cur[-overlap:] + " " + s
        else:
            cur = (cur + " " + s).strip() if cur else s.strip()
    return out + ([cur.strip()] if cur.strip() else [])


def test_chunks(spark):
    r = random.Random(1)
    texts = [None, "", "  \n ", "a" * 1500, "x" * 547 + ". " + "y" * 550 + ".", "x" * 548 + ". " + "y" * 550 + "."]
    texts += [" ".join("w" * r.randint(1, 12) + r.choice(["", ".", "!", ".\n"]) for _ in range(r.randint(1, 700))) for _ in range(40)]
    got = one(spark, texts, T.chunk_texts)
    assert got == [chunks_brute(t) for t in texts]
    assert [len(g) for g in got[:6]] == [0, 0, 0, 1, 1, 2]
    for t, chunks in zip(texts, got):
        assert all(s.strip() in " ".join(chunks) for s in re.split(r"(?<=[.!?])\s+", t or ""))


def test_white_space_of_all_scripts(spark):
    blanks = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    texts = [f"{b}One{b}two.{b}Three{b}{b}four!{b}" + f"word{b}" * 400 for b in [*blanks, "\ufeff", "\u200b", "\x1b"]]
    assert len(blanks) == 29
    assert one(spark, texts, T.chunk_texts) == [chunks_brute(t) for t in texts]
    assert one(spark, texts, T.word_count) == [len(t.split()) for t in texts]
    assert one(spark, texts, T.strip) == [t.strip() for t in texts]
    assert one(spark, [f"Machine{b}Learning Unit 3: Deep{b}Nets." for b in blanks], T.phrases)[5] == re.findall(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}", f"Machine{blanks[5]}Learning Unit 3: Deep{blanks[5]}Nets.")


def test_ui_chunks(spark):
    got = one(spark, ["a" * 200 + ". " + "b" * 200 + ". c", "short", None], T.ui_chunk_texts)
    assert [len(g) for g in got] == [2, 1, 0] and got[0][1] == "c"


def test_grounding_score_is_stable_and_in_range(spark):
    got = one(spark, ["a", "b", "", "é"], T.grounding_score)
    assert all(0.86 <= g <= 1.025 for g in got) and got == one(spark, ["a", "b", "", "é"], T.grounding_score)


def test_clean_text(spark):
    text = "keep\n[TABLE]\n| a | b |\n[/TABLE]\n[VISUAL CONTENT p1] x [/VISUAL CONTENT]\n| loose |\n\n\n\nend [/TABLE]"
    assert one(spark, [text, None, ""], T.clean_text) == ["keep\n\nend", "", ""]


def test_table_markdown(spark):
    tables = [[["a", None, " c "], ["1"], ["1", "2", "3", "4"]], [], None, [[]]]
    got = one(spark, tables, T.table_markdown, "array<array<string>>")
    assert got == ["| a |  | c |\n| --- | --- | --- |\n| 1 |  |  |\n| 1 | 2 | 3 | 4 |", "", "", ""]


def test_concepts_statements_and_summary(spark):
    text = "Unit 3: Deep Learning. We study Overfitting and bias. Éa Open Source Tools. students will learn to build good models."
    got = one(spark, [text], T.key_concepts)[0]
    assert got[0] == "Deep Learning" and "Overfitting" in got and "bias" in got and "Open Source Tools" in got and len(set(got)) == len(got)
    found = one(spark, [text, "nothing here"], T.learning_objectives)
    assert found[0][0].startswith("Learn") and len(found[1]) == 5
    assert one(spark, ["requires linear algebra and probability. x", "no"], T.prerequisites)[1][0] == "Basic programming knowledge"
    made = one(spark, ["A. B. C. D."], lambda c: T.summary(c, F.array(F.lit("k"))))
    assert made == ["A. B. C This syllabus covers 1 key concepts including k."]


def test_json_and_options(spark):
    replies = ['```json\n[{"a":1}]\n```', 'so: [1, 2] ok', "none"]
    assert one(spark, replies, T.json_array) == ['[{"a":1}]', "[1, 2]", "none"]
    assert one(spark, ['["A","B"]', "x", None, "{}"], T.parsed_options) == [["A", "B"], [], [], []]


def test_display_functions(spark):
    assert one(spark, [None, 0, 12, 2048, 3328, 5 * 1024 * 1024], T.human_size, "long") == ["", "", "12 B", "2.0 KB", "3.3 KB", "5.0 MB"]
    assert one(spark, [0, 61, 600], T.minutes_seconds, "long") == ["00:00", "01:01", "10:00"]
    assert one(spark, ["a.b.TXT"], T.file_extension) == ["txt"] and one(spark, ["a.b.TXT"], T.file_title) == ["a.b"]
    assert one(spark, ["ann@x.org"], T.email_name) == ["ann"]
    assert one(spark, [6000, 7000, 359999], T.minutes_seconds, "long") == ["100:00", "116:40", "5999:59"]
    assert one(spark, [None, "", "0", "false", "x"], lambda c: T.or_default(c, "d")) == ["d", "d", "0", "false", "x"]
    assert one(spark, [None, 0, 3], lambda c: T.or_default(c, 10), "int") == [10, 10, 3]
    assert one(spark, [None, False, True], lambda c: T.or_default(c, True), "boolean") == [True, True, True]
    assert one(spark, ["a  b", " x" * 2000], T.compact) == ["a b", "x " * 800]


CASES = [
    ("short", "alpha gamma delta", None, 10, "", (False, 0)),
    ("short", "alpha gamma delta", None, 10, "a", (False, 0)),
    ("short", "alphas gammas deltas", None, 10, "alphas gammas", (False, 6)),
    ("short", "alphas gammas deltas thetas", None, 10, "alphas gammas deltas", (True, 6)),
    ("short", "alphas gammas deltas", None, 10, "ALPHAS gammas, deltas!", (True, 10)),
    ("short", "alphas gammas deltas", None, 10, "nothing at all", (False, 2)),
    ("short", "alphas", None, 0, "alphas", (True, 10)),
    ("short", "a b c", None, 5, "whatever", (False, 1)),
    (None, None, None, None, "whatever", (False, 2)),
    ("mcq", "Paris", '["Paris","Rome"]', 5, " paris ", (True, 5)),
    ("mcq", "Paris", '["Paris","Rome"]', 5, "Rome", (False, 0)),
    ("mcq", "The city of Paris", "x", 5, "the city of light", (True, 5)),
    ("mcq", "Paris", None, 5, "Madrid", (False, 0)),
    ("mcq", "", None, 5, "anything", (True, 5)),
]


@pytest.mark.parametrize("case", CASES, ids=range(len(CASES)))
def test_grader(spark, case):
    kind, correct, options, points, answer, want = case
    df = spark.createDataFrame([(kind, correct, options, points, answer)], "t string, c string, o string, p int, a string")
    g = G.grade(F.col("t"), F.col("c"), F.col("o"), F.col("p"), F.col("a"))
    assert tuple(df.select(g.is_correct, g.score).collect()[0]) == want


def test_bands(spark):
    df = spark.createDataFrame([(8, 10), (5, 10), (1, 10), (None, 10), (1, 0)], "s int, t int")
    got = df.select(G.performance_band(F.col("s"), F.col("t")), G.percent(F.col("s"), F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("strong", 80), ("partial", 50), ("weak", 10), ("weak", 0), ("weak", 0)]
    assert one(spark, ["Hard", "Easy", "x", None], G.default_points) == [15, 5, 10, 10]
    assert one(spark, [80, 60, 40, 1], G.coverage_band, "int") == ["high", "good", "fair", "low"]
    assert one(spark, ["Overfit", "New Paradigm", "iterating", None], lambda c: G.gap_reason(c, F.lit(""))) == ["overfitting", "paradigms", "iteration", "ungrounded"]
