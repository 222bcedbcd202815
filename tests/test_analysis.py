"""The analysis record against the rules written out by hand, and the flows between model and rules."""

import json
import re

import pytest
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.operators import analysis, modules
from gradelake.operators import questions as Q

SENTENCE = "Machine Learning is a model of Fairness number {}. It goes on for a while so that chunks fill up, word after word after word."


def tree(chunks, concepts):
    out, width = [], max(1, len(chunks) // 4)
    for i in range(0, len(chunks), width):
        no, topics = len(out) + 1, []
        for j, t in enumerate(chunks[i : i + width]):
            held = [c for c in concepts if c.lower() in t.lower()][:3]
            topics.append({"id": f"module_{no}_topic_{j + 1}", "title": f"Topic {no}.{j + 1}", "description": t[:150] + "..." if len(t) > 150 else t, "chunk_indices": [i + j], "concepts": held})
        indices = list(range(i, min(i + width, len(chunks))))
        out.append({"id": f"module_{no}", "title": f"Module {no}", "description": f"Content from chunks {indices[0] + 1}-{indices[-1] + 1}", "topics": topics, "chunk_indices": indices, "weight": 1.0})
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 4, 7, 9, 40])
def test_module_tree(spark, n):
    chunks = [f"Chunk {i} about Alpha and beta " + "x" * (i % 3 * 100) for i in range(n)]
    concepts = ["beta", "ALPHA", "chunk 1", "about", "zzz"]
    df = spark.createDataFrame([(chunks, concepts)], "t array<string>, c array<string>")
    got = json.loads(df.select(F.to_json(analysis.module_tree(F.col("t"), F.col("c")))).first()[0])
    assert got == tree(chunks, concepts)


def test_record_has_the_ten_fields(spark):
    texts = [(1, "One", " ".join(SENTENCE.format(i) for i in range(60))), (2, "Two", "short"), (3, None, None)]
    df = spark.createDataFrame(texts, "doc_id long, title string, content string")
    rows = {r.doc_id: json.loads(r.v) for r in analysis.analysis_records(df).select("doc_id", F.to_json(analysis.as_variant(F.col("analysis"))).alias("v")).collect()}
    fields = ["document_id", "document_title", "summary", "key_concepts", "module_structure", "concept_coverage", "suggested_distribution", "difficulty_distribution", "learning_objectives", "prerequisites"]
    assert all(sorted(r) == sorted(fields) for r in rows.values())
    chunks = df.where("doc_id = 1").select(T.chunk_texts(F.col("content"))).first()[0]
    one = rows[1]
    assert one["module_structure"] == tree(chunks, one["key_concepts"])
    joined = " ".join(chunks).lower()
    assert one["concept_coverage"] == {c: min(100.0, joined.count(c.lower()) * 10.0 + 20.0) for c in one["key_concepts"]}
    total = min(max(len(chunks) // 2, 6), 20)
    assert one["suggested_distribution"] == {"mcq": total // 3, "short": total // 3, "conceptual": total - 2 * (total // 3), "total": total, "rationale": f"Based on {len(chunks)} content chunks covering {len(one['key_concepts'])} key concepts"}
    assert rows[3]["module_structure"] == [] and rows[3]["document_title"] is None and rows[3]["suggested_distribution"]["total"] == 6


def test_model_or_rules(spark):
    docs = spark.createDataFrame([(i, f"T{i}", SENTENCE.format(i)) for i in range(5)], "doc_id long, title string, content string")
    replies = spark.createDataFrame([(0, 'x {"modules": [{"title": "M"}], "total_chunks": 3} y'), (1, '{"modules": 5}'), (2, "{broken"), (3, None)], "doc_id long, reply string")
    made = analysis.by_model_or_rules(replies, analysis.analysis_records(docs), "doc_id", "reply")
    got = {r.doc_id: (r.made_by, json.loads(r.a), json.loads(r.m)) for r in made.select("doc_id", "made_by", F.to_json("syllabus_analysis").alias("a"), F.to_json("module_structure").alias("m")).collect()}
    assert got[0] == ("model", {"modules": [{"title": "M"}], "total_chunks": 3}, [{"title": "M"}])
    assert {i: got[i][0] for i in range(1, 5)} == dict.fromkeys(range(1, 5), "rules")
    assert got[3][2] == got[3][1]["module_structure"] and got[3][2][0]["id"] == "module_1"


def test_generated_sets(spark):
    selected = spark.createDataFrame([(0, "First Thing here", "d", 1), (1, "Second one", "d", 1)], "place int, text string, title string, page int")
    whole = json.dumps([{"question_text": f"q{i}", "points": p, "options": o, "grounding_chunk": "Second" if i else "made up"} for i, (p, o) in enumerate([("7", None), (7.0, {"a": 1}), ("8 points", ["x"]), (None, None), (3, None)])])
    replies = spark.createDataFrame([(1, f"so {whole}"), (2, "[{"), (3, None)], "id long, raw string")
    rows = Q.generated(replies, "raw", selected, {"mcq": 2, "short": 1, "conceptual": 1}, ["id"]).orderBy("id", "question_no").collect()
    one = [r for r in rows if r.id == 1]
    assert [r.points for r in one] == [7, 7, 8, 10] and [r.options for r in one] == [None, '{"a":1}', '["x"]', None]
    assert one[0].grounding_chunk == "First Thing here" and one[1].grounding_chunk == "Second"
    assert [sum(r.id == i and r.made_by == "rules" for r in rows) for i in (1, 2, 3)] == [0, 4, 4]


def test_prompt_data_is_cut(spark):
    df = spark.createDataFrame([(1, "g" * 600, None, "s  " * 400)], "id long, grounding_chunk string, correct_answer string, student_answer string")
    r = Q.evaluation_data(df).first()
    assert (len(r.grounding_chunk), r.correct_answer, len(r.student_answer)) == (500, "", 900) and "  " not in r.compact
    chunks = spark.createDataFrame([(1, 0, "a" * 600, 1, "T"), (1, 1, "b", 1, "T")], "doc_id long, chunk_id int, text string, page int, title string")
    docs = spark.createDataFrame([(1, "c" * 9000), (2, None)], "doc_id long, content string")
    got = {r.doc_id: (r.chunks, len(r.preview)) for r in Q.analysis_data(chunks, docs).collect()}
    assert got == {1: ("[Chunk 1 | Doc: T | p1]: " + "a" * 500 + "\n\n[Chunk 2 | Doc: T | p1]: b", 8000), 2: ("", 0)}
    assert re.match(r"\[Chunk 1 ", got[1][0]) and modules.question_total(F.lit(3)) is not None
