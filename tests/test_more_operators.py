"""Extraction passes, results read back, written grades, lists and selections on small rows."""

import datetime

from pyspark.sql import functions as F

from gradelake.functions import grading as G
from gradelake.functions import text as T
from gradelake.operators import crud, grading, modules, reports, sessions
from gradelake.operators import questions as Q
from gradelake.sources import files, tables


def test_pdf_passes_with_replaceable_readers(spark):
    def broken(_):
        raise ValueError("no")

    big, small = b"i" * 6000, b"i" * 10
    docs = {b"text": "A page of text.", b"scan": "", b"image": "Short."}
    pages = {b"text": [("A page of text.", [small], big)], b"scan": [("", [], small)], b"image": [("Short.", [big, small], big), ("", [], big)]}
    readers = files.PdfReaders(first=docs.get, fallback=broken, pages=pages.get, describe=lambda p: f"{len(p)} bytes", ocr=lambda c: "recognised text of a scan" if c == b"scan" else "x")
    found = spark.createDataFrame([("a", b"text"), ("b", b"scan"), ("c", b"image"), ("d", b"none")], "path string, content binary")
    block = "\n[VISUAL CONTENT — Page {}]\n6000 bytes\n[/VISUAL CONTENT]\n".format
    got = {r.path: r.text for r in files.pdf_documents(found, readers).collect()}
    assert got == {"a": "A page of text.", "b": "recognised text of a scan", "c": "\n\n".join(["Short.", block(1), block(2)]), "d": "x"}
    bare = files.PdfReaders(first=broken, fallback=lambda c: "fallback")
    assert {r.text for r in files.pdf_documents(found, bare).collect()} == {"fallback"}


def test_only_undecodable_bytes_go(spark):
    found = spark.createDataFrame([("x/a.txt", "a�b".encode() + b"\xff\xc3 c")], "path string, content binary")
    assert files.extracted(found).first()["text"] == "a�b c"


def test_results_are_read_back(spark, tmp_path):
    (tmp_path / "r.txt").write_text('{"id": 1, "t": "a"}\nwarming up {"id": 2, "t": "b"}\nno result\n{broken\n')
    rows, bad = files.results(spark, str(tmp_path), "id int, t string")
    assert sorted((r.id, r.t) for r in rows.collect()) == [(1, "a"), (2, "b")] and sorted(r.value for r in bad.collect()) == ["no result", "{broken"]


def test_blank_answers_have_no_gap_reason(spark):
    q = spark.createDataFrame([(1, "short", "generalization matters greatly", None, 10, "x", None)], "id int, question_type string, correct_answer string, options string, points int, concept_tag string, grounding_chunk string")
    a = spark.createDataFrame([(7, 1, " \t\n "), (7, 1, "wrong words"), (7, 2, "unknown")], "submission_id int, question_id int, student_answer string")
    got = {r.student_answer: (r.score, r.gap) for r in grading.graded_answers(a, q).collect()}
    assert got == {" \t\n ": (0, None), "wrong words": (2, "overfitting")}
    back = {r.student_answer: (r.score, r.max_score, r.feedback is None) for r in grading.written_back(a.where("student_answer <> 'wrong words'"), grading.graded_answers(a.where("student_answer <> 'wrong words'"), q), ["submission_id", "question_id"]).collect()}
    assert back == {" \t\n ": (0, 10, False), "unknown": (None, None, True)}


def test_feedback_of_a_partial_answer(spark):
    df = spark.createDataFrame([("gradient descent minimises losses stepwise", "gradient descent minimises losses", "The chunk.")], "e string, a string, c string")
    g = G.grade(F.lit("short"), F.col("e"), F.lit(None).cast("string"), F.lit(10), F.col("a"))
    said, gap = G.feedback(g, F.lit("short"), F.col("e"), F.lit(None).cast("string"), F.col("c"), F.col("a"))
    r = df.select(said.alias("s"), gap.alias("g")).first()
    assert r.s == 'Partial — 4/5 core ideas present but missing nuance: expected direction "gradient descent minimises losses stepwise…" (chunk: "The chunk.…").'
    assert r.g == "Gap: incomplete conceptual chain. You covered 4 ideas yet missed the link the chunk stresses. Next: rewrite adding the missing link in one sentence."


def test_lists_put_nulls_first_when_descending(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, at int")
    assert [r.id for r in reports.listed(df, "at", descending=True).collect()] == [2, 3, 1] and [r.id for r in reports.listed(df, "at").collect()] == [1, 3, 2]
    assert reports.filtered_by(df, "id", "All").count() == 3 and reports.filtered_by(df, "id", "2").count() == 1


def test_modules_list_their_topics_chunks_too(spark):
    chunks = spark.createDataFrame([(1, i, f"t{i}") for i in range(5)], "doc_id int, chunk_id int, text string")
    tree = spark.createDataFrame([(1, 1, [0], [{"chunk_indices": [3]}])], "doc_id int, module_no int, chunk_indices array<int>, topics array<struct<chunk_indices:array<int>>>")
    assert sorted(r.chunk_id for r in Q.in_modules(chunks, tree, F.lit(True)).collect()) == [0, 3]
    none = modules.topic_tree(chunks.limit(0), spark.createDataFrame([(9, "Alone")], "doc_id int, title string")).collect()
    assert [(r.doc_id, r.title, r.topics[0].title) for r in none] == [(9, "Alone", "Core Concepts")]


def test_small_form_functions(spark):
    now = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(now, 30, None), (now, 30, now + datetime.timedelta(minutes=10))], "s timestamp, m int, e timestamp")
    assert [r.closed_at.minute for r in sessions.auto_submitted(df, "s", "m", "e").collect()] == [30, 10]
    assert crud.stamped(df, F.lit("now")).columns[-1] == "updated_at"
    assert crud.with_defaults(spark.createDataFrame([(None,)], "points int"), "questions").first()[0] == 10
    assert spark.range(1).select(T.avatar_url(F.lit(""), F.lit("a b@c.d"))).first()[0].endswith("?seed=a%20b%40c.d")
    assert spark.range(1).select(T.incomplete(F.array(F.lit("x"), F.lit(" \n")))).first()[0] and not spark.range(1).select(T.incomplete(F.array(F.lit("x")))).first()[0]


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    df = tables.table(spark, str(tmp_path), "t", spread=True)
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and df.count() == 100
    kept = tables.written(df, "t")
    assert kept.count() == 100 and kept.inputFiles()[0].startswith(tables.shared_folder(spark).replace("file:/", "file:///").replace("////", "///")[:8])
