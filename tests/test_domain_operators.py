"""Operators on small tables."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from gradelake import schemas
from gradelake.operators import crud, grading, materials, modules, reports, retrieval, sessions
from gradelake.operators import questions as Q
from gradelake.sources import files, models
from gradelake.streaming import sessions as streams


def chunk_table(spark, texts):
    rows = [(d, i, t, 0.9 if d else 1.0) for d, i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, chunk_id int, text string, grounding_score double")


def test_retrieval_equals_scoring_every_pair(spark):
    import re
    from collections import Counter

    texts = [(d, i, " ".join(["apple", "pear", "plum", "fig"][(d * i + k) % 4] for k in range(d + 1)) if (d + i) % 3 else "zzz yyy") for d in range(6) for i in range(4)]
    chunks = chunk_table(spark, texts)
    queries = spark.createDataFrame([(1, "apple pear"), (2, "fig"), (3, "none of these"), (4, "")], "query_id long, query string")
    tok = lambda s: Counter(re.findall("[a-z]{3,}", s.lower()))
    want = []
    for q, text in [(r.query_id, r.query) for r in queries.collect()]:
        scored = []
        for d, i, t in texts:
            a, b = tok(text), tok(t)
            norm = (sum(a.values()) + sum(b.values())) / 2 or 1
            scored.append((-round(0.7 * sum((a & b).values()) / norm + 0.3 * (0.9 if d else 1.0), 6), d, i))
        want += [(q, d, i, r + 1) for r, (_, d, i) in enumerate(sorted(scored)[:5])]
    got = sorted((r.query_id, r.doc_id, r.chunk_id, r["rank"]) for r in retrieval.scored_chunks(queries, chunks, 5).collect())
    assert got == sorted(want)


def test_module_segments(spark):
    chunks = chunk_table(spark, [(0, 0, "intro Text"), (0, 1, "more"), (0, 2, "Module 1: Basics Here"), (0, 3, "Big Idea and Big Idea, Other Thing"), (1, 0, "UNIT IV. Start"), (2, 0, "plain")])
    got = {(r.doc_id, r.module_no): (r.title, r.chunk_indices, r.topics) for r in modules.module_segments(chunks).collect()}
    assert got[0, 1] == ("General Content", [0, 0, 1], []) and got[0, 2] == ("Module 1", [2, 3], ["Big Idea", "Other Thing"])
    assert got[1, 1] == ("UNIT IV", [0], []) and got[2, 1] == ("General Content", [0, 0], [])
    told = chunk_table(spark, [(5, 0, "intro Text"), (5, 1, "Big Idea here"), (5, 2, "Other Thing. Big Idea. Third One. Fourth Two")])
    assert modules.module_segments(told).collect()[0].topics == ["Big Idea", "Other Thing", "Third One"]
    topics = modules.topic_tree(told).collect()[0].topics
    assert [(t.id, t.title, t.chunk_indices) for t in topics] == [("1.1", "Big Idea", [1]), ("1.2", "Other Thing", [2]), ("1.3", "Third One", [2])]
    clean = modules.module_segments(chunks, dedupe_default=True).where("doc_id = 0 and module_no = 1").collect()[0]
    assert clean.chunk_indices == [0, 1]


def test_module_groups_exceed_four(spark):
    chunks = chunk_table(spark, [(1, i, "x") for i in range(7)] + [(2, i, "x") for i in range(9)])
    got = modules.module_groups(chunks).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 7, 2: 5}


def test_reports(spark):
    subs = spark.createDataFrame([(1, 10, "evaluated", 8, 10), (2, 10, "submitted", 1, 10), (3, 11, "evaluated", 1, 30)], "id long, student_id long, status string, score long, total long")
    students = spark.createDataFrame([(10, "a"), (11, "b"), (12, "c")], "id long, name string")
    assert reports.class_average(subs).collect()[0].class_average == 22.5
    assert reports.class_average(subs.limit(0)).collect()[0].class_average is None
    assert {r.id: r.average for r in reports.roster(students, subs).collect()} == {10: 80, 11: 3, 12: None}


def test_grading_joins(spark):
    q = spark.createDataFrame([(1, "short", "alphas gammas", None, 10, "Overfit"), (2, "mcq", "Yes", '["Yes","No"]', 5, "t")], "id long, question_type string, correct_answer string, options string, points int, concept_tag string")
    a = spark.createDataFrame([(7, 1, "alphas gammas"), (7, 2, "No"), (8, 1, "other words"), (8, 99, "x"), (9, None, "x")], "submission_id long, question_id long, student_answer string")
    g = grading.graded_answers(a, q)
    assert {(r.submission_id, r.question_id): (r.score, r.gap) for r in g.collect()} == {(7, 1): (10, None), (7, 2): (0, None), (8, 1): (2, "overfitting")}
    totals = grading.rolled_up(g)
    assert {r.submission_id: (r.score, r.total) for r in totals.collect()} == {7: (10, 15), 8: (2, 10)}
    subs = spark.createDataFrame([(7, None, None, "submitted"), (10, None, None, "pending")], "id long, score long, total long, status string")
    assert {r.id: (r.score, r.status) for r in grading.applied_grades(subs, totals).collect()} == {7: (10, "evaluated"), 10: (None, "pending")}


def test_question_sets(spark):
    assert Q.requested(None) == {"mcq": 2, "short": 2, "conceptual": 2} and Q.split_total(10) == {"mcq": 3, "short": 3, "conceptual": 4}
    for bad in ({}, {"mcq": 51}, {"mcq": -1}):
        with pytest.raises(ValueError):
            Q.requested(bad)
    chunks = chunk_table(spark, [(1, 0, "Some Thing is here."), (1, 1, "next"), (2, 0, "third Other")])
    weights = spark.createDataFrame([(1, 0.0), (2, 0.9)], "doc_id long, weight double")
    picked = Q.weighted_selection(Q.pooled(chunks, weights, 2), 3)
    assert [(r.doc_id, r.chunk_id) for r in picked.orderBy("place").collect()] == [(2, 0), (1, 0), (1, 1)]
    made = Q.template_questions(picked, {"mcq": 1, "short": 1, "conceptual": 1}).orderBy("question_no").collect()
    assert [r.question_type for r in made] == ["mcq", "short", "conceptual"] and made[0].correct_answer == "third Other"
    assert made[0].options.startswith('["third Other",') and [r.concept_tag for r in made] == ["Other", "Some Thing", "Other"]
    cited = spark.createDataFrame([(1, "next"), (2, "absent"), (3, "")], "n int, grounding_chunk string")
    assert {r.n: r.grounding_chunk for r in Q.grounded(cited, picked).collect()} == {1: "next", 2: "third Other", 3: ""}
    tree = spark.createDataFrame([(1, "m1", [1])], "doc_id long, id string, chunk_indices array<int>")
    assert [(r.doc_id, r.chunk_id) for r in Q.in_modules(chunks, tree, F.col("id") == "m1").collect()] == [(1, 1)]
    assert Q.in_modules(chunks, tree, F.col("id") == "zz").count() == 3


def test_replies(spark):
    good = 'Sure:\n```json\n[{"question":"q1","points":0,"difficulty":"Hard"},{"question_text":"q2"},{"question_text":"q3"},{"question_text":"q4"}]\n```'
    df = spark.createDataFrame([(1, good), (2, "no json"), (3, '[{"question":"only one"}]'), (4, None)], "id int, raw string")
    got = Q.normalised_replies(df, "raw").orderBy("question_no").collect()
    assert [(r.id, r.question_text, r.points) for r in got] == [(1, "q1", 15), (1, "q2", 10), (1, "q3", 10), (1, "q4", 10)]

    def missing(_):
        raise models.Missing

    calls = []

    def flaky(p):
        calls.append(p)
        if len(calls) < 2:
            raise OSError
        return p.upper()

    assert models.answered("a", [missing, flaky], wait_s=0) == "A" and len(calls) == 2
    prompts = spark.createDataFrame([("x",), (None,)], "p string")
    assert [r[0] for r in prompts.select(models.replies(F.col("p"), [str.upper])).collect()] == ["X", None]


def test_crud(spark):
    s = spark.createDataFrame([(1, "a", "x@e"), (2, "b", "y@e")], "id long, name string, email string")
    new = spark.createDataFrame([(3, "c", "x@e"), (4, "d", "z@e")], "id long, name string, email string")
    assert sorted(r.id for r in crud.inserted_if_absent(s, new, "email").collect()) == [1, 2, 4]
    change = spark.createDataFrame([(1, "n", None)], "id long, name string, email string")
    assert {r.id: (r.name, r.email) for r in crud.updated(s, change, "id", ["name", "email"]).collect()}[1] == ("n", "x@e")
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    sets = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id long, document_id long")
    subs = spark.createDataFrame([(20, 10, 1, 5), (21, 11, 2, 5)], "id long, set_id long, document_id long, student_id long")
    answers = spark.createDataFrame([(30, 20, 7), (31, 21, 7)], "id long, submission_id long, question_id long")
    left = crud.cascaded({"documents": docs, "question_sets": sets, "submissions": subs, "answers": answers}, "documents", docs.where("id = 1"))
    assert {t: sorted(r.id for r in df.collect()) for t, df in left.items()} == {"documents": [2], "question_sets": [11, 12], "submissions": [21], "answers": [31]}
    q = spark.createDataFrame([(1, "t", "mcq", "a", "Easy"), (2, "t", "essay", "a", None), (3, None, "mcq", "a", None)], "id long, question_text string, question_type string, correct_answer string, difficulty string")
    good, bad = crud.valid_and_quarantined(q, "questions")
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]
    assert crud.single(docs.where("id = 1")).count() == 1
    with pytest.raises(ValueError):
        crud.single(docs)
    assert crud.filtered(s, {"id": 0, "name": "a"}).count() == 1 and crud.filtered(s, among={"id": []}).count() == 0
    assert crud.visible(s, "students", "public").count() == 0 and crud.visible(s, "students", "service").count() == 2


def test_schemas_are_valid(spark):
    for table, ddl in schemas.TABLES.items():
        df = spark.createDataFrame([], ddl.replace("variant", "string"))
        assert set(schemas.REQUIRED[table]) <= set(df.columns)


def test_materials(spark):
    f = spark.createDataFrame([(1, "Notes.PDF", b"abc"), (2, "x.txt", b"")], "id long, name string, content binary")
    stored = materials.stored(f, F.col("name"), F.col("content")).drop("content")
    back = {r.id: (r.title, r.file_type, r.found, bytes(r.content) if r.content else None) for r in materials.downloaded(stored.withColumn("file_url", F.lit(None).cast("string"))).collect()}
    assert back == {1: ("Notes", "pdf", True, b"abc"), 2: ("x", "txt", False, None)}
    assert {r.id: r.has_file for r in materials.listed(stored).collect()} == {1: True, 2: False}


def test_sessions(spark):
    rows = [("u", t, i, "click" if t % 2 == 0 else "scroll", f"b{t % 3}", t, 3 * i, 4 * i) for i, t in enumerate([0, 150, 260, 300, 700])]
    e = spark.createDataFrame(rows, "s string, t long, i long, type string, element string, depth_pct int, x long, y long")
    r = sessions.summaries(e, "s", "t", "i").collect()[0]
    assert (r.total_clicks, r.total_scrolls, r.time_to_first_click_ms, r.cursor_distance_px, r.duration_ms) == (5, 0, 150, 20, 700)
    assert sorted(x.kept_ms for x in sessions.throttled(e, "s", "t", "i", 250).collect()) == [0, 260, 700]
    assert sessions.capped(e, "s", "t", "i", most=2).count() == 2 and sessions.capped(e, "s", "t", "i", most_ms=260).count() == 2


def docx(paragraphs, table):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def write_files(folder):
    long = "A sentence that is long enough to be kept as a document. " * 3
    (folder / "a.txt").write_bytes(long.encode() + b"\xff")
    (folder / "b.MD").write_text("too short")
    (folder / "c.docx").write_bytes(docx([long, " "], [["h", "k"], ["1", ""]]))
    (folder / "d.xyz").write_text(long)
    (folder / "e.docx").write_bytes(b"not a zip")


def test_ingest_of_files(spark, tmp_path):
    write_files(tmp_path)
    good, bad = files.ingested(files.files(spark, str(tmp_path)))
    rows = {r.original_name: r for r in good.collect()}
    assert set(rows) == {"a.txt", "c.docx"} and rows["a.txt"].title == "a" and "�" not in rows["a.txt"].content
    assert rows["c.docx"].content.endswith("[TABLE]\n| h | k |\n| --- | --- |\n| 1 |  |\n[/TABLE]") and rows["c.docx"].extraction_stats.tables == 1
    why = {r.path.split("/")[-1]: r.reason for r in bad.collect()}
    assert why["b.MD"] == "Not enough text" and why["d.xyz"] == "Unsupported file type" and why["e.docx"].startswith("BadZipFile")


def test_extraction_passes(spark):
    df = spark.createDataFrame([("text", None, None, "longer ocr text"), (None, None, None, "ocr"), (None, "fall", "an image", "o" * 50), ("", "", "", None)], "a string, b string, c string, d string")
    got = [r[0] for r in df.select(files.passes(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got == ["text", "ocr", "o" * 50, ""]


def test_streams(spark, tmp_path):
    rows = [(u, f"2024-01-01 {h:02d}:{m:02d}:00", k) for u in (1, 2) for h in (1, 3) for m, k in ((0, "click"), (10, "view"), (20, "click"))]
    e = spark.createDataFrame(rows, "user_id long, t string, event_type string").select("user_id", F.to_timestamp("t").alias("ts"), "event_type")
    # One file: several are read in an order that chance gives, and the watermark then drops rows as late.
    e.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    spark.createDataFrame([(9, "2024-01-02 00:00:00", "view")], "user_id long, t string, event_type string").select("user_id", F.to_timestamp("t").alias("ts"), "event_type").write.parquet(str(tmp_path / "in" / "b"))
    stream = streams.event_stream(spark, str(tmp_path / "in" / "*"), e.schema)
    streams.flushed(streams.session_counts(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    key = lambda df: sorted((r.user_id, r.session_start, r.n_events, r.n_clicks, r.n_views) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(streams.session_counts(e))

    folder = tmp_path / "drop"
    folder.mkdir()
    write_files(folder)
    args = (spark, str(folder), str(tmp_path / "docs"), str(tmp_path / "bad"), str(tmp_path / "ck"))
    streams.ingest_stream(*args)
    (folder / "f.txt").write_text("Another text that is certainly long enough to be ingested here.")
    streams.ingest_stream(*args)
    assert sorted(r.original_name for r in spark.read.parquet(str(tmp_path / "docs")).collect()) == ["a.txt", "c.docx", "f.txt"]


def test_concepts_list_all_modules(spark):
    from gradelake.operators import concepts

    found = spark.createDataFrame([("A", 3), ("B", 1)], "concept string, n long")
    mods = spark.createDataFrame([(2, "Second"), (1, "First")], "module_no int, title string")
    assert {r.concept: list(r.modules) for r in concepts.concepts_with_modules(found, mods).collect()} == {c: ["First", "Second"] for c in "AB"}
    assert [list(r.modules) for r in concepts.concepts_with_modules(found, mods.limit(0)).collect()] == [[], []]


def test_one_analysis_goes_to_every_source_document(spark):
    docs = spark.createDataFrame([(1, None, "m"), (2, "old", "m"), (3, "old", "m")], "id long, syllabus_analysis string, module_structure string")
    made = spark.createDataFrame([("new", "[]")], "syllabus_analysis string, module_structure string")
    got = {r.id: (r.syllabus_analysis, r.module_structure) for r in crud.analysed(docs, spark.createDataFrame([(1,), (2,), (2,)], "id long"), made).collect()}
    assert got == {1: ("new", "[]"), 2: ("new", "[]"), 3: ("old", "m")}


def test_focus_sample_is_seeded(spark):
    chunks = chunk_table(spark, [(d, i, "t") for d in range(4) for i in range(5)])
    pick = lambda n, seed: [(r.doc_id, r.chunk_id) for r in Q.focus_sample(chunks, n, seed).orderBy("place").collect()]
    assert pick(6, "a") == pick(6, "a") == pick(20, "a")[:6] and pick(20, "a") != pick(20, "b")
    assert len(set(pick(50, "a"))) == 20
