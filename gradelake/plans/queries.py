"""The registered queries over the domain views, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradelake.functions import grading as G
from gradelake.functions import text as T
from gradelake.operators import analysis, changes, chunking, concepts, crud, grading, materials, modules, reports, retrieval, sessions
from gradelake.operators import questions as Q
from gradelake.plans import domain as D
from gradelake.plans.domain import sql
from gradelake.streaming import sessions as stream_sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = "2024-01-14"


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return register


# Documents and chunks


@query(sql("SELECT doc_id, chunk_id, text, tokens, page FROM chunks", "chunks"))
def q_chunk_documents(spark, d):
    return D.chunks(spark, d).select("doc_id", "chunk_id", "text", "tokens", "page")


@query(sql("SELECT doc_id, chunk_id, grounding_score FROM chunks", "chunks"))
def q_grounding_score(spark, d):
    return D.chunks(spark, d).select("doc_id", "chunk_id", "grounding_score")


@query(
    sql(
        r"""SELECT doc_id, length(regexp_replace(content, '^\s+|\s+$', '', 'g')) >= 50 AS accepted,
        CAST((length(content) - length(replace(content, '[TABLE]', ''))) // 7 AS INTEGER) AS n_tables,
        CAST((length(content) - length(replace(content, '[VISUAL CONTENT', ''))) // 15 AS INTEGER) AS n_visuals FROM marked""",
        "marked",
    )
)
def q_ingest_gate(spark, d):
    return chunking.ingest_gate(D.marked_documents(spark, d), F.col("content")).select("doc_id", "accepted", "n_tables", "n_visuals")


@query(sql("SELECT doc_id, CAST(len(texts) AS INTEGER) AS n_chunks, len(texts) > 0 AND len(list_filter(texts, lambda t: length(t) <= 30)) = 0 AS chunks_valid FROM chunk_lists", "chunk_lists"))
def q_chunk_validate(spark, d):
    return chunking.ingest_gate(D.documents(spark, d), F.col("content")).select("doc_id", "n_chunks", "chunks_valid")


@query(sql(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\[TABLE\](?:.|\n)*?\[/TABLE\]', '', 'g'), '\[VISUAL CONTENT[^\]]*\](?:.|\n)*?\[/VISUAL CONTENT\]', '', 'g'), '\[/?TABLE\]', '', 'g'), '\[/?VISUAL CONTENT[^\]]*\]', '', 'g'), '(?m)^\s*\|.*\|\s*$', '', 'g'), '(?m)^\s*\|[\s\-:|]+\|\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM marked""", "marked"))
def q_clean_text(spark, d):
    return D.marked_documents(spark, d).select("doc_id", T.clean_text(F.col("content")).alias("cleaned"))


@query(
    """SELECT r_name, '| name | key | extra |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(list_sort(list(n_name)), lambda x:
    '| ' || x || ' | ' || CASE WHEN length(x) > 7 THEN '' ELSE lower(x) END || ' |  |'), chr(10)) AS markdown
    FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def q_table_markdown(spark, d):
    nation, region = D.table(spark, d, "nation"), D.table(spark, d, "region")
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    cells = F.transform("names", lambda x: F.array(x, F.when(F.length(x) <= 7, F.concat(F.lit(" "), F.lower(x), F.lit(" ")))))
    header = F.array(F.array(F.lit("name"), F.lit("key"), F.lit("extra")))
    return rows.select("r_name", T.table_markdown(F.concat(header, cells)).alias("markdown"))


_WIDE = "CASE doc_id % 4 WHEN 0 THEN chr(12288) || replace(content, '. ', '.' || chr(8232)) WHEN 1 THEN replace(content, ' ', chr(160)) WHEN 2 THEN replace(content, '. ', '.' || chr(28)) || chr(8199) ELSE replace(content, ', ', ',' || chr(133)) END"


@query(sql("", "docs").rstrip() + f""",\nwide AS (SELECT doc_id, title, {_WIDE} AS content FROM docs), lists AS ({D.chunked("wide")})
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk_id, md5(texts[i]) AS text_md5, CAST(len(list_filter(regexp_split_to_array(texts[i], '{D._S}+'), lambda w: w <> '')) AS INTEGER) AS tokens FROM (SELECT doc_id, texts, unnest(range(1, len(texts) + 1)) AS i FROM lists)""")
def q_unicode_chunks(spark, d):
    """Chunks of documents whose blanks are those of other scripts: wide, fixed, separators of lines and files."""
    docs = D.documents(spark, d)
    c, of = F.col("content"), F.col("doc_id") % 4
    swapped = lambda old, new: F.replace(c, F.lit(old), F.lit(new))
    wide = F.when(of == 0, F.concat(F.lit("\u3000"), swapped(". ", ".\u2028"))).when(of == 1, swapped(" ", "\u00a0")).when(of == 2, F.concat(swapped(". ", ".\x1c"), F.lit("\u2007"))).otherwise(swapped(", ", ",\x85"))
    return chunking.chunk_documents(docs, "doc_id", wide).select("doc_id", "chunk_id", F.md5("text").alias("text_md5"), "tokens")


# Retrieval

_SCORED = r"""tok AS (SELECT doc_id, chunk_id, word, count(*) AS n FROM (SELECT doc_id, chunk_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS word FROM chunks) GROUP BY ALL),
qtok AS (SELECT query_id, word, count(*) AS nq FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z]{3,}')) AS word FROM asked) GROUP BY ALL),
common AS (SELECT query_id, doc_id, chunk_id, CAST(sum(least(n, nq)) AS INTEGER) AS overlap FROM tok JOIN qtok USING (word) GROUP BY ALL),
csize AS (SELECT doc_id, chunk_id, grounding_score, len(regexp_extract_all(lower(text), '[a-z]{3,}')) AS nc FROM chunks),
qsize AS (SELECT query_id, len(regexp_extract_all(lower(query), '[a-z]{3,}')) AS nq FROM asked),
pairs AS (SELECT query_id, doc_id, chunk_id, coalesce(overlap, 0) AS overlap, round((CASE WHEN nq + nc > 0 THEN coalesce(overlap, 0) / ((nq + nc) / 2.0::DOUBLE) ELSE 0 END) * 0.7::DOUBLE + grounding_score * 0.3::DOUBLE, 6) AS score FROM csize CROSS JOIN qsize LEFT JOIN common USING (query_id, doc_id, chunk_id)),
ranked AS (SELECT query_id, doc_id, chunk_id, CAST(overlap AS INTEGER) AS overlap, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id) AS INTEGER) AS rank FROM pairs)"""


def _retrieval(body: str) -> str:
    return sql("", "chunks", "asked").rstrip() + ",\n" + _SCORED + "\n" + body


@query(_retrieval("SELECT * FROM ranked WHERE rank <= 5"))
def q_retrieve_topk(spark, d):
    return retrieval.scored_chunks(D.queries(spark, d), D.chunk_index(spark, d), 5)


@query(_retrieval("SELECT query_id, doc_id, chunk_id, score FROM ranked WHERE rank = 1"))
def q_best_grounding(spark, d):
    return retrieval.scored_chunks(D.queries(spark, d), D.chunk_index(spark, d), 1).select("query_id", "doc_id", "chunk_id", "score")


@query(_retrieval("""SELECT query_id, string_agg('[Chunk ' || (chunk_id + 1) || ' | p' || page || ' | ' || tokens || ' tok | g=' || CAST(grounding_score AS VARCHAR) || ']: ' || text, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked JOIN chunks USING (doc_id, chunk_id) WHERE rank <= 5 GROUP BY query_id"""))
def q_context(spark, d):
    chunks = D.chunk_index(spark, d, cited=True)
    return retrieval.contexts(retrieval.scored_chunks(D.queries(spark, d), chunks, 5), chunks)


# Reports


@query(sql("SELECT round(sum(score) FILTER (status = 'evaluated') / CAST(sum(total) FILTER (status = 'evaluated') AS DOUBLE) * 100, 1) AS class_average, count(*) FILTER (status = 'evaluated') AS n_evaluated FROM scored_submissions", "scored_submissions"))
def q_class_average(spark, d):
    return reports.class_average(D.scored_submissions(spark, d))


@query(sql("SELECT s.id, s.name, CAST(floor(a.s * 100.0::DOUBLE / nullif(a.t, 0) + 0.5) AS INTEGER) AS average, coalesce(a.n, 0) AS n_evaluated FROM students s LEFT JOIN (SELECT student_id, sum(score) AS s, sum(total) AS t, count(*) AS n FROM scored_submissions WHERE status = 'evaluated' GROUP BY student_id) a ON s.id = a.student_id", "students", "scored_submissions"))
def q_roster(spark, d):
    return reports.roster(D.students(spark, d), D.scored_submissions(spark, d))


@query(sql("SELECT count(*) AS total, count(*) FILTER (status = 'evaluated') AS evaluated, count(*) FILTER (status = 'submitted') AS submitted FROM submissions", "submissions"))
def q_status_counts(spark, d):
    return reports.status_counts(D.submissions(spark, d))


@query(sql("SELECT (SELECT count(*) FROM docs) AS n_documents, (SELECT CAST(sum(len(texts)) AS BIGINT) FROM chunk_lists) AS n_chunks, (SELECT count(*) FROM questions) AS n_questions, (SELECT count(*) FROM question_sets) AS n_sets", "chunk_lists", "question_sets"))
def q_overview(spark, d):
    docs = D.documents(spark, d)
    return reports.overview(docs, F.size(T.chunk_texts(F.col("content"))), D.questions(spark, d), D.question_sets(spark, d))


@query(sql("SELECT concept_tag, count(*) AS n_questions, CAST(58 + (length(concept_tag) * 7) % 35 AS INTEGER) AS display, CASE WHEN 58 + (length(concept_tag) * 7) % 35 > 80 THEN 'high' WHEN 58 + (length(concept_tag) * 7) % 35 > 65 THEN 'medium' ELSE 'low' END AS band FROM questions GROUP BY concept_tag", "questions"))
def q_concept_histogram(spark, d):
    return reports.concept_histogram(D.questions(spark, d))


@query(sql("SELECT concept_tag, round(sum(greatest(0, least(score, points))) * 100.0::DOUBLE / sum(points), 1) AS mastery, count(*) AS n_answers FROM answers a JOIN questions q ON a.question_id = q.id GROUP BY concept_tag", "answers", "questions"))
def q_concept_mastery(spark, d):
    q = D.questions(spark, d)
    return reports.concept_mastery(grading.clamped_answers(D.answers(spark, d), q).drop("points", "concept_tag"), q)


@query(sql(f"SELECT s.id, coalesce(q.n, 0) AS n_questions, coalesce(q.p, 0) AS points, coalesce(a.n, 0) AS n_attempts, coalesce(f.c, '') AS first_concepts, coalesce(due_date < DATE '{NOW}', FALSE) AS overdue FROM question_sets s LEFT JOIN (SELECT set_id, count(*) AS n, CAST(sum(points) AS BIGINT) AS p FROM questions GROUP BY set_id) q ON q.set_id = s.id LEFT JOIN (SELECT set_id, count(*) AS n FROM submissions GROUP BY set_id) a ON a.set_id = s.id LEFT JOIN (SELECT set_id, string_agg(concept_tag, ', ' ORDER BY id) AS c FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY id) AS r FROM questions) WHERE r <= 3 GROUP BY set_id) f ON f.set_id = s.id", "question_sets", "submissions"))
def q_set_stats(spark, d):
    return reports.set_statistics(D.question_sets(spark, d), D.questions(spark, d), D.submissions(spark, d), F.to_date(F.lit(NOW)))


# Grading


@query(sql("SELECT submission_id, question_id, greatest(0, least(a.score, q.points)) AS score, points, concept_tag, is_correct FROM answers a JOIN questions q ON a.question_id = q.id", "answers", "questions"))
def q_grade_join(spark, d):
    return grading.clamped_answers(D.answers(spark, d), D.questions(spark, d)).select("submission_id", "question_id", "score", "points", "concept_tag", "is_correct")


@query(sql("SELECT submission_id, CAST(sum(greatest(0, least(a.score, q.points))) AS BIGINT) AS score, CAST(sum(points) AS BIGINT) AS total, count(*) AS n_answers FROM answers a JOIN questions q ON a.question_id = q.id GROUP BY submission_id", "answers", "questions"))
def q_submission_rollup(spark, d):
    return grading.rolled_up(grading.clamped_answers(D.answers(spark, d), D.questions(spark, d)))


@query(sql("SELECT s.id, CASE WHEN t.total IS NULL THEN s.status ELSE 'evaluated' END AS status, t.score, t.total FROM submissions s LEFT JOIN scored_submissions t ON s.id = t.id", "submissions", "scored_submissions"))
def q_write_back(spark, d):
    totals = grading.rolled_up(grading.clamped_answers(D.answers(spark, d), D.questions(spark, d)))
    empty = F.lit(None).cast("long")
    return grading.applied_grades(D.submissions(spark, d).withColumns({"score": empty, "total": empty}), totals).select("id", "status", "score", "total")


@query(sql("SELECT s.id, st.name, st.email, s.status, q.question_text, a.score FROM submissions s LEFT JOIN students st ON s.student_id = st.id LEFT JOIN answers a ON a.submission_id = s.id LEFT JOIN questions q ON q.id = a.question_id AND q.set_id % 2 = 0", "submissions", "students", "answers", "questions"))
def q_review_left(spark, d):
    known = D.questions(spark, d).where("set_id % 2 = 0")
    review = grading.reviewed(D.answers(spark, d), known).select(F.col("submission_id").alias("id"), "question_text", "score")
    student = D.students(spark, d).select(F.col("id").alias("student_id"), "name", "email")
    return D.submissions(spark, d).join(student, "student_id", "left").join(review, "id", "left").select("id", "name", "email", "status", "question_text", "score")


_KEYWORDS = r"""SELECT *, lower(correct_answer) AS qa, regexp_replace(lower(student_answer), '^\s+|\s+$', '', 'g') AS sa FROM free_answers"""
_GRADED = rf"""g AS (SELECT conv_id, turn, sa, qa, kw, len(list_filter(kw, lambda k: contains(sa, k))) AS matched FROM (SELECT *, list_slice(list_filter(regexp_split_to_array(qa, '\W+'), lambda w: length(w) > 4), 1, 6) AS kw FROM ({_KEYWORDS}))),
c AS (SELECT *, matched / CAST(greatest(len(kw), 1) AS DOUBLE) AS coverage FROM g)"""


@query(
    sql("", "free_answers").rstrip()
    + ",\n"
    + _GRADED
    + """
    SELECT conv_id, turn, length(sa) >= 2 AND coverage >= 0.7 AS is_correct, CAST(CASE WHEN length(sa) < 2 THEN 0 WHEN coverage >= 0.85 THEN 10 WHEN coverage >= 0.65 THEN 6 ELSE 2 END AS INTEGER) AS score,
    CAST(matched AS INTEGER) AS matched, CAST(len(kw) AS INTEGER) AS n_keywords,
    CASE WHEN length(sa) >= 2 AND coverage < 0.65 THEN CASE WHEN contains(qa, 'generalization') THEN 'overfitting' ELSE 'ungrounded' END END AS gap FROM c"""
)
def q_local_grade_short(spark, d):
    a = D.free_answers(spark, d)
    key = F.concat_ws(":", "conv_id", "turn")
    none = F.lit(None).cast("string")
    q = a.select(key.alias("id"), F.lit("short").alias("question_type"), "correct_answer", none.alias("options"), F.lit(10).alias("points"), none.alias("concept_tag"))
    given = a.select(key.alias("question_id"), "conv_id", "turn", "student_answer")
    return grading.graded_answers(given, q).select("conv_id", "turn", "is_correct", "score", "matched", "n_keywords", "gap")


_SAID = """SELECT conv_id, turn, CASE WHEN length(sa) < 2 THEN 'No substantive answer — the grounded chunk notes: "' || left(chunk, 120) || '…". Gemma flags missing engagement with the cited source.'
    WHEN coverage >= 0.85 THEN 'Strong — you hit ' || matched || '/' || len(kw) || ' key ideas (' || array_to_string(list_slice(kw, 1, 3), ', ') || ') and track the grounded chunk: "' || left(chunk, 100) || '…".'
    WHEN coverage >= 0.65 THEN 'Partial — ' || matched || '/' || len(kw) || ' core ideas present but missing nuance: expected direction "' || left(correct_answer, 120) || '…" (chunk: "' || left(chunk, 90) || '…").'
    ELSE 'Grounded expectation: "' || left(correct_answer, 140) || '…" (chunk: "' || left(chunk, 100) || '…"). Your answer "' || left(student_answer, 120) || '…" diverges from that lineage.' END AS feedback,
    CASE WHEN length(sa) < 2 THEN 'Gap: Absence of retrieval — re-read the cited chunk and restate the core idea in one sentence focusing on WHY.'
    WHEN coverage >= 0.85 THEN 'Minor gap: expression depth — connect the idea to a concrete example to cement transfer.'
    WHEN coverage >= 0.65 THEN 'Gap: incomplete conceptual chain. You covered ' || matched || ' ideas yet missed the link the chunk stresses. Next: rewrite adding the missing link in one sentence.'
    ELSE CASE WHEN contains(tag, 'overfit') OR contains(qa, 'generalization') THEN 'Classic overfitting fallacy: training accuracy ≠ generalization — variance and validation matter per the chunk.'
    WHEN contains(tag, 'paradigm') THEN 'Paradigms conflated: theory-driven (interpretable/low-data) vs data-driven (perceptual/large-data) — trade-off missed.'
    WHEN contains(tag, 'iterat') THEN 'Feedback-loop rationale missed — single-pass cannot revise early errors per the iterative chunk.'
    ELSE 'Answer diverges from the grounded source — indicates retrieval without grounding.' END || ' Action: re-read the cited chunk, then explain the concept to a peer in 30s focusing on WHY.' END AS conceptual_gap,
    length(sa) >= 2 AND coverage >= 0.7 AS is_correct, CAST(CASE WHEN length(sa) < 2 THEN 0 WHEN coverage >= 0.85 THEN 10 WHEN coverage >= 0.65 THEN 6 ELSE 2 END AS INTEGER) AS score
    FROM (SELECT c.*, a.student_answer, a.correct_answer, left(a.correct_answer, 200) AS chunk, CASE conv_id % 4 WHEN 0 THEN 'overfitting' WHEN 1 THEN 'paradigms' WHEN 2 THEN 'iteration' ELSE '' END AS tag FROM c JOIN free_answers a USING (conv_id, turn))"""


def _asked_freely(spark, d):
    """Questions and answers of conversations, as the grader takes them."""
    a = D.free_answers(spark, d)
    none = F.lit(None).cast("string")
    tags = F.array(*map(F.lit, ["Overfitting", "Paradigms", "Iteration", ""]))
    q = a.select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.lit("short").alias("question_type"), "correct_answer", none.alias("options"), F.lit(10).alias("points"), F.get(tags, (F.col("conv_id") % 4).cast("int")).alias("concept_tag"), F.left("correct_answer", F.lit(200)).alias("grounding_chunk"))
    return a.select(F.concat_ws(":", "conv_id", "turn").alias("question_id"), "conv_id", "turn", "student_answer"), q


@query(sql("", "free_answers").rstrip() + ",\n" + _GRADED + f"\nSELECT conv_id, turn, feedback, conceptual_gap FROM ({_SAID})")
def q_feedback(spark, d):
    return grading.graded_answers(*_asked_freely(spark, d)).select("conv_id", "turn", "feedback", "conceptual_gap")


@query(sql("", "free_answers").rstrip() + ",\n" + _GRADED + f"\nSELECT a.conv_id, a.turn, s.is_correct, s.score, CASE WHEN s.score IS NOT NULL THEN 10 END AS max_score, s.feedback, s.conceptual_gap FROM free_answers a LEFT JOIN (SELECT * FROM ({_SAID}) WHERE conv_id % 5 <> 0) s USING (conv_id, turn)")
def q_answers_write_back(spark, d):
    """A fifth of the answers have lost their question and stay as they were."""
    answers, q = _asked_freely(spark, d)
    known = q.where(F.split_part("id", F.lit(":"), F.lit(1)).cast("long") % 5 != 0)
    done = grading.written_back(answers, grading.graded_answers(answers, known), ["question_id"])
    return done.select("conv_id", "turn", "is_correct", "score", "max_score", "feedback", "conceptual_gap")


@query(sql("", "free_answers").rstrip() + ",\n" + _GRADED + f"""\nSELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN TRUE ELSE is_correct END AS is_correct, CAST(CASE turn % 3 WHEN 0 THEN least(10, conv_id % 14) ELSE score END AS INTEGER) AS score,
    CASE turn % 3 WHEN 0 THEN 'By the model.' ELSE feedback END AS feedback, CASE turn % 3 WHEN 0 THEN '' ELSE conceptual_gap END AS conceptual_gap FROM ({_SAID})""")
def q_model_evaluation(spark, d):
    """Replies of a model on a third of the answers, without a score or broken on the others."""
    graded = grading.graded_answers(*_asked_freely(spark, d))
    said = F.concat(F.lit('Sure: {"is_correct": true, "score": '), (F.col("conv_id") % 14).cast("string"), F.lit('.2, "feedback": "By the model."} done'))
    reply = F.when(F.col("turn") % 3 == 0, said).when(F.col("turn") % 3 == 1, F.lit('{"is_correct": true, "feedback": "no score"}')).otherwise(F.lit("{broken"))
    return grading.evaluated(graded.withColumn("reply", reply), "reply").select("conv_id", "turn", "is_correct", "score", "feedback", "conceptual_gap")


@query(
    """WITH a AS (SELECT p_partkey AS id, p_type AS correct, [p_type, p_brand, p_name] AS opts, CASE p_partkey % 5 WHEN 0 THEN ' ' || upper(p_type) || ' ' WHEN 1 THEN p_brand WHEN 2 THEN left(p_type, 5) WHEN 3 THEN 'zz' ELSE '' END AS given, p_name AS chunk FROM part),
    b AS (SELECT *, lower(trim(given)) AS sa, lower(correct) AS qa, len(list_filter(opts, lambda o: trim(lower(o)) = lower(trim(given)))) > 0 AS listed FROM a)
    SELECT id, CASE WHEN length(sa) < 2 THEN 'No substantive answer — the grounded chunk notes: "' || left(chunk, 120) || '…". Gemma flags missing engagement with the cited source.'
    WHEN listed AND trim(qa) = sa THEN 'Correct — aligns with the grounded source: "' || left(chunk, 110) || '…". You discriminated the diagnostic distractors.'
    WHEN listed THEN 'Your choice "' || given || '" does not match the grounded expectation "' || correct || '". The chunk states: "' || left(chunk, 120) || '…".'
    WHEN sa = qa OR contains(qa, left(sa, 12)) OR contains(sa, left(qa, 12)) THEN 'Correct — matches the grounded answer and the chunk: "' || left(chunk, 110) || '…".'
    ELSE 'Not aligned with the grounded answer "' || correct || '". Grounded source: "' || left(chunk, 120) || '…".' END AS feedback,
    CASE WHEN length(sa) < 2 THEN 'Gap: Absence of retrieval — re-read the cited chunk and restate the core idea in one sentence focusing on WHY.'
    WHEN listed AND trim(qa) = sa THEN 'No gap. Stretch: write one sentence for why each distractor is wrong.'
    WHEN listed THEN 'Misconception: distractor maps to surface familiarity, not the grounded principle. Annotate the chunk and explain why the correct option follows from it.'
    WHEN sa = qa OR contains(qa, left(sa, 12)) OR contains(sa, left(qa, 12)) THEN 'No gap. Next: link this concept to a concrete example from the lecture.'
    ELSE 'Gap: shallow pattern match vs grounded reasoning. Re-read the chunk and justify the correct choice in one sentence.' END AS conceptual_gap FROM b"""
)
def q_feedback_mcq(spark, d):
    p = D.table(spark, d, "part")
    k = F.col("p_partkey") % 5
    given = F.when(k == 0, F.concat(F.lit(" "), F.upper("p_type"), F.lit(" "))).when(k == 1, F.col("p_brand")).when(k == 2, F.left("p_type", F.lit(5))).when(k == 3, "zz").otherwise("")
    g = G.grade(F.lit("mcq"), F.col("p_type"), F.to_json(F.array("p_type", "p_brand", "p_name")), F.lit(10), given)
    said, gap = G.feedback(g, F.lit("mcq"), F.col("p_type"), F.lit(""), F.col("p_name"), given)
    return p.select(F.col("p_partkey").alias("id"), said.alias("feedback"), gap.alias("conceptual_gap"))


@query(
    """WITH a AS (SELECT p_partkey AS id, p_type AS correct, [p_type, p_brand, p_name] AS opts, CASE p_partkey % 5 WHEN 0 THEN ' ' || upper(p_type) || ' ' WHEN 1 THEN p_brand WHEN 2 THEN left(p_type, 5) WHEN 3 THEN 'zz' ELSE '' END AS given, CASE WHEN p_size <= 17 THEN 5 WHEN p_size <= 34 THEN 10 ELSE 15 END AS points FROM part),
    b AS (SELECT *, lower(trim(given)) AS sa, lower(correct) AS qa FROM a),
    c AS (SELECT *, CASE WHEN length(sa) < 2 THEN FALSE WHEN len(list_filter(opts, lambda o: trim(lower(o)) = sa)) > 0 THEN trim(qa) = sa ELSE sa = qa OR contains(qa, left(sa, 12)) OR contains(sa, left(qa, 12)) END AS is_correct FROM b)
    SELECT id, is_correct, CASE WHEN is_correct THEN points ELSE 0 END AS score FROM c"""
)
def q_local_grade_mcq(spark, d):
    p = D.table(spark, d, "part")
    k = F.col("p_partkey") % 5
    given = F.when(k == 0, F.concat(F.lit(" "), F.upper("p_type"), F.lit(" "))).when(k == 1, F.col("p_brand")).when(k == 2, F.left("p_type", F.lit(5))).when(k == 3, "zz").otherwise("")
    points = F.when(F.col("p_size") <= 17, 5).when(F.col("p_size") <= 34, 10).otherwise(15)
    g = G.grade(F.lit("mcq"), F.col("p_type"), F.to_json(F.array("p_type", "p_brand", "p_name")), points, given)
    return p.select(F.col("p_partkey").alias("id"), g.is_correct.alias("is_correct"), g.score.alias("score"))


@query(sql("SELECT id, CASE WHEN coalesce(score / CAST(total AS DOUBLE), 0) >= 0.8 THEN 'strong' WHEN coalesce(score / CAST(total AS DOUBLE), 0) >= 0.5 THEN 'partial' ELSE 'weak' END AS band, CAST(coalesce(floor(score * 100.0::DOUBLE / total + 0.5), 0) AS INTEGER) AS percent FROM scored_submissions", "scored_submissions"))
def q_bands(spark, d):
    return D.scored_submissions(spark, d).select("id", G.performance_band(F.col("score"), F.col("total")).alias("band"), G.percent(F.col("score"), F.col("total")).alias("percent"))


# Concepts and modules

_PHRASE = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"


@query(sql(rf"SELECT concept, n FROM (SELECT p AS concept, count(*) AS n, min((doc_id, chunk_id, i)) AS first FROM (SELECT doc_id, chunk_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT doc_id, chunk_id, regexp_extract_all(text, '{_PHRASE}') AS ps FROM chunks)) GROUP BY p) ORDER BY n DESC, first LIMIT 20", "chunks"))
def q_concept_topn(spark, d):
    return concepts.top_concepts(D.chunks(spark, d))


def _concept_sql(content: str) -> str:
    # Letters beyond ASCII are word characters, which this SQL's \b does not know: a digit stands for them.
    content, terms = f"regexp_replace({content}, '[^\\x00-\\x7F]', '0', 'g')", []
    for pattern, group in T.CONCEPTS:
        terms.append(f"list_filter(list_transform(regexp_extract_all({content}, '{pattern}', {group}), lambda c: regexp_replace(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), '[:.,;]+$', '')), lambda c: length(c) > 3 AND length(c) < 50)")
    terms.append(f"list_filter(regexp_extract_all({content}, '{T.LONG_PHRASE}'), lambda c: length(c) > 5 AND length(c) < 50)")
    joined = f"flatten([{', '.join(terms)}])"
    return f"list_slice(list_filter({joined}, lambda c, i: list_position({joined}, c) = i), 1, 20)"


_CONCEPTS = f"kc AS (SELECT doc_id, content, {_concept_sql('content')} AS concepts FROM (SELECT doc_id, content || ' Unit 3: Machine Learning. Privacy and bias, a model of Overfitting. ' || left(content, 400) AS content FROM docs))"


def _concept_docs(spark, d):
    """Documents with a closing line of concept terms, which the invented prose lacks."""
    docs = D.documents(spark, d)
    return docs.withColumn("content", F.concat("content", F.lit(" Unit 3: Machine Learning. Privacy and bias, a model of Overfitting. "), F.left("content", F.lit(400))))


# Occurrences are counted in the chunks' texts, joined by blanks.
_COVERAGE = f"""{_CONCEPTS}, ktitled AS (SELECT doc_id, '' AS title, content FROM kc), kchunks AS ({D.chunked("ktitled")}),
cv AS (SELECT doc_id, concept, least(100.0::DOUBLE, (length(content) - length(replace(content, lower(concept), ''))) // length(concept) * 10.0::DOUBLE + 20.0::DOUBLE) AS coverage FROM (SELECT doc_id, lower(array_to_string(texts, ' ')) AS content, unnest(concepts) AS concept FROM kc JOIN kchunks USING (doc_id)))"""


@query(sql("", "docs").rstrip() + f",\n{_COVERAGE}\nSELECT doc_id, concept, coverage FROM cv")
def q_concept_coverage(spark, d):
    return concepts.concept_coverage(_concept_docs(spark, d), "content")


@query(sql("", "chunks").rstrip() + f",\n{_CONCEPTS}\nSELECT doc_id, chunk_id, array_to_string(list_slice(list_filter(concepts, lambda k: contains(lower(text), lower(k))), 1, 3), '; ') AS concepts FROM chunks JOIN kc USING (doc_id)")
def q_concept_match(spark, d):
    kc = _concept_docs(spark, d).select("doc_id", T.key_concepts(F.col("content")).alias("concepts"))
    return concepts.chunk_concepts(D.chunks(spark, d), kc).withColumn("concepts", F.array_join("concepts", "; "))


@query(sql(rf"""SELECT concept, doc_id, chunk_id FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{_PHRASE}')) AS concept FROM (SELECT text FROM chunks WHERE chunk_id % 9 = 4)) JOIN chunks ON contains(lower(text), lower(concept))""", "chunks"))
def q_concept_places(spark, d):
    """All phrases of every ninth chunk of a document from the fifth on, looked for in all chunks."""
    chunks = D.chunk_table(spark, d)
    phrases = chunks.where("chunk_id % 9 = 4").select(F.explode(T.phrases(F.col("text"))).alias("concept")).distinct()
    return concepts.concept_places(chunks, phrases)


_SEGMENTS = rf"""seg0 AS (SELECT doc_id, chunk_id, regexp_extract(text, '(?im)^(?:Module|MODULE|Unit|UNIT)\s+(?:\d+|[IVX]+)[:.\s]') AS h, list_slice(regexp_extract_all(text, '{_PHRASE}'), 1, 3) AS p FROM headed),
seg1 AS (SELECT *, sum(CASE WHEN h <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_id) AS n FROM seg0),
seg2 AS (SELECT *, CAST(n + CASE WHEN min(n) OVER (PARTITION BY doc_id) = 0 THEN 1 ELSE 0 END AS INTEGER) AS module_no, n = 0 AS d, chunk_id = min(chunk_id) OVER (PARTITION BY doc_id) AS opening FROM seg1),
seg AS (SELECT doc_id, module_no, min(CASE WHEN d THEN 'General Content' WHEN h <> '' THEN regexp_replace(regexp_replace(h, '[:.]$', ''), '^\s+|\s+$', '', 'g') END) AS title, CASE WHEN bool_or(d) THEN list_prepend(min(chunk_id), list(chunk_id ORDER BY chunk_id)) ELSE list(chunk_id ORDER BY chunk_id) END AS chunk_indices, flatten(list(CASE WHEN h = '' AND NOT opening THEN p ELSE [] END ORDER BY chunk_id)) AS all_topics FROM seg2 GROUP BY doc_id, module_no)"""


def _segments(body: str, *views: str) -> str:
    return sql("", "headed", *views).rstrip() + ",\n" + _SEGMENTS + "\n" + body


@query(_segments("SELECT doc_id, module_no, title, array_to_string(chunk_indices, ',') AS chunk_indices, array_to_string(list_filter(all_topics, lambda t, i: list_position(all_topics, t) = i), '; ') AS topics FROM seg"))
def q_module_segments(spark, d):
    m = modules.module_segments(D.headed_chunks(spark, d))
    return m.select("doc_id", "module_no", "title", F.array_join(F.col("chunk_indices").cast("array<string>"), ",").alias("chunk_indices"), F.array_join("topics", "; ").alias("topics"))


@query(sql("SELECT doc_id, CAST(chunk_id // w + 1 AS INTEGER) AS module_no, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk, count(*) AS n_chunks, 'Module ' || CAST(chunk_id // w + 1 AS INTEGER) AS title FROM (SELECT doc_id, chunk_id, greatest(1, count(*) OVER (PARTITION BY doc_id) // 4) AS w FROM chunks) GROUP BY doc_id, chunk_id // w", "chunks"))
def q_module_groups(spark, d):
    return modules.module_groups(D.chunks(spark, d))


@query(_segments("""SELECT doc_id, module_no, q AS questions, CAST(greatest(1, floor(q * 0.4 + 0.5)) AS INTEGER) AS mcq, CAST(greatest(1, floor(q * 0.3 + 0.5)) AS INTEGER) AS short, CAST(greatest(1, q - floor(q * 0.4 + 0.5) - floor(q * 0.3 + 0.5)) AS INTEGER) AS conceptual FROM (
    SELECT doc_id, module_no, CAST(greatest(1, floor(least(greatest(total, 6), 20) * (len(chunk_indices) / CAST(total AS DOUBLE)) + 0.5)) AS INTEGER) AS q FROM (SELECT *, sum(len(list_distinct(chunk_indices))) OVER (PARTITION BY doc_id) AS total FROM seg))"""))
def q_module_quota(spark, d):
    return modules.module_quota(modules.module_segments(D.headed_chunks(spark, d)))


@query(sql("SELECT doc_id, mcq, short, total - mcq - short AS conceptual FROM (SELECT doc_id, CAST(total AS INTEGER) AS total, CAST(greatest(1, floor(total * 0.4 + 0.5)) AS INTEGER) AS mcq, CAST(greatest(1, floor(total * 0.3 + 0.5)) AS INTEGER) AS short FROM (SELECT doc_id, least(greatest(len(texts), 6), 20) AS total FROM chunk_lists))", "chunk_lists"))
def q_type_quota(spark, d):
    total = modules.question_total(F.size(T.chunk_texts(F.col("content"))))
    mcq, short, rest = modules.type_quota(F.col("total"))
    return D.documents(spark, d).select("doc_id", total.alias("total")).select("doc_id", mcq.alias("mcq"), short.alias("short"), rest.alias("conceptual"))


@query(sql("SELECT doc_id, t AS total, greatest(1, t // 3) AS mcq, greatest(1, t // 3) AS short, t - 2 * greatest(1, t // 3) AS conceptual, greatest(1, t // 4) AS easy, greatest(1, t // 2) AS medium, greatest(1, t // 4) AS hard FROM (SELECT doc_id, CAST(least(greatest(len(texts) // 2, 6), 20) AS INTEGER) AS t FROM chunk_lists)", "chunk_lists"))
def q_library_quota(spark, d):
    total = modules.question_total(F.size(T.chunk_texts(F.col("content"))), halved=True)
    (mcq, short, rest), (easy, medium, hard) = modules.third_quota(F.col("total")), modules.difficulty_quota(F.col("total"))
    return D.documents(spark, d).select("doc_id", total.alias("total")).select("doc_id", "total", mcq.alias("mcq"), short.alias("short"), rest.alias("conceptual"), easy.alias("easy"), medium.alias("medium"), hard.alias("hard"))


_TREE = rf"""tp AS (SELECT s.doc_id, s.module_no, t.chunk_id, t.p, t.i FROM (SELECT doc_id, module_no, unnest(list_distinct(chunk_indices)) AS chunk_id FROM seg) s JOIN (SELECT doc_id, chunk_id, unnest(p) AS p, unnest(range(len(p))) AS i FROM seg2 WHERE h = '' AND NOT opening) t USING (doc_id, chunk_id)),
tf AS (SELECT doc_id, module_no, p AS title, min(chunk_id) AS chunk_id, min((chunk_id, i)) AS k FROM tp GROUP BY ALL),
tn AS (SELECT doc_id, module_no, title, chunk_id, row_number() OVER (PARTITION BY doc_id, module_no ORDER BY k) AS no FROM tf)"""


@query(sql("", "headed").rstrip() + ",\n" + _SEGMENTS + ",\n" + _TREE + "\nSELECT doc_id, module_no, module_no || '.' || no AS id, title, 'Understand ' || title AS objective, chunk_id FROM tn UNION ALL SELECT doc_id, 1, '1.1', 'Core Concepts', 'Understand the main concepts', NULL FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM headed)")
def q_topic_tree(spark, d):
    docs = D.documents(spark, d).select("doc_id", "title")
    tree = modules.topic_tree(D.headed_chunks(spark, d, stored=True), docs)
    rows = tree.select("doc_id", "module_no", F.explode("topics").alias("t"))
    return rows.select("doc_id", "module_no", "t.id", "t.title", F.get("t.learning_objectives", F.lit(0)).alias("objective"), F.get("t.chunk_indices", F.lit(0)).alias("chunk_id"))


@query(sql("", "docs").rstrip() + f",\n{_COVERAGE}\nSELECT doc_id, concept, coverage, CAST(place AS INTEGER) AS place, 0.0::DOUBLE AS by_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coverage DESC, concept) AS place FROM cv) WHERE place <= 3")
def q_coverage_display(spark, d):
    maps = concepts.coverage_map(concepts.concept_coverage(_concept_docs(spark, d), "content"))
    by_id = concepts.covered(F.col("coverage"), F.lit("1.1")).alias("by_id")
    return concepts.most_covered(maps.select("doc_id", "coverage", by_id), 3, keep=["by_id"]).select("doc_id", "concept", "coverage", "place", "by_id")


def _statement_sql(patterns: list[str], longer: int, default: list[str], most: int) -> str:
    found = ", ".join(f"regexp_extract_all(content, '{p}')" for p in patterns)
    clean = f"list_filter(list_transform(flatten([{found}]), lambda s: regexp_replace(regexp_replace(s, '^\\s+|\\s+$', '', 'g'), '\\.+$', '')), lambda s: length(s) > {longer})"
    fallback = ", ".join(f"'{x}'" for x in default)
    return f"SELECT doc_id, array_to_string(list_slice(CASE WHEN len(c) > 0 THEN list_transform(c, lambda s: upper(left(s, 1)) || lower(substr(s, 2))) ELSE [{fallback}] END, 1, {most}), '; ') AS found FROM (SELECT doc_id, {clean} AS c FROM od)"


_OD = "od AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Students will master the basics of ' || left(content, 60) || '. Prior experience with ' || left(content, 40) || '. ' ELSE '' END || content AS content FROM docs)"


def _objective_docs(spark, d):
    docs = D.documents(spark, d)
    lead = F.concat(F.lit("Students will master the basics of "), F.left("content", F.lit(60)), F.lit(". Prior experience with "), F.left("content", F.lit(40)), F.lit(". "))
    return docs.withColumn("content", F.concat(F.when(F.col("doc_id") % 2 == 0, lead).otherwise(F.lit("")), F.col("content")))


@query(sql("", "docs").rstrip() + f",\n{_OD}\n" + _statement_sql(T.OBJECTIVES, 15, T.DEFAULT_OBJECTIVES, 10))
def q_objectives(spark, d):
    return _objective_docs(spark, d).select("doc_id", F.array_join(T.learning_objectives(F.col("content")), "; ").alias("found"))


@query(sql("", "docs").rstrip() + f",\n{_OD}\n" + _statement_sql(T.PREREQUISITES, 10, T.DEFAULT_PREREQUISITES, 6))
def q_prereqs(spark, d):
    return _objective_docs(spark, d).select("doc_id", F.array_join(T.prerequisites(F.col("content")), "; ").alias("found"))


@query(sql("", "docs").rstrip() + f",\n{_CONCEPTS}\nSELECT doc_id, CASE WHEN length(h) > 300 THEN left(h, 300) || '...' ELSE h END || ' This syllabus covers ' || len(concepts) || ' key concepts including ' || array_to_string(list_slice(concepts, 1, 5), ', ') || '.' AS summary FROM (SELECT doc_id, concepts, array_to_string(list_slice(string_split(content, '. '), 1, 3), '. ') AS h FROM kc)")
def q_summary(spark, d):
    docs = _concept_docs(spark, d).select("doc_id", "content", T.key_concepts(F.col("content")).alias("concepts"))
    return docs.select("doc_id", T.summary(F.col("content"), F.col("concepts")).alias("summary"))


# The analysis record

_TREE_SQL = f"""{_COVERAGE},
mw AS (SELECT doc_id, content, concepts, texts, len(texts) AS n, greatest(1, len(texts) // 4) AS w FROM kc JOIN kchunks USING (doc_id)),
mt AS (SELECT doc_id, concepts, w, n, i, (i // w) + 1 AS m, (i % w) + 1 AS j, texts[i + 1] AS t FROM (SELECT *, unnest(range(n)) AS i FROM mw))"""


@query(sql("", "docs").rstrip() + f""",\n{_TREE_SQL}
    SELECT doc_id, 'module_' || m AS module_id, 'Module ' || m AS module_title, 'Content from chunks ' || ((m - 1) * w + 1) || '-' || least(m * w, n) AS module_description, CAST(least(m * w, n) - (m - 1) * w AS INTEGER) AS n_chunks, 1.0::DOUBLE AS weight,
    'module_' || m || '_topic_' || j AS topic_id, 'Topic ' || m || '.' || j AS title, CASE WHEN length(t) > 150 THEN left(t, 150) || '...' ELSE t END AS description, CAST(i AS INTEGER) AS chunk_id,
    array_to_string(list_slice(list_filter(concepts, lambda k: contains(lower(t), lower(k))), 1, 3), '; ') AS concepts FROM mt""")
def q_module_tree(spark, d):
    """The modules and topics of each document's record, read back from its stored form."""
    records = analysis.analysis_records(_concept_docs(spark, d))
    tree = "array<struct<id:string,title:string,description:string,topics:array<struct<id:string,title:string,description:string,chunk_indices:array<int>,concepts:array<string>>>,chunk_indices:array<int>,weight:double>>"
    stored = records.select("doc_id", analysis.as_variant(F.col("analysis")).alias("v"))
    rows = stored.select("doc_id", F.explode(F.variant_get("v", "$.module_structure", tree)).alias("m"))
    rows = rows.select("doc_id", F.col("m.id").alias("module_id"), F.col("m.title").alias("module_title"), F.col("m.description").alias("module_description"), F.size("m.chunk_indices").alias("n_chunks"), "m.weight", F.explode("m.topics").alias("t"))
    return rows.select("doc_id", "module_id", "module_title", "module_description", "n_chunks", "weight", F.col("t.id").alias("topic_id"), "t.title", "t.description", F.get("t.chunk_indices", F.lit(0)).alias("chunk_id"), F.array_join("t.concepts", "; ").alias("concepts"))


@query(sql("", "docs").rstrip() + f""",\n{_TREE_SQL},
cm AS (SELECT doc_id, string_agg(concept || '=' || CAST(coverage AS INTEGER), ';' ORDER BY concept) AS covered FROM cv GROUP BY doc_id),
q AS (SELECT *, CAST(least(greatest(n // 2, 6), 20) AS INTEGER) AS total, CASE WHEN length(h) > 300 THEN left(h, 300) || '...' ELSE h END AS head FROM (SELECT *, array_to_string(list_slice(string_split(content, '. '), 1, 3), '. ') AS h FROM mw))
SELECT doc_id, 'doc-' || doc_id AS title, head || ' This syllabus covers ' || len(concepts) || ' key concepts including ' || array_to_string(list_slice(concepts, 1, 5), ', ') || '.' AS summary, CAST(least(len(concepts), 15) AS INTEGER) AS n_concepts, CAST(ceil(n / CAST(w AS DOUBLE)) AS INTEGER) AS n_modules, coalesce(covered, '') AS covered,
total // 3 AS mcq, total - 2 * (total // 3) AS conceptual, total, 'Based on ' || n || ' content chunks covering ' || len(concepts) || ' key concepts' AS rationale, total // 4 AS easy, total // 2 AS medium FROM q LEFT JOIN cm USING (doc_id)""")
def q_analysis_record(spark, d):
    """Fields of each document's record, read by path from its stored form."""
    v = analysis.analysis_records(_concept_docs(spark, d)).select("doc_id", analysis.as_variant(F.col("analysis")).alias("v"))
    at = lambda path, kind: F.variant_get("v", f"$.{path}", kind)
    entries = F.array_sort(F.map_entries(at("concept_coverage", "map<string,int>")))
    return v.select(
        "doc_id",
        at("document_title", "string").alias("title"),
        at("summary", "string").alias("summary"),
        F.size(at("key_concepts", "array<string>")).alias("n_concepts"),
        F.size(at("module_structure", "array<variant>")).alias("n_modules"),
        F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("covered"),
        *[at(f"suggested_distribution.{x}", k).alias(x) for x, k in (("mcq", "int"), ("conceptual", "int"), ("total", "int"), ("rationale", "string"))],
        *[at(f"difficulty_distribution.{x}", "int").alias(x) for x in ("easy", "medium")],
    )


_ANALYSED = "CASE WHEN doc_id % 3 = 0 THEN 'model' ELSE 'rules' END"


@query(sql("", "docs").rstrip() + f""",\n{_TREE_SQL},
a AS (SELECT doc_id, {_ANALYSED} AS made_by, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE ceil(n / CAST(w AS DOUBLE)) END AS INTEGER) AS n_modules, CASE WHEN doc_id % 3 = 0 THEN left(lang, 2) WHEN n > 0 THEN 'Module 1' END AS first_title FROM mw JOIN docs USING (doc_id)),
src AS (SELECT doc_id AS document_id, max(pick) AS pick FROM (SELECT doc_id, doc_id AS pick FROM docs WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id + 1, doc_id FROM docs WHERE doc_id % 2 = 0) GROUP BY doc_id)
SELECT docs.doc_id, made_by, n_modules, first_title FROM docs LEFT JOIN src ON src.document_id = docs.doc_id LEFT JOIN a ON a.doc_id = src.pick""")
def q_analysis_flow(spark, d):
    """Analyses of every second document, by a model's reply where it holds one, stored on it and the next document.

    Of the replies a third hold modules, a third are broken and the others are missing.
    """
    docs = _concept_docs(spark, d)
    said = F.concat(F.lit('So:\n```json\n{"modules": [{"title": "'), F.left("lang", F.lit(2)), F.lit('"}, {"title": "b"}]}\n``` done'))
    replies = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, said).when(F.col("doc_id") % 3 == 1, F.lit('{"modules": "none"')).alias("reply"))
    made = analysis.by_model_or_rules(replies, analysis.analysis_records(docs), "doc_id", "reply").withColumnRenamed("doc_id", "analysis_id")
    picks = docs.select("doc_id").where("doc_id % 2 = 0")
    sources = picks.select(F.col("doc_id").alias("analysis_id"), F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 1)).alias("document_id"))
    none = F.lit(None).cast("variant")
    bare = docs.select(F.col("doc_id").alias("id"), none.alias("syllabus_analysis"), none.alias("module_structure"))
    done = analysis.on_sources(bare, made, sources)
    found = done.join(sources.groupBy(F.col("document_id").alias("id")).agg(F.max("analysis_id").alias("analysis_id")), "id", "left").join(made.select("analysis_id", "made_by"), "analysis_id", "left")
    modules_of = F.try_variant_get("module_structure", "$", "array<variant>")
    return found.select(F.col("id").alias("doc_id"), "made_by", F.when(modules_of.isNotNull(), F.size(modules_of)).alias("n_modules"), F.try_variant_get("module_structure", "$[0].title", "string").alias("first_title"))


# Question sets

_SELECTED = """w AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE (doc_id % 10) / 10.0::DOUBLE END AS weight FROM docs),
pool AS (SELECT c.*, CASE WHEN coalesce(w.weight, 0) = 0 THEN 1.0::DOUBLE / (SELECT count(*) FROM docs) ELSE w.weight END AS weight FROM chunks c JOIN w USING (doc_id)),
sel AS (SELECT *, CAST(row_number() OVER (ORDER BY weight DESC, doc_id, chunk_id) - 1 AS INTEGER) AS place FROM pool QUALIFY place < 12)"""


def _selected(spark, d):
    """The heaviest chunks of all documents under a teacher's weights, some of them unset."""
    docs = D.documents(spark, d)
    weights = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, 0.0).otherwise((F.col("doc_id") % 10) / F.lit(10.0)).alias("weight"))
    return Q.weighted_selection(Q.pooled(D.chunks(spark, d), weights, docs.count()), 6)


def _selection(body: str) -> str:
    return sql("", "chunks").rstrip() + ",\n" + _SELECTED + "\n" + body


@query(_selection("SELECT doc_id, chunk_id, round(weight, 6) AS weight, place FROM sel"))
def q_weighted_select(spark, d):
    return _selected(spark, d).select("doc_id", "chunk_id", F.round("weight", 6).alias("weight"), "place")


@query(sql("SELECT doc_id, chunk_id, CAST(row_number() OVER (ORDER BY draw, doc_id, chunk_id) - 1 AS INTEGER) AS place FROM (SELECT doc_id, chunk_id, -ln((('0x' || substr(md5('7:' || doc_id || ':' || chunk_id), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656.0::DOUBLE) / grounding_score AS draw FROM chunks) QUALIFY place < 40", "chunks"))
def q_weighted_sample(spark, d):
    """Forty chunks drawn by their grounding scores."""
    return Q.weighted_sample(D.chunks(spark, d), "grounding_score", ["doc_id", "chunk_id"], 40, seed=7).select("doc_id", "chunk_id", "place")


@query(sql("SELECT doc_id, round(greatest(0.1, least(1.0, v)) / sum(greatest(0.1, least(1.0, v))) OVER (), 9) AS share FROM (SELECT doc_id, (doc_id % 13) / 10.0::DOUBLE AS v FROM docs)", "docs"))
def q_weight_shares(spark, d):
    w = D.documents(spark, d).select("doc_id", ((F.col("doc_id") % 13) / F.lit(10.0)).alias("weight"))
    return Q.normalised_weights(w).select("doc_id", F.round("share", 9).alias("share"))


@query(_segments("SELECT h.doc_id, h.chunk_id FROM headed h WHERE (h.doc_id, h.chunk_id) IN (SELECT doc_id, unnest(chunk_indices) FROM seg WHERE module_no = 2)"))
def q_module_filter(spark, d):
    headed = D.headed_chunks(spark, d, stored=True)
    m = modules.module_segments(headed)
    return Q.in_modules(headed, m, F.col("module_no") == 2).select("doc_id", "chunk_id")


@query(sql("SELECT doc_id, chunk_id FROM chunks", "chunks"))
def q_module_filter_fallback(spark, d):
    headed = D.headed_chunks(spark, d, stored=True)
    m = modules.module_segments(headed)
    return Q.in_modules(headed, m, F.col("module_no") == -1).select("doc_id", "chunk_id")


def _template_sql() -> str:
    import re

    def filled(pattern: str) -> str:
        parts = re.split(r"\{(\d+)\}", pattern)
        return " || ".join(f"left(txt, {p})" if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if i % 2 or p)

    def pick(make) -> str:
        cases = " ".join(f"WHEN t = '{t}' AND k = {k} THEN {make(x)}" for t in Q.TYPES for k, x in enumerate(Q.TEMPLATES[t]))
        return f"CASE {cases} END"

    slots = ", ".join(f"({i}, '{t}', {k})" for i, (t, k) in enumerate((t, k) for t in Q.TYPES for k in range(6)))
    clean = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"  # the prose holds no blocks to be cleaned away
    return f"""cl AS (SELECT place, {clean} AS text FROM sel),
    con AS (SELECT list_slice(list_filter(l, lambda c, i: list_position(l, c) = i), 1, 20) AS cs FROM (SELECT flatten(list(list_slice(regexp_extract_all(text, '{_PHRASE}'), 1, 3) ORDER BY place)) AS l FROM cl)),
    slots(i, t, k) AS (VALUES {slots}),
    q AS (SELECT i, t, k, cl.text AS txt, cs[i % len(cs) + 1] AS tag FROM slots JOIN cl ON cl.place = i % (SELECT count(*) FROM cl) CROSS JOIN con)
    SELECT CAST(i AS INTEGER) AS question_no, t AS question_type, {pick(lambda x: filled(x[2]))} AS question_text, {pick(lambda x: filled(x[3]))} AS correct_answer, tag AS concept_tag, {pick(lambda x: f"'{x[0]}'")} AS difficulty, CAST({pick(lambda x: str(x[1]))} AS INTEGER) AS points, txt AS grounding_chunk FROM q"""


@query(_selection("").rstrip() + ",\n" + _template_sql())
def q_generate_local(spark, d):
    made = Q.template_questions(_selected(spark, d), {t: 6 for t in Q.TYPES})
    return made.select("question_no", "question_type", "question_text", "correct_answer", "concept_tag", "difficulty", "points", "grounding_chunk")


@query(_selection("SELECT item_id, CASE WHEN contains((SELECT string_agg(text, ' ' ORDER BY place) FROM sel), left(cite, 40)) THEN cite ELSE (SELECT left(text, 220) FROM sel WHERE place = 0) END AS grounding_chunk FROM (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN text ELSE (SELECT substr(text, 5, 90) FROM sel WHERE place = 3) END AS cite FROM benchmark)"))
def q_grounding_guard(spark, d):
    selected = _selected(spark, d)
    third = selected.where("place = 3").select(F.substring("text", 5, 90).alias("_c"), F.lit(1).alias("_k"))
    cited = D.table(spark, d, "benchmark").withColumn("_k", F.lit(1)).join(third, "_k")
    cited = cited.select("item_id", F.when(F.col("item_id") % 2 == 0, F.col("text")).otherwise(F.col("_c")).alias("grounding_chunk"))
    return Q.grounded(cited, selected)


@query(_selection("").rstrip() + ",\nlocal AS (" + _template_sql().replace("cl AS (", "WITH cl AS (", 1) + ")\n" + """SELECT s.id, question_no, question_text, question_type, points, made_by, grounding_chunk FROM (
    SELECT id, CAST(i - 1 AS INTEGER) AS question_no, 'Q' || i || ' ' || id AS question_text, 'short' AS question_type, CAST(i AS INTEGER) AS points, 'model' AS made_by, (SELECT left(text, 220) FROM sel WHERE place = 0) AS grounding_chunk FROM question_sets, (SELECT unnest(range(1, 19)) AS i) WHERE id % 3 = 0
    UNION ALL SELECT id, question_no, question_text, question_type, points, 'rules', grounding_chunk FROM question_sets CROSS JOIN local WHERE id % 3 <> 0) s""".replace("question_sets", "(SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS BIGINT) AS id FROM part)"))
def q_generate_flow(spark, d):
    """Sets of questions, of which a third have a whole reply of a model, a third a broken one and the others none."""
    sets = D.question_sets(spark, d).select("id")
    one = lambda i: F.concat(F.lit(f'{{"question": "Q{i} '), F.col("id").cast("string"), F.lit(f'", "points": "{i}", "answer": "A{i}"}}'))
    whole = F.concat(F.lit("Here:\n```json\n["), F.array_join(F.array(*[one(i) for i in range(1, 21)]), ", "), F.lit("]\n```"))
    replies = sets.withColumn("raw", F.when(F.col("id") % 3 == 0, whole).when(F.col("id") % 3 == 1, F.concat(F.lit("["), one(1), F.lit(", {"))))
    made = Q.generated(replies, "raw", _selected(spark, d), {t: 6 for t in Q.TYPES}, ["id"])
    return made.select("id", "question_no", "question_text", "question_type", "points", "made_by", "grounding_chunk")


@query(sql("SELECT doc_id, coalesce(string_agg('[Chunk ' || (chunk_id + 1) || ' | Doc: ' || chunks.title || ' | p' || page || ']: ' || left(chunks.text, 500), chr(10) || chr(10) ORDER BY chunk_id), '') AS chunks, left(any_value(content), 8000) AS preview FROM docs LEFT JOIN chunks USING (doc_id) GROUP BY doc_id", "docs", "chunks"))
def q_analysis_prompt(spark, d):
    return Q.analysis_data(D.chunks(spark, d), D.documents(spark, d)).select("doc_id", "chunks", "preview")


@query(sql(f"SELECT conv_id, turn, left(correct_answer || correct_answer, 500) AS grounding_chunk, left(correct_answer, 500) AS correct_answer, left(student_answer || ' ' || student_answer, 900) AS student_answer, left(regexp_replace(regexp_replace(left(correct_answer || correct_answer, 500) || ' ' || left(correct_answer, 500) || ' ' || left(student_answer || ' ' || student_answer, 900), '^{D._S}+|{D._S}+$', '', 'g'), '{D._S}+', ' ', 'g'), 1600) AS compact FROM free_answers", "free_answers"))
def q_evaluation_prompt(spark, d):
    a = D.free_answers(spark, d).withColumns({"grounding_chunk": F.concat("correct_answer", "correct_answer"), "student_answer": F.concat_ws(" ", "student_answer", "student_answer")})
    return Q.evaluation_data(a).select("conv_id", "turn", *Q.CUTS, "compact")


@query(_selection("SELECT (SELECT string_agg('[Chunk ' || (place + 1) || ' | Doc: ' || title || ' | p' || page || ']: ' || text, chr(10) || chr(10) ORDER BY place) FROM sel WHERE place < 8) AS context, left((SELECT string_agg(text, ' ' ORDER BY place) FROM sel), 6000) AS preview"))
def q_generation_prompt(spark, d):
    """What a request of three questions shows of the selection: eight chunks."""
    selected = D.written(_selected(spark, d), "selected")  # twelve rows, used twice
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), " ")
    content = selected.agg(whole.alias("content")).first()["content"] or ""  # the texts of twelve chunks
    return Q.generation_data(selected, F.lit(content), 3)


@query(sql("SELECT doc_id, chunk_id, CAST(row_number() OVER (ORDER BY md5('s:' || doc_id || ':' || chunk_id), doc_id, chunk_id) - 1 AS INTEGER) AS place FROM chunks QUALIFY place < 15", "chunks"))
def q_focus_sample(spark, d):
    return Q.focus_sample(D.chunks(spark, d), 15, "s").select("doc_id", "chunk_id", "place")


@query(_segments(f"SELECT concept, array_to_string((SELECT list(title ORDER BY module_no) FROM seg WHERE doc_id = (SELECT min(doc_id) FROM seg)), '; ') AS modules FROM (SELECT p AS concept, count(*) AS n, min((doc_id, chunk_id, i)) AS first FROM (SELECT doc_id, chunk_id, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM (SELECT doc_id, chunk_id, regexp_extract_all(text, '{_PHRASE}') AS ps FROM chunks)) GROUP BY p) ORDER BY n DESC, first LIMIT 20", "chunks"))
def q_concept_modules(spark, d):
    """The most frequent phrases of all chunks, each with the modules of the first document, as an analysis lists them."""
    m = modules.module_segments(D.headed_chunks(spark, d, stored=True))
    first = m.join(m.agg(F.min("doc_id").alias("doc_id")), "doc_id")
    found = concepts.concepts_with_modules(concepts.top_concepts(D.chunk_table(spark, d)), first.select("module_no", "title"))
    return found.select("concept", F.array_join("modules", "; ").alias("modules"))


@query(_segments("SELECT DISTINCT doc_id, chunk_id FROM (SELECT doc_id, unnest(chunk_indices) AS chunk_id FROM seg WHERE module_no = 1 UNION ALL SELECT doc_id, chunk_id FROM seg0 WHERE h = '' AND (doc_id, chunk_id) IN (SELECT doc_id, chunk_id FROM seg2 WHERE module_no = 1))"))
def q_index_union(spark, d):
    """The chunks that the first modules or their topics list, each once."""
    headed = D.headed_chunks(spark, d, stored=True)
    return Q.in_modules(headed, modules.topic_tree(headed), F.col("module_no") == 1).select("doc_id", "chunk_id")


@query(sql("SELECT id, set_id FROM questions WHERE set_id % 5 <> 0 AND id % 4 <> 0", "questions"))
def q_delete_rows(spark, d):
    """Questions after every fifth set and every fourth question by id went."""
    q = D.questions(spark, d)
    left = crud.deleted(q, D.question_sets(spark, d).where("id % 5 = 0"), "set_id", "id")
    return crud.deleted(left, q.where("id % 4 = 0"), "id").select("id", "set_id")


@query(sql("SELECT id, set_id FROM questions WHERE set_id = 13 AND difficulty IN ('Easy', 'Hard')", "questions"))
def q_row_filters(spark, d):
    """An equality that is asked, one that is not, and a membership."""
    return crud.filtered(D.questions(spark, d), {"set_id": 13, "concept_tag": ""}, {"difficulty": ["Easy", "Hard"]}).select("id", "set_id")


# Model replies and options


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS n FROM events""")
def q_json_recover(spark, d):
    e = D.table(spark, d, "events")
    fenced = F.concat(F.lit("Here you are:\n```json\n["), F.when(F.col("event_id") % 3 != 0, F.col("props")).otherwise(F.lit("")), F.lit("]\n```\nbye"))
    wrapped = F.concat(F.lit("noise "), F.col("props"), F.lit(" tail"))
    item = F.from_json(T.json_array(fenced), "array<struct<k:int>>")
    return e.select("event_id", F.get_json_object(T.json_object(wrapped), "$.k").cast("int").alias("k"), F.size(item).alias("n"))


@query(
    """SELECT id, question_no, CASE question_no WHEN 0 THEN name WHEN 1 THEN brand WHEN 2 THEN 'Untitled' ELSE 'q3' END AS question_text, CASE question_no WHEN 0 THEN 'mcq' ELSE 'short' END AS question_type,
    CASE question_no WHEN 0 THEN 'false' WHEN 1 THEN '0' WHEN 2 THEN type ELSE '' END AS correct_answer, CASE question_no WHEN 0 THEN brand ELSE 'General' END AS concept_tag,
    CASE question_no WHEN 0 THEN 'Hard' WHEN 1 THEN 'Easy' ELSE 'Medium' END AS difficulty, CASE question_no WHEN 0 THEN 15 WHEN 1 THEN 5 WHEN 2 THEN 7 ELSE CAST(id % 50 + 2 AS INTEGER) END AS points,
    CASE question_no WHEN 0 THEN '["' || type || '","' || brand || '"]' WHEN 1 THEN '{"a":"' || brand || '"}' END AS options,
    CASE question_no WHEN 0 THEN left(type, 30) ELSE 'The first chunk of the selection.' END AS grounding_chunk
    FROM (SELECT p_partkey AS id, p_name AS name, p_brand AS brand, p_type AS type FROM part WHERE p_partkey % 3 <> 0) CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS question_no)
    WHERE question_no <> 0 OR contains('The first chunk of the selection. ' || (SELECT string_agg(p_type, ' ') FROM (SELECT DISTINCT p_type FROM part)), left(left(type, 30), 40))"""
)
def q_reply_defaults(spark, d):
    """Replies of five questions, of which four are asked for; a third of the replies hold too few."""
    p = D.table(spark, d, "part")
    field = lambda **kw: F.struct(*[c.alias(n) for n, c in kw.items()])
    none, lit = F.lit(None).cast("string"), F.lit
    of = lambda qt=none, q=none, t=none, ca=none, a=none, ct=none, c=none, df=none, g=none, pt=none, op=none: field(question_text=qt, question=q, question_type=t, correct_answer=ca, answer=a, concept_tag=ct, concept=c, difficulty=df, grounding_chunk=g, points=pt, options=op)
    asked = F.array(
        of(qt=F.col("p_name"), t=lit("MCQ"), ca=lit("false"), c=F.col("p_brand"), df=lit("Hard"), g=F.left("p_type", lit(30)), op=lit("@array")),
        of(q=F.col("p_brand"), qt=lit(""), a=lit("0"), df=lit("Easy"), g=lit("made up, in no chunk of the selection at all"), op=lit("@object")),
        of(ca=lit(""), a=F.col("p_type"), pt=lit("7")),
        of(qt=lit("q3"), t=lit(""), pt=lit("@decimal")),
        of(qt=lit("one too many")),
    )
    kept = F.when(F.col("p_partkey") % 3 == 0, F.slice(asked, 1, 3)).otherwise(asked)
    said = F.to_json(kept)
    for mark, value in (("@array", F.to_json(F.array("p_type", "p_brand"))), ("@object", F.concat(lit('{"a":"'), "p_brand", lit('"}'))), ("@decimal", F.concat((F.col("p_partkey") % 50 + 2).cast("string"), lit(".0")))):
        said = F.replace(said, lit(f'"{mark}"'), value)
    replies = p.select(F.col("p_partkey").alias("id"), F.concat(lit("Sure:\n```json\n"), said, lit("\n```")).alias("raw"))
    texts = p.select(F.col("p_type").alias("text")).distinct().withColumn("place", F.lit(1))
    selected = spark.createDataFrame([("The first chunk of the selection.", 0)], "text string, place int").unionByName(texts)
    made = Q.normalised_replies(replies, "raw", total=4, selected=selected)
    return made.select("id", "question_no", "question_text", "question_type", "correct_answer", "concept_tag", "difficulty", "points", "options", "grounding_chunk")


@query("SELECT item_id AS id, 'https://api.dicebear.com/7.x/initials/svg?seed=' || url_encode(CASE WHEN item_id % 2 = 0 THEN left(text, 20) ELSE 'a.b@c.edu' END) AS avatar, 'a.b' AS name FROM benchmark WHERE text IS NOT NULL")
def q_avatar(spark, d):
    b = D.table(spark, d, "benchmark").where("text is not null")
    email = F.lit("a.b@c.edu")
    name = F.when(F.col("item_id") % 2 == 0, F.left("text", F.lit(20))).otherwise("")
    return b.select(F.col("item_id").alias("id"), T.avatar_url(name, email).alias("avatar"), T.email_name(email).alias("name"))


@query("SELECT p_partkey AS id, p_partkey % 3 <> 0 AS incomplete, array_to_string(CASE WHEN p_size % 2 = 0 THEN ['m1', 'm3'] ELSE ['m1', 'm2', 'm3', 'm4'] END, ',') AS chosen, CAST(length(p_name) + length(p_type) AS INTEGER) AS n_text FROM part")
def q_attempt_form(spark, d):
    """The form of an attempt: answers left blank, a selection with one item switched, the length of all parts."""
    p = D.table(spark, d, "part")
    k = F.col("p_partkey") % 3
    answers = F.array("p_name", F.when(k == 0, F.col("p_type")).when(k == 1, F.lit(" \t\n")), F.lit("x"))
    item = F.when(F.col("p_size") % 2 == 0, "m2").otherwise("m4")
    return p.select(F.col("p_partkey").alias("id"), T.incomplete(answers).alias("incomplete"), F.array_join(T.toggled(F.array(*map(F.lit, ["m1", "m2", "m3"])), item), ",").alias("chosen"), T.text_total(F.array("p_name", F.lit(None).cast("string"), F.col("p_type"))).alias("n_text"))


@query("SELECT p_partkey AS id, CAST(CASE p_partkey % 4 WHEN 0 THEN 2 ELSE 0 END AS INTEGER) AS n_options FROM part")
def q_options_parse(spark, d):
    p = D.table(spark, d, "part")
    k = F.col("p_partkey") % 4
    stored = F.when(k == 0, F.to_json(F.array("p_type", "p_brand"))).when(k == 1, F.lit("x")).when(k == 2, F.lit(None)).otherwise(F.lit('{"a":1}'))
    return p.select(F.col("p_partkey").alias("id"), F.size(T.parsed_options(stored)).alias("n_options"))


# Materials


def _material_rows(spark, d):
    p = D.table(spark, d, "pages")
    kinds = F.array(*map(F.lit, ["syllabus", "notes", "slides"]))
    name = F.concat(F.lit("page."), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".HTML").otherwise(".txt"))
    return p.select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.when(F.col("page_id") % 3 == 0, F.lit("Lecture Notes")).alias("description"), name.alias("file_name"), F.get(kinds, (F.col("page_id") % 3).cast("int")).alias("category"), F.col("html"))


_MATERIALS = "m AS (SELECT page_id AS id, url AS title, CASE WHEN page_id % 3 = 0 THEN 'Lecture Notes' END AS description, 'page.' || page_id || CASE WHEN page_id % 2 = 0 THEN '.HTML' ELSE '.txt' END AS file_name, ['syllabus', 'notes', 'slides'][page_id % 3 + 1] AS category, html FROM pages)"


@query(f"WITH {_MATERIALS} SELECT id, title FROM m WHERE category = 'syllabus' AND (contains(lower(title), 'lecture') OR contains(lower(coalesce(description, '')), 'lecture'))")
def q_material_search(spark, d):
    return materials.searched(_material_rows(spark, d), "syllabus", "Lecture").select("id", "title")


@query(f"WITH {_MATERIALS} SELECT c.category, coalesce(n, 0) AS n FROM (VALUES ('syllabus'), ('notes'), ('slides'), ('reference')) c(category) LEFT JOIN (SELECT category, count(*) AS n FROM m GROUP BY category) x ON x.category = c.category")
def q_category_counts(spark, d):
    return reports.category_counts(_material_rows(spark, d))


@query(f"WITH {_MATERIALS} SELECT id, regexp_replace(file_name, '\\.[^/.]+$', '') AS title, lower(list_extract(string_split(file_name, '.'), -1)) AS file_type, CAST(strlen(html) AS BIGINT) AS file_size, md5(base64(encode(html))) AS data_md5, CASE WHEN strlen(html) < 1024 THEN strlen(html) || ' B' ELSE printf('%.1f KB', floor(strlen(html) / 102.4::DOUBLE + 0.5) / 10) END AS shown FROM m WHERE strlen(html) > 0")
def q_store_material(spark, d):
    m = materials.stored(_material_rows(spark, d).where(F.octet_length("html") > 0).drop("title"), F.col("file_name"), F.encode("html", "UTF-8"))
    data = F.regexp_replace("file_data", r"\s", "")
    return m.select("id", "title", "file_type", "file_size", F.md5(data).alias("data_md5"), T.human_size(F.col("file_size")).alias("shown"))


@query("SELECT doc_id, doc_id % 6 = 0 AND doc_id IN (SELECT page_id FROM pages) AS is_shared FROM documents")
def q_shared_flag(spark, d):
    docs = D.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("page."), F.col("doc_id").cast("string"), F.lit(".HTML"))).alias("original_name"))
    return materials.shared_flag(docs, _material_rows(spark, d)).select("doc_id", "is_shared")


@query(sql("SELECT id, email FROM students WHERE lower(email) IN (SELECT lower(upper(email)) FROM students WHERE id % 10 = 0)", "students"))
def q_email_lookup(spark, d):
    s = D.students(spark, d)
    return materials.by_email(s, s.where("id % 10 = 0").select(F.upper("email").alias("email"))).select("id", "email")


@query(sql("SELECT set_id, document_id FROM (SELECT id AS set_id, id * 3 AS document_id FROM question_sets UNION SELECT set_id, arg_min(id % 500, id) AS document_id FROM questions GROUP BY set_id) WHERE document_id IN (SELECT doc_id FROM docs)", "question_sets", "docs"))
def q_or_join(spark, d):
    docs = D.documents(spark, d).select(F.col("doc_id").alias("id"))
    sets = D.question_sets(spark, d).select("id", (F.col("id") * 3).alias("document_id"))
    q = D.questions(spark, d).select("id", "set_id", (F.col("id") % 500).alias("document_id"))
    return materials.attempt_documents(docs, sets, q)


@query(sql("SELECT l.o_orderkey AS id, coalesce(a.name, b.name) AS name FROM orders l LEFT JOIN students a ON a.id = CASE WHEN l.o_orderkey % 2 = 0 THEN l.o_custkey END LEFT JOIN students b ON b.email = 'customer#' || lpad(CAST(l.o_custkey AS VARCHAR), 9, '0') || '@example.edu'", "students"))
def q_profile_lookup(spark, d):
    o = D.table(spark, d, "orders")
    email = F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("@example.edu"))
    keys = o.select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("id_key"), email.alias("other_key"))
    return materials.by_either(D.students(spark, d), keys, "id", "email").select(F.col("order_id").alias("id"), F.col("found.name").alias("name"))


@query(sql("SELECT s.id, s.status, st.name AS student_name, st.email AS student_email, d.title AS document_title FROM (SELECT *, id % 700 AS document_id FROM submissions) s LEFT JOIN (SELECT * FROM students WHERE id % 3 <> 0) st ON s.student_id = st.id LEFT JOIN docs d ON s.document_id = d.doc_id WHERE s.set_id = 4", "submissions", "students", "docs"))
def q_submission_list(spark, d):
    subs = D.submissions(spark, d).withColumn("document_id", F.col("id") % 700)
    docs = D.documents(spark, d).select(F.col("doc_id").alias("id"), "title")
    out = reports.submission_list(subs, D.students(spark, d).where("id % 3 <> 0"), docs)
    return reports.filtered_by(reports.filtered_by(out, "set_id", "4"), "status", "All").select("id", "status", "student_name", "student_email", "document_title")


@query(sql("SELECT s.id, d.title AS document_title FROM (SELECT id, id * 9 AS document_id FROM question_sets) s LEFT JOIN docs d ON d.doc_id = s.document_id", "question_sets", "docs"))
def q_set_list(spark, d):
    sets = D.question_sets(spark, d).withColumn("document_id", F.col("id") * 9)
    return reports.set_list(sets, D.documents(spark, d).select(F.col("doc_id").alias("id"), "title")).select("id", "document_title")


@query(sql("SELECT set_id, question_text, CASE WHEN set_id % 2 = 0 THEN 'model' ELSE 'rules' END AS made_by FROM questions", "questions"))
def q_model_or_rules(spark, d):
    """A model made the questions of every second set; the rules fill in the others."""
    local = D.questions(spark, d).select("set_id", "question_text", F.lit("rules").alias("made_by"))
    made = local.where("set_id % 2 = 0").withColumn("made_by", F.lit("model"))
    return Q.with_fallback(made, local, ["set_id"])


@query(sql("SELECT * FROM (SELECT id, due_date, CAST(row_number() OVER (ORDER BY due_date DESC NULLS FIRST, id) AS INTEGER) AS place FROM question_sets) WHERE place <= 10", "question_sets"))
def q_newest_first(spark, d):
    rows = reports.listed(D.question_sets(spark, d), "due_date", descending=True, limit=10, ties=["id"])
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_first("due_date"), "id")
    return rows.select("id", "due_date", F.row_number().over(order).alias("place"))


@query(sql("SELECT doc_id // 3 AS pick, string_agg(title, ', ' ORDER BY doc_id) AS sources, string_agg(title, ' + ' ORDER BY doc_id) AS title, coalesce(string_agg(content, chr(10) || chr(10) ORDER BY doc_id) FILTER (content <> ''), '') AS content, CAST(sum(len(texts)) AS BIGINT) AS n_chunks FROM docs JOIN chunk_lists c USING (doc_id, title) GROUP BY doc_id // 3", "docs", "chunk_lists"))
def q_selection_totals(spark, d):
    docs = D.documents(spark, d).withColumn("pick", F.floor(F.col("doc_id") / 3))
    return reports.selection_totals(docs, F.size(T.chunk_texts(F.col("content"))), ["pick"], "doc_id")


@query(_selection("SELECT string_agg('[Chunk ' || (place + 1) || ' | Doc: ' || title || ' | p' || page || ']: ' || text, chr(10) || chr(10) ORDER BY place) AS prompt FROM sel"))
def q_chunk_prompt(spark, d):
    return Q.chunk_prompt(_selected(spark, d))


@query(sql("SELECT string_agg(left(question_text, 80), chr(10) || '- ' ORDER BY id) AS existing, (SELECT string_agg(concept_tag, ', ' ORDER BY i) FROM (SELECT concept_tag, min(id) AS i FROM (SELECT * FROM questions ORDER BY id LIMIT 100) GROUP BY concept_tag)) AS tags FROM (SELECT * FROM questions ORDER BY id LIMIT 100)", "questions"))
def q_existing_prompt(spark, d):
    return Q.existing_prompt(D.questions(spark, d))


# Inserts, updates, deletes


@query(sql("SELECT id, name, email FROM students WHERE id % 2 = 0 UNION ALL SELECT id + 100000, upper(name), email FROM students WHERE id % 3 = 0 AND id % 2 <> 0", "students"))
def q_insert_if_absent(spark, d):
    s = D.students(spark, d).select("id", "name", "email")
    new = s.where("id % 3 = 0").select((F.col("id") + 100000).alias("id"), F.upper("name").alias("name"), "email")
    return crud.inserted_if_absent(s.where("id % 2 = 0"), new, "email")


@query(sql("SELECT 'submissions' AS t, count(*) AS n FROM submissions WHERE student_id % 7 <> 0 UNION ALL SELECT 'answers', count(*) FROM answers WHERE submission_id NOT IN (SELECT id FROM submissions WHERE student_id % 7 = 0) UNION ALL SELECT 'students', count(*) FROM students WHERE id % 7 <> 0", "students", "submissions", "answers"))
def q_cascade_delete(spark, d):
    numbered = D.answers(spark, d).withColumn("id", F.monotonically_increasing_id())
    left = crud.cascaded({"students": D.students(spark, d), "submissions": D.submissions(spark, d), "answers": numbered}, "students", D.students(spark, d).where("id % 7 = 0"))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("t"), "n") for t, df in left.items()]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


@query("SELECT l_orderkey AS submission_id, 'submitted' AS status, o_custkey AS student_id, l_partkey AS question_id, l_returnflag AS student_answer, FALSE AS is_correct, 0 AS score, CASE l_linenumber % 3 WHEN 0 THEN 10 ELSE l_linenumber % 3 END AS max_score FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT o_orderkey, 'submitted', o_custkey, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_submit(spark, d):
    """Payloads of answers, one an order, taken apart into submissions and answers and met again."""
    line = D.table(spark, d, "lineitem")
    answer = F.struct(F.col("l_partkey").alias("question_id"), F.col("l_returnflag").alias("student_answer"), (F.col("l_linenumber") % 3).alias("max_score"))
    given = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(answer).alias("answers"))
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student_id"), F.lit(1).alias("set_id"), F.lit(1).alias("document_id"))
    subs, answers = crud.submitted(o.join(given, "id", "left"))
    met = subs.select(F.col("id").alias("submission_id"), "status", "student_id").join(answers, "submission_id", "left")
    return met.select("submission_id", "status", "student_id", "question_id", "student_answer", "is_correct", F.col("score").cast("int").alias("score"), "max_score")


@query(sql("SELECT s.id AS set_id, s.document_id, n AS total_questions, q.id AS question_id, q.question_text, q.points FROM (SELECT set_id AS id, set_id * 3 AS document_id, CAST(count(*) AS INTEGER) AS n FROM questions GROUP BY set_id) s JOIN questions q ON q.set_id = s.id", "questions"))
def q_create_set(spark, d):
    q = D.questions(spark, d)
    payload = q.groupBy("set_id").agg(F.collect_list(F.struct(F.col("id").alias("question_id"), "question_text", "points")).alias("questions"))
    none = F.lit(None).cast("string")
    payload = payload.select(F.col("set_id").alias("id"), (F.col("set_id") * 3).alias("document_id"), none.alias("question_types"), none.alias("module_filter"), none.alias("document_weights"), "questions")
    sets, rows = crud.question_set(payload)
    return sets.select(F.col("id").alias("set_id"), "total_questions").join(rows, "set_id").select("set_id", "document_id", "total_questions", "question_id", "question_text", "points")


@query(sql(f"SELECT id, id % 3 = 0 AS is_published, CASE WHEN id % 3 = 0 THEN DATE '{NOW}' END AS published_at FROM question_sets", "question_sets"))
def q_publish(spark, d):
    return crud.published(D.question_sets(spark, d), F.col("id") % 3 == 0, F.to_date(F.lit(NOW))).select("id", "is_published", "published_at")


@query(sql("SELECT id, CASE id % 3 WHEN 0 THEN due_date WHEN 1 THEN NULL ELSE CAST(DATE '2024-06-01' AS DATE) END AS due_date, CAST(CASE id % 2 WHEN 0 THEN NULL ELSE 45 END AS INTEGER) AS time_limit_minutes FROM question_sets", "question_sets"))
def q_sparse_patch(spark, d):
    s = D.question_sets(spark, d).select("id", "due_date", F.lit(45).alias("time_limit_minutes"))
    p = s.select("id", F.when(F.col("id") % 3 == 2, F.to_date(F.lit("2024-06-01"))).alias("due_date"), (F.col("id") % 3 != 0).alias("set_due_date"), F.lit(0).alias("time_limit_minutes"), (F.col("id") % 2 == 0).alias("set_time_limit_minutes"))
    return crud.patched(s, p, "id", ["due_date", "time_limit_minutes"])


@query("SELECT p_partkey AS id, p_size <= 17 AND p_partkey % 3 <> 0 AS valid FROM part")
def q_valid_quarantine(spark, d):
    p = D.table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("question_text"), F.lit("mcq").alias("question_type"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("correct_answer"), F.when(F.col("p_size") <= 17, "Easy").otherwise("Impossible").alias("difficulty"))
    good, bad = crud.valid_and_quarantined(rows, "questions")
    return good.select("id", F.lit(True).alias("valid")).unionAll(bad.select("id", F.lit(False).alias("valid")))


@query(sql("SELECT id, score FROM (SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN CAST(floor(o_totalprice) AS BIGINT) END, -1) AS score FROM orders)"))
def q_update(spark, d):
    o = D.table(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.lit(-1).cast("long").alias("score"))
    changes = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice").cast("long")).alias("score"))
    return crud.updated(rows, changes, "id", ["score"])


_LOG = """g AS (SELECT l_orderkey % 1000 AS id, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_orderkey % 7 = 3 AND l_linenumber = 2 THEN 'delete' ELSE 'put' END AS op,
    CASE WHEN l_linenumber % 2 = 0 THEN CAST(floor(l_quantity) AS BIGINT) END AS score, CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag END AS status FROM lineitem)"""


def _change_log(spark, d):
    """Several changes of each of a thousand submissions: scores, states, deletions, in no order."""
    line = D.table(spark, d, "lineitem")
    n, none = F.col("l_linenumber"), F.lit(None)
    return line.select(
        (F.col("l_orderkey") % 1000).alias("id"),
        (F.col("l_orderkey") * 10 + n).alias("seq"),
        F.when((F.col("l_orderkey") % 7 == 3) & (n == 2), "delete").otherwise("put").alias("op"),
        F.when(n % 2 == 0, F.floor("l_quantity").cast("long")).otherwise(none).alias("score"),
        F.when(n % 3 == 0, F.col("l_returnflag")).otherwise(none).alias("status"),
    )


@query(sql("", "submissions").rstrip() + f""",\n{_LOG},
x AS (SELECT id, max(seq) FILTER (op = 'delete') AS gone, max(seq) FILTER (op = 'put') AS put FROM g GROUP BY id),
v AS (SELECT g.id, max((seq, score)) FILTER (op = 'put' AND score IS NOT NULL AND seq > coalesce(gone, -1)) AS s, max((seq, g.status)) FILTER (op = 'put' AND g.status IS NOT NULL AND seq > coalesce(gone, -1)) AS t FROM g JOIN x USING (id) GROUP BY g.id)
SELECT coalesce(b.id, x.id) AS id, v.s[2] AS score, CASE WHEN v.t IS NOT NULL THEN v.t[2] WHEN gone IS NULL THEN b.status END AS status FROM submissions b FULL JOIN x ON x.id = b.id LEFT JOIN v ON v.id = x.id WHERE x.id IS NULL OR put > coalesce(gone, -1)""")
def q_merge_log(spark, d):
    """Submissions after a log of changes, several for each key, merged in two parts of which the first is run twice."""
    columns = ["score", "status"]
    base = D.submissions(spark, d).select("id", F.lit(None).cast("long").alias("score"), "status")
    log = _change_log(spark, d)
    half = log.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    early = changes.merged(changes.fresh(base), log.where(F.col("seq") <= half), "id", columns)
    again = changes.merged(early, log.where(F.col("seq") <= half), "id", columns)
    return changes.live(changes.merged(again, log, "id", columns))


@query(sql("SELECT submission_id, CAST(sum(greatest(0, least(CASE WHEN submission_id % 5 = 0 AND question_id % 2 = 0 THEN 15 - (submission_id + question_id) % 20 ELSE score END, points))) AS BIGINT) AS score, CAST(sum(points) AS BIGINT) AS total, count(*) AS n_answers FROM answers JOIN questions ON question_id = id GROUP BY submission_id", "answers", "questions"))
def q_rollup_delta(spark, d):
    """Totals after a fifth of the submissions are graded again, from the old totals and what changed."""
    answers, q = D.answers(spark, d), D.questions(spark, d)
    totals = grading.rolled_up(grading.clamped_answers(answers, q))
    return changes.kept_up(totals, changes.regrade_delta(answers, _regrades(answers), q), ["submission_id"])


def _regrades(answers):
    some = answers.where("submission_id % 5 = 0 and question_id % 2 = 0")
    return some.select("submission_id", "question_id", (15 - (F.col("submission_id") + F.col("question_id")) % 20).cast("int").alias("score")).distinct()


@query(sql("SELECT s.student_id, CAST(sum(t.score) AS BIGINT) AS score, CAST(sum(t.total) AS BIGINT) AS total, count(*) AS n_evaluated FROM submissions s JOIN (SELECT submission_id, sum(greatest(0, least(CASE WHEN submission_id % 5 = 0 AND question_id % 2 = 0 THEN 15 - (submission_id + question_id) % 20 ELSE score END, points))) AS score, sum(points) AS total FROM answers JOIN questions ON question_id = id GROUP BY submission_id) t ON t.submission_id = s.id WHERE status = 'evaluated' GROUP BY s.student_id", "answers", "questions", "submissions"))
def q_roster_delta(spark, d):
    """Students' sums after the same regrade, through the submissions' delta."""
    answers, q, subs = D.answers(spark, d), D.questions(spark, d), D.submissions(spark, d)
    scored = D.scored_submissions(spark, d).where("status = 'evaluated' and total is not null")
    view = scored.groupBy("student_id").agg(F.sum("score").alias("score"), F.sum("total").alias("total"), F.count(F.lit(1)).alias("n_evaluated"))
    delta = changes.roster_delta(changes.regrade_delta(answers, _regrades(answers), q), subs)
    return changes.kept_up(view, delta, ["student_id"], "n_evaluated")


# Sessions


@query(sql("""SELECT user_id, count(*) FILTER (type = 'click') AS total_clicks, count(*) FILTER (type = 'scroll') AS total_scrolls, coalesce(max(depth_pct) FILTER (type = 'scroll'), 0) AS max_scroll_depth_pct,
    count(DISTINCT element) FILTER (type = 'click') AS unique_elements_clicked, coalesce(min(t) FILTER (type = 'click' AND t > 0), min(t) FILTER (type = 'click')) AS time_to_first_click_ms, coalesce(min(t) FILTER (type = 'scroll' AND t > 0), min(t) FILTER (type = 'scroll')) AS time_to_first_scroll_ms,
    CAST(floor(sum(dist) + 0.5) AS BIGINT) AS cursor_distance_px, max(t) AS duration_ms FROM (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0) AS dist FROM interactions WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) GROUP BY user_id""", "interactions"))
def q_session_summary(spark, d):
    return sessions.summaries(D.interactions(spark, d), "user_id", "t", "event_id")


@query(sql("SELECT user_id, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(ts, lambda t: [t])), lambda a, x: CASE WHEN len(a) = 0 OR x[1] - a[-1] >= 3600000 THEN list_concat(a, x) ELSE a END)) AS kept_ms FROM (SELECT user_id, list_sort(list(DISTINCT t)) AS ts FROM interactions GROUP BY user_id)", "interactions"))
def q_sampling_throttle(spark, d):
    return sessions.throttled(D.interactions(spark, d), "user_id", "t", "event_id", 3_600_000)


@query(sql("SELECT user_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM interactions WHERE t < 864000000) WHERE r <= 20 GROUP BY user_id", "interactions"))
def q_session_caps(spark, d):
    kept = sessions.capped(D.interactions(spark, d), "user_id", "t", "event_id", most=20, most_ms=864_000_000)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, CASE WHEN m < 10 THEN '0' || m ELSE CAST(m AS VARCHAR) END || ':' || CASE WHEN r < 10 THEN '0' || r ELSE CAST(r AS VARCHAR) END AS timer FROM (SELECT o_orderkey, o_orderkey % 7000 // 60 AS m, o_orderkey % 7000 % 60 AS r FROM orders)")
def q_timer(spark, d):
    o = D.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), T.minutes_seconds(F.col("o_orderkey") % 7000).alias("timer"))


@query("SELECT event_id, CAST(CASE WHEN page > 800 THEN least(100, floor((top + 800) * 100.0::DOUBLE / page + 0.5)) ELSE 100 END AS INTEGER) AS depth FROM (SELECT event_id, event_id * 7 % 3000 AS top, event_id * 13 % 5000 AS page FROM events)")
def q_scroll_depth(spark, d):
    e = D.table(spark, d, "events")
    return e.select("event_id", T.scroll_depth(F.col("event_id") * 7 % 3000, F.lit(800), F.col("event_id") * 13 % 5000).alias("depth"))


@query(sql("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM interactions) WHERE r <= CASE WHEN n <= 40 THEN n WHEN n <= 80 THEN ceil(n / 2.0) WHEN n <= 160 THEN ceil(n / 4.0) WHEN n <= 320 THEN ceil(n / 8.0) WHEN n <= 640 THEN ceil(n / 16.0) WHEN n <= 1280 THEN ceil(n / 32.0) WHEN n <= 2560 THEN ceil(n / 64.0) ELSE ceil(n / 128.0) END", "interactions"))
def q_recorder_overflow(spark, d):
    return sessions.halved_on_overflow(D.interactions(spark, d), "user_id", "t", "event_id", 40).select("user_id", "event_id")


_RECORD = """WITH timed AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' ELSE 'cursor' END AS type, epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS t FROM events),
ev AS (SELECT * FROM timed WHERE t < 864000000),
folded AS (SELECT user_id, type, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(ts, lambda t: [t])), lambda a, x: CASE WHEN len(a) = 0 OR x[1] - a[-1] >= gap THEN list_concat(a, x) ELSE a END)) AS t
    FROM (SELECT user_id, type, CASE type WHEN 'scroll' THEN 3600000 ELSE 7200000 END AS gap, list_sort(list(DISTINCT t)) AS ts FROM ev WHERE type <> 'click' GROUP BY user_id, type)),
taken AS (SELECT user_id, type, t, min(event_id) AS event_id FROM folded JOIN ev USING (user_id, type, t) GROUP BY ALL UNION ALL SELECT user_id, type, t, event_id FROM ev WHERE type = 'click'),
numbered AS (SELECT *, CASE type WHEN 'cursor' THEN 'cursor' ELSE 'interaction' END AS kind, row_number() OVER (PARTITION BY user_id, type = 'cursor' ORDER BY t, event_id) AS n FROM taken),
sized AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM ev)"""


@query(f"""{_RECORD}
    SELECT user_id, event_id, t, type, kind FROM numbered WHERE n <= CASE kind WHEN 'cursor' THEN 9 ELSE 12 END
    UNION ALL SELECT user_id, event_id, t, type, 'store' FROM sized WHERE r <= CASE WHEN n <= 7 THEN n ELSE 4 + (n - 8) % 4 END""")
def q_recorder(spark, d):
    """What the recorder keeps of each user's events within ten days, and the replay store after its overflows."""
    e = D.table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "scroll").otherwise("cursor")
    rows = e.select("user_id", "event_id", "ts", kind.alias("type"))
    return sessions.recorded(rows, sessions.Limits(ms=864_000_000, interactions=12, cursors=9, stored=7, scroll_gap_ms=3_600_000, cursor_gap_ms=7_200_000))


@query("""WITH a AS (SELECT o_orderkey AS id, TIMESTAMP '2024-01-01' + to_minutes(o_orderkey % 1000) AS at, o_orderkey % 5 + 1 AS limit_minutes FROM orders),
g AS (SELECT l_orderkey AS id, TIMESTAMP '2024-01-01' + to_minutes(l_orderkey % 1000) + to_seconds(70 * l_linenumber) AS at, l_linenumber AS seq, l_partkey % 3 AS q, l_returnflag AS answer, l_linenumber = 4 AS sent FROM lineitem),
c AS (SELECT a.id, least(a.at + to_minutes(limit_minutes), min(g.at) FILTER (sent)) AS closed_at, coalesce(min(g.at) FILTER (sent) <= a.at + to_minutes(limit_minutes), FALSE) AS by_student FROM a LEFT JOIN g USING (id) GROUP BY a.id, a.at, limit_minutes),
l AS (SELECT g.id, q, arg_max(answer, (g.at, seq, answer)) AS answer FROM g JOIN c USING (id) WHERE NOT sent AND g.at <= closed_at GROUP BY g.id, q)
SELECT c.id AS attempt_id, epoch_us(closed_at) AS closed_us, CASE WHEN by_student THEN 'student' ELSE 'time' END AS by, coalesce(string_agg(q || '=' || answer, ';' ORDER BY q), '') AS answers FROM c LEFT JOIN l USING (id) GROUP BY ALL""")
def q_countdown(spark, d):
    """Attempts, one an order: answered line by line, sent with the fourth, closed when their minutes are over."""
    o, line = D.table(spark, d, "orders"), D.table(spark, d, "lineitem")
    began = lambda key: F.timestamp_seconds(F.lit(1_704_067_200) + key % 1000 * 60)
    none = F.lit(None).cast("string")
    starts = o.select(F.col("o_orderkey").alias("attempt_id"), began(F.col("o_orderkey")).alias("ts"), F.lit(0).cast("long").alias("seq"), F.lit("start").alias("kind"), F.lit(None).cast("long").alias("question_id"), none.alias("answer"), (F.col("o_orderkey") % 5 + 1).cast("int").alias("limit_minutes"))
    sent = F.col("l_linenumber") == 4
    at = began(F.col("l_orderkey")) + F.make_dt_interval(secs=70 * F.col("l_linenumber"))
    given = line.select(F.col("l_orderkey").alias("attempt_id"), at.alias("ts"), F.col("l_linenumber").cast("long").alias("seq"), F.when(sent, "submit").otherwise("answer").alias("kind"), (F.col("l_partkey") % 3).alias("question_id"), F.col("l_returnflag").alias("answer"), F.lit(None).cast("int").alias("limit_minutes"))
    closed = sessions.closed_attempts(starts.unionByName(given))
    said = F.array_join(F.transform("answers", lambda a: F.concat_ws("=", a["question_id"], a["answer"])), ";")
    return closed.select("attempt_id", F.unix_micros("closed_at").alias("closed_us"), "by", said.alias("answers"))


# Sessions of the event stream, on its batch form


@query(
    """SELECT user_id, count(*) AS n_events, count(*) FILTER (event_type = 'click') AS n_clicks, count(*) FILTER (event_type = 'view') AS n_views, epoch_us(min(ts)) AS start_us FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def q_session_windows(spark, d):
    found = stream_sessions.session_counts(D.table(spark, d, "events"))
    return found.select("user_id", "n_events", "n_clicks", "n_views", F.unix_micros("session_start").alias("start_us"))
