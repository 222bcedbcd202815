"""Grading: answers met with their questions, graded, and rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradelake.functions import grading as G
from gradelake.functions import text as T


def graded_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with a known question (inner join), with is_correct, score, max_score, matched keywords, gap reason, feedback and conceptual_gap.

    The cited chunk (``grounding_chunk``) may be missing from ``questions``; it is empty then.
    """
    chunk = F.col("grounding_chunk") if "grounding_chunk" in questions.columns else F.lit(None).cast("string")
    q = questions.select(F.col("id").alias("question_id"), "question_type", "correct_answer", "options", "points", "concept_tag", chunk.alias("grounding_chunk"))
    met = answers.join(q, "question_id")
    g = G.grade(F.col("question_type"), F.col("correct_answer"), F.col("options"), F.col("points"), F.col("student_answer"))
    low = (F.coalesce("question_type", F.lit("")) != "mcq") & ~g.blank & (g.coverage < 0.65)
    gap = F.when(low, G.gap_reason(F.col("concept_tag"), F.col("correct_answer")))
    said, missing = G.feedback(g, F.col("question_type"), F.col("correct_answer"), F.col("concept_tag"), F.col("grounding_chunk"), F.col("student_answer"))
    return met.withColumns({"is_correct": g.is_correct, "score": g.score, "max_score": F.col("points"), "matched": g.matched, "n_keywords": g.n_keywords, "gap": gap, "feedback": said, "conceptual_gap": missing})


WRITTEN = ["is_correct", "score", "max_score", "feedback", "conceptual_gap"]


def written_back(answers: DataFrame, graded: DataFrame, key: list[str]) -> DataFrame:
    """Answers with what the grader found; those it did not grade (no known question) keep what they had."""
    new = graded.select(*key, F.lit(True).alias("_graded"), *[F.col(c).alias(f"_{c}") for c in WRITTEN])
    met = answers.join(new, key, "left")
    old = lambda c: F.col(c) if c in answers.columns else F.lit(None)
    met = met.withColumns({c: F.when(F.col("_graded"), F.col(f"_{c}")).otherwise(old(c)) for c in WRITTEN})
    return met.drop("_graded", *[f"_{c}" for c in WRITTEN])


def clamped_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers with a score from elsewhere, held between 0 and the question's points."""
    q = questions.select(F.col("id").alias("question_id"), "points", "concept_tag")
    return answers.join(q, "question_id").withColumn("score", G.clamped(F.col("score"), F.col("points")))


def rolled_up(graded: DataFrame) -> DataFrame:
    """(submission_id, score, total, n_answers): one row per submission with answers."""
    return graded.groupBy("submission_id").agg(F.sum("score").cast("long").alias("score"), F.sum("points").cast("long").alias("total"), F.count(F.lit(1)).alias("n_answers"))


def reviewed(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """All answers, with their question where it is known (left join)."""
    q = questions.select(F.col("id").alias("question_id"), "question_text", "concept_tag", "difficulty", "points")
    return answers.join(q, "question_id", "left")


def applied_grades(submissions: DataFrame, totals: DataFrame) -> DataFrame:
    """Submissions with the rolled-up score and total; graded ones become evaluated, others stay as they are."""
    t = totals.select(F.col("submission_id").alias("id"), F.col("score").alias("_score"), F.col("total").alias("_total"))
    met = submissions.join(t, "id", "left")
    known = F.col("_total").isNotNull()
    out = {"score": F.when(known, F.col("_score")).otherwise(F.col("score")), "total": F.when(known, F.col("_total")).otherwise(F.col("total")), "status": F.when(known, "evaluated").otherwise(F.col("status"))}
    return met.withColumns(out).drop("_score", "_total")


def evaluated(graded: DataFrame, reply_col: str) -> DataFrame:
    """Graded answers, with a model's judgement in place of the rules' where its reply holds one.

    A reply counts if the JSON object in it has a truth value ``is_correct`` and a number
    ``score``, which is rounded and held to the question's points; any other leaves the rules'.
    """
    reply = F.from_json(T.json_object(F.col(reply_col)), "is_correct string, score string, feedback string, conceptual_gap string")
    rows = graded.withColumn("_m", reply)
    score = F.try_to_number("_m.score", F.lit("S9999999999.9999999999")).cast("double")
    ok = F.col("_m.is_correct").isin("true", "false") & score.isNotNull()
    new = {"is_correct": F.col("_m.is_correct") == "true", "score": G.clamped(G.rounded(score), F.col("max_score")).cast("int"), "feedback": F.coalesce("_m.feedback", F.lit("")), "conceptual_gap": F.coalesce("_m.conceptual_gap", F.lit(""))}
    return rows.withColumns({c: F.when(ok, v).otherwise(F.col(c)) for c, v in new.items()}).drop("_m")
