"""Reports: class averages, rosters, counts, concept and set statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The categories of study material.
CATEGORIES = ["syllabus", "notes", "slides", "reference"]


def _evaluated(column: str) -> Column:
    return F.sum(F.when(F.col("status") == "evaluated", F.col(column)))


def class_average(submissions: DataFrame) -> DataFrame:
    """One row: percent of all points that evaluated submissions got, one decimal; null without any."""
    share = F.try_divide(_evaluated("score").cast("double"), _evaluated("total").cast("double"))
    return submissions.agg(F.round(share * 100, 1).alias("class_average"), F.count_if(F.col("status") == "evaluated").alias("n_evaluated"))


def roster(students: DataFrame, submissions: DataFrame) -> DataFrame:
    """Every student with the whole-percent average of evaluated submissions; null without one."""
    sums = submissions.where("status = 'evaluated'").groupBy(F.col("student_id").alias("id")).agg(F.sum("score").alias("_s"), F.sum("total").alias("_t"), F.count(F.lit(1)).alias("n_evaluated"))
    average = F.floor(F.try_divide(F.col("_s") * F.lit(100.0), F.col("_t")) + 0.5).cast("int")
    return students.join(sums, "id", "left").select("id", "name", average.alias("average"), F.coalesce("n_evaluated", F.lit(0)).alias("n_evaluated"))


def status_counts(submissions: DataFrame) -> DataFrame:
    return submissions.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "evaluated").alias("evaluated"), F.count_if(F.col("status") == "submitted").alias("submitted"))


def overview(documents: DataFrame, n_chunks: Column, questions: DataFrame, sets: DataFrame) -> DataFrame:
    """One row of totals; documents without chunks count none."""
    d = documents.agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum(F.coalesce(n_chunks, F.lit(0))), F.lit(0)).cast("long").alias("n_chunks"))
    q = questions.agg(F.count(F.lit(1)).alias("n_questions"))
    s = sets.agg(F.count(F.lit(1)).alias("n_sets"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(d).join(one(q), "_k").join(one(s), "_k").drop("_k")


def concept_histogram(questions: DataFrame) -> DataFrame:
    """Per concept the number of questions, the display figure (of the tag's length) and its band."""
    display = 58 + (F.length("concept_tag") * 7) % 35
    band = F.when(display > 80, "high").when(display > 65, "medium").otherwise("low")
    return questions.groupBy("concept_tag").agg(F.count(F.lit(1)).alias("n_questions")).withColumns({"display": display, "band": band})


def concept_mastery(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Per concept the percent of points that its answers got: what the display figure only looks like."""
    q = questions.select(F.col("id").alias("question_id"), "concept_tag", "points")
    met = answers.join(q, "question_id")
    return met.groupBy("concept_tag").agg(F.round(F.try_divide(F.sum("score") * F.lit(100.0), F.sum("points")), 1).alias("mastery"), F.count(F.lit(1)).alias("n_answers"))


def set_statistics(sets: DataFrame, questions: DataFrame, submissions: DataFrame, now: Column) -> DataFrame:
    """Per set: questions, points, attempts, the first three concepts and whether it is overdue."""
    q = questions.groupBy(F.col("set_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.sum("points").cast("long").alias("points"),
    )
    # Three questions of each set by rank, so that no set's questions are gathered in one value.
    order = Window.partitionBy("set_id").orderBy("id")
    first = questions.withColumn("_r", F.row_number().over(order)).where("_r <= 3").groupBy(F.col("set_id").alias("id"))
    first = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "concept_tag"))), lambda x: x["concept_tag"]), ", ").alias("first_concepts"))
    a = submissions.groupBy(F.col("set_id").alias("id")).agg(F.count(F.lit(1)).alias("n_attempts"))
    overdue = F.coalesce(F.col("due_date") < now, F.lit(False))
    none = F.lit(0).cast("long")
    return sets.join(q, "id", "left").join(first, "id", "left").join(a, "id", "left").select("id", F.coalesce("n_questions", none).alias("n_questions"), F.coalesce("points", none).alias("points"), F.coalesce("n_attempts", none).alias("n_attempts"), F.coalesce("first_concepts", F.lit("")).alias("first_concepts"), overdue.alias("overdue"))


def category_counts(materials: DataFrame, categories: list[str] = CATEGORIES) -> DataFrame:
    """Materials per listed category, none left out."""
    listed = materials.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    n = materials.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return listed.join(n, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def listed(rows: DataFrame, column: str, descending: bool = False, limit: int | None = None, ties: list[str] | None = None) -> DataFrame:
    """Rows in the order of a stored list: newest first with nulls on top, or ascending with nulls at the end; the first ``limit``.

    ``ties`` are columns, ascending, that make the order (and so the cut) the same in every run.
    """
    order = F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)
    out = rows.orderBy(order, *[F.asc_nulls_last(c) for c in ties or []])
    return out if limit is None else out.limit(limit)


def selection_totals(documents: DataFrame, n_chunks: Column, group: list[str], order: str) -> DataFrame:
    """Per selection of documents (``group``): the titles in order, joined, the contents, and the sum of chunks.

    A selection is what one person picked by hand, a few documents.
    """
    rows = documents.withColumn("_n", F.coalesce(n_chunks, F.lit(0)))
    picked = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("title", F.lit("")).alias("t"), F.coalesce("content", F.lit("")).alias("c"))))
    part = lambda field, sep: F.array_join(F.transform("_l", lambda x: x[field]), sep)
    filled = F.array_join(F.transform(F.filter("_l", lambda x: x["c"] != ""), lambda x: x["c"]), "\n\n")
    out = rows.groupBy(*group).agg(picked.alias("_l"), F.sum("_n").cast("long").alias("n_chunks"))
    return out.select(*group, part("t", ", ").alias("sources"), part("t", " + ").alias("title"), filled.alias("content"), "n_chunks")


def submission_list(submissions: DataFrame, students: DataFrame, documents: DataFrame) -> DataFrame:
    """Every submission with its student's name and e-mail and its document's title, where they are known."""
    s = students.select(F.col("id").alias("student_id"), F.col("name").alias("student_name"), F.col("email").alias("student_email"))
    d = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    return submissions.join(s, "student_id", "left").join(d, "document_id", "left")


def filtered_by(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    """The rows of one set or concept, compared as text; all of them for "All"."""
    return rows if wanted == "All" else rows.where(F.col(column).cast("string") == wanted)


def set_list(sets: DataFrame, documents: DataFrame) -> DataFrame:
    """Every set with the title of its document, where it is known."""
    d = documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"))
    return sets.join(d, "document_id", "left")
