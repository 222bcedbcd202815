"""Inserts, updates, deletes and validation of stored tables, as DataFrame transformations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake import schemas


def with_defaults(rows: DataFrame, table: str) -> DataFrame:
    """Rows with the table's defaults where a value is null."""
    return rows.fillna({k: v for k, v in schemas.DEFAULTS.get(table, {}).items() if k in rows.columns})


def validity(rows: DataFrame, table: str) -> Column:
    """True where required columns hold a value and listed ones a listed value (null is allowed there)."""
    ok = [F.col(c).isNotNull() for c in schemas.REQUIRED.get(table, []) if c in rows.columns]
    ok += [F.col(c).isNull() | F.col(c).isin(v) for c, v in schemas.ALLOWED.get(table, {}).items() if c in rows.columns]
    return reduce(lambda a, b: a & b, ok, F.lit(True))


def valid_and_quarantined(rows: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    ok = validity(rows, table)
    return rows.where(ok), rows.where(~ok)


def inserted_if_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table with those new rows whose key it does not hold; existing rows are unchanged."""
    fresh = new.join(existing.select(key), key, "left_anti").dropDuplicates([key]).select(*new.columns)
    return existing.unionByName(fresh, allowMissingColumns=True)


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """Rows with the non-null values of ``changes`` in ``columns``.

    Of several changes of a key the last one by ``order`` that has a value counts, for each
    column; without an order the greatest value.
    """
    last = lambda c: F.max(c) if order is None else F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))
    new = changes.groupBy(key).agg(*[last(c).alias(f"_{c}") for c in columns])
    out = rows.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns]).select(*rows.columns)


def patched(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows under sparse patches: a column whose ``set_<column>`` is true takes the patch's value.

    An empty or zero value clears the column, which is how a date or limit is taken back.
    """
    new = patches.select(key, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"set_{c}").alias(f"_set_{c}") for c in columns])
    out = rows.join(new, key, "left")
    cleared = lambda c: F.when(F.col(f"_{c}").cast("string").isin("", "0"), None).otherwise(F.col(f"_{c}"))
    done = {c: F.when(F.coalesce(f"_set_{c}", F.lit(False)), cleared(c)).otherwise(F.col(c)) for c in columns}
    return out.withColumns(done).select(*rows.columns)


def analysed(documents: DataFrame, sources: DataFrame, analysis: DataFrame, key: str = "id") -> DataFrame:
    """The documents, those in ``sources`` with the one analysis row's syllabus_analysis and module_structure."""
    made = analysis.select(F.col("syllabus_analysis").alias("_analysis"), F.col("module_structure").alias("_modules"))
    new = sources.select(F.col(key).alias("_key")).distinct().crossJoin(made)
    met = documents.join(new, documents[key] == new["_key"], "left")
    hit = F.col("_key").isNotNull()
    values = {"syllabus_analysis": "_analysis", "module_structure": "_modules"}
    old = lambda c: F.col(c) if c in documents.columns else F.lit(None)
    return met.withColumns({c: F.when(hit, F.col(v)).otherwise(old(c)) for c, v in values.items()}).drop("_key", "_analysis", "_modules")


def published(rows: DataFrame, flag: Column, now: Column) -> DataFrame:
    """Rows published or withdrawn: ``published_at`` is ``now`` for the former and null for the latter."""
    return rows.withColumns({"is_published": flag, "published_at": F.when(flag, now)})


def deleted(rows: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    ids = gone.select(F.col(gone_key or key).alias("_gone")).where("_gone is not null").distinct()
    return rows.join(ids, F.col(key) == F.col("_gone"), "left_anti")


def cascaded(tables: dict[str, DataFrame], root: str, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables after rows of ``root`` (ids in ``gone.id``) go, and all that depends on them.

    Children go by left anti joins, level by level; rows whose parent is null stay.
    """
    lost: dict[str, list[DataFrame]] = {root: [gone.select("id")]}
    order, todo = [root], [root]
    while todo:
        parent = todo.pop(0)
        for child, column in schemas.CHILDREN.get(parent, []):
            if child not in tables:
                continue
            ids = reduce(DataFrame.unionByName, lost[parent]).distinct()
            mine = tables[child].join(ids.select(F.col("id").alias("_gone")), F.col(column) == F.col("_gone"), "left_semi").select("id")
            lost.setdefault(child, []).append(mine)
            if child not in order:
                order.append(child)
            todo.append(child)
    return {t: deleted(df, reduce(DataFrame.unionByName, lost[t]), "id") if t in lost else df for t, df in tables.items()}


def visible(rows: DataFrame, table: str, role: str) -> DataFrame:
    """What a role may read: the service reads all, the public not students and submissions."""
    return rows if role == "service" or table not in ("students", "submissions") else rows.where(F.lit(False))


def filtered(rows: DataFrame, equal: dict[str, object] | None = None, among: dict[str, list] | None = None) -> DataFrame:
    """Equality filters of which empty ones are not applied, and membership filters (an empty list matches id 0 only)."""
    for column, value in (equal or {}).items():
        if value not in (None, "", 0, False):
            rows = rows.where(F.col(column) == F.lit(value))
    for column, values in (among or {}).items():
        rows = rows.where(F.col(column).isin(values or [0]))
    return rows


def single(rows: DataFrame) -> DataFrame:
    """The rows themselves if there is exactly one; an error otherwise. Two rows are fetched at most."""
    if len(found := rows.limit(2).collect()) != 1:
        raise ValueError(f"expected one row, found {'none' if not found else 'more'}")
    return rows


def submitted(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New submissions and their answers from payloads (id, student_id, set_id, document_id, answers array<struct<question_id,student_answer,max_score>>).

    A submission starts as 'submitted' with no points; its answers start ungraded, worth 10
    points where the payload does not say. A payload without answers is a submission alone.
    """
    zero = F.lit(0)
    rows = payloads.select("id", "student_id", "set_id", "document_id", F.lit("submitted").alias("status"), zero.alias("score"), zero.alias("total"))
    each = payloads.select(F.col("id").alias("submission_id"), F.explode("answers").alias("a"))
    none = F.lit(None).cast("string")
    worth = F.when(F.coalesce("a.max_score", zero) == 0, 10).otherwise(F.col("a.max_score")).cast("int")
    answers = each.select("submission_id", "a.question_id", "a.student_answer", F.lit(False).alias("is_correct"), zero.alias("score"), worth.alias("max_score"), none.alias("feedback"), none.alias("conceptual_gap"))
    return rows, answers


def question_set(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New sets and their questions from payloads (id, document_id, question_types, module_filter, document_weights, questions array<struct>).

    A set counts its questions; each question carries the set and document it belongs to.
    """
    rows = payloads.select("id", "document_id", F.size(F.coalesce("questions", F.array())).alias("total_questions"), "question_types", "module_filter", "document_weights")
    each = payloads.select(F.col("id").alias("set_id"), "document_id", F.explode("questions").alias("q"))
    return rows, each.select("set_id", "document_id", "q.*")


def stamped(rows: DataFrame, now: Column) -> DataFrame:
    """Rows with ``updated_at`` set to now, as every change leaves them."""
    return rows.withColumn("updated_at", now)
