"""Study materials: search, flags, stored files and lookups by e-mail or either of two keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import text as T

MOST_BYTES = 5 * 1024 * 1024


def stored(files: DataFrame, name: Column, content: Column) -> DataFrame:
    """Files of up to 5 MiB as records: title, extension, size and the content in base64."""
    size = F.octet_length(content)
    return files.where(size <= MOST_BYTES).withColumns({"title": T.file_title(name), "file_type": T.file_extension(name), "file_size": size.cast("long"), "file_data": F.base64(content)})


def downloaded(materials: DataFrame) -> DataFrame:
    """``content`` (binary) where data is stored, else ``location`` to go to, else ``found`` is false."""
    has = F.coalesce(F.col("file_data"), F.lit("")) != ""
    return materials.withColumns({"content": F.when(has, F.unbase64("file_data")), "location": F.when(~has, F.col("file_url")), "found": has | F.col("file_url").isNotNull()})


def listed(materials: DataFrame) -> DataFrame:
    """Records without the stored data, with a flag of whether there is any."""
    return materials.withColumn("has_file", F.coalesce(F.length("file_data") > 0, F.lit(False))).drop("file_data")


def searched(materials: DataFrame, category: str = "all", query: str = "") -> DataFrame:
    """Of one category or all, those with the query in title or description, whatever the case."""
    out = materials if category == "all" else materials.where(F.col("category") == category)
    if query:
        q = F.lit(query.lower())
        out = out.where(F.contains(F.lower("title"), q) | F.contains(F.lower(F.coalesce("description", F.lit(""))), q))
    return out


def shared_flag(documents: DataFrame, materials: DataFrame, name_col: str = "original_name") -> DataFrame:
    """Documents with ``is_shared``: a material has the same file name. Null names are shared with none."""
    names = materials.select(F.col("file_name").alias("_name")).where("_name is not null").distinct()
    met = documents.join(names, F.col(name_col) == F.col("_name"), "left")
    return met.withColumn("is_shared", F.col("_name").isNotNull()).drop("_name")


def by_email(students: DataFrame, email: DataFrame) -> DataFrame:
    """The first student (by id) of each e-mail, whatever its case."""
    asked = email.select(F.lower("email").alias("_e")).distinct()
    met = students.join(asked, F.lower("email") == F.col("_e"), "left_semi")
    first = met.groupBy(F.lower("email").alias("_e")).agg(F.min("id").alias("id"))
    return met.join(first.select("id"), "id", "left_semi")


def by_either(rows: DataFrame, lookups: DataFrame, first: str, second: str) -> DataFrame:
    """Lookups (id_key, other_key) with the row of the first key, else that of the second."""
    a = lookups.join(rows.select(F.col(first).alias("id_key"), F.struct("*").alias("_a")), "id_key", "left")
    b = a.join(rows.select(F.col(second).alias("other_key"), F.struct("*").alias("_b")), "other_key", "left")
    return b.withColumn("found", F.coalesce("_a", "_b")).drop("_a", "_b")


def attempt_documents(documents: DataFrame, sets: DataFrame, questions: DataFrame) -> DataFrame:
    """(set_id, document_id): documents that a set or its first question names, each once.

    The choice between the two keys is a union of two equi-joins.
    """
    first = questions.groupBy("set_id").agg(F.min_by("document_id", "id").alias("document_id"))
    named = sets.select(F.col("id").alias("set_id"), "document_id").unionByName(first)
    return named.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("set_id", "document_id").distinct()
