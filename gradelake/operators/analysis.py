"""The analysis of a document as one nested record, kept as VARIANT and read back by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions import text as T
from gradelake.operators import modules

_DESCRIPTION = 150


def _topics(texts: Column, concepts: Column, module: Column, first: Column) -> Column:
    """A topic for each chunk of a module (``texts`` are its own): what it begins with, and the first three concepts it holds."""

    def topic(t: Column, j: Column) -> Column:
        no = (j + 1).cast("string")
        held = T.once(F.lower(t), lambda low: F.filter(concepts, lambda c: F.contains(low, F.lower(c))))
        return F.struct(
            F.concat(F.lit("module_"), module, F.lit("_topic_"), no).alias("id"),
            F.concat(F.lit("Topic "), module, F.lit("."), no).alias("title"),
            F.when(F.length(t) > _DESCRIPTION, F.concat(F.left(t, F.lit(_DESCRIPTION)), F.lit("..."))).otherwise(t).alias("description"),
            F.array((first + j).cast("int")).alias("chunk_indices"),
            F.slice(held, 1, 3).alias("concepts"),
        )

    return F.transform(texts, topic)


def module_tree(texts: Column, concepts: Column) -> Column:
    """Modules of a quarter of the chunks each (one at least), with a topic for each chunk: an array of nested records.

    Built by slices of the chunks' own array, level inside level, so that nothing is taken apart
    and grouped again. Documents without chunks have none.
    """
    n = F.size(texts)
    width = F.greatest(F.lit(1), F.floor(n / 4).cast("int"))

    def module(m: Column) -> Column:
        first = m * width
        own = F.slice(texts, first + 1, width)
        last = first + F.size(own)
        no = (m + 1).cast("string")
        return F.struct(
            F.concat(F.lit("module_"), no).alias("id"),
            F.concat(F.lit("Module "), no).alias("title"),
            F.concat(F.lit("Content from chunks "), (first + 1).cast("string"), F.lit("-"), last.cast("string")).alias("description"),
            _topics(own, concepts, no, first).alias("topics"),
            F.transform(F.sequence(first, last - 1), lambda i: i.cast("int")).alias("chunk_indices"),
            F.lit(1.0).alias("weight"),
        )

    made = F.transform(F.sequence(F.lit(0), F.ceil(F.greatest(n, F.lit(1)) / width).cast("int") - 1), module)
    return F.when(n > 0, made).otherwise(F.slice(made, 1, 0))


def analysis_records(docs: DataFrame, id_col: str = "doc_id", title: str = "title", content: str = "content") -> DataFrame:
    """(id, analysis): the record of ten fields that the rules make of each document, from its own text and chunks.

    Concepts are found in the content; their coverage counts them in the chunks. A null content
    is an empty one: no concepts, no modules, the default statements.
    """
    # Each step in columns of its own, so that none is worked out twice.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(title).alias("_title"), F.coalesce(content, F.lit("")).alias("_content"))
    rows = rows.withColumns({"_texts": T.chunk_texts(F.col("_content")), "_concepts": T.key_concepts(F.col("_content"))})
    rows = rows.withColumns({"_all": F.lower(F.array_join("_texts", " ")), "_n": F.size("_texts"), "_total": modules.question_total(F.size("_texts"), halved=True)})
    covered = F.transform("_concepts", lambda c: F.struct(c, F.least(F.lit(100.0), T.occurrences(F.col("_all"), F.lower(c)) * F.lit(10.0) + 20.0)))
    rows = rows.withColumns({"_tree": module_tree(F.col("_texts"), F.col("_concepts")), "_covered": covered})
    mcq, short, rest = modules.third_quota(F.col("_total"))
    easy, medium, hard = modules.difficulty_quota(F.col("_total"))
    why = F.concat(F.lit("Based on "), F.col("_n").cast("string"), F.lit(" content chunks covering "), F.size("_concepts").cast("string"), F.lit(" key concepts"))
    record = F.struct(
        F.col("_id").alias("document_id"),
        F.col("_title").alias("document_title"),
        T.summary(F.col("_content"), F.col("_concepts")).alias("summary"),
        F.slice("_concepts", 1, 15).alias("key_concepts"),
        F.col("_tree").alias("module_structure"),
        F.map_from_entries("_covered").alias("concept_coverage"),
        F.struct(mcq.alias("mcq"), short.alias("short"), rest.alias("conceptual"), F.col("_total").alias("total"), why.alias("rationale")).alias("suggested_distribution"),
        F.struct(easy.alias("easy"), medium.alias("medium"), hard.alias("hard")).alias("difficulty_distribution"),
        T.learning_objectives(F.col("_content")).alias("learning_objectives"),
        T.prerequisites(F.col("_content")).alias("prerequisites"),
    )
    return rows.select(F.col("_id").alias(id_col), record.alias("analysis"))


def as_variant(record: Column) -> Column:
    """A nested record as it is stored."""
    return F.parse_json(F.to_json(record, {"ignoreNullFields": "false"}))


def by_model_or_rules(replies: DataFrame, records: DataFrame, id_col: str, reply_col: str) -> DataFrame:
    """(id, syllabus_analysis variant, module_structure variant, made_by): the model's analysis where its reply holds one, else the rules'.

    A reply counts if the JSON object found in it has an array ``modules``; null, broken and
    other replies do not. ``records`` is what ``analysis_records`` made of the same ids.
    """
    blob = T.strip(F.regexp_replace(T.json_object(F.col(reply_col)), "```json|```", ""))
    said = replies.select(F.col(id_col).alias("_id"), F.try_parse_json(blob).alias("_said"))
    told = F.try_variant_get("_said", "$.modules", "array<variant>")
    said = said.withColumn("_said", F.when(told.isNotNull(), F.col("_said")))
    met = records.join(said, records[id_col] == F.col("_id"), "left").withColumn("_rules", as_variant(F.col("analysis")))
    by = F.when(F.col("_said").isNotNull(), "model").otherwise("rules")
    tree = F.when(F.col("_said").isNotNull(), F.try_variant_get("_said", "$.modules", "variant")).otherwise(F.variant_get("_rules", "$.module_structure", "variant"))
    return met.select(id_col, F.when(F.col("_said").isNotNull(), F.col("_said")).otherwise(F.col("_rules")).alias("syllabus_analysis"), tree.alias("module_structure"), by.alias("made_by"))


def on_sources(documents: DataFrame, analyses: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """Documents with the analysis of the selection they are a source of (``sources``: analysis_id, document_id); others keep theirs.

    ``analyses`` is (analysis_id, syllabus_analysis, module_structure). Of several selections of
    a document the last by number counts, as the last one stored does.
    """
    last = sources.groupBy("document_id").agg(F.max("analysis_id").alias("analysis_id"))
    new = last.join(analyses, "analysis_id").select(F.col("document_id").alias("_key"), F.col("syllabus_analysis").alias("_analysis"), F.col("module_structure").alias("_tree"))
    met = documents.join(new, documents[key] == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    out = {"syllabus_analysis": F.when(hit, F.col("_analysis")).otherwise(F.col("syllabus_analysis")), "module_structure": F.when(hit, F.col("_tree")).otherwise(F.col("module_structure"))}
    return met.withColumns(out).drop("_key", "_analysis", "_tree")
