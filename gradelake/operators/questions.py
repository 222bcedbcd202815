"""Question sets: chunk pools, module filters, weighted selection, templates and the grounding guard."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradelake.functions import text as T

# The question templates, in the order they take turns. {n} stands for the first
# n characters of the chunk.
TEMPLATES = {
    "mcq": [
        ("Medium", 5, 'A system implements the approach described: "{100}…". What outcome does the document indicate will result?', "{140}", ["The system fails due to missing integration", "Performance degrades without manual intervention", "No measurable change occurs"], "Tests application of the documented principle to a scenario."),
        ("Medium", 5, 'According to the text, which condition is necessary for "{80}…" to be effective?', "{140}", ["High computational resources alone", "Complete automation without human oversight", "Isolated data silos"], "Tests understanding of necessary conditions from the document."),
        ("Hard", 10, 'The document states: "{90}…". Which misconception does this directly address?', "{140}", ["That the approach works without data integration", "That legacy systems are incompatible", "That real-time processing is optional"], "Tests ability to identify the misconception the document corrects."),
        ("Medium", 5, 'When applying the principle "{80}…", what is the key trade-off mentioned?', "{140}", ["Speed vs. accuracy with no middle ground", "Cost vs. quality with linear relationship", "Complexity vs. maintainability with no solution"], "Tests understanding of trade-offs documented in the text."),
        ("Easy", 5, 'The document describes a mechanism where "{80}…". What role does X play in this mechanism?', "{140}", ["Passive data storage only", "Independent decision maker", "Redundant backup system"], "Tests functional understanding of components in the documented mechanism."),
        ("Hard", 10, 'Based on "{90}…", what would be the consequence of omitting the described step?', "{140}", ["Process completes faster with same quality", "No impact on final outcome", "Alternative pathway activates automatically"], "Tests causal reasoning from the documented process."),
    ],
    "short": [
        ("Medium", 10, 'The document states: "{100}…". Explain the mechanism by which this achieves its stated purpose in 2-3 sentences.', "The mechanism works by {180}. This enables the described outcome through the documented process.", [], "Requires explaining the documented mechanism in own words."),
        ("Medium", 10, 'Based on "{90}…", describe the relationship between the key components mentioned and why this relationship matters.', "The relationship is {180}. This matters because the document indicates this connection drives the documented outcome.", [], "Tests synthesis of component relationships from the text."),
        ("Hard", 15, 'Why does the document recommend "{80}…" over alternative approaches? Provide reasoning from the text.', "The document recommends this because {180}. Alternatives lack this specific capability as noted in the text.", [], "Tests ability to extract justification from the document."),
        ("Medium", 10, 'How does the approach "{80}…" address the problem or limitation described in the document?', "It addresses this by {180}. The document shows this directly resolves the stated limitation.", [], "Tests problem-solution mapping from the text."),
        ("Hard", 15, 'Explain the trade-off between the factors mentioned in "{90}…" and how the document suggests balancing them.', "The trade-off is {180}. The document suggests balancing by the documented approach.", [], "Tests understanding of documented trade-offs and resolutions."),
        ("Medium", 10, 'What is the significance of "{80}…" in the broader context described by the document?', "Its significance is {180}. The document positions this as a key enabler for the overall framework.", [], "Tests contextual understanding of the documented concept."),
    ],
    "conceptual": [
        ("Hard", 15, 'Critique this claim using ONLY the document: "The approach described in "{80}…" is sufficient for all scenarios." Support your position with evidence from the text.', "The document shows {160}. This indicates limitations in scenarios not covered by the documented conditions.", [], "Tests critical evaluation using only document evidence."),
        ("Hard", 15, "Apply the concept \"{80}…\" to a new scenario: [describe a related but different context]. What adaptations would the document's principles require?", "The document's principle of {160} would need adaptation for the new context by modifying the documented parameters.", [], "Tests transfer of documented principles to new contexts."),
        ("Hard", 15, 'What would happen if the component "{70}…" were removed from the system described? Predict consequences using the document.', "Removing it would {160}. The document indicates this component is essential for the documented outcome.", [], "Tests causal reasoning and system thinking from the text."),
        ("Hard", 15, "How does the principle \"{80}…\" relate to [different domain concept] in a way the document implies but doesn't explicitly state?", "The document's principle of {160} shares the structural pattern of [domain concept] in that both require the documented condition.", [], "Tests analogical reasoning grounded in the document."),
        ("Hard", 15, "Design a follow-up validation experiment based on the finding \"{90}…\" that would test the document's claims.", "An experiment would test {160} by varying the documented parameters and measuring the stated outcomes.", [], "Tests experimental design thinking grounded in the document."),
        ("Hard", 15, 'What are the implications of "{80}…" for scaling the described system? Justify using the document.', "The implications are {160}. The document suggests scaling requires maintaining the documented relationships.", [], "Tests implication analysis for system scaling from the text."),
    ],
}
DEFAULT_CONCEPT = {"mcq": "Core Principles", "short": "Iterative Learning", "conceptual": "Generalization"}
TYPES = ("mcq", "short", "conceptual")


def requested(types: dict[str, int] | None, most: int = 50) -> dict[str, int]:
    """The asked counts by type: 2 each by default, none below 0, in all 1 to ``most``."""
    types = {"mcq": 2, "short": 2, "conceptual": 2} if types is None else types
    counts = {t: max(0, int(types.get(t) or 0)) for t in TYPES}
    if not 1 <= sum(counts.values()) <= most:
        raise ValueError(f"total questions must be between 1 and {most}")
    return counts


def split_total(total: int) -> dict[str, int]:
    """Counts by type when none is asked: thirds, halves to even, the rest conceptual."""
    third = max(1, round(total / 3))
    return {"mcq": third, "short": third, "conceptual": total - 2 * third}


def chunk_limit(total: int) -> int:
    return min(max(2 * total, 8), 20)


def normalised_weights(weights: DataFrame, weight_col: str = "weight", group: list[str] | None = None) -> DataFrame:
    """Weights held to 0.1 to 1 and divided by their sum (over ``group`` or all rows)."""
    held = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col(weight_col)))
    rows = weights.withColumn("_w", held)
    if group:
        return rows.withColumn("share", F.col("_w") / F.sum("_w").over(Window.partitionBy(*group))).drop("_w")
    total = rows.agg(F.sum("_w").alias("_sum")).withColumn("_k", F.lit(1))
    return rows.withColumn("_k", F.lit(1)).join(total, "_k").withColumn("share", F.col("_w") / F.col("_sum")).drop("_w", "_sum", "_k")


def pooled(chunks: DataFrame, weights: DataFrame, n_docs: int, doc_col: str = "doc_id") -> DataFrame:
    """Chunks of the selected documents with their weight; a missing or zero one is 1 / n_docs."""
    w = weights.select(doc_col, F.col("weight").alias("_w"))
    given = F.when(F.coalesce("_w", F.lit(0.0)) == 0, F.lit(1.0 / max(1, n_docs))).otherwise(F.col("_w"))
    return chunks.join(w, doc_col, "left").withColumn("weight", given).drop("_w")


def in_modules(chunks: DataFrame, modules: DataFrame, wanted: Column, doc_col: str = "doc_id") -> DataFrame:
    """Chunks that the wanted modules or their topics list, by document and chunk; all chunks if they list none.

    The fall-back is one flag, joined to the chunks; nothing is counted on the driver.
    """
    indices = F.col("chunk_indices")
    kind = modules.schema["topics"].dataType.simpleString() if "topics" in modules.columns else ""
    if "chunk_indices" in kind:  # a tree: topics list chunks of their own
        indices = F.concat(indices, F.flatten(F.transform("topics", lambda t: t["chunk_indices"])))
    listed = modules.where(wanted).select(doc_col, F.explode(indices).alias("chunk_id")).distinct()
    kept = chunks.join(listed.withColumn("_in", F.lit(True)), [doc_col, "chunk_id"], "left")
    any_kept = kept.agg(F.coalesce(F.bool_or("_in"), F.lit(False)).alias("_any")).withColumn("_k", F.lit(1))
    out = kept.withColumn("_k", F.lit(1)).join(any_kept, "_k").where(F.col("_in") | ~F.col("_any"))
    return out.drop("_in", "_any", "_k")


def weighted_selection(chunks: DataFrame, total: int, doc_col: str = "doc_id", seed: str | None = None) -> DataFrame:
    """The chunks with the largest weight, as many as ``total`` questions need; ``place`` counts from 0.

    Ties go by document and chunk, or by a digest of ``seed`` with both where one is given.
    """
    tie = [doc_col, "chunk_id"] if seed is None else [F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_col), F.col("chunk_id"))), doc_col, "chunk_id"]
    best = chunks.orderBy(F.desc("weight"), *tie).limit(chunk_limit(total))
    tie_columns = [F.desc("weight"), *tie]
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*tie_columns)) - 1)


def focus_sample(chunks: DataFrame, total: int, seed: str, doc_col: str = "doc_id") -> DataFrame:
    """``total`` chunks, or all if fewer, first by a digest of ``seed`` with document and chunk; ``place`` counts from 0."""
    order = [F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_col), F.col("chunk_id"))), doc_col, "chunk_id"]
    best = chunks.orderBy(*order).limit(total)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)) - 1)


def _filled(pattern: str, text: Column) -> Column:
    """The pattern with each {n} replaced by the first n characters of the text."""
    parts = re.split(r"\{(\d+)\}", pattern)
    return F.concat(*[F.left(text, F.lit(int(p))) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def template_questions(selected: DataFrame, types: dict[str, int] | None = None) -> DataFrame:
    """Questions from templates over a selection of chunks (``place``, ``text``), one row each.

    Types take turns through their six templates; question i takes chunk i modulo the number
    of chunks and concept i modulo the number of distinct concepts among the first three
    phrases of each chunk (20 at most). The answer of a multiple choice is its first option.
    """
    counts = requested(types)
    spark = selected.sparkSession
    rows = [(i, t, k % 6) for i, (t, k) in enumerate((t, k) for t in TYPES for k in range(counts[t]))]
    slots = spark.createDataFrame(rows, "i int, question_type string, template int").withColumn("_k", F.lit(1))
    clean = selected.select("place", T.clean_text(F.col("text")).alias("text"))
    pool = clean.agg(
        F.array_sort(F.collect_list(F.struct("place", "text"))).alias("chunks"),
    ).withColumn("_k", F.lit(1))
    phrases = F.flatten(F.transform("chunks", lambda c: F.slice(T.phrases(c["text"]), 1, 3)))
    pool = pool.withColumn("concepts", F.slice(F.array_distinct(phrases), 1, 20))
    met = slots.join(pool, "_k").where(F.size("chunks") > 0)
    chunk = F.get("chunks", F.col("i") % F.size("chunks"))["text"]
    fallback = F.coalesce(*[F.when(F.col("question_type") == t, c) for t, c in DEFAULT_CONCEPT.items()])
    concept = F.when(F.size("concepts") > 0, F.get("concepts", F.col("i") % F.greatest(F.size("concepts"), F.lit(1)))).otherwise(fallback)
    met = met.select("i", "question_type", "template", chunk.alias("text"), concept.alias("concept_tag"))

    def pick(make) -> Column:
        return F.coalesce(*[F.when((F.col("question_type") == t) & (F.col("template") == k), make(x)) for t in TYPES for k, x in enumerate(TEMPLATES[t])])

    text = F.col("text")
    answer = pick(lambda x: _filled(x[3], text))
    options = pick(lambda x: F.array(_filled(x[3], text), *map(F.lit, x[4])) if x[4] else F.lit(None).cast("array<string>"))
    return met.select(
        F.col("i").alias("question_no"),
        pick(lambda x: _filled(x[2], text)).alias("question_text"),
        "question_type",
        F.to_json(options).alias("options"),
        answer.alias("correct_answer"),
        "concept_tag",
        pick(lambda x: F.lit(x[0])).alias("difficulty"),
        pick(lambda x: F.lit(x[5])).alias("explanation"),
        text.alias("grounding_chunk"),
        pick(lambda x: F.lit(x[1])).cast("int").alias("points"),
    )


def grounded(questions: DataFrame, selected: DataFrame) -> DataFrame:
    """Questions whose citation is in the selected chunks; any other gets the first chunk's first 220 characters.

    A citation counts as found if its first 40 characters are; an empty one stays empty.
    """
    texts = F.array_sort(F.collect_list(F.struct("place", "text")))
    pool = selected.agg(texts.alias("_c")).select(F.array_join(F.transform("_c", lambda c: c["text"]), " ").alias("_all"), F.get(F.transform("_c", lambda c: c["text"]), F.lit(0)).alias("_first")).withColumn("_k", F.lit(1))
    met = questions.withColumn("_k", F.lit(1)).join(pool, "_k")
    g = F.coalesce("grounding_chunk", F.lit(""))
    lost = (g != "") & (F.col("_all") != "") & ~F.contains("_all", F.left(g, F.lit(40)))
    return met.withColumn("grounding_chunk", F.when(lost, F.left("_first", F.lit(220))).otherwise(F.col("grounding_chunk"))).drop("_k", "_all", "_first")


def normalised_replies(replies: DataFrame, raw_col: str, least: int = 4, total: int | None = None, selected: DataFrame | None = None) -> DataFrame:
    """Questions from model replies: the JSON array found in each, its fields under either name, with defaults.

    A reply that does not parse or holds fewer than ``least`` questions gives none; of others
    the first ``total`` are taken. A missing citation is the start of the first chunk of
    ``selected`` (place, text), and one that its chunks do not hold is replaced by it. Points
    count by the whole number they begin with, in quotes or not; options are kept as they came.
    """
    item = "struct<question_text:string,question:string,question_type:string,options:string,correct_answer:string,answer:string,concept_tag:string,concept:string,difficulty:string,explanation:string,grounding_chunk:string,points:string>"
    parsed = F.from_json(T.json_array(F.col(raw_col)), f"array<{item}>")
    rows = replies.withColumn("_q", parsed).where(F.size(F.coalesce("_q", F.array().cast(f"array<{item}>"))) >= least)
    taken = F.col("_q") if total is None else F.slice("_q", 1, total)
    rows = rows.select(*[c for c in replies.columns if c != raw_col], F.posexplode(taken).alias("question_no", "_q"))
    f = lambda name: F.col(f"_q.{name}")
    difficulty = T.or_default(f("difficulty"), "Medium")
    whole = F.regexp_extract(f("points"), r"^\s*([+-]?\d{1,9})", 1).try_cast("int")
    by_difficulty = F.when(f("difficulty") == "Hard", 15).when(f("difficulty") == "Easy", 5).otherwise(10)
    made = rows.withColumns(
        {
            "question_text": T.or_default(f("question_text"), T.or_default(f("question"), "Untitled")),
            "question_type": F.lower(T.or_default(f("question_type"), "short")),
            "options": T.or_default(f("options"), F.lit(None).cast("string")),
            "correct_answer": T.or_default(f("correct_answer"), T.or_default(f("answer"), "")),
            "concept_tag": T.or_default(f("concept_tag"), T.or_default(f("concept"), "General")),
            "difficulty": difficulty,
            "explanation": T.or_default(f("explanation"), ""),
            "grounding_chunk": T.or_default(f("grounding_chunk"), ""),
            "points": F.coalesce(F.nullif(whole, F.lit(0)), by_difficulty),
        }
    ).drop("_q")
    if selected is None:
        return made
    first = selected.where("place = 0").select(F.left("text", F.lit(220)).alias("_first"), F.lit(1).alias("_k"))
    cited = made.withColumn("_k", F.lit(1)).join(first, "_k", "left").withColumn("grounding_chunk", T.or_default(F.col("grounding_chunk"), F.coalesce("_first", F.lit("")))).drop("_k", "_first")
    return grounded(cited, selected)


def sampling_key(weight: Column, seed: int, *parts: Column) -> Column:
    """A row's draw: the time of its first event at a rate of ``weight``, from a digest of seed and parts; null without a weight.

    The rows with the least draws are a weighted sample without replacement, the same in every
    run of a seed. Draws do not hang on other rows, so samples of parts merge.
    """
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((digest + 1) / F.lit(float(1 << 48))) / weight)


def weighted_sample(rows: DataFrame, weight: str, parts: list[str], k: int, seed: int) -> DataFrame:
    """``k`` rows with chances by ``weight``, without replacement, in the order they are drawn (``place``); ties by ``parts``.

    Each task keeps its own ``k`` first. Rows without a positive weight are never drawn.
    """
    drawn = rows.withColumn("_key", sampling_key(F.col(weight), seed, *[F.col(p) for p in parts])).where("_key is not null")
    few = drawn.orderBy("_key", *parts).limit(k)
    order = Window.partitionBy(F.lit(1)).orderBy("_key", *parts)
    return few.withColumn("place", F.row_number().over(order) - 1).drop("_key")


def generated(replies: DataFrame, raw_col: str, selected: DataFrame, types: dict[str, int], keys: list[str]) -> DataFrame:
    """The questions of each request (``keys``): the model's where its reply holds a set, else the rules'; with ``made_by``.

    A reply goes through all steps: its array is found, fields get their defaults, citations are
    held against the selection, and as many questions stay as are asked for. A null, broken or
    too short one falls back to the templates over the same selection.
    """
    columns = [*keys, "question_no", "question_text", "question_type", "options", "correct_answer", "concept_tag", "difficulty", "explanation", "grounding_chunk", "points"]
    asked = sum(requested(types).values())
    made = normalised_replies(replies, raw_col, total=asked, selected=selected).withColumn("made_by", F.lit("model"))
    local = template_questions(selected, types).withColumns({"_k": F.lit(1), "made_by": F.lit("rules")})
    each = replies.select(*keys, F.lit(1).alias("_k")).join(local, "_k").drop("_k")
    return with_fallback(made.select(*columns, "made_by"), each.select(*columns, "made_by"), keys)


# How many characters of each part go into a prompt.
CUTS = {"grounding_chunk": 500, "correct_answer": 500, "student_answer": 900}
CHUNK_CUT, PREVIEW, GENERATION_PREVIEW = 500, 8_000, 6_000


def evaluation_data(answers: DataFrame) -> DataFrame:
    """Answers with the texts of their question cut to what a judgement is asked with; null ones are empty.

    ``compact`` is these parts on one line, as the second model is asked.
    """
    cut = {c: F.left(F.coalesce(c, F.lit("")), F.lit(n)) for c, n in CUTS.items()}
    return answers.withColumns(cut).withColumn("compact", T.compact(F.concat_ws(" ", *CUTS)))


def generation_data(selected: DataFrame, content: Column, total: int) -> DataFrame:
    """(context, preview) for ``total`` questions: the chunks that a request of this size shows, and the start of the content."""
    shown = chunk_prompt(selected.where(F.col("place") < chunk_limit(total)))
    return shown.select(F.col("prompt").alias("context"), F.left(content, F.lit(GENERATION_PREVIEW)).alias("preview"))


def analysis_data(chunks: DataFrame, documents: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc, chunks, preview): each document's chunks, 500 characters of each, and the first 8,000 of its content."""
    number, page = (F.col("chunk_id") + 1).cast("string"), F.col("page").cast("string")
    line = F.concat(F.lit("[Chunk "), number, F.lit(" | Doc: "), F.col("title"), F.lit(" | p"), page, F.lit("]: "), F.left("text", F.lit(CHUNK_CUT)))
    listed = F.array_sort(F.collect_list(F.struct("chunk_id", line.alias("line"))))
    shown = chunks.groupBy(doc_col).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n").alias("chunks"))
    preview = documents.select(doc_col, F.left(F.coalesce("content", F.lit("")), F.lit(PREVIEW)).alias("preview"))
    return preview.join(shown, doc_col, "left").withColumn("chunks", F.coalesce("chunks", F.lit("")))


def existing_prompt(questions: DataFrame, most: int = 100) -> DataFrame:
    """(existing, tags): the first 80 characters of up to ``most`` known questions as a list, and their distinct concepts.

    The first by id are taken, so that the prompt is the same in every run.
    """
    rows = questions.orderBy("id").limit(most)
    listed = F.array_sort(F.collect_list(F.struct("id", F.left("question_text", F.lit(80)).alias("t"), "concept_tag")))
    texts = F.transform("_l", lambda x: x["t"])
    tags = F.array_distinct(F.transform("_l", lambda x: x["concept_tag"]))
    return rows.agg(listed.alias("_l")).select(F.array_join(texts, "\n- ").alias("existing"), F.array_join(tags, ", ").alias("tags"))


def chunk_prompt(selected: DataFrame, focus: bool = False) -> DataFrame:
    """(prompt): the chunks of a selection (place, title, page, text) as labelled paragraphs, or as focus chunks."""
    number = (F.col("place") + 1).cast("string")
    page, title = F.col("page").cast("string"), F.col("title")
    if focus:
        line = F.concat(F.lit("FOCUS CHUNK "), number, F.lit(" (Doc: "), title, F.lit(" | p"), page, F.lit("): "), F.col("text"))
    else:
        line = F.concat(F.lit("[Chunk "), number, F.lit(" | Doc: "), title, F.lit(" | p"), page, F.lit("]: "), F.col("text"))
    return selected.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n\n").alias("prompt"))


def with_fallback(made: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """What a model made, and for keys of which it made nothing, what the rules make; columns of ``local``."""
    missing = local.join(made.select(*keys).distinct(), keys, "left_anti")
    return made.select(*local.columns).unionByName(missing)
