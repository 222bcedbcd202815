"""The assessment domain seen in the benchmark tables, for Spark and, in the same words, for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradelake.operators.chunking import chunk_documents
from gradelake.operators.retrieval import indexed
from gradelake.sources.tables import table, written


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.concat(F.lower("c_name"), F.lit("@example.edu")).alias("email"), F.col("c_mktsegment").alias("segment"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    difficulty = F.when(F.col("p_size") <= 17, "Easy").when(F.col("p_size") <= 34, "Medium").otherwise("Hard")
    points = F.when(F.col("p_size") <= 17, 5).when(F.col("p_size") <= 34, 10).otherwise(15)
    return p.select(F.col("p_partkey").alias("id"), F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("long").alias("set_id"), F.col("p_type").alias("concept_tag"), difficulty.alias("difficulty"), points.alias("points"), F.col("p_name").alias("question_text"))


def question_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = questions(spark, sf_dir).select(F.col("set_id").alias("id")).distinct()
    due = F.to_date(F.lit("2024-01-01")) + F.col("id").cast("int")
    return ids.withColumns({"is_published": F.col("id") % 2 == 0, "due_date": F.when(F.col("id") % 5 != 0, due)})


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "evaluated").when(F.col("o_orderstatus") == "O", "submitted").otherwise("pending")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("student_id"), (F.col("o_orderkey") % 25 + 1).alias("set_id"), status.alias("status"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per line item; the raw score is before it is held to the question's points."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("submission_id"), F.col("l_partkey").alias("question_id"), F.floor(F.col("l_quantity") / 3).cast("int").alias("score"), (F.col("l_returnflag") == "N").alias("is_correct"))


def scored_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions with score and total from their answers; those without answers have none."""
    q = questions(spark, sf_dir).select(F.col("id").alias("question_id"), "points")
    a = answers(spark, sf_dir).join(q, "question_id").groupBy(F.col("submission_id").alias("id"))
    sums = a.agg(F.sum(F.greatest(F.lit(0), F.least("score", "points"))).cast("long").alias("score"), F.sum("points").cast("long").alias("total"))
    return submissions(spark, sf_dir).join(sums, "id", "left")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", spread=True)
    return d.select("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), F.col("source").alias("category"), "lang")


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which every fifth holds a table block and every seventh a visual block."""
    mark = F.when(F.col("doc_id") % 5 == 0, F.lit("\n[TABLE]\n| a | b |\n| --- | --- |\n| 1 | 2 |\n[/TABLE]\n\n\n\n| loose | row |\n")).otherwise(F.lit(""))
    visual = F.when(F.col("doc_id") % 7 == 0, F.lit("\n[VISUAL CONTENT p1]\nA figure.\n[/VISUAL CONTENT]\n[TABLE] left")).otherwise(F.lit(""))
    return documents(spark, sf_dir).withColumn("content", F.concat("content", mark, visual))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return chunk_documents(d, "doc_id", F.col("content"), F.col("title"))


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks written once, for queries that use them more than once, as documents are chunked once when they come in."""
    return written(chunks(spark, sf_dir), "chunks")


def chunk_index(spark: SparkSession, sf_dir: str, cited: bool = False) -> DataFrame:
    """The chunks with their terms, as the retrieval index stores them; ``cited``: with what a citation shows of them."""
    index = indexed(chunks(spark, sf_dir))
    return written(index if cited else index.drop("text", "tokens", "page", "title"), "chunk-index")


def headed_chunks(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """Chunks of which every fourth from the second on starts with a module header; ``stored``: written once, with their places and texts alone."""
    rows = chunks(spark, sf_dir)
    if stored:
        rows = written(rows.select("doc_id", "chunk_id", "text"), "chunks")
    head = F.concat(F.lit("Module "), F.floor((F.col("chunk_id") + 2) / 4).cast("string"), F.lit(": "))
    return rows.withColumn("text", F.when((F.col("chunk_id") % 4 == 2) & (F.col("doc_id") % 3 != 0), F.concat(head, F.col("text"))).otherwise(F.col("text")))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def free_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns followed by an assistant's: the answer is a prefix of the expected text, of 0 to all of it."""
    c = table(spark, sf_dir, "conversations")
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumns({"next_role": F.lead("role").over(order), "next_text": F.lead("text").over(order)})
    rows = rows.where("role = 'user' and next_role = 'assistant'")
    share = F.get(F.array(*map(F.lit, [0.0, 0.2, 0.5, 0.8, 1.0])), ((F.col("conv_id") + F.col("turn")) % 5).cast("int"))
    given = F.left("next_text", F.floor(F.length("next_text") * share).cast("int"))
    return rows.select("conv_id", "turn", F.col("next_text").alias("correct_answer"), given.alias("student_answer"))


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user as interactions: clicks, views as scrolls, others as cursor samples."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "click").when(F.col("event_type") == "view", "scroll").otherwise("cursor")
    k = F.get_json_object("props", "$.k").cast("int")
    start = F.min("ts").over(Window.partitionBy("user_id"))
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000
    return e.select("user_id", "event_id", F.floor(ms).cast("long").alias("t"), kind.alias("type"), F.concat(F.lit("button:"), k.cast("string")).alias("element"), (k % 101).alias("depth_pct"), (F.col("event_id") % 1000).alias("x"), (F.col("event_id") * 7 % 800).alias("y"))


#: White space, as an SQL pattern has it.
_S = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: The same views as common table expressions: name -> (views it needs, text).
VIEWS = {
    "students": ([], "SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.edu' AS email, c_mktsegment AS segment FROM customer"),
    "questions": ([], "SELECT p_partkey AS id, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS set_id, p_type AS concept_tag, CASE WHEN p_size <= 17 THEN 'Easy' WHEN p_size <= 34 THEN 'Medium' ELSE 'Hard' END AS difficulty, CASE WHEN p_size <= 17 THEN 5 WHEN p_size <= 34 THEN 10 ELSE 15 END AS points, p_name AS question_text FROM part"),
    "question_sets": (["questions"], "SELECT id, id % 2 = 0 AS is_published, CASE WHEN id % 5 <> 0 THEN DATE '2024-01-01' + CAST(id AS INTEGER) END AS due_date FROM (SELECT DISTINCT set_id AS id FROM questions)"),
    "submissions": ([], "SELECT o_orderkey AS id, o_custkey AS student_id, o_orderkey % 25 + 1 AS set_id, CASE o_orderstatus WHEN 'F' THEN 'evaluated' WHEN 'O' THEN 'submitted' ELSE 'pending' END AS status FROM orders"),
    "answers": ([], "SELECT l_orderkey AS submission_id, l_partkey AS question_id, CAST(floor(l_quantity / 3) AS INTEGER) AS score, l_returnflag = 'N' AS is_correct FROM lineitem"),
    "scored_submissions": (["questions", "answers", "submissions"], "SELECT s.*, a.score, a.total FROM submissions s LEFT JOIN (SELECT submission_id, CAST(sum(greatest(0, least(a.score, q.points))) AS BIGINT) AS score, CAST(sum(q.points) AS BIGINT) AS total FROM answers a JOIN questions q ON a.question_id = q.id GROUP BY submission_id) a ON s.id = a.submission_id"),
    "docs": ([], "SELECT doc_id, 'doc-' || doc_id AS title, text AS content, source AS category, lang FROM documents"),
    "marked": (["docs"], r"""SELECT doc_id, title, category, content || CASE WHEN doc_id % 5 = 0 THEN E'\n[TABLE]\n| a | b |\n| --- | --- |\n| 1 | 2 |\n[/TABLE]\n\n\n\n| loose | row |\n' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN E'\n[VISUAL CONTENT p1]\nA figure.\n[/VISUAL CONTENT]\n[TABLE] left' ELSE '' END AS content FROM docs"""),
    "chunk_lists": (["docs"], r"""SELECT doc_id, title, CASE WHEN trim_cur <> '' THEN list_append(r.out, trim_cur) ELSE r.out END AS texts FROM (
        SELECT doc_id, title, r, regexp_replace(r.cur, '^{S}+|{S}+$', '', 'g') AS trim_cur FROM (
        SELECT doc_id, title, list_reduce(list_prepend({'cur': '', 'out': []::VARCHAR[]}, list_transform(sents, lambda s: {'cur': s, 'out': []::VARCHAR[]})), lambda a, x:
            CASE WHEN a.cur <> '' AND length(a.cur) + length(x.cur) + 1 > 1100
            THEN {'cur': right(a.cur, 140) || ' ' || x.cur, 'out': list_append(a.out, regexp_replace(a.cur, '^{S}+|{S}+$', '', 'g'))}
            ELSE {'cur': regexp_replace(CASE WHEN a.cur <> '' THEN a.cur || ' ' || x.cur ELSE x.cur END, '^{S}+|{S}+$', '', 'g'), 'out': a.out} END) AS r
        FROM (SELECT doc_id, title, list_filter(string_split(regexp_replace(regexp_replace(content, '^{S}+|{S}+$', '', 'g'), '([.!?]){S}+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^{S}+|{S}+$', '', 'g') <> '') AS sents FROM docs)))""".replace("{S}", _S)),
    "chunks": (["chunk_lists"], r"""SELECT doc_id, title, CAST(i - 1 AS INTEGER) AS chunk_id, texts[i] AS text, CAST(len(list_filter(regexp_split_to_array(texts[i], '{S}+'), lambda w: w <> '')) AS INTEGER) AS tokens, CAST((i - 1) // 3 + 1 AS INTEGER) AS page, round(0.86 + (('0x' || substr(md5(texts[i]), 1, 8))::BIGINT % 100) / 600.0::DOUBLE, 3) AS grounding_score FROM (SELECT doc_id, title, texts, unnest(range(1, len(texts) + 1)) AS i FROM chunk_lists)""".replace("{S}", _S)),
    "headed": (["chunks"], "SELECT * REPLACE (CASE WHEN chunk_id % 4 = 2 AND doc_id % 3 <> 0 THEN 'Module ' || CAST((chunk_id + 2) // 4 AS VARCHAR) || ': ' || text ELSE text END AS text) FROM chunks"),
    "asked": ([], "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "free_answers": ([], "SELECT conv_id, turn, next_text AS correct_answer, left(next_text, CAST(floor(length(next_text) * ([0.0, 0.2, 0.5, 0.8, 1.0]::DOUBLE[])[(conv_id + turn) % 5 + 1]) AS INTEGER)) AS student_answer FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"),
    "interactions": ([], "SELECT user_id, event_id, CAST(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000) AS BIGINT) AS t, CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'scroll' ELSE 'cursor' END AS type, 'button:' || CAST(json_extract(props, '$.k') AS INTEGER) AS element, CAST(json_extract(props, '$.k') AS INTEGER) % 101 AS depth_pct, event_id % 1000 AS x, event_id * 7 % 800 AS y FROM events"),
}


def chunked(docs: str) -> str:
    """The text of ``chunk_lists`` over another view (doc_id, title, content)."""
    return VIEWS["chunk_lists"][1].replace("FROM docs)", f"FROM {docs})")


def sql(body: str, *views: str) -> str:
    """The text of a query over views, with all the views they need before them."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    heads = ",\n".join(f"{v} AS ({VIEWS[v][1]})" for v in order)
    return f"WITH {heads}\n{body}" if order else body
