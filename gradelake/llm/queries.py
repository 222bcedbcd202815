"""The registered queries of the training-text operators, with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradelake.llm import bpe_codec, decontam, embedding_dedup, katz, lang_id, manifest, paragraph_dedup, periodic_runs, secrets, simhash, suffix_dedup, token_counts, url_filter
from gradelake.llm.common import dealt_out, table, written

VOCABULARY = "byte_bpe_50k.json"
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(VOCABULARY)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.suffix_dedup(docs, length=50)
    return found.select("doc_id", "n_bytes", "n_removed", F.size(F.coalesce("starts", F.array().cast("array<int>"))).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.simhash_components(docs, words=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return embedding_dedup.embedding_classes(vectors, cosine=0.98)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "llr")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    benchmark = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontam.contamination(docs, benchmark)


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with what is removed of it and the short lines that repeat or nearly repeat earlier ones and stay."""
    docs = table(spark, sf_dir, "documents", spread=False).select("doc_id", "text")
    repeats = written(paragraph_dedup.repeated_units(docs, spread=dealt_out), "repeats")
    short = paragraph_dedup.short_equal(repeats)
    gone = paragraph_dedup.removals(paragraph_dedup.stretches(repeats))
    told = docs.select("doc_id").distinct().join(gone, "doc_id", "left").join(short, "doc_id", "left").join(paragraph_dedup.short_near(repeats), "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return told.select("doc_id", n("n_removed"), n("n_chars_removed"), F.coalesce("kept_docs", F.array().cast("array<long>")).alias("kept_docs"), n("n_short_repeats"), n("n_short_chars"), n("n_short_near"), n("n_short_near_chars"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    profiles = lang_id.language_profiles(docs.where(fold != 2))
    judged = lang_id.identify(docs.withColumn("held_out", F.coalesce(fold == 2, F.lit(False))).drop("lang"), profiles)
    return judged.select("doc_id", "held_out", "lang_pred", "score")


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_codec.encode_decode(docs, public_tokenizers.path(VOCABULARY))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets.secret_scan(docs, keep_text=False)
    n = lambda c: F.size(c).cast("long")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_list", 256).alias("base_sha256"), F.col("span_list").alias("spans"), n("owned_spans").alias("n_owned"), n("copied_spans").alias("n_copied"))


def ascii_lower(text: Column) -> Column:
    """A to Z lower-cased, other letters as they are."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document by hash is looked at again with its text in lower case."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    made = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], found={"text": ascii_lower(F.col("text"))}, changed=tampered)
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _repeated_tails(docs: DataFrame) -> DataFrame:
    """Every tenth document by hash repeats a stretch of its words from a place on, as the query's contract has it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    rows = docs.withColumn("_w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    rows = rows.withColumns({"_a": F.when(F.size("_w") > 0, g % F.size("_w")), "_n": F.size("_w")})
    rows = rows.withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8)))
    again = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get(F.col("_w"), (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return rows.withColumn("text", F.when(F.col("_n") > 0, F.array_join(again, " ")).otherwise(F.col("text"))).drop("_w", "_a", "_n", "_p")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic_runs.periodic_runs(_repeated_tails(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period = -F.col("_b.s"), -F.col("_b.p")
    return rows.select("doc_id", "n_runs", start.alias("start"), F.col("_b.l").alias("length"), period.alias("period"), F.floor(F.col("_b.l") * 1000 / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7
    scored = katz.katz_scores(docs, fold != 2)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_PART = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}"))

#: CRC-32 bit by bit, and trees as recursive aggregates: runs of 8 nodes, level by level.
_MANIFEST = f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 3 = 0 AS changed FROM documents),
l AS (SELECT doc_id, g, sha256({_LEAF.format(text="text")}) AS leaf, CASE WHEN changed THEN sha256({_LEAF.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS claim FROM d),
i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l),
t(g, level, pos, n, h) AS (SELECT g, 0, idx, n, leaf FROM i UNION ALL SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, level, n, pos // 8),
s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, pos, n, h) AS (SELECT 0, idx, n, subroot FROM s UNION ALL SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY level, n, pos // 8),
runs AS (SELECT g, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM t WHERE n > 1 GROUP BY ALL),
tops AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM u WHERE n > 1 GROUP BY ALL),
f(doc_id, g, level, pos, acc, proof) AS (SELECT doc_id, g, 0, idx, coalesce(claim, leaf), '' FROM i UNION ALL
    SELECT f.doc_id, f.g, f.level + 1, f.pos // 8, sha256(array_to_string(list_transform(r.hs, lambda h, k: CASE WHEN k - 1 = f.pos % 8 THEN f.acc ELSE h END), '')), f.proof || array_to_string(list_filter(r.hs, lambda h, k: k - 1 <> f.pos % 8), '') FROM f JOIN runs r ON r.g = f.g AND r.level = f.level AND r.run = f.pos // 8),
e AS (SELECT doc_id, g, arg_max(acc, level) AS acc, arg_max(proof, level) AS proof FROM f GROUP BY doc_id, g),
v(doc_id, subroot, level, pos, acc, proof) AS (SELECT e.doc_id, s.subroot, 0, s.idx, e.acc, e.proof FROM e JOIN s USING (g) UNION ALL
    SELECT v.doc_id, v.subroot, v.level + 1, v.pos // 8, sha256(array_to_string(list_transform(r.hs, lambda h, k: CASE WHEN k - 1 = v.pos % 8 THEN v.acc ELSE h END), '')), v.proof || array_to_string(list_filter(r.hs, lambda h, k: k - 1 <> v.pos % 8), '') FROM v JOIN tops r ON r.level = v.level AND r.run = v.pos // 8),
w AS (SELECT doc_id, any_value(subroot) AS subroot, arg_max(acc, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM v GROUP BY doc_id)
SELECT i.doc_id, i.leaf, w.subroot, (SELECT h FROM u WHERE n = 1) AS root, w.proof_sha256, w.folded_root, w.folded_root = (SELECT h FROM u WHERE n = 1) AS verified FROM i JOIN w USING (doc_id)"""


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_suffix_dedup, op3_simhash_dedup, op4_embedding_dedup, op5_url_filters, op6_benchmark_decontamination, op7_paragraph_dedup, op8_language_id, op9_bpe_codec, op10_secret_scans, op11_merkle_manifest, op12_periodic_runs, op13_lm_scoring)}
ORACLE: dict[str, str] = {"op11_merkle_manifest": _MANIFEST}
