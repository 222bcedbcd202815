"""The pipeline against a plain-Python version of its stages."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gradelake.llm import simhash

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["lorem", "ipsum", "dolor", "amet", "velit"]) + str(r.randrange(90)) for _ in range(n))


def write(spark, folder, rows):
    item = prose(77, 20)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    item = prose(77, 20)
    texts = {1: prose(1, 80), 2: prose(1, 80), 3: prose(3, 60) + " " + item, 4: None, 5: "12 34 !", 6: prose(6, 50) + " token = hunter2hunter2 end", 7: "", 8: prose(8, 200) + "\n\té😀", 9: prose(1, 79) + " other"}
    write(spark, str(tmp_path), [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in texts.items()])
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    prints = {i: simhash.fingerprint(t, 5) for i, t in left.items()}
    group = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 7:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i and item not in t}
    left = {i: t.replace("token = hunter2hunter2", corpus_pipeline.MASK) for i, t in left.items()}
    assert 2 not in left and 3 not in left and 6 in left
    assert set(got) == set(left)
    for i, t in left.items():
        assert list(got[i].ids) == LIBRARY.encode(t, add_special_tokens=False).ids and got[i].n_tokens == len(got[i].ids) and got[i].round_trip


def jaccard(a, b):
    a, b = (set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_go_by_jaccard_and_only_by_it(spark, tmp_path):
    r = random.Random(5)
    texts = {}
    for g in range(60):
        base = prose(1000 + g, 150).split()
        edited = list(base)
        for at in r.sample(range(2, 148), 3):
            edited[at] = f"other{r.randrange(10**6)}"
        texts[2 * g], texts[2 * g + 1] = " ".join(base), " ".join(edited)
    texts[500], texts[501] = "a b c d e f g h", "a b c d e f g x"  # Jaccard 0.6
    group = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((group[i], group[j]))
                group = {k: a if g == b else g for k, g in group.items()}
    want = {i for i in texts if group[i] == i}
    far = sum((simhash.fingerprint(texts[2 * g], 5) ^ simhash.fingerprint(texts[2 * g + 1], 5)).bit_count() > 7 for g in range(60) if group[2 * g + 1] == 2 * g)
    assert far > 10 and {500, 501} <= want
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    assert {x.doc_id for x in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()} == want


def test_rows_of_one_id_and_different_texts_are_judged_apart(spark, tmp_path):
    one, two = prose(1, 60), prose(2, 60)
    rows = [(1, one, "en", "s", 1), (2, one, "en", "s", 1), (2, two, "en", "s", 1), (3, two, "en", "b", 1), (2, two, "en", "a", 1), (None, one, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted(((x.doc_id, x.text, x.source) for x in got), key=repr) == sorted([(1, one, "s"), (2, two, "a"), (None, one, "s")], key=repr)


def test_stages_keep_their_columns_and_stand_empty_tables(spark, tmp_path):
    write(spark, str(tmp_path), [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "bpe_codec" or out.columns == docs.columns)


def test_stages_stand_awkward_rows_and_clashing_names(spark, tmp_path):
    """Null and repeated ids, nulls in any column, long texts, and columns named like what operators make."""
    write(spark, str(tmp_path), [])
    long = prose(9, 20000)
    texts = [(1, prose(1, 80)), (1, prose(1, 80)), (1, prose(2, 80)), (None, prose(3, 80)), (None, None), (4, None), (5, long), (6, "token = hunter2hunter2"), (7, ""), (8, " \n ")]
    extra = ["id", "th", "pid", "key", "row", "repo", "owner", "_live", "ids", "component", "fingerprint", "lang_pred", "score", "base_spans", "candidates", "h"]
    docs = spark.createDataFrame([(i, t, None, None, None, *["x"] * len(extra)) for i, t in texts], SCHEMA + "".join(f", {c} string" for c in extra))
    named = docs.withColumn("lang", F.lit("en"))
    assert corpus_pipeline.languages(spark, named, str(tmp_path)).count() == 6
    near = corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in near if r.doc_id is not None) == sorted([(1, texts[0][1]), (1, texts[2][1]), (4, None), (5, long), (6, texts[7][1])])
    assert corpus_pipeline.benchmark_leaks(spark, docs, str(tmp_path)).count() == len(texts)
    masked = corpus_pipeline.secret_masks(spark, docs, str(tmp_path))
    assert masked.columns == docs.columns and sorted((r.text or "" for r in masked.collect())) == sorted((t or "").replace("token = hunter2hunter2", corpus_pipeline.MASK) for _, t in texts)
    assert all(r.id == "x" and r.candidates == "x" and r.row == "x" for r in masked.collect())
    assert sorted(r.n_tokens for r in corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()) == sorted(len(LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t in texts)
