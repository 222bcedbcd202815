"""Secret scan with corpus-wide ownership frequency; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.llm.common import written

# The patterns of the base kinds, in their listed order. Runs of hex digits and
# access keys are taken only at the least length; a shorter run cannot hold a longer one.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the ownership method: web tokens of three parts, and long runs of key characters
#: with a digit and a letter. An equals sign is part of a run only as padding at its end, so that
#: the value of NAME=value is a run of its own.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?:eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}|(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?)"
KINDS = ("assign", "access", "hex", "owned")
#: A credential in use stands in few files; what more repositories with texts of their own hold is a sample.
MAX_REPOS = 20
_SPAN = "array<struct<start:int,end:int,rank:int,value:string>>"


def _spans(text: Column, pattern: str, rank: int, value_group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between matches give the places: a match starts where the pieces and matches
    before it end. Matches whose value is shorter than ``least`` are dropped afterwards.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("match"), values.alias("value"))
    none = F.array().cast(_SPAN)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["piece"])
        end = start + F.coalesce(F.length(part["match"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), part["value"].alias("value"))
        keep = part["match"].isNotNull() & (F.length(part["value"]) >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["out"], F.array(span).cast(_SPAN))).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    folded = F.aggregate(parts, start, step, lambda s: s["out"])
    return F.when(F.regexp_like(text, F.lit(pattern)), folded).otherwise(none)


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    kind = F.array(*map(F.lit, KINDS))
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"])))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _hash(span: Column) -> Column:
    return F.sha2(span["value"], 256)


def suspicious(text: Column) -> Column:
    """Whether a text holds a base match or a candidate run; a null text does not."""
    return F.coalesce(F.regexp_like(text, F.lit(ASSIGN)) | F.regexp_like(text, F.lit(ACCESS)) | F.regexp_like(text, F.lit(HEX)) | F.regexp_like(text, F.lit(CANDIDATE)), F.lit(False))


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base_spans``, ``candidates`` (arrays of start, end, rank, value) and ``content`` to each row; one narrow pass.

    Candidates are the credentials themselves: the value of each base span (of an assignment
    only what is assigned), and each web token or long mixed run that no base span overlaps.
    ``content`` is a digest of the text of rows with a candidate, which tells exact copies.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, 0, 2, 6), _spans(text, ACCESS, 1), _spans(text, HEX, 2))
    found = docs.withColumn("base_spans", base).withColumn("_wide", _spans(text, CANDIDATE, 3))
    apart = F.filter("_wide", lambda c: ~F.exists("base_spans", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    # The value of an assignment ends where the match ends.
    of_base = F.transform("base_spans", lambda b: F.struct((b["end"] - F.length(b["value"])).alias("start"), b["end"].alias("end"), F.lit(3).alias("rank"), b["value"].alias("value")))
    found = found.withColumn("candidates", F.array_distinct(F.concat(of_base, apart))).drop("_wide")
    return found.withColumn("content", F.when(F.size("candidates") > 0, F.sha2(text, 256)))


def ownership(found: DataFrame, repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(hash, n_repos, n_owners) of each candidate value of a scanned table, over the whole corpus.

    Exact copies of a text that an owner has are one repository, the least of theirs. A null
    repository counts as one, and so does a null owner. Rows are counted by value, owner and
    text, then by repository, before each shuffle; a repository counts for each owner it has.
    """
    each = found.select(F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), "content", F.explode(F.array_distinct(F.transform("candidates", _hash))).alias("hash"))
    by_text = each.groupBy("hash", "owner", "content").agg(F.min("repo").alias("repo"))
    by_owner = by_text.select("hash", "owner", "repo").distinct().groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def judged(found: DataFrame, owners: DataFrame, repo_col: str = "doc_id", max_owners: int = 1, max_repos: int = MAX_REPOS) -> DataFrame:
    """Scanned rows with ``owned_spans``, ``copied_spans``, the base counts, ``base_list`` and ``span_list``.

    A value is live if at most ``max_owners`` owners and at most ``max_repos`` repositories hold
    it. Only the rows that have a candidate are joined with ``owners`` (hash, n_repos, n_owners):
    each of their distinct values once, by the value, and back by a number of the row.
    """
    found = found.withColumn("_row", F.xxhash64(F.col(repo_col), F.col("candidates")))
    asked = found.where(F.size("candidates") > 0).select("_row", "candidates").distinct()
    asked = asked.select("_row", F.explode(F.array_distinct(F.transform("candidates", _hash))).alias("hash"))
    few = owners.where((F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)).select("hash")
    live = asked.join(few, "hash").groupBy("_row").agg(F.collect_set("hash").alias("_live"))
    live = live.withColumnRenamed("_row", "_lrow")
    some = F.size("candidates") > 0
    joined = found.where(some).join(live, F.col("_row") == F.col("_lrow"), "left").drop("_lrow")
    out = joined.unionByName(found.where(~some).withColumn("_live", F.lit(None).cast("array<string>"))).drop("_row")
    is_live = lambda s: F.coalesce(F.array_contains(F.col("_live"), _hash(s)), F.lit(False))
    out = out.withColumns({"owned_spans": F.filter("candidates", is_live), "copied_spans": F.filter("candidates", lambda s: ~is_live(s))})
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["rank"] == k)).cast("long")
    out = out.withColumns({"n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_list": _listed(F.col("base_spans")), "span_list": _listed(F.concat("base_spans", "owned_spans"))})
    return out.drop("_live", "candidates", "content")


_MADE = ["base_spans", "owned_spans", "copied_spans", "n_assign", "n_access", "n_hex", "base_list", "span_list"]


def secret_scan(docs: DataFrame, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1, max_repos: int = MAX_REPOS, keep_text: bool = True) -> DataFrame:
    """Add ``base_spans``, ``owned_spans``, ``copied_spans`` (arrays of start, end, rank, value), the three base counts, ``base_list`` and ``span_list``.

    Base kinds are the three fixed patterns. The method adds spans of kind ``owned``: candidate
    credentials (values of base spans, web tokens and long mixed runs) that at most
    ``max_owners`` distinct owners and at most ``max_repos`` distinct repositories hold over the
    whole corpus, in however many exact copies: they look live. Candidates that more owners or
    more repositories hold are ``copied_spans``: widely copied examples. By default a document
    is a repository and its source the owner; a null owner counts as one of its own, and so
    does a null repository.

    A null or empty text has no spans; texts of any length are taken whole; spans that start
    alike are listed by kind, then end. Repeated rows count once for a repository and each get
    their spans; an empty table gives none. Other columns pass through; columns named as a
    result are replaced.

    Without ``keep_text`` the text goes, and what one pass of the patterns found is written to
    the shared folder and read for the counts and the result. With it, the rows with a match or
    candidate are written there, the others are only told by the patterns.
    """
    others = [c for c in docs.columns if (c not in _MADE or c in (text_col, repo_col, owner_col)) and (keep_text or c != text_col)]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"))
    hot = suspicious(F.col("text")) if keep_text else F.lit(True)
    found = written(scan(rows.where(hot)).drop("text"), "scanned")
    out = judged(found, written(ownership(found, "repo", "owner"), "owners"), "repo", max_owners, max_repos).select("row.*", *_MADE)
    if not keep_text:
        return out
    none, zero = F.array().cast(_SPAN), F.lit(0).cast("long")
    empty = {"base_spans": none, "owned_spans": none, "copied_spans": none, "n_assign": zero, "n_access": zero, "n_hex": zero, "base_list": F.lit(""), "span_list": F.lit("")}
    return out.unionByName(rows.where(~hot).select("row.*").withColumns(empty))


def masked(docs: DataFrame, mask: str, text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", max_owners: int = 1, max_repos: int = MAX_REPOS) -> DataFrame:
    """The rows with each stretch of ``text_col`` that spans cover replaced by ``mask``; null texts stay null.

    Of a base span of the assign kind the whole match goes, name and value. Overlapping spans
    are one stretch. Texts without a match or candidate are told by the patterns alone and are
    neither joined nor shuffled. Nulls, long texts, repeated rows, clashing names and empty
    tables are as in ``secret_scan``.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"))
    found = written(scan(row.where(suspicious(F.col("text")))), "scanned")
    found = judged(found, written(ownership(found, "repo", "owner"), "owners"), "repo", max_owners, max_repos)
    spans = F.array_sort(F.concat("base_spans", "owned_spans"))

    def step(state: Column, span: Column) -> Column:
        start, end = span["start"], F.greatest(span["end"], state["at"])
        between = F.substring("text", state["at"] + 1, F.greatest(start - state["at"], F.lit(0)))
        fresh = F.concat(state["out"], between, F.lit(mask))
        return F.struct(end.alias("at"), F.when(start < state["at"], state["out"]).otherwise(fresh).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.lit(2**31 - 1))))
    clean = F.when(F.size(spans) > 0, clean).otherwise(F.col("text"))
    changed = found.select(*[(clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
    return docs.where(~suspicious(F.col(text_col))).unionByName(changed)
