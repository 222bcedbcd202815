"""A Merkle manifest of a table: a tree of digests for each group, a root over all, and proofs by looked-up coordinates.

Every node has a coordinate (group, level, position). What a node needs for its proof follows
from its position and its group's size alone, so proofs are made by joining coordinates with
the stored node table, not by walking trees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradelake.llm.common import union_all, written

ARITY_BITS = 3  # runs of 8
LEVELS = 2  # levels handled in one step: a block has 64 nodes, however large its group
BLOCK_BITS = ARITY_BITS * LEVELS

STEP = "array<struct<before:string,after:string>>"


def _text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def leaf_digest(fields: list[Column]) -> Column:
    """Hexadecimal SHA-256 of the fields' texts, each with its length in bytes before it; '-' for null."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with ``index`` in their ``group`` by ``order`` (nulls first) and the group's ``size``.

    Rows are dealt out by range and counted by task; a row's place is its place in its task and
    the number of rows of its group in the tasks before. Ties are cut by where a row was read,
    so neither a large group nor a row that repeats often meets in one task.
    """
    keys = [F.asc_nulls_first(c) for c in ["group", *order, "_tie"]]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_tie"), name)
    task = F.shiftrightunsigned("_at", 33)
    by_group = Window.partitionBy("group")
    before = F.sum("_n").over(by_group.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    runs = placed.groupBy("group", task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    runs = runs.select("group", "_task", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_n").over(by_group).alias("size"))
    runs = written(runs, f"{name}-runs")
    return placed.withColumn("_task", task).join(runs, ["group", "_task"]).withColumn("index", F.col("_at") + F.col("_offset")).drop("_at", "_task", "_offset")


def depth(size: Column) -> Column:
    """Levels above the leaves until one node remains."""
    bits = F.length(F.bin(size - 1))
    return F.when(size <= 1, 0).otherwise(F.floor((bits + ARITY_BITS - 1) / ARITY_BITS)).cast("int")


def _count(size: Column, level: int) -> Column:
    """Nodes of a group at a level."""
    return F.shiftright(size - 1, level * ARITY_BITS) + 1


def _siblings(level: int, own: Column) -> Column:
    """The coordinates (_level, _pos) of the nodes that stand beside one in its run."""
    first = F.shiftleft(F.shiftright(own, ARITY_BITS), ARITY_BITS)
    last = F.least(first + ((1 << ARITY_BITS) - 1), _count(F.col("size"), level) - 1)
    places = F.filter(F.sequence(first, F.greatest(first, last)), lambda x: x != own)
    return F.transform(places, lambda x: F.struct(F.lit(level).alias("_level"), x.alias("_pos")))


def _step(level: int, own: Column) -> Column:
    """What stands before and after a node at a level, from the nodes found for its block (``_s``)."""
    some = F.coalesce("_s", F.array().cast("array<struct<_level:int,_pos:bigint,digest:binary>>"))
    run = F.shiftright(own, ARITY_BITS)
    here = F.filter(some, lambda s: (s["_level"] == level) & (F.shiftright(s["_pos"], ARITY_BITS) == run))
    joined = lambda found: F.array_join(F.transform(found, lambda s: _text(s["digest"])), "")
    before, after = F.filter(here, lambda s: s["_pos"] < own), F.filter(here, lambda s: s["_pos"] > own)
    return F.array(F.struct(joined(before).alias("before"), joined(after).alias("after")))


def _nodes(digests: Column, level: int, first: Column) -> Column:
    return F.transform(digests, lambda d, i: F.struct(F.lit(level).alias("level"), (first + i).alias("pos"), d.alias("digest")))


def _parents(children: Column) -> Column:
    """The digests of each run of a block's nodes, given in order."""
    width = 1 << ARITY_BITS
    run = lambda i: F.transform(F.slice(children, i * width + 1, F.lit(width)), _text)
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(children) - 1) / width).cast("int")), lambda i: F.unhex(F.sha2(F.array_join(run(i), ""), 256)))


def node_table(leaves: DataFrame, name: str) -> DataFrame:
    """(group, size, level, pos, digest): all nodes above ``leaves`` (group, size, index, digest), and these.

    ``LEVELS`` levels are made in one step from blocks of at most 64 nodes, so a step is one
    shuffle, a group's block is bounded, and each step has a 64th of the last one's rows.
    """
    deepest = leaves.agg(F.max(depth(F.col("size")))).first()[0] or 0
    base = leaves.select("group", "size", F.lit(0).alias("level"), F.col("index").alias("pos"), "digest")
    tables = [base]
    for level in range(0, deepest, LEVELS):
        rows = base.where((F.col("level") == level) & (depth(F.col("size")) > level))
        blocks = rows.groupBy("group", "size", F.shiftright("pos", BLOCK_BITS).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest"))).alias("_l"))
        made = blocks.select("group", "size", "block", F.transform("_l", lambda x: x["digest"]).alias("l0"))
        for k in range(LEVELS):
            made = made.withColumn(f"l{k + 1}", _parents(F.col(f"l{k}")))
        nodes = []
        for k in range(1, LEVELS + 1):
            node = _nodes(F.col(f"l{k}"), level + k, F.shiftleft("block", ARITY_BITS * (LEVELS - k)))
            nodes.append(F.when(depth(F.col("size")) >= level + k, node).otherwise(F.slice(node, 1, 0)))
        base = written(made.select("group", "size", F.explode(F.concat(*nodes)).alias("n")).select("group", "size", "n.*"), f"{name}-{level}")
        tables.append(base)
    return union_all(tables)


def roots(nodes: DataFrame) -> DataFrame:
    """(group, size, digest) of each group's last node; a lone leaf is its own."""
    return nodes.where(F.col("level") == depth(F.col("size"))).select("group", "size", "digest")


def paths(leaves: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """``leaves`` with ``path``: for each level up to the group's root, what stands before and after the own digest.

    Nodes explode the coordinates of their siblings on the next ``LEVELS`` levels, from their
    position and the group's size; those of a block want the same ones, which are asked for
    once, joined with the node table and put in order. Leaves do so for the lowest levels, the
    nodes of the level above for the next ones, and so on: what is common to a block is handed
    down to its at most 64 nodes. So a coordinate is looked up once, at any size.
    """
    deepest = leaves.agg(F.max(depth(F.col("size")))).first()[0] or 0
    table = nodes.select("group", F.col("level").alias("_level"), F.col("pos").alias("_pos"), "digest")
    above = None
    for base in reversed(range(0, max(deepest, 1), LEVELS)):
        if base:
            units = nodes.where((F.col("level") == base) & (depth(F.col("size")) > base)).select("group", "size", "pos")
        else:
            units = leaves.withColumn("pos", F.col("index"))
        units = units.withColumn("_block", F.shiftright("pos", BLOCK_BITS))
        wanted = []
        for k in range(LEVELS):
            coordinates = _siblings(base + k, F.shiftright("pos", ARITY_BITS * k))
            wanted.append(F.when(depth(F.col("size")) > base + k, coordinates).otherwise(F.slice(coordinates, 1, 0)))
        asked = units.select("group", "_block", F.explode(F.concat(*wanted)).alias("_w")).select("group", "_block", "_w.*").distinct()
        found = asked.join(table, ["group", "_level", "_pos"]).groupBy("group", "_block").agg(F.array_sort(F.collect_list(F.struct("_level", "_pos", "digest"))).alias("_s"))
        met = units.join(found, ["group", "_block"], "left")
        if above is not None:
            met = met.join(above.select("group", F.col("pos").alias("_block"), F.col("path").alias("_up")), ["group", "_block"], "left")
        steps = [F.when(depth(F.col("size")) > base + k, _step(base + k, F.shiftright("pos", ARITY_BITS * k))).otherwise(F.array().cast(STEP)) for k in range(LEVELS)]
        if above is not None:
            steps.append(F.coalesce("_up", F.array().cast(STEP)))
        made = met.withColumn("path", F.concat(*steps))
        above = made.drop("_s", "_up", "_block", "pos") if base == 0 else written(made.select("group", "pos", "path"), f"{name}-{base}")
    return above


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "lang", found: dict[str, Column] | None = None, changed: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded_root, verified) of each row, digests in hexadecimal.

    A leaf is the digest of ``fields``. In each group, leaves ascend by id and every 8
    consecutive nodes become one until one remains, the subroot; subroots, ordered by group,
    likewise give the root. ``proof`` is the text of all sibling digests from leaf to root.
    ``found`` says what the fields are when the table is checked, on rows where ``changed``:
    ``folded_root`` is the root from what was found and the proof, and ``verified`` tells
    whether it is the root on record.

    Null fields, ids and groups count as such (first in order) and are not the same as empty
    ones; texts are digested whole at any length; rows that repeat are a leaf each, ties of ids
    go by digest; an empty table gives no rows. Columns other than those named are not read,
    so names cannot clash unless the id's is one of the results'.
    """
    spark = docs.sparkSession
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaf = leaf_digest([F.col(f) for f in fields])
    again = leaf_digest([(found or {}).get(f, F.col(f)) for f in fields])
    claim = F.when(F.lit(False) if changed is None else F.coalesce(changed, F.lit(False)), F.unhex(again))
    rows = written(docs.select(F.col(id_col).alias("id"), group.alias("group"), F.unhex(leaf).alias("digest"), claim.alias("claim")), "manifest-leaves")
    leaves = numbered(rows, ["id", "digest"], "manifest-numbered")
    nodes = node_table(leaves, "manifest-nodes")
    groups = roots(nodes)
    top = numbered(groups.select(F.lit("").alias("group"), F.col("group").alias("of"), "digest"), ["of"], "manifest-groups")
    top_nodes = node_table(top, "manifest-top")
    top_paths = paths(top, top_nodes, "manifest-top-paths")
    whole = roots(top_nodes).first()
    root = _text(F.lit(bytes(whole["digest"]) if whole else b""))
    top_paths = written(top_paths.select(F.col("of").alias("group"), F.col("digest").alias("subroot"), F.col("path").alias("up")), "manifest-subroots")
    out = paths(leaves, nodes, "manifest-paths").join(top_paths, "group")
    out = out.withColumn("path", F.concat("path", "up"))
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = out.select(F.col("id").alias(id_col), _text(F.col("digest")).alias("leaf"), _text(F.col("subroot")).alias("subroot"), root.alias("root"), proof.alias("proof"), folded(_text(F.coalesce("claim", "digest")), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
