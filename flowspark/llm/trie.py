"""Prefix trie of conversations by heavy-path decomposition.

A node is a distinct sequence of first turns. Its key is its depth and two exclusive-ors, over its turns, of 64-bit
hashes of a turn's content and position (128 bits together): they compose along a conversation in blocks, so a conversation of
any length is keyed without one task walking it, and taking the last turn out again gives the parent's key.

Each node's heavy child is that with the most conversations (the smallest id among equals); all other edges are light
and at least halve the conversations, so a way from the root crosses at most log2(conversations) light edges. Heavy edges
join nodes into paths, each of which ends in a leaf. The leaf's smallest conversation runs through its whole path, so a
path is that conversation's nodes from the depth of its last light edge on. Sums over subtrees then take one round for each number of
light edges, deepest first: suffix sums along the paths of a round (in blocks of bounded length), then each path's total
goes to the parent of its head, which lies on a path of the next round.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import delete_folder
from flowspark.llm.mixing import words_of
from flowspark.llm.ordering import lookup, positions
from flowspark.session import durable, shared_dir

NODE = ["k1", "k2", "depth"]
#: Turns of a conversation, or nodes of a path, that one window holds; ids that one string joins.
BLOCK, IDS_A_BLOCK = 1 << 16, 1 << 16
NO_IDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, t1, t2, words): the turns of each conversation from 1, with two hashes of role and text, and the words of the
    text. Order is by turn (null first), then role, then the text's hashes. Null role and text are empty; rows without a
    conversation id are left out. Texts themselves travel nowhere."""
    role, text = (F.coalesce(c, F.lit("")) for c in (role_col, text_col))
    turns = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), words_of(text).alias("words"),
        F.xxhash64(role, F.lit("turn"), text).alias("t1"), F.xxhash64(F.lit("content"), text, role).alias("t2"),
    )
    return positions(turns, "pos", ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "t1", "t2"]).select("conv_id", "pos", "t1", "t2", "words")


def _running(rows: DataFrame, groups: list[str], order: str, values: dict[str, Column], fold, neutral: Column, down: bool = False, block: int = BLOCK) -> DataFrame:
    """``rows`` with running ``fold``s of ``values`` along ``order`` (integers) within ``groups``, block by block; a table of one
    row a block carries what earlier blocks hold."""
    rows = rows.withColumn("block", F.floor(F.col(order) / block).cast("long"))
    way = (lambda c: F.col(c).desc()) if down else F.col
    inside = Window.partitionBy(*groups, "block").orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*groups).orderBy(way("block")).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*groups, "block").agg(*(fold(v).alias(n) for n, v in values.items()))
    carried = totals.select(*groups, "block", *(fold(F.col(n)).over(earlier).alias(f"earlier {n}") for n in values))
    carried = carried.where(F.col(f"earlier {next(iter(values))}").isNotNull())
    rows = rows.withColumns({n: fold(v).over(inside) for n, v in values.items()}).join(carried, [*groups, "block"], "left")
    both = {n: fold_two(F.col(n), F.coalesce(f"earlier {n}", neutral), fold) for n in values}
    return rows.withColumns(both).drop("block", *(f"earlier {n}" for n in values))


def fold_two(a: Column, b: Column, fold) -> Column:
    return a.bitwiseXOR(b) if fold is F.bit_xor else a + b


def _nodes(turns: DataFrame, turnless: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns with their nodes' keys, and the nodes with their own figures, parents and children."""
    mixed = {"k1": F.xxhash64("t1", "t2", "depth"), "k2": F.xxhash64(F.lit(1), "t2", "depth", "t1")}
    rows = turns.withColumns({"m1": mixed["k1"], "m2": mixed["k2"]})
    rows = _running(rows, ["conv_id"], "depth", {"k1": F.col("m1"), "k2": F.col("m2")}, F.bit_xor, F.lit(0))
    rows = durable(rows.select("conv_id", *NODE, F.col("k1").bitwiseXOR(F.col("m1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("m2")).alias("p2"), "words", "turns"))
    nodes = rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    everyone = rows.where("depth = 1").select("conv_id").unionByName(turnless.select("conv_id"))
    none = F.lit(None).cast("long")
    root = everyone.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(*(F.lit(0).cast("long").alias(c) for c in NODE), "n_convs", "conv_id", F.lit(0).cast("long").alias("words"), none.alias("p1"), none.alias("p2"))
    nodes = durable(nodes.unionByName(root))

    # The largest number of conversations, then the smallest id (the complement turns the order round).
    first = F.max(F.struct("n_convs", F.bitwise_not("conv_id").alias("turned")))["turned"]
    up = [F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"), F.bitwise_not(first).alias("heavy"))
    nodes = durable(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy").alias("parents_heavy"), F.col("n_children").alias("siblings"))
    below = lookup(nodes.where("depth > 0"), parents, ["p1", "p2", "depth"], "siblings")
    below = below.withColumn("light", (F.col("parents_heavy") != F.col("conv_id")).cast("long"))
    top = nodes.where("depth = 0").withColumns({"parent_conv_id": none, "light": F.lit(0).cast("long")})
    names = [*NODE, "conv_id", "n_convs", "words", "p1", "p2", "parent_conv_id", "n_children", "light"]
    return rows, durable(below.select(*names).unionByName(top.select(*names)))


def _on_paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with path (the conversation of the leaf it ends in), head (the depth it begins at) and level (light edges above)."""
    leaves = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"), F.col("depth").alias("bottom"))
    routes = lookup(rows.select(F.col("conv_id").alias("path"), *NODE), leaves, ["path"], "bottom").drop("bottom")
    routes = durable(lookup(routes, nodes.where("depth > 0"), NODE, "n_convs"))
    seen = routes.groupBy("path").agg(F.max(F.when(F.col("light") == 1, F.col("depth"))).alias("head"), F.sum("light").alias("level"))
    paths = leaves.join(seen, "path", "left").select("path", "bottom", F.coalesce("head", F.lit(0)).alias("head"), F.coalesce("level", F.lit(0)).alias("level"))
    paths = durable(paths)
    top = nodes.where("depth = 0").join(paths.where("head = 0").drop("bottom"), F.col("depth") == F.col("head"))  # one row each
    return lookup(routes, paths, ["path"], "bottom").where("depth >= head").drop("bottom").unionByName(top)


def _subtree_sums(placed: DataFrame, block: int) -> DataFrame:
    """``placed`` with n_leaves and saved_tokens over each node's subtree, one round a level."""
    spark = placed.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/trie-{uuid.uuid4().hex}"
    placed.write.partitionBy("level").parquet(folder)
    table = spark.read.schema(placed.schema).parquet(folder)
    deepest = table.agg(F.max("level")).first()[0]
    names = [*NODE, "conv_id", "n_convs", "parent_conv_id", "n_children", "n_leaves", "saved_tokens"]
    out, hung = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        own = table.where(F.col("level") == level).withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
        if hung is not None:
            own = own.join(hung, NODE, "left")
            own = own.withColumns({n: F.col(n) + F.coalesce(f"hung {n}", F.lit(0)) for n in ("n_leaves", "saved_tokens")})
        sums = _running(own, ["path"], "depth", {n: F.col(n) for n in ("n_leaves", "saved_tokens")}, F.sum, F.lit(0), down=True, block=block)
        sums = durable(sums.select(*names, "p1", "p2", "head"))
        hung = sums.where("depth = head and depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
        hung = hung.agg(F.sum("n_leaves").alias("hung n_leaves"), F.sum("saved_tokens").alias("hung saved_tokens"))
        out = sums.select(*names) if out is None else out.unionByName(sums.select(*names))
    delete_folder(spark, folder)
    return out if out is not None else placed.select(*NODE, "conv_id", "n_convs", "parent_conv_id", "n_children", F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))


def _digests(ends: DataFrame, ids_a_block: int) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): the digest of a node's ids, in order and comma-joined. Blocks of ids are joined to
    strings in parallel; a node's digest then runs over its strings in order, one at a time."""
    block = F.floor(F.col("conv_id") / ids_a_block).cast("long").alias("block")
    joined = ends.groupBy(*NODE, block).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    joined = joined.repartition(*NODE).sortWithinPartitions(*NODE, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*NODE, "ids")), strict=True):
                if key != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield made(done)
        if node is not None:
            yield made([(*node, digest.hexdigest())])

    def made(done: list) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[], [], [], []]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])

    return joined.mapInArrow(run, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, turnless: DataFrame, block: int = BLOCK, ids_a_block: int = IDS_A_BLOCK) -> DataFrame:
    """One row a node of the trie of (conv_id, depth from 1, t1, t2, words, turns: the conversation's number) and of the turnless
    conversations (conv_id): see ``conversation_trie``."""
    rows, nodes = _nodes(turns, turnless)
    sums = _subtree_sums(_on_paths(rows, nodes), block)
    at_root = turnless.select(*(F.lit(0).cast("long").alias(c) for c in NODE), "conv_id")
    ends = _digests(rows.where("depth = turns").select(*NODE, "conv_id").unionByName(at_root), ids_a_block)
    out = sums.join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_IDS)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The prefix trie of the conversations in ``df``, one row a node, the root (depth 0, without text) included.

    conv_id: the smallest conversation that begins with the node's turns; depth; parent_conv_id: that of the parent (root:
    null); n_convs: conversations that begin with it; n_children; n_leaves: childless nodes in its subtree, which includes
    itself; saved_tokens: summed over its subtree, (n_convs - 1) times the words of a node's last text, which is what
    storing each shared turn once saves; ends_sha256: SHA-256 of the ids, ascending and comma-joined, of the conversations
    that end at it (none: of the empty string).

    Turns are in order of ``turn_col`` (null first); rows of equal turn by role and then text hashes; repeated rows are turns
    of their own. Null role or text is empty. Rows without a conversation id are left out. Other columns are not read,
    whatever their names. An empty table has no conversation and so no node.
    """
    turns = durable(numbered_turns(df, conv_col, turn_col, role_col, text_col))
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    turns = lookup(turns.withColumnRenamed("pos", "depth"), lengths, ["conv_id"], "turns")
    return prefix_trie(turns, lengths.where("turns = 0"))
