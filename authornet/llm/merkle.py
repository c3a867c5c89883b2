"""Merkle manifest of a dataset: a leaf per row, a tree per group, one root over the groups' roots.

A tree's leaves are numbered in order and dealt into aligned blocks of ``fanout ** height`` leaves, the
"partitions" of the method; a task hashes one block up to its subtree root.  The upper levels are a butterfly
exchange: in round r the ``fanout`` blocks whose numbers differ in digit r alone swap the roots of the subtrees they
stand for, and each of them hashes the ancestor by itself.  After the last round every block holds the tree's root
and all siblings on its way up, so no pass goes down again.  A block beyond the last one takes part as an empty
partner, which keeps every exchange at ``fanout`` rows; empty subtrees hash to nothing.

The roots of the groups are the leaves of one more tree, built by the same functions.

Edge cases: null fields hash as ``-``; null groups and ids come first; rows that repeat an id are ordered by
their leaf, equal rows stand side by side; a tree of one leaf is that leaf; an empty table gives an empty manifest;
extra columns are ignored; text length has no bound (the leaf is hashed by Spark, texts are never moved).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from authornet.session import broadcast_offsets

from . import common

FANOUT = 2
# levels hashed inside one task: blocks of 4,096 leaves for a fanout of 2
BLOCK_LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7
# rounds between two written tables (each round is one small shuffle)
ROUNDS_A_STAGE = 8


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """Hash of all fields: ``-`` for null, else UTF-8 length, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
             for c in fields]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(level: list[str], fanout: int) -> list[str]:
    """The next level: every run of ``fanout`` nodes becomes its hash."""
    return [digest("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]


def block_levels(nodes: list[str], fanout: int, height: int | None) -> list[list[str]]:
    """The nodes and all levels above them: up to one node, or exactly ``height`` levels
    where the block is part of a larger tree."""
    levels = [nodes]
    while len(levels[-1]) > 1 if height is None else len(levels) <= height:
        levels.append(fold(levels[-1], fanout))
    return levels


def siblings(levels: list[list[str]], at: int, fanout: int) -> list[tuple[str, str]]:
    """(left, right) siblings of node ``at`` on every level below the top."""
    path = []
    for level in levels[:-1]:
        first = at - at % fanout
        path.append(("".join(level[first:at]), "".join(level[at + 1:first + fanout])))
        at //= fanout
    return path


def fold_path(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest(left + node + right)
    return node


def numbered(nodes: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """``nodes`` with ``pos`` (rank in its tree, nulls first) and ``n_nodes``: one range sort, then
    the offsets of a small table of counts per task and tree."""
    low = (1 << 33) - 1  # monotonically_increasing_id: the task above bit 33, the row below
    ranged = nodes.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    at = common.write_shared(ranged.withColumn("_at", F.monotonically_increasing_id()), f"{name}-sorted")
    at = at.withColumn("_part", F.shiftright("_at", 33)).withColumn("_nth", F.col("_at").bitwiseAND(F.lit(low)))
    runs = at.groupBy(F.col(tree).alias("_tree"), "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_nth").alias("_first"))
    before = Window.partitionBy("_tree").orderBy("_part")  # a row per task that holds rows of the tree
    runs = runs.select("_tree", F.col("_part").alias("_of"), "_first",
                       F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
                       F.sum("_n").over(Window.partitionBy("_tree")).alias("n_nodes"))
    runs = broadcast_offsets(runs)
    return (at.join(runs, (F.col("_part") == F.col("_of")) & F.col(tree).eqNullSafe(F.col("_tree")))
            .withColumn("pos", F.col("_start") + F.col("_nth") - F.col("_first"))
            .drop("_at", "_part", "_nth", "_of", "_tree", "_first", "_start"))


def blocks_of(nodes: DataFrame, tree: str, keep: list[str], fanout: int, height: int) -> DataFrame:
    """One row per block: tree, block, n_blocks, its nodes in order with the columns of
    ``keep``, and the root of its subtree."""
    size = fanout ** height
    dealt = nodes.select(F.col(tree).alias("tree"), F.floor(F.col("pos") / size).cast("long").alias("block"),
                         F.ceil(F.col("n_nodes") / size).cast("long").alias("n_blocks"), "pos", "node", *keep)
    fields = dealt.schema
    inner = pa.struct([("node", pa.string())] + [(c, _arrow(fields[c].dataType.typeName())) for c in keep])
    kept = ", ".join(f"`{c}`: {fields[c].dataType.simpleString()}" for c in keep)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        one = {c: table.column(c)[0].as_py() for c in ("tree", "block", "n_blocks")}
        nodes_here = table.column("node").to_pylist()
        top = block_levels(nodes_here, fanout, None if one["n_blocks"] == 1 else height)[-1][0]
        rows = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in ("node", *keep)],
                                          fields=list(inner))
        return pa.table({"tree": pa.array([one["tree"]], pa.string()), "block": pa.array([one["block"]], pa.int64()),
                         "n_blocks": pa.array([one["n_blocks"]], pa.int64()), "root": pa.array([top], pa.string()),
                         "rows": pa.ListArray.from_arrays([0, len(rows)], rows)})

    return dealt.groupBy("tree", "block").applyInArrow(
        run, f"tree string, block bigint, n_blocks bigint, root string, rows array<struct<node: string{', ' + kept if kept else ''}>>")


def _arrow(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "string": pa.string(), "integer": pa.int32()}[kind]


def butterfly(roots: DataFrame, fanout: int) -> DataFrame:
    """``roots`` (tree, block, n_blocks, root) -> (tree, block, root of the tree, path): in round r
    blocks that differ in digit r alone exchange the roots of their subtrees."""
    most = roots.agg(F.max("n_blocks")).first()[0] or 1
    rounds, span = 0, 1
    while span < most:
        rounds, span = rounds + 1, span * fanout
    state = roots.select("tree", "block", "n_blocks", "root", F.array().cast("array<struct<left: string, right: string>>").alias("path"))
    if not rounds:
        return state.select("tree", "block", "root", "path")
    # the last block of a tree brings the empty partners that fill its span: the smallest power that holds all blocks
    spans = F.array(*[F.lit(fanout ** r).cast("long") for r in range(rounds + 1)])
    span = F.array_min(F.filter(spans, lambda s: s >= F.col("n_blocks")))
    gaps = state.filter((F.col("block") == F.col("n_blocks") - 1) & (span > F.col("n_blocks"))).select(
        "tree", F.explode(F.sequence(F.col("n_blocks"), span - 1)).alias("block"), "n_blocks",
        F.lit(None).cast("string").alias("root"), "path")
    state = state.unionByName(gaps)
    for r in range(rounds):
        step = fanout ** r
        digit = F.pmod(F.floor(F.col("block") / step), F.lit(fanout)).cast("int")
        open_ = F.col("n_blocks") > step  # the tree still has several nodes on this level
        member = F.struct(digit.alias("digit"), "block", "root", "path")
        met = state.withColumn("_digit", digit).groupBy(
            "tree", "n_blocks", F.when(open_, F.col("block") - F.col("_digit") * step).otherwise(F.col("block")).alias("_group")
        ).agg(F.array_sort(F.collect_list(member)).alias("all"))  # fanout rows, or the block alone
        text = lambda rows: F.concat_ws("", F.transform(rows, lambda m: m["root"]))
        some = F.exists("all", lambda m: m["root"].isNotNull())
        parent = F.when(open_ & some, F.sha2(text(F.col("all")).cast("binary"), 256)).otherwise(F.element_at("all", 1)["root"])
        each = met.select("tree", "n_blocks", "all", parent.alias("root"), F.explode("all").alias("m"))
        left = F.filter("all", lambda o: o["digit"] < F.col("m.digit"))
        right = F.filter("all", lambda o: o["digit"] > F.col("m.digit"))
        hop = F.array(F.struct(text(left).alias("left"), text(right).alias("right")))
        state = each.select("tree", F.col("m.block").alias("block"), "n_blocks", "root",
                            F.when(open_, F.concat("m.path", hop)).otherwise(F.col("m.path")).alias("path"))
        if (r + 1) % ROUNDS_A_STAGE == 0:
            state = common.write_shared(state, "merkle-round")
    return state.filter(F.col("block") < F.col("n_blocks")).select("tree", "block", "root", "path")


def _trees(nodes: DataFrame, tree: str, order: list[str], keep: list[str], fanout: int, height: int,
           name: str) -> tuple[DataFrame, DataFrame]:
    """(blocks with their rows, butterfly state per block)."""
    blocks = common.write_shared(blocks_of(numbered(nodes, tree, order, name), tree, keep, fanout, height), f"{name}-blocks")
    ways = common.write_shared(butterfly(blocks.select("tree", "block", "n_blocks", "root"), fanout), f"{name}-ways")
    return blocks, ways


def manifest(rows: DataFrame, tree: str = "tree", fanout: int = FANOUT, height: int = BLOCK_LEVELS) -> DataFrame:
    """``rows``: (key long, ``tree`` string, node: leaf digest, changed: digest to verify).  Returns per row key,
    leaf, subroot, root, proof_sha256, folded_root, verified.  Leaves of a tree ascend by key."""
    blocks, ways = _trees(rows.select("key", tree, "node", "changed"), tree, ["key", "node", "changed"], ["key", "changed"],
                          fanout, height, "merkle")
    tops = ways.filter(F.col("block") == 0).select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("node"))
    top_blocks, top_ways = _trees(tops, "tree", ["name"], ["name"], fanout, height, "merkle-top")
    upper = _opened(top_blocks, top_ways, fanout, height)
    whole = ways.select(F.col("tree").alias("_tree"), F.col("block").alias("_block"), F.col("root").alias("subroot"), "path")
    with_top = whole.join(upper, F.col("_tree").eqNullSafe(F.col("name"))).drop("name")
    joined = blocks.select("tree", "block", "n_blocks", "rows").join(
        with_top, (F.col("block") == F.col("_block")) & F.col("tree").eqNullSafe(F.col("_tree")))
    hops = lambda way: [(h["left"], h["right"]) for h in way]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                above = hops(row["path"]) + hops(row["top_path"])
                levels = block_levels([x["node"] for x in row["rows"]], fanout, None if row["n_blocks"] == 1 else height)
                out = {k: [] for k in ("key", "leaf", "proof_sha256", "folded_root")}
                for at, x in enumerate(row["rows"]):
                    path = siblings(levels, at, fanout) + above
                    out["key"].append(x["key"])
                    out["leaf"].append(x["node"])
                    out["proof_sha256"].append(digest("".join(left + right for left, right in path)))
                    out["folded_root"].append(fold_path(x["changed"], path))
                n = len(row["rows"])
                out["key"] = pa.array(out["key"], pa.int64())
                yield pa.RecordBatch.from_pydict({
                    **out, "subroot": [row["subroot"]] * n, "root": [row["root"]] * n,
                    "verified": [f == row["root"] for f in out["folded_root"]]})

    return joined.select("n_blocks", "rows", "path", "subroot", "root", "top_path").mapInArrow(
        run, "key bigint, leaf string, proof_sha256 string, folded_root string, subroot string, root string, verified boolean")


def _opened(blocks: DataFrame, ways: DataFrame, fanout: int, height: int) -> DataFrame:
    """Per node of the top tree: name, root, top_path (its siblings from its own level to the root)."""
    joined = blocks.select("block", "n_blocks", "rows").join(ways.select("block", "root", "path"), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for row in batch.to_pylist():
                levels = block_levels([x["node"] for x in row["rows"]], fanout, None if row["n_blocks"] == 1 else height)
                paths = [[{"left": a, "right": b} for a, b in siblings(levels, at, fanout)] + row["path"]
                         for at in range(len(row["rows"]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["name"] for x in row["rows"]], pa.string()), pa.array([row["root"]] * len(paths), pa.string()),
                     pa.array(paths, kind)], names=["name", "root", "top_path"])

    return joined.select("n_blocks", "rows", "root", "path").mapInArrow(
        run, "name string, root string, top_path array<struct<left: string, right: string>>")


def tampered(doc_id: Column) -> Column:
    """True where a multiple of 7 is the CRC-32 of the decimal id; null ids are left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))


def op12_merkle(spark: SparkSession, sf_dir: str, fanout: int = FANOUT, height: int = BLOCK_LEVELS) -> DataFrame:
    """All documents as leaves of a tree per lang (one row per document)."""
    docs = common.documents(spark, sf_dir)
    fields = [F.col(c) for c in FIELDS]
    changed = [F.col(c).cast("long") + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    leaves = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("lang").alias("tree"), leaf_hash(fields).alias("node"),
                         F.when(tampered(F.col("doc_id")), leaf_hash(changed)).alias("new"))
    leaves = leaves.select("key", "tree", "node", F.coalesce("new", "node").alias("changed"))
    out = manifest(common.write_shared(leaves, "merkle-leaves"), fanout=fanout, height=height)
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
