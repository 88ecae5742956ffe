"""A Merkle manifest of a dataset: leaf digests, a root over trees of groups, and a proof for each row.

Rows are leaves. In each group (a language, say) leaves stand in the order of their ids; as long as there is more than one
node, each two in a row, and a last single one too, become the digest of their digests. What remains is the group's
subroot, and subroots in the order of their groups are the leaves of the last tree. A proof is what lies beside a leaf's
way to the root.

Both directions are time-forward processing. A node's label is its level and place; a node sends its digest to
its parent under the parent's label, and a priority queue hands the messages over in the order of labels, so that all
children of a node have come when its turn is. The reversed sweep takes labels from the top down: a node sends what it
knows about the way to the root to its children, with each one's sibling put before it. The queue is external: labels
are cut into pieces of 2^``LEVELS`` leaves and the levels over them. Messages that leave a piece go through
Spark's sorted exchange, which spills, and written tables; those that stay inside are in a heap of one task, which holds
one piece at a time. N leaves take log2 N / LEVELS rounds up and as many down.

Leaves are numbered by range partitions of (group, id, digest) and offsets from each partition's counts, so that no group
is sorted or numbered in one task; a group that holds a third of all rows is many pieces.

Nulls in any column have an encoding of their own (``-``). A null group is one of its own and comes first; null ids come first in their
group. Ties (rows with one id) stand by their digests; repeated rows are leaves each. Texts of any length are hashed
whole. Other columns are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.llm.scratch import materialise

#: Levels that a task goes up at once, and so the leaves of a piece.
LEVELS = 12
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 of the columns, each with its length in bytes before it, ``-`` for null."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[part(c.cast("string")) for c in columns]), 256)


def height(n: int) -> int:
    """Levels over n nodes."""
    return (n - 1).bit_length()


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves (grp, ...) with pos, their place in the group from 0 by ``order``, and n, the group's size; written."""
    own = F.monotonically_increasing_id()
    ranged = leaves.withColumn("at", own).repartitionByRange("grp", *order, "at").sortWithinPartitions("grp", *order, "at").drop("at")
    # Places within a partition, and which partition it is, in ascending order of the ranges.
    ranged = materialise(ranged.withColumns({"part": F.spark_partition_id(), "at": own}), "ranged")
    counts = ranged.groupBy("grp", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = F.sum("c").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("grp", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(Window.partitionBy("grp")).alias("n"))
    return materialise(ranged.join(starts, ["grp", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift"), "leaves")


def sweep(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of all nodes over a piece's leaves, level by level, from a queue of messages by label."""
    nodes = [list(digests)] + [[] for _ in range(levels)]
    queue = [(1, i >> 1, i, d) for i, d in enumerate(digests)] if levels else []  # in order, so a heap
    while queue:
        level, place, _, d = heapq.heappop(queue)
        children = [d]
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        node = digest(*children)
        nodes[level].append(node)
        if level < levels:
            heapq.heappush(queue, (level + 1, place >> 1, place, node))
    return nodes


def reversed_sweep(nodes: list[list[str]], proof: str) -> list[str]:
    """The proof of each leaf of a piece, given that of its top node."""
    queue = [(1 - len(nodes), 0, proof)]
    out = [""] * len(nodes[0])
    while queue:
        level, place, proof = heapq.heappop(queue)
        if not level:
            out[place] = proof
            continue
        below = nodes[-level - 1]
        pair = range(2 * place, min(2 * place + 2, len(below)))
        for child in pair:
            heapq.heappush(queue, (level + 1, child, "".join(below[s] for s in pair if s != child) + proof))
    return out


def fold(leaf: str, pos: int, n: int, proof: str) -> tuple[str, str]:
    """What a leaf and its proof give at the top of a tree of n, and what of the proof is left."""
    while n > 1:
        if pos ^ 1 < n:
            sibling, proof = proof[:64], proof[64:]
            leaf = digest(sibling, leaf) if pos & 1 else digest(leaf, sibling)
        else:
            leaf = digest(leaf)
        pos, n = pos >> 1, (n + 1) >> 1
    return leaf, proof


def _piece(table: pa.Table, up: int) -> tuple[pa.Table, int, int]:
    """A piece's nodes in their order, the size of its group's level, and the levels over it that it has."""
    table = table.sort_by("pos")
    n = table["n"][0].as_py()
    return table, n, min(up, height(n))


def _pieces(nodes: DataFrame, up: int):
    """Grouped by group and piece; the shuffle goes by both, so a group isn't one key."""
    return nodes.withColumn("piece", F.shiftright("pos", up)).groupBy("grp", "piece")


def climb(nodes: DataFrame, up: int) -> list[DataFrame]:
    """Tables (grp, pos, n, digest, ...): the leaves, the nodes ``up`` levels over them, and so on to the tops."""

    def top_of(table: pa.Table) -> pa.Table:
        table, n, levels = _piece(table, up)
        top = sweep(table["digest"].to_pylist(), levels)[-1][0]
        return pa.table({"grp": table["grp"][:1], "pos": pa.array([table["pos"][0].as_py() >> up]), "n": pa.array([-(-n >> up)]), "digest": pa.array([top])})

    out = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        out.append(materialise(_pieces(out[-1].select("grp", "pos", "n", "digest"), up).applyInArrow(top_of, "grp string, pos long, n long, digest string"), "nodes"))
        if (largest := -(-largest >> up)) == 1:
            return out


def descend(levels: list[DataFrame], known: DataFrame, up: int, own: list[str], schema: str, finish: Callable[[pa.Table, list[str], pa.Table], pa.Table]) -> DataFrame:
    """From what is known at the tops (grp, proof, and the columns ``own`` of a group) to the leaves' proofs."""
    known = known.withColumn("pos", F.lit(0).cast("long"))

    def down(nodes: pa.Table, above: pa.Table) -> tuple[pa.Table, list[str]]:
        table, _, levels = _piece(nodes, up)
        return table, reversed_sweep(sweep(table["digest"].to_pylist(), levels), above["proof"][0].as_py())

    def inner(nodes: pa.Table, above: pa.Table) -> pa.Table:
        table, proofs = down(nodes, above)
        return pa.table({"grp": table["grp"], "pos": table["pos"], "proof": pa.array(proofs, pa.string())} | {c: pa.repeat(above[c][0], len(proofs)) for c in own})

    def leaves(nodes: pa.Table, above: pa.Table) -> pa.Table:
        return finish(*down(nodes, above), above)

    kinds = dict(known.dtypes)
    between = f"grp string, pos long, proof string, {', '.join(f'{c} {kinds[c]}' for c in own)}"
    for i in range(len(levels) - 2, -1, -1):
        above = known.withColumnRenamed("pos", "piece").groupBy("grp", "piece")
        pairs = _pieces(levels[i], up).cogroup(above)
        known = materialise(pairs.applyInArrow(inner, between), "proofs") if i else pairs.applyInArrow(leaves, schema)
    return known


def manifest(docs: DataFrame, tampered: Column | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "lang", up: int = LEVELS) -> DataFrame:
    """For each row of ``docs``: doc_id, leaf, subroot, root, proof (siblings' digests up to the root), folded_root and verified.

    ``tampered``: an expression for n_chars to be hashed in place of it when a leaf is checked against its proof.
    ``up``: the levels of a piece.
    """
    cols = [F.col(c) for c in columns]
    changed = [c if tampered is None or name != "n_chars" else tampered for name, c in zip(columns, cols)]
    # Groups in the order of their UTF-8 bytes; the mark tells the empty name from null, which comes first.
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = docs.select(grp.alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(cols).alias("digest"), leaf_digest(changed).alias("shown"))
    trees = climb(numbered(materialise(leaves, "digests"), ["doc_id", "digest"]), up)
    tops = trees[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("digest"))
    crown = climb(numbered(tops, ["name"]), up)
    root = crown[-1].select("grp", F.lit("").alias("proof"), F.col("digest").alias("root"))

    def subroots(table: pa.Table, proofs: list[str], above: pa.Table) -> pa.Table:
        k = len(proofs)
        return pa.table({
            "grp": table["name"], "proof": pa.array(proofs, pa.string()), "subroot": table["digest"], "root": pa.repeat(above["root"][0], k), "top_pos": table["pos"], "top_n": table["n"],
        })

    known = materialise(descend(crown, root, up, ["root"], "grp string, proof string, subroot string, root string, top_pos long, top_n long", subroots), "subroots")

    def checked(table: pa.Table, proofs: list[str], above: pa.Table) -> pa.Table:
        subroot, root, top_pos, top_n = (above[c][0].as_py() for c in ("subroot", "root", "top_pos", "top_n"))
        folded = []
        for leaf, pos, n, proof in zip(table["shown"].to_pylist(), table["pos"].to_pylist(), table["n"].to_pylist(), proofs):
            top, rest = fold(leaf, pos, n, proof)
            folded.append(fold(top, top_pos, top_n, rest)[0])
        k = len(proofs)
        return pa.table({
            "doc_id": table["doc_id"], "leaf": table["digest"], "subroot": pa.array([subroot] * k, pa.string()), "root": pa.array([root] * k, pa.string()),
            "proof": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": pa.array([x == root for x in folded], pa.bool_()),
        })

    schema = "doc_id long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
    return descend(trees, known, up, ["subroot", "root", "top_pos", "top_n"], schema, checked)
