"""Merkle manifest of a table: a hash tree over its rows whose parents keep the hash state before each child.

A row's leaf is the SHA-256 of its fields (``-`` for null, else byte count, ``:``, value).  Rows of one group (``lang``) ascend by id; while
more than one node is left, each run of eight becomes the SHA-256 of its digests as hex text.  What is left is the group's subroot; the
subroots, ordered by group, are joined into the root by the same rule.

* A parent hashes its children one by one and keeps a copy of its hash state before each child's slot.
* Folding a replaced row resumes its parent's state at the row's slot and hashes the replacement and the siblings right of it only; the
  siblings left of it are in the state.  So up to the root.
* A proof is the digest of all siblings, from the leaf's level to the root's: one running state a row.

Scale: the texts are read once, for the leaves.  Leaves are range-sorted by (group, id, leaf), numbered by counts per partition, and built in
blocks of ``ARITY ** DEPTH`` = 4,096 consecutive leaves, so a group that holds most rows is many tasks.  The blocks' tops are the leaves of the next
table, 4,096 times smaller, until one is left.  Back down, each node's path (its siblings, level by level) goes to
its block by a join on (group, block); there the states of the levels above are made once and resumed for every leaf.

Defined cases: an empty table has no rows and no root; equal ids order by leaf, null ids come first and are never tampered with; a null group
comes before all others; repeated rows are leaves of their own; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.util import lower_ascii, prepare, stage

ARITY = 8
DEPTH = 4
WIDTH = 64  # a digest as hex text
PATH = "path array<struct<left:string,right:string>>, subroot binary"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


@dataclass
class Level:
    """A level of a block: its nodes' digests as one hex text, and for each node its parent's hash state before the node's slot."""

    text: bytes
    kept: list

    def siblings(self, i: int) -> tuple[bytes, bytes]:
        """The siblings left and right of node ``i``."""
        run = i // ARITY * ARITY * WIDTH
        return self.text[run : i * WIDTH], self.text[(i + 1) * WIDTH : run + ARITY * WIDTH]


def build(nodes: list[bytes], total: int, depth: int = DEPTH) -> tuple[list[Level], bytes]:
    """The levels over a block's nodes, of which the whole group has ``total``, and the block's top."""
    levels = []
    while len(levels) < depth and total > 1:
        kept, parents = [], []
        for at in range(0, len(nodes), ARITY):
            state = sha256()
            for child in nodes[at : at + ARITY]:
                kept.append(state.copy())
                state.update(child)
            parents.append(state.hexdigest().encode())
        levels.append(Level(b"".join(nodes), kept))
        nodes, total = parents, -(-total // ARITY)
    return levels, nodes[0]


def fold(levels: list[Level], i: int, leaf: bytes) -> bytes:
    """The block's top with ``leaf`` in place ``i``: at each level the parent's state is resumed at the slot."""
    for lv in levels:
        state = lv.kept[i].copy()
        state.update(leaf + lv.siblings(i)[1])
        leaf, i = state.hexdigest().encode(), i // ARITY
    return leaf


def _hex(col) -> list[bytes]:
    return [d.hex().encode() for d in col.to_pylist()]


def _column(table: pa.Table, name: str, order: np.ndarray):
    return table.column(name).combine_chunks().take(pa.array(order))


def _block(t: pa.Table, depth: int) -> tuple[np.ndarray, list[bytes], list[Level], bytes]:
    """A block's rows in order, their digests, the levels over them and the top."""
    order = np.argsort(t.column("rank").to_numpy(), kind="stable")
    own = _hex(_column(t, "digest", order))
    return order, own, *build(own, t.column("total")[0].as_py(), depth)


def _tops(depth: int):
    """A block's top, as a node of the next table."""

    def run(t: pa.Table) -> pa.Table:
        _, _, levels, top = _block(t, depth)
        total = -(-t.column("total")[0].as_py() // ARITY ** len(levels))
        return pa.table([t.column("grp").slice(0, 1), t.column("block").slice(0, 1), pa.array([total]), pa.array([bytes.fromhex(top.decode())])], names=["grp", "rank", "total", "digest"])

    return run


def _paths(depth: int):
    """Each node's path: its siblings left and right, level by level, its block's own levels first."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        order, own, levels, _ = _block(nodes, depth)
        out = []
        for i in range(len(own)):
            steps = []
            for lv in levels:
                left, right = lv.siblings(i)
                steps.append({"left": left.decode(), "right": right.decode()})
                i //= ARITY
            out.append(steps + above.column("path")[0].as_py())
        path = pa.array(out, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        sub = pa.array([above.column("subroot")[0].as_py()] * len(own), pa.binary())
        return pa.table([_column(nodes, "grp", order), _column(nodes, "rank", order), path, sub], names=["grp", "block", "path", "subroot"])

    return run


def _prove(root: bytes, depth: int):
    def run(leaves: pa.Table, above: pa.Table) -> pa.Table:
        order, own, levels, _ = _block(leaves, depth)
        path = [(s["left"].encode(), s["right"].encode()) for s in above.column("path")[0].as_py()]
        resumed = [(sha256(left), right) for left, right in path]
        higher = b"".join(left + right for left, right in path)
        top, proofs, folded = root.hex().encode(), [], []
        for i, other in enumerate(_hex(_column(leaves, "replaced", order))):
            cur = fold(levels, i, other)
            for kept, right in resumed:
                state = kept.copy()
                state.update(cur + right)
                cur = state.hexdigest().encode()
            folded.append(cur)
            proof = sha256()
            for lv in levels:
                left, right = lv.siblings(i)
                proof.update(left + right)
                i //= ARITY
            proof.update(higher)
            proofs.append(proof.hexdigest())
        n, sub = len(own), above.column("subroot")[0].as_py().hex()
        cols = [_column(leaves, "doc_id", order), pa.array(own).cast(pa.string()), pa.array([sub] * n), pa.array([top.decode()] * n), pa.array(proofs), pa.array(folded).cast(pa.string())]
        return pa.table([*cols, pa.array([f == top for f in folded])], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def leaf(*fields):
    """The digest of a row's fields."""
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def number(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with each row's ``rank`` in its ``grp`` by the ``order`` columns (nulls first) and the group's ``total``, as a written table."""
    spark = df.sparkSession
    keys = ["grp", *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = stage(placed.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "sorted")
    runs = placed.groupBy("grp", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    whole = Window.partitionBy("grp")
    runs = runs.withColumn("__before", F.sum("__n").over(whole.orderBy("__part")) - F.col("__n")).withColumn("total", F.sum("__n").over(whole))
    out = placed.join(runs, ["grp", "__part"]).withColumn("rank", F.col("__before") + F.col("__at") - F.col("__first"))
    return out.drop("__part", "__at", "__n", "__first", "__before")


def _blocks(df: DataFrame, depth: int) -> DataFrame:
    return df.withColumn("block", F.expr(f"rank div {ARITY**depth}"))


def climb(nodes: DataFrame, depth: int = DEPTH) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes, each of the tops of the one before, and the last tops: one a group."""
    tables = []
    while True:
        tables.append(nodes)
        cols = _blocks(nodes, depth).select("grp", "block", "rank", "total", "digest")
        nodes = stage(cols.groupBy("grp", "block").applyInArrow(_tops(depth), "grp string, rank long, total long, digest binary"), "tops")
        if (nodes.agg(F.max("total")).first()[0] or 1) == 1:
            return tables, nodes


def _descend(tables: list[DataFrame], above: DataFrame, depth: int) -> DataFrame:
    """Paths of the nodes of the first table, from the path and subroot of each top."""
    for nodes in reversed(tables):
        cols = _blocks(nodes, depth).select("grp", "block", "rank", "total", "digest")
        above = stage(cols.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(_paths(depth), f"grp string, block long, {PATH}"), "paths")
    return above


def manifest(docs: DataFrame, tamper=None, id_col: str = "doc_id", group_col: str = "lang", fields=FIELDS, text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    ``tamper``: a condition; where it holds, the row is folded with its ``text_col`` in ASCII lower case in place of the original.
    ``depth``: levels of a block."""
    spark = prepare(docs.sparkSession)
    own = [F.col(c) for c in fields]
    other = [F.when(F.col(c).isNotNull(), lower_ascii(F.col(c))) if c == text_col else F.col(c) for c in fields]
    hit = F.lit(False) if tamper is None else F.coalesce(tamper, F.lit(False))
    group = F.when(F.col(group_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("doc_id"), group.alias("grp"), leaf(*own).alias("digest"), F.when(hit, leaf(*other)).alias("replaced"))
    rows = stage(rows.withColumn("replaced", F.coalesce("replaced", "digest")).withColumn("__row", F.monotonically_increasing_id()), "leaves")
    leaves = stage(number(rows, ["doc_id", "digest", "__row"]).drop("__row"), "numbered")
    tables, subroots = climb(leaves, depth)
    one = number(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"])
    tops, roots = climb(stage(one, "subroots"), depth)
    kind = docs.schema[id_col].dataType.simpleString()
    made = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    top = roots.first()
    if top is None:
        return spark.createDataFrame([], made)
    root = bytes(top["digest"])
    above = spark.createDataFrame([("", 0, [], b"")], f"grp string, block long, {PATH}")
    paths = _descend(tops, above, depth).select("block", "path")
    named = tops[0].join(paths, F.col("rank") == F.col("block")).select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"))
    above = _descend(tables[1:], named, depth)
    cols = _blocks(leaves, depth).select("grp", "block", "rank", "total", "digest", "replaced", "doc_id")
    out = cols.groupBy("grp", "block").cogroup(above.groupBy("grp", "block"))
    return out.applyInArrow(_prove(root, depth), made)
