"""Merkle manifest of a dataset: a persistent tree in which a tampered leaf makes a version by path copying.

Leaves are digests of whole rows.  Those of one language, by ascending id, are the
lowest nodes of its tree; every eight consecutive nodes have a parent until one node,
the subroot, remains.  Subroots, by language, are the leaves of the root's tree.

The tree is cut into aligned blocks of ``8 ** LEVELS`` nodes.  A block climbs its own
levels in one task, blocks of blocks go on in the next round, so no task ever holds
more nodes than a block has, whatever the size of a language.  On the way down each
block is handed the untouched nodes beside its way to the root (shared by all
versions), and each tampered leaf makes a version of its own: only its ancestors are
copied, first within its block, then through the levels above; every other node is
the one of the original tree.

Texts are read once, by Spark's own functions; what is shuffled are digests.  Leaves
are numbered by their place in range-sorted slices, which split a hot language
too.  Leaves, numbered leaves and the nodes between rounds are tables in the shared
folder; nothing else is kept between jobs.

Null cells have a mark of their own; a null language is a tree of its own and comes
first.  Rows of equal id (a null id comes first) follow their leaf digest, and rows
that are wholly equal are leaves of their own, side by side.  Very long texts are one
digest each.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope.llm.labelled import small
from tillscope.session import scratch_path

WIDTH = 8
LEVELS = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
# The untouched nodes beside a way to the root: level by level, those left and right of it.
NODE = ["tree", "place", "nodes", "digest"]
BESIDE = "array<struct<before:string,after:string>>"


def parent(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def climb(nodes: list[str], levels: int, alone: bool) -> list[list[str]]:
    """All levels above the nodes of a block, the nodes first.

    A block that holds its whole tree ends with one node; any other has ``levels``
    levels, and a run that is shorter than the others has a parent too.
    """
    tree = [nodes]
    while len(tree[-1]) > 1 if alone else len(tree) <= levels:
        last = tree[-1]
        tree.append([parent(last[i : i + WIDTH]) for i in range(0, len(last), WIDTH)])
    return tree


def beside(tree: list[list[str]], place: int) -> list[tuple[str, str]]:
    """The nodes left and right of the way up from a place, level by level."""
    found = []
    for nodes in tree[:-1]:
        start = place - place % WIDTH
        found.append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + WIDTH])))
        place //= WIDTH
    return found


def copied_path(node: str, way: list[tuple[str, str]]) -> list[str]:
    """A version's own nodes: the changed one and its copied ancestors; all others are shared."""
    path = [node]
    for before, after in way:
        path.append(sha256(f"{before}{path[-1]}{after}".encode()).hexdigest())
    return path


def leaf_digest(text: Column) -> Column:
    """Digest of a row's fields, each ``-`` if null, else byte count, colon and value."""
    values = {name: F.col(name).cast("string") for name in FIELDS} | {"text": text}
    parts = [
        F.when(values[name].isNull(), "-").otherwise(
            F.concat(F.octet_length(values[name]).cast("string"), F.lit(":"), values[name])
        )
        for name in FIELDS
    ]
    return F.sha2(F.concat(*parts), 256)


def leaves_of(documents: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, tree (of the language), leaf and changed: the leaf after tampering, null where there is none.

    Tampering lower-cases the letters A to Z of a text and nothing else.
    """
    lower = F.translate(F.col("text"), UPPER, LOWER)
    # "0" sorts before every "1...": the tree of rows without a language is the first.
    tree = F.when(F.col("lang").isNull(), "0").otherwise(F.concat(F.lit("1"), F.col("lang")))
    leaf = leaf_digest(F.col("text"))
    changed = F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(lower))
    return documents.select("doc_id", tree.alias("tree"), leaf.alias("leaf"), changed.alias("changed"))


def third_of_ids() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Add ``place`` (from 0) and ``nodes`` (their number) within ``tree``, following ``order``.

    Rows are cut into range-sorted slices that are written with each row's place in
    its slice.  A slice begins a tree or goes on with one, so what has to be known
    besides is one row per tree and slice.
    """
    spark = nodes.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spot = F.monotonically_increasing_id()
    sliced = _stored(
        nodes.repartitionByRange(slices, "tree", *order).sortWithinPartitions("tree", *order).withColumn("_spot", spot),
        "merkle-places",
    )
    part = F.shiftrightunsigned("_spot", 33).alias("_part")
    parts = sliced.groupBy("tree", part).agg(F.min("_spot").alias("_first"), F.count("*").alias("_rows"))
    begins = F.expr("sum(_rows) OVER (PARTITION BY tree ORDER BY _part) - _rows").alias("_before")
    total = F.expr("sum(_rows) OVER (PARTITION BY tree)").alias("nodes")
    borders = _stored(parts.select("tree", "_part", "_first", begins, total), "merkle-borders")
    joined = sliced.withColumn("_part", part).join(small(borders), ["tree", "_part"])
    place = (F.col("_spot") - F.col("_first") + F.col("_before")).alias("place")
    return joined.select(*nodes.columns, place, "nodes")


def _block(levels: int) -> Column:
    return F.floor(F.col("place") / WIDTH**levels).alias("block")


def next_round(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, place, nodes, digest): one node per block of (tree, place, nodes, digest)."""

    def top(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        number, place = block["nodes"][0].as_py(), block["place"][0].as_py()
        tree = climb(block["digest"].to_pylist(), levels, number <= WIDTH**levels)
        above = [block["tree"][0].as_py()], [place // WIDTH**levels], [-(-number // WIDTH**levels)], tree[-1]
        return pa.table(dict(zip(NODE, above, strict=True)))

    rows = nodes.select(*NODE, _block(levels))
    return rows.groupBy("tree", "block").applyInArrow(top, "tree string, place long, nodes long, digest string")


def rounds_of(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Nodes of every round, each stored; in the last one every tree is a single node."""
    rounds = [nodes]
    while len(rounds) == 1 or not rounds[-1].where("nodes > 1").isEmpty():
        rounds.append(_stored(next_round(rounds[-1], levels), "merkle-nodes"))
    return rounds


def _ways(nodes: DataFrame, above: DataFrame, levels: int, with_rows, schema: T.StructType | str) -> DataFrame:
    """Hand every block the way from its top to the root and let ``with_rows`` go on from there."""

    def work(block: pa.Table, way: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree = climb(block["digest"].to_pylist(), levels, block["nodes"][0].as_py() <= WIDTH**levels)
        top = [(step["before"], step["after"]) for step in way["beside"][0].as_py()]
        return with_rows(block, tree, top, way["subroot"][0].as_py(), way["root"][0].as_py())

    own = nodes.withColumn("block", _block(levels)).groupBy("tree", "block")
    # A way belongs to the node that a block has become.
    return own.cogroup(above.withColumnRenamed("place", "block").groupBy("tree", "block")).applyInArrow(work, schema)


WAY = f"tree string, place long, beside {BESIDE}, subroot string, root string"


def _ways_of_nodes(block: pa.Table, tree: list[list[str]], top: list[tuple[str, str]], subroot: str, root: str) -> pa.Table:
    step = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    rows = [[{"before": b, "after": a} for b, a in beside(tree, i) + top] for i in range(len(block))]
    return pa.table(
        {
            "tree": block["tree"], "place": block["place"], "beside": pa.array(rows, step),
            "subroot": [subroot] * len(block), "root": [root] * len(block),
        }
    )


def _down(rounds: list[DataFrame], ways: DataFrame, levels: int) -> DataFrame:
    """Ways of the nodes of the first of some rounds, from those of the last."""
    for nodes in reversed(rounds[:-1]):
        ways = _stored(_ways(nodes, ways, levels, _ways_of_nodes, WAY), "merkle-ways")
    return ways


RESULT = (
    "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "copied_nodes long"
)


def _versions(block: pa.Table, tree: list[list[str]], top: list[tuple[str, str]], subroot: str, root: str) -> pa.Table:
    proofs, roots, copies = [], [], []
    tail = "".join(before + after for before, after in top)
    for i, (leaf, changed) in enumerate(zip(tree[0], block["changed"].to_pylist(), strict=True)):
        own = beside(tree, i)
        proofs.append(sha256(("".join(before + after for before, after in own) + tail).encode()).hexdigest())
        # Within the block first, then on through the levels above it.
        path = copied_path(changed or leaf, own)
        path += copied_path(path[-1], top)[1:]
        roots.append(path[-1])
        copies.append(len(path) if changed else 0)
    return pa.table(
        {
            "doc_id": block["doc_id"], "leaf": block["digest"], "subroot": [subroot] * len(block),
            "root": [root] * len(block), "proof_sha256": proofs, "folded_root": roots,
            "verified": [r == root for r in roots], "copied_nodes": copies,
        }
    )


class Manifest:
    """The stored rounds of all trees and of the root's tree."""

    def __init__(self, documents: DataFrame, tampered: Column, levels: int = LEVELS):
        self.levels = levels
        self.doc_id = documents.schema["doc_id"].dataType
        leaves = _stored(leaves_of(documents, tampered), "merkle-leaves")
        self.leaves = numbered(leaves.withColumnRenamed("leaf", "digest"), ["doc_id", "digest"])
        self.trees = rounds_of(self.leaves.select(*NODE), levels)
        subroots = self.trees[-1].select("tree", "digest")
        one = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("language"), "digest")
        self.top = rounds_of(_stored(numbered(one, ["language"]), "merkle-subroots"), levels)

    def nodes(self) -> Iterator[tuple[int, DataFrame]]:
        """Stored nodes (tree, place, nodes, digest) by their level above the leaves."""
        for number, nodes in enumerate(self.trees):
            yield number * self.levels, nodes.select(*NODE)

    def ways(self) -> DataFrame:
        """The untouched nodes beside the way from each lowest block to the root, with subroot and root."""
        root = self.top[-1].select(
            "tree", "place", F.array().cast(BESIDE).alias("beside"), F.lit("").alias("subroot"), F.col("digest").alias("root")
        )
        subroots = self.top[0].select("place", "language", "digest").join(
            _down(self.top, root, self.levels).drop("tree", "subroot"), "place"
        )
        last = subroots.select(F.col("language").alias("tree"), F.lit(0).cast("long").alias("place"), "beside", F.col("digest").alias("subroot"), "root")
        return _down(self.trees[1:], _stored(last, "merkle-tops"), self.levels)

    def versions(self) -> DataFrame:
        """One row per document: its leaf, proof and the root of its version (the original one if untampered)."""
        schema = T.StructType([T.StructField("doc_id", self.doc_id), *T._parse_datatype_string(RESULT).fields])
        return _ways(self.leaves, self.ways(), self.levels, _versions, schema)


def merkle_manifest(documents: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, copied_nodes of every document.

    ``tampered`` says which rows have a changed version; by default those whose id's
    crc32 is divisible by three.
    """
    return Manifest(documents, third_of_ids() if tampered is None else tampered, levels).versions()


def root_of(spark: SparkSession, manifest: Manifest) -> str | None:
    """The root digest, or None for an empty table."""
    row = manifest.top[-1].select("digest").first()
    return row[0] if row else None
