"""Merkle manifest of a dataset: one tree per source, one tree over the sources' roots.

Only every third level of a tree is stored (as blocks of up to 27 neighbouring nodes).
A proof is regenerated from the top down: each stored block recomputes the two levels
inside it, hands every child its siblings, and keeps none of the recomputed nodes.

A leaf is the digest of all five fields, so a row's text is read once and never
shuffled; what is exchanged is two digests a row. Ranks inside a source come from one
range sort over (source, doc_id, leaf): a source may span any number of partitions, and
only one number per partition is broadcast. Blocks have bounded size, so a hot source
is simply many blocks.

Nulls: a null field is `-`, a null source is a source like any other and comes first, a
null doc_id comes first in its source and counts as not tampered with. Rows with one
doc_id follow each other by leaf; equal rows are equal leaves at different places, each
with its own proof. An empty table gives an empty manifest. Columns beyond the five
named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgrid.llm.tables import materialise, partitions
from signalgrid.llm.text import column

FAN = 3
#: Levels between two stored ones, and the nodes of a stored block.
STRIDE = 3
BLOCK = FAN**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(**changed: Column) -> Column:
    """Digest of the five fields, each with its length in bytes; `changed` replaces fields."""
    parts = []
    for name in FIELDS:
        text = changed.get(name, F.col(name)).cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return digest(F.concat(*parts))


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `pos`, the gapless rank inside `tree` by `order`.

    The range sort leaves each tree in runs, one per partition at most. Only the first run
    of a partition can continue an earlier one, so the starts to add are no more rows
    than there are partitions."""
    kept = rows.columns
    n = partitions(rows.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            tree = column(batch, "tree")
            code = np.asarray(tree.dictionary_encode("encode").indices)
            fresh = np.concatenate([[True], code[1:] != code[:-1]])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(code)), 0))
            run = np.arange(len(code)) - begin
            if seen and tree[0].as_py() == last:
                run[begin == 0] += seen
            seen, last = int(run[-1]) + 1, tree[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part, np.int32)), pa.array(run)], [*kept, "_part", "_run"])

    schema = rows.select("*", F.lit(0).alias("_part"), F.lit(0).cast("bigint").alias("_run")).schema
    runs = materialise(rows.repartitionByRange(n, "tree", *order).sortWithinPartitions("tree", *order).mapInArrow(number, schema), "merkle-runs")
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("n")).withColumn("_start", F.sum("n").over(before)).where("_start > 0")
    starts = F.broadcast(starts.select(F.col("tree").alias("_tree"), F.col("_part").alias("_in"), "_start"))
    placed = runs.join(starts, (F.col("_part") == F.col("_in")) & F.col("tree").eqNullSafe(F.col("_tree")), "left")
    return placed.select(*kept, (F.col("_run") + F.coalesce("_start", F.lit(0))).alias("pos"))


def _up(nodes: Column) -> Column:
    """The level above: every run of FAN neighbours becomes one digest."""
    begins = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(begins, lambda i: digest(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), "")))


#: A block that is its tree's whole stored level and holds one node: nothing is left to fold.
LONE = "block = 0 and size(kids) = 1"


def _levels(blocks: DataFrame) -> DataFrame:
    """The levels l0 to l3 inside each block and how many of them count: a block that is
    not full and comes first is alone in its tree, which ends at its own height."""
    size = F.size("kids")
    height = sum((F.when(size > FAN**k, 1).otherwise(0) for k in range(STRIDE)), F.lit(0))
    out = blocks.withColumn("l0", F.col("kids.digest")).withColumn("height", F.when((F.col("block") == 0) & (size < BLOCK), height).otherwise(STRIDE))
    for k in range(STRIDE):
        out = out.withColumn(f"l{k + 1}", _up(F.col(f"l{k}")))
    return out


def stored_levels(nodes: DataFrame) -> list[DataFrame]:
    """Blocks (tree, block, kids) of every third level, from the leaves up to the roots.

    nodes: (tree, pos, digest, ...); further columns stay with the leaves."""
    out = []
    while True:
        kid = F.struct("pos", "digest", *[c for c in nodes.columns if c not in ("tree", "pos", "digest")])
        block = F.expr(f"pos div {BLOCK}").alias("block")
        out.append(materialise(nodes.groupBy("tree", block).agg(F.sort_array(F.collect_list(kid)).alias("kids")), f"merkle-level{STRIDE * len(out)}"))
        unfinished = out[-1].where(f"not ({LONE})")
        if unfinished.isEmpty():
            return out
        root = F.when(F.col("height") == 1, F.col("l1")).when(F.col("height") == 2, F.col("l2")).otherwise(F.col("l3"))
        nodes = _levels(unfinished).select("tree", F.col("block").alias("pos"), root[0].alias("digest"))


def roots(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest, ...): each tree ends as the lone node of one stored level."""
    out = None
    for table in levels:
        ended = table.where(LONE).select("tree", F.col("kids")[0]["digest"].alias("digest"))
        out = ended if out is None else out.unionByName(ended)
    return out


def _siblings(k: int) -> Column:
    """Left and right siblings of child `at` of a block, on level k of the block."""
    nodes, i = F.col(f"l{k}"), F.expr(f"at div {FAN**k}")
    first = F.expr(f"at div {FAN ** (k + 1)}") * FAN
    left = F.slice(nodes, first + 1, i - first)
    right = F.slice(nodes, i + 2, first + FAN - 1 - i)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def proofs(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The leaves' columns with `path`: siblings (left, right) of every level, from the leaf up.

    top: (tree, path, ...), the part of the path above each tree's root; its further columns are handed down."""
    handed = [c for c in top.columns if c not in ("tree", "path")]
    top = top.withColumnRenamed("tree", "_tree")
    above: DataFrame | None = None
    for table in reversed(levels):
        lone = table.where(LONE).join(top, F.col("tree").eqNullSafe(F.col("_tree"))).select("tree", F.col("kids")[0].alias("kid"), "path", *handed)
        if above is not None:
            upper = above.select(F.col("tree").alias("_tree"), F.col("kid.pos").alias("_pos"), F.col("path").alias("_path"), *handed)
            inner = table.where(f"not ({LONE})").join(upper, (F.col("block") == F.col("_pos")) & F.col("tree").eqNullSafe(F.col("_tree")))
            kids = _levels(inner).select(
                "tree", "height", *[f"l{k}" for k in range(STRIDE)], "_path", *handed, F.posexplode("kids").alias("at", "kid"))
            own = F.slice(F.array(*[_siblings(k) for k in range(STRIDE)]), F.lit(1), F.col("height"))
            lone = lone.unionByName(kids.select("tree", "kid", F.concat(own, F.col("_path")).alias("path"), *handed))
        above = lone
    return above.select("tree", "kid.*", "path", *handed)


def folded(start: Column, path: Column) -> Column:
    """The root that `start` leads to along `path`."""
    return F.aggregate(path, start, lambda node, step: digest(F.concat(step["left"], node, step["right"])))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row doc_id, source, leaf, tampered (the leaf to verify), subroot, root and its proof `path`."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    leaves = materialise(docs.select("doc_id", F.col("source").alias("tree"), leaf().alias("digest"), leaf(text=text).alias("tampered")), "merkle-leaves")
    levels = stored_levels(positions(leaves, "doc_id", "digest"))
    sources = roots(levels).select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest")
    upper = stored_levels(positions(materialise(sources, "merkle-sources"), "source"))
    top = roots(upper).select("tree", F.lit(None).cast(PATH).alias("path"), F.col("digest").alias("root")).withColumn("path", F.array().cast(PATH))
    subroots = materialise(proofs(upper, top).select(F.col("source").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), "merkle-subroots")
    return proofs(levels, subroots).withColumnsRenamed({"tree": "source", "digest": "leaf"})


def op12_merkle_manifest(docs: DataFrame) -> DataFrame:
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    out = manifest(docs).select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.col("tampered"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
