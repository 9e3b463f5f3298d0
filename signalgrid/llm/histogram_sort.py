"""Sharding by histogram sort: shards of near-equal byte sizes in one key order.

Rows are ordered by (hash of the text, hash of the id). Probes between two keys are
refined by counting exact bytes below them over all partitions, until each of the
splitters lies within the tolerance of its target; rows are then exchanged once.
Only the histogram of a round (bins x open splitters) reaches the driver, a fixed size.

Equal texts are neighbours in the order, so copies share a shard unless a splitter must
cut a group that is larger than the tolerance. Repeated rows (same id and text) stay
together. Null texts have size 1; null ids are keys like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgrid.llm.tables import materialise, partitions, utf8_bytes

BINS = 4096
LOW, HIGH = -(2**63), 2**63 - 1


@dataclass
class Bracket:
    """The splitter for `target` bytes lies at a key (k1, k2) with lo <= k < hi on the open level.

    On level 1 the open key is k1; on level 2 k1 is fixed and k2 is open.
    `below` and `rows` are exact bytes and rows under (k1, lo)."""

    target: float
    level: int = 1
    k1: int = LOW
    lo: int = LOW
    hi: int = HIGH + 1
    below: int = 0
    rows: int = 0
    done: bool = False

    def width(self) -> int:
        return max(1, -(-(self.hi - self.lo) // BINS))


def keyed(docs: DataFrame) -> DataFrame:
    """Sizes, checksums and sort keys of all documents, without their texts."""
    return docs.select(
        "doc_id", (utf8_bytes("text") + 1).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k1"), F.xxhash64("doc_id").alias("k2"))


def _bin(b: Bracket) -> tuple[Column, Column]:
    """Membership of a row in the bracket, and its bin there."""
    key = F.col("k1") if b.level == 1 else F.col("k2")
    inside = (key >= b.lo) & (key <= b.hi - 1)
    if b.level == 2:
        inside = inside & (F.col("k1") == b.k1)
    wide = key.cast("decimal(20,0)") - F.lit(b.lo).cast("decimal(20,0)")
    return inside, F.floor(wide / F.lit(b.width()).cast("decimal(20,0)")).cast("int")


def _histograms(keys: DataFrame, open_: list[Bracket]) -> dict[tuple[int, int], tuple[int, int]]:
    """Exact (bytes, rows) of each bin of each open bracket: one pass with map-side sums."""
    hits = []
    for i, b in enumerate(open_):
        inside, spot = _bin(b)
        hits.append(F.when(inside, F.struct(F.lit(i).alias("b"), spot.alias("bin"))))
    rows = keys.select("size", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("_x"))
    counted = rows.groupBy("_x.b", "_x.bin").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return {(r["b"], r["bin"]): (r["bytes"], r["rows"]) for r in counted.toLocalIterator()}


def _refine(b: Bracket, bins: dict[int, tuple[int, int]], tolerance: float) -> None:
    """Move the bracket to the bin that holds the target, or settle on an edge within the tolerance."""
    step, low = b.width(), b.lo
    for i in sorted(bins):
        size, rows = bins[i]
        if b.below + size > b.target:
            b.lo, b.hi = low + i * step, min(b.hi, low + (i + 1) * step)
            under, over = b.target - b.below, b.below + size - b.target
            if min(under, over) <= tolerance or (b.level == 2 and b.hi - b.lo <= 1):
                if over < under:  # the upper edge is nearer
                    b.below, b.rows, b.lo = b.below + size, b.rows + rows, b.hi
                b.done = True
            elif b.hi - b.lo <= 1:  # one text: cut between its copies
                b.level, b.k1, b.lo, b.hi = 2, b.lo, LOW, HIGH + 1
            return
        b.below, b.rows = b.below + size, b.rows + rows
    b.lo, b.done = b.hi, True


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[Bracket]:
    """The shards-1 splitters: exact bytes below each are within `tolerance` of a shard's share.

    A single row or a set of repeated rows that is larger than this is not cut."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    found = [Bracket(total * k / shards) for k in range(1, shards)]
    limit = tolerance * total / shards
    while open_ := [b for b in found if not b.done]:
        counts = _histograms(keys, open_)
        for i, b in enumerate(open_):
            _refine(b, {spot: v for (j, spot), v in counts.items() if j == i}, limit)
    return sorted(found, key=lambda b: b.target)


def _shard(found: list[Bracket]) -> Column:
    """Splitters at or under the row's key."""
    out = F.lit(0)
    for b in found:
        if b.level == 1:
            at = F.lit(b.lo <= HIGH) & (F.col("k1") >= min(b.lo, HIGH))
        else:
            at = (F.col("k1") > b.k1) | ((F.col("k1") == b.k1) & F.lit(b.lo <= HIGH) & (F.col("k2") >= min(b.lo, HIGH)))
        out = out + at.cast("int")
    return out


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, shard and the gapless slot inside the shard.

    The exchange deals cells of the key order that hold about equally many rows; texts with
    more copies than a cell are spread by the hash of the id. Slots are local row numbers
    plus the exact number of rows in earlier cells."""
    spark = docs.sparkSession
    keys = materialise(keyed(docs), "shard-keys")
    rows = keys.count()
    found = splitters(keys, shards, tolerance)
    keys = keys.withColumn("shard", _shard(found))
    cells = 4 * max(partitions(spark), rows // 1_000_000)
    fits = max(1, 2 * rows // cells)
    # At most cells / 2 texts can have more rows than this: a table of proven size.
    hot = keys.groupBy("k1").count().where(F.col("count") > fits).select("k1", F.ceil(F.col("count") / fits).cast("bigint").alias("_parts"))
    part = lambda key, n: F.floor((key.cast("double") + 2.0**63) / 2.0**64 * n).cast("bigint")
    dealt = keys.join(F.broadcast(hot), "k1", "left").withColumn("_c1", part(F.col("k1"), F.lit(cells))).withColumn(
        "_hot", F.when(F.col("_parts").isNotNull(), F.col("k1"))).withColumn("_c2", F.when(F.col("_parts").isNotNull(), part(F.col("k2"), F.col("_parts"))))
    # The cell of a cold row must not span a hot text, or local numbers would not be contiguous.
    hot_before = keys.sparkSession.createDataFrame([], "k1 bigint") if rows == 0 else hot.select("k1")
    ranks = hot_before.withColumn("_cell", part(F.col("k1"), F.lit(cells))).groupBy("_cell").agg(F.sort_array(F.collect_list("k1")).alias("_hots"))
    dealt = dealt.join(F.broadcast(ranks), dealt["_c1"] == ranks["_cell"], "left").drop("_cell").withColumn(
        "_gap", F.when(F.col("_hots").isNull(), 0).otherwise(F.size(F.filter("_hots", lambda h: h < F.col("k1")))))
    cell = ["shard", "_c1", "_gap", "_hot", "_c2"]
    cut = materialise(dealt.select("doc_id", "size", "text_crc32", "k1", "k2", *cell), "shard-cells")
    order = Window.partitionBy("shard").orderBy("_c1", "_gap", F.col("_hot").isNotNull(), "_hot", "_c2").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(order), F.lit(0))).withColumn(
        "_key", F.struct(*cell)).select("_key", "_start")
    local = Window.partitionBy("_key").orderBy("k1", "k2", "doc_id")
    return cut.withColumn("_key", F.struct(*cell)).withColumn("_i", F.row_number().over(local)).join(starts, "_key").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_i") - 1).alias("slot"))


def op3_histogram_shards(docs: DataFrame) -> DataFrame:
    return shard(docs.select("doc_id", "text")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
