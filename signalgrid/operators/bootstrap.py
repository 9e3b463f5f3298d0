"""Bootstrap replicates of sums over groups of any size, without a row per draw.

The units of a group are cut into blocks of neighbouring positions. How many of a
replicate's n draws fall into each block is a multinomial count, and a binary tree over
the blocks gives it: at every node the draws are split between both halves by a binomial
count, seeded by (group, node, replicates). A block walks its own path from the root, so
all blocks agree on the counts without exchanging anything. Inside a block, draw j of
replicate b takes the unit at a position hashed from (group, block, b, j).

Rows are shuffled once, into blocks; afterwards a block yields one row of sums per
replicate, combined before they are shuffled. Positions have 64 bits. A rerun, another
partitioning, another group or more replicates change no draw.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from signalgrid.functions.hashing import stable_hash
from signalgrid.session import spread

#: Units of a block: what one row holds, and the most that SQL without binomial counts can reproduce.
BLOCK_ROWS = 16_384
#: Replicates that share a node's generator. Part of the rule, not of the plan.
STRIDE = 500
#: Draws that are in memory at a time.
DRAWS = 1 << 19


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 32-bit words whose output bits depend on all input bits."""
    for _ in range(2):
        x = (x ^ (x >> np.uint32(16))) * np.uint32(0x45D9F3B)
    return x ^ (x >> np.uint32(16))


def block_draws(key: int, block: int, n: int, replicates: np.ndarray, block_rows: int) -> np.ndarray:
    """Draws of each replicate that fall into `block`; the replicates lie in one stride."""
    counts = np.full(len(replicates), n, dtype=np.int64)
    low, high = 0, -(-n // block_rows)
    while high - low > 1:
        middle = (low + high) // 2
        left, both = (middle - low) * block_rows, min(high * block_rows, n) - low * block_rows
        # Drawn from the stride's first replicate on, so that a shorter request gets the same counts.
        source = np.random.Generator(np.random.PCG64([key, low, high, int(replicates[0]) // STRIDE]))
        part = source.binomial(counts, left / both)
        if block < middle:
            counts, high = part, middle
        else:
            counts, low = counts - part, middle
    return counts


def block_sums(key: int, block: int, n: int, values: Sequence[np.ndarray], iterations: int, block_rows: int) -> list[np.ndarray]:
    """Per replicate, the sum of each value over the draws inside one block."""
    size = np.uint32(len(values[0]))
    salt = mixed(np.array([key], dtype=np.uint32) + np.array([block], dtype=np.uint32) * np.uint32(0x9E3779B1))
    sums = [np.zeros(iterations) for _ in values]
    for start in range(0, iterations, STRIDE):
        replicates = np.arange(start, min(start + STRIDE, iterations))
        counts = block_draws(key, block, n, replicates, block_rows)
        step = max(1, DRAWS // max(1, int(counts.max())))
        for at in range(0, len(replicates), step):
            some, times = replicates[at:at + step], counts[at:at + step]
            own = np.repeat(np.arange(len(some)), times)
            draw = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
            first = mixed(some.astype(np.uint32) + salt)
            second = mixed(first ^ np.uint32(0x9E3779B1))
            picked = mixed(mixed(draw.astype(np.uint32) + first[own]) ^ second[own]) % size
            for total, value in zip(sums, values, strict=True):
                total[some] = np.bincount(own, weights=value[picked], minlength=len(some))
    return sums


def replicate_sums(units: DataFrame, keys: Sequence[str], position: str, size: str, values: Sequence[str], iterations: int, seed: int,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Sums of `values` over the n draws of every replicate `b` of every group, with n.

    `units` holds each group's rows with positions 0 to n-1 and n itself. Values are not
    null. Null keys are a group.
    """
    keys, values = list(keys), list(values)
    placed = units.select(*keys, F.col(size).cast("bigint").alias("_n"), F.expr(f"{position} div {int(block_rows)}").alias("_block"),
                          F.struct(F.col(position).alias("p"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)]).alias("_u"))
    packed = placed.groupBy(*keys, "_n", "_block").agg(F.array_sort(F.collect_list("_u")).alias("_u")).select(
        *keys, "_n", "_block", stable_hash(F.lit(str(seed)), *keys).alias("_key"), *[F.col(f"_u.v{i}").alias(f"_v{i}") for i in range(len(values))])
    fields = [packed.schema[k] for k in [*keys, "_n"]] + [StructField("b", LongType())] + [StructField(f"_s{i}", DoubleType()) for i in range(len(values))]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = batch.select([*keys, "_n", "_block", "_key"])
            parts = [batch.column(batch.schema.get_field_index(f"_v{i}")) for i in range(len(values))]
            for i in range(batch.num_rows):
                n, block, key = (head.column(len(keys) + c)[i].as_py() for c in range(3))
                sums = block_sums(key, block, n, [p[i].values.to_numpy(zero_copy_only=False) for p in parts], iterations, block_rows)
                labels = head.select([*keys, "_n"]).take(pa.array(np.full(iterations, i)))
                yield pa.RecordBatch.from_arrays([*labels.columns, pa.array(np.arange(iterations)), *[pa.array(s) for s in sums]],
                                                 names=[f.name for f in fields])

    # Blocks are few and light beside their draws, so they are dealt over all tasks.
    drawn = spread(packed, *keys, "_block").mapInArrow(kernel, StructType(fields))
    return drawn.groupBy(*keys, F.col("_n").alias(size), "b").agg(*[F.sum(f"_s{i}").alias(v) for i, v in enumerate(values)])
