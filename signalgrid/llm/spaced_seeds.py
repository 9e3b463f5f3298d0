"""Benchmark decontamination with spaced seeds.

A seed is a window of words of which a fixed mask looks at some and ignores the others, so
a substituted word under an ignored position does not hide a match. Seeds of the benchmark
and of the documents are joined on their hashes; around every hit both texts are compared
word by word, and the longest stretch whose share of equal words stays high is the overlap.

The benchmark side is the stated query set. It is read in blocks of `BLOCK_SEEDS` seeds,
so what is sent to the tasks has a fixed bound, and every block is run against all
documents. Documents are never shuffled; hot sources and copies are ordinary rows. Null or
wordless texts match nothing. Items shorter than a mask are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.llm.tables import materialise
from signalgrid.llm.text import NOT_ALNUM, Words, chained, column, giving_back, list_array, mix, slices, split_words

#: Positions of a window that count (fixed values): no single substitution breaks both masks everywhere.
MASKS: tuple[tuple[int, ...], ...] = ((0, 1, 2, 4, 7, 8), (0, 1, 3, 5, 6, 8))
MIN_WORDS = 13
MIN_SHARE = 0.8
BLOCK_SEEDS = 2_000_000


def seeds(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Hash of every window (across text borders too), ignoring the positions outside the mask."""
    total = max(0, len(hashes) - mask[-1])
    out = np.full(total, np.uint64(len(mask) + (mask[-1] << 8) + (sum(1 << k for k in mask) << 16)))
    for k in mask:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k: k + total])
    return out


@dataclass
class Block:
    """Some benchmark items: words, and sorted seeds with the place each one comes from."""

    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    seed: np.ndarray
    item: np.ndarray
    at: np.ndarray
    runs: dict[int, dict[int, list[int]]]  # items shorter than a window: length -> hash of all words -> items


def build_block(items: list[tuple[int, str]], masks: tuple[tuple[int, ...], ...]) -> Block:
    words = split_words(pa.array([t or "" for _, t in items], pa.string()), NOT_ALNUM)
    seed, item, at, runs = [], [], [], {}
    span = max(m[-1] for m in masks) + 1
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if 0 < b - a < span:
            runs.setdefault(b - a, {}).setdefault(int(chained(words.hash[a:b], b - a)[0]), []).append(i)
        for mask in masks if b - a >= span else ():
            found = seeds(words.hash[a:b], mask)
            seed.append(found)
            item.append(np.full(len(found), i))
            at.append(np.arange(len(found)))
    seed = np.concatenate(seed) if seed else np.zeros(0, np.uint64)
    order = np.argsort(seed, kind="stable")
    pick = lambda x: np.concatenate(x)[order] if x else np.zeros(0, np.int64)
    return Block(np.array([k for k, _ in items], object), words.hash, words.first, seed[order], pick(item), pick(at), runs)


def blocks(benchmark: DataFrame, masks: tuple[tuple[int, ...], ...], most: int = BLOCK_SEEDS) -> Iterator[Block]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    items, count = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len(masks) * (len(row["text"] or "") // 2 + 1)
        if items and count + n > most:
            yield build_block(items, masks)
            items, count = [], 0
        items.append((row["item_id"], row["text"]))
        count += n
    yield build_block(items, masks)


def overlap(doc: np.ndarray, item: np.ndarray, shift: int, share: float) -> tuple[int, int, int]:
    """Best stretch of the item aligned at doc[shift:]: (begin, end, equal words) with a share of equal
    words of `share` or more; the stretch maximises equal words minus the allowed rate of others."""
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[lo + shift: hi + shift] == item[lo:hi]
    gain = np.cumsum(np.where(same, 1 - share, -share))
    before = np.concatenate([[0.0], gain[:-1]])
    lowest = np.minimum.accumulate(before)
    end = int(np.argmax(gain - lowest))
    begin = int(np.argmin(before[: end + 1]))
    return lo + begin, lo + end + 1, int(same[begin: end + 1].sum())


def hits(words: Words, block: Block, masks: tuple[tuple[int, ...], ...], least: int, share: float) -> dict[int, list[tuple]]:
    """Per text: verified (item, begin, end, equal words), one for each item and alignment."""
    out: dict[int, list[tuple]] = {}
    seen: set[tuple[int, int, int]] = set()
    for mask in masks:
        found = seeds(words.hash, mask)
        left = np.searchsorted(block.seed, found, "left")
        spots = np.flatnonzero(block.seed[np.minimum(left, len(block.seed) - 1)] == found) if len(block.seed) else []
        if not len(spots):
            continue
        text = np.searchsorted(words.first, spots, "right") - 1
        fits = spots + mask[-1] < words.first[text + 1]
        right = np.searchsorted(block.seed, found[spots], "right")
        for p, d, a, b in zip(spots[fits].tolist(), text[fits].tolist(), left[spots][fits].tolist(), right[fits].tolist()):
            for k in range(a, b):
                item, shift = int(block.item[k]), p - int(words.first[d]) - int(block.at[k])
                if (d, item, shift) in seen:
                    continue
                seen.add((d, item, shift))
                target = block.words[block.first[item]: block.first[item + 1]]
                begin, end, equal = overlap(words.hash[words.first[d]: words.first[d + 1]], target, shift, share)
                if end - begin >= min(least, len(target)) and equal >= share * (end - begin):
                    out.setdefault(d, []).append((item, begin + shift, end + shift, equal))
    for n, known in block.runs.items():
        found = chained(words.hash, n)
        for p in np.flatnonzero(np.isin(found, np.array(list(known), np.uint64))).tolist():
            d = int(np.searchsorted(words.first, p, "right") - 1)
            if p + n <= words.first[d + 1]:
                begin = p - int(words.first[d])
                out.setdefault(d, []).extend((item, begin, begin + n, n) for item in known[int(found[p])])
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[tuple[int, ...], ...] = MASKS, least: int = MIN_WORDS,
                 share: float = MIN_SHARE) -> DataFrame:
    """`docs` plus `items` (ids of the items found), `n_overlaps`, `overlap_words` (longest overlap) and `contaminated`.

    A text is contaminated by an item when they agree, substitutions aside, over `least` words
    or over the whole of a shorter item. Items without an id are searched as well and count in
    n_overlaps and overlap_words, not in `items`; items without words match nothing."""
    kept = [c for c in docs.columns if c.lower() not in ("items", "n_overlaps", "overlap_words", "contaminated")]
    context = docs.sparkSession.sparkContext
    schema = docs.select(*kept, F.array(F.lit(0).cast("bigint")).alias("items"), F.lit(0).cast("bigint").alias("n_overlaps"),
                         F.lit(0).cast("bigint").alias("overlap_words")).schema

    def searched(rows: DataFrame, block: Block) -> DataFrame:
        shared = context.broadcast(block)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for batch in batches:
                for a, b in slices(column(batch, "text")):
                    part = batch.slice(a, b - a)
                    found = hits(split_words(column(part, "text"), NOT_ALNUM), block, masks, least, share)
                    items = [np.array(sorted({block.ids[h[0]] for h in found.get(d, ())} - {None}), np.int64) for d in range(b - a)]
                    counts = [len(found.get(d, ())) for d in range(b - a)]
                    longest = [max((h[2] - h[1] for h in found.get(d, ())), default=0) for d in range(b - a)]
                    yield pa.RecordBatch.from_arrays([*[column(part, c) for c in kept], list_array(items), pa.array(counts, pa.int64()), pa.array(longest, pa.int64())], schema.names)

        return rows.select(*kept).mapInArrow(giving_back(kernel), schema)

    found = None
    for block in blocks(benchmark, masks):
        if found is None:
            found = searched(docs, block)
        else:  # further blocks: store what is known, search again, and merge per row
            known = materialise(found.withColumnsRenamed({"items": "_i", "n_overlaps": "_n", "overlap_words": "_w"}), "seed-hits")
            kept = known.columns
            schema = known.select("*", F.col("_i").alias("items"), F.col("_n").alias("n_overlaps"), F.col("_w").alias("overlap_words")).schema
            found = searched(known, block).withColumns({
                "items": F.array_sort(F.array_union("_i", "items")), "n_overlaps": F.col("_n") + F.col("n_overlaps"),
                "overlap_words": F.greatest("_w", "overlap_words")}).drop("_i", "_n", "_w")
            kept = [c for c in kept if c not in ("_i", "_n", "_w")]
    return found.withColumn("contaminated", F.col("n_overlaps") > 0)


def op5_spaced_seeds(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs.select("doc_id", "text"), benchmark).drop("text")


