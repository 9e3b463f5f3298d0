"""Product codes of vectors, with codebooks refined under Drake-Hamerly bounds.

Vectors are cut into equal parts; each part position has a codebook. Between rounds a
row keeps, per part, its entry, the b closest other entries with ordered lower bounds on
their distances, and one outer bound for all entries beyond. When the entries move,
bounds shrink by the moves; a part whose own distance stays under them keeps its entry
unseen. Else the entries whose bounds were passed are compared in exact integers, and
all entries only where the outer bound was passed.

b adapts per part position: each pass counts the gaps between the own distance and every
bound; once the moves are known, the next state keeps the smallest b with which at most
a tenth of the parts would pass the outer bound.

Bounds are kept in whole units, rounded so that they stay bounds; every decision that
they leave open is made on integers, so results do not depend on b or on the bounds.
A pass is one scan without a shuffle. Each task adds its parts' sums in one array; those
are summed per position, and a codebook (entries x dimension numbers) reaches the driver.

Rows whose vector is null, or holds null or non-finite components, are dropped, and so are
rows whose length is not that of the first kept row in the order (vec_id, vector). A length
that is no multiple of the parts is filled with zeros. Null vec_ids come last in that
order. With fewer rows than entries there are as many entries as rows. Components must lie
under 2**20 in size (else the sums of squares leave 64 bits): larger ones raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalgrid.llm.tables import materialise
from signalgrid.llm.text import column, list_array, list_parts

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LARGEST = 1 << 20
#: Bits of a gap that the histograms tell apart; share of parts that may pass the outer bound.
GAPS, PASSED = 17, 0.1
UNITS = 65535
#: A label with this share of the rows at least is joined by broadcast (so at most 1 / share of them are).
HOT_SHARE = 1 / 1000


def finite(vector: str) -> F.Column:
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _squares(v: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    d = v - entries
    return np.einsum("...i,...i->...", d, d)


def _all_squares(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry, one component at a time."""
    out = np.zeros((len(v), len(book)), np.int64)
    for i in range(v.shape[1]):
        d = v[:, i, None] - book[None, :, i]
        out += d * d
    return out


@dataclass
class Pass:
    """What a pass needs: codebooks (part, entry, place), how far entries moved since the bounds
    were set (in units, rounded up), units a distance of 1, and b per part of the state read and written."""

    books: np.ndarray
    moved: np.ndarray
    units: np.ndarray
    read: list[int]
    write: list[int]

    def least(self, p: int, squares: np.ndarray) -> np.ndarray:
        """Distances in units, rounded down: a lower bound."""
        return np.minimum(np.floor(np.sqrt(squares.astype(float)) * self.units[p]), UNITS).astype(np.int64)

    def first(self, p: int, v: np.ndarray) -> tuple[np.ndarray, ...]:
        """Entry, its square, the b closest others, their bounds and the outer bound, from all distances."""
        squares = _all_squares(v, self.books[p])
        own = squares.argmin(1)
        rows = np.arange(len(v))
        best = squares[rows, own]
        k, b = squares.shape[1], self.write[p]
        squares[rows, own] = np.iinfo(np.int64).max
        near = np.argpartition(squares, b, 1)[:, : b + 1] if b < k else np.argsort(squares, 1)
        low = np.take_along_axis(squares, near, 1)
        order = np.argsort(low, 1, kind="stable")
        near, low = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
        bounds = self.least(p, low)
        outer = bounds[:, b] if bounds.shape[1] > b else np.full(len(v), UNITS)
        return own, best, near[:, :b], bounds[:, :b], outer

    def again(self, p: int, v: np.ndarray, own: np.ndarray, near: np.ndarray, low: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, ...]:
        """As `first`, from the state of the pass before."""
        book, b = self.books[p], self.write[p]
        low, outer = low - self.moved[p][near], outer - self.moved[p].max(initial=0)
        best = _squares(v, book[own])
        reach = self.least(p, best) + 2  # above the own distance
        own, near = own.copy(), near.copy()
        for z in range(near.shape[1]):  # bounds are ordered, so few rows stay open after the first ones
            open_ = np.flatnonzero(low[:, z] <= reach)
            squares = _squares(v[open_], book[near[open_, z]])
            better = (squares < best[open_]) | ((squares == best[open_]) & (near[open_, z] < own[open_]))
            low[open_, z] = self.least(p, squares)
            won, gone = open_[better], best[open_][better]
            own[won], near[won, z] = near[won, z], own[won]
            best[won], low[won, z] = squares[better], self.least(p, gone)
        full = np.flatnonzero(outer <= self.least(p, best) + 2)
        order = np.argsort(low, 1, kind="stable")
        near, low = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
        if near.shape[1] > b:  # a smaller b: the first bound given up joins the outer one
            outer = np.minimum(outer, low[:, b])
            near, low = near[:, :b], low[:, :b]
        if len(full):
            for old, new in zip((own, best, near, low, outer), self.first(p, v[full])):
                old[full] = new
        return own, best, near, low, outer

    def gaps(self, p: int, best: np.ndarray, low: np.ndarray, outer: np.ndarray) -> np.ndarray:
        """Counts (bound, bits of the gap between it and the own distance); the last bound is the outer one."""
        gap = np.maximum(np.column_stack([low, outer]) - self.least(p, best)[:, None], 0)
        bits = np.ceil(np.log2(gap + 1)).astype(np.int64)
        return np.stack([np.bincount(column_, minlength=GAPS)[:GAPS] for column_ in bits.T])


def _state(batch: pa.RecordBatch, b: list[int]) -> tuple[list, ...]:
    """Entries, neighbours, bounds and outer bounds per part from a batch of stored rows."""
    bytes_ = lambda name, kind, width: np.frombuffer(b"".join(column(batch, name).to_pylist()), kind).reshape(batch.num_rows, width).astype(np.int64)
    near, low = bytes_("near", np.uint8, sum(b) + len(b)), bytes_("low", np.uint16, sum(b) + len(b))
    at = np.cumsum([0, *[n + 1 for n in b]])
    cut = list(zip(at[:-1], at[1:]))
    return [near[:, i] for i, _ in cut], [near[:, i + 1: j] for i, j in cut], [low[:, i: j - 1] for i, j in cut], [low[:, j - 1] for _, j in cut]


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def assign(rows: DataFrame, setup: Pass, last: bool) -> DataFrame:
    """One pass: (vec_id, label, v, near, low, sums), or (vec_id, label, code, error) at the end.

    sums is set on one further row of each task: per (part, entry) the count and the componentwise
    sum of its parts, then the gap counts."""
    label = rows.schema["label"].dataType.simpleString()
    ids = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {ids}, label {label}, " + ("code string, error bigint" if last else "v array<int>, near binary, low binary, sums array<bigint>")
    first = "near" not in rows.columns
    parts, k, width = setup.books.shape

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, gaps, out_schema = np.zeros((parts, k, width + 1), np.int64), [np.zeros((b + 1, GAPS), np.int64) for b in setup.write], None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat, _ = list_parts(column(batch, "v"), np.int64)
            v = np.zeros((n, parts * width), np.int64)
            v[:, : len(flat) // n] = flat.reshape(n, -1)
            v = v.reshape(n, parts, width)
            state = None if first else _state(batch, setup.read)
            found = [setup.first(p, v[:, p]) if first else setup.again(p, v[:, p], *(s[p] for s in state)) for p in range(parts)]
            own = np.column_stack([f[0] for f in found])
            keys = [column(batch, "vec_id"), column(batch, "label")]
            if last:
                error = np.sum([f[1] for f in found], 0)
                yield pa.RecordBatch.from_arrays([*keys, pa.array([r.tobytes().hex() for r in own.astype(np.uint8)]), pa.array(error)], ["vec_id", "label", "code", "error"])
                continue
            for p, (mine, best, _, low, outer) in enumerate(found):
                np.add.at(sums[p], mine, np.column_stack([np.ones(n, np.int64), v[:, p]]))
                gaps[p] += setup.gaps(p, best, low, outer)
            near = np.column_stack([x for f in found for x in (f[0][:, None], f[2])]).astype(np.uint8)
            low = np.column_stack([np.clip(x, 0, UNITS) for f in found for x in (f[3], f[4][:, None])]).astype(np.uint16)
            out = pa.RecordBatch.from_arrays(
                [*keys, column(batch, "v"), _binary(near), _binary(low), pa.nulls(n, pa.list_(pa.int64()))], ["vec_id", "label", "v", "near", "low", "sums"])
            out_schema = out.schema
            yield out
        if not last and out_schema is not None:
            total = list_array([np.concatenate([sums.ravel(), *[g.ravel() for g in gaps]])])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in out_schema][:-1] + [total], schema=out_schema)

    return rows.mapInArrow(kernel, schema)


def totals(state: DataFrame, setup: Pass) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sums per (part, entry) and gap counts per part over all tasks."""
    flat = np.zeros(setup.books[..., 0].size * (setup.books.shape[2] + 1) + sum(b + 1 for b in setup.write) * GAPS, np.int64)
    for r in state.where("sums is not null").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toLocalIterator():
        flat[r["i"]] = r["x"]
    shape = (*setup.books.shape[:2], setup.books.shape[2] + 1)
    cut = int(np.prod(shape))
    gaps, at = [], cut
    for b in setup.write:
        gaps.append(flat[at: at + (b + 1) * GAPS].reshape(b + 1, GAPS))
        at += (b + 1) * GAPS
    return flat[:cut].reshape(shape), gaps


def moved_books(books: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Componentwise floor of the means; entries without parts stay."""
    count = sums[..., :1]
    return np.where(count > 0, sums[..., 1:] // np.maximum(count, 1), books)


def adapted(setup: Pass, gaps: list[np.ndarray], moved: np.ndarray) -> list[int]:
    """The smallest b, part by part, with which at most PASSED of the parts would pass the outer bound."""
    out = []
    for p, counts in enumerate(gaps):
        shift = int(np.ceil(np.log2(1 + moved[p].mean() * 2)))
        passed = counts[:, : shift + 1].sum(1) / max(1, counts[0].sum())
        enough = np.flatnonzero(passed[1:] <= PASSED)
        out.append(max(min(2, setup.write[p]), int(enough[0]) + 1) if len(enough) else setup.write[p])
    return out


def prepared(vectors: DataFrame, vector: str, entries: int) -> tuple[DataFrame, list[list[int]]]:
    """Kept rows as integers (vec_id, label, v), and the vectors of the smallest ids."""
    rows = vectors.select("vec_id", "label", F.col(vector).cast("array<double>").alias("x")).where(finite("x"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    if first:
        rows = rows.where(F.size("x") == len(first[0]["x"]))
    large = F.exists("x", lambda x: F.abs(x) >= LARGEST)
    whole = F.when(large, F.raise_error(F.lit(f"a component of {LARGEST} or more"))).otherwise(F.transform("x", lambda x: F.floor(x * SCALE).cast("int")))
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select(whole.alias("v")).collect()
    return rows.select("vec_id", "label", whole.alias("v")), [r["v"] for r in seeds]


def encode(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept row, and the codebooks (part, entry, place)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    rows, seeds = prepared(vectors, vector, entries)
    width = -(-len(seeds[0]) // parts) if seeds else 1
    start = np.zeros((len(seeds), parts * width), np.int64)
    if seeds:
        start[:, : len(seeds[0])] = np.array(seeds, np.int64).reshape(len(seeds), -1)
    books = np.ascontiguousarray(start.reshape(len(seeds), parts, width).transpose(1, 0, 2))
    if not seeds:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")).where("false"), books
    spread = np.sqrt([_all_squares(b, b).max() for b in books])
    b = [max(1, min(entries // 8, len(seeds) - 1))] * parts
    setup = Pass(books, np.zeros(books.shape[:2], np.int64), UNITS / 4 / np.maximum(spread, 1), b, b)
    for _ in range(rounds):
        state = materialise(assign(rows, setup, last=False), "vector-state")
        sums, gaps = totals(state, setup)
        new = moved_books(setup.books, sums)
        moved = np.ceil(np.sqrt(_squares(new, setup.books).astype(float)) * setup.units[:, None]).astype(np.int64) + 1
        moved[(new == setup.books).all(2)] = 0
        setup = Pass(new, moved, setup.units, setup.write, adapted(setup, gaps, moved))
        rows = state.where("sums is null")
    return assign(rows, setup, last=True), setup.books


def label_errors(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """`coded` with label_error. Labels with many rows are joined by broadcast, the rest by a shuffle without hot keys."""
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label-errors")
    rows = sums.agg(F.sum("n")).first()[0] or 0
    hot = sums.where(F.col("n") >= rows * HOT_SHARE).select(F.col("label").alias("_label"), "label_error", F.lit(True).alias("_hot"))
    tagged = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    cold = sums.where(F.col("n") < rows * HOT_SHARE).select(F.col("label").alias("_label"), F.col("label_error").alias("_error"))
    if cold.isEmpty():
        return tagged.drop("_hot")
    rare = tagged.where("_hot is null").join(cold, F.col("label").eqNullSafe(F.col("_label"))).withColumn("label_error", F.col("_error"))
    return tagged.where("_hot").select(*coded.columns, "label_error").unionByName(rare.select(*coded.columns, "label_error"))


def op13_vector_codes(vectors: DataFrame) -> DataFrame:
    coded, books = encode(vectors)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = label_errors(vectors.sparkSession, materialise(coded, "vector-codes"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
