"""Exact Jaccard self-join of word-shingle sets, with set-relation skipping.

1. Equal sets are one set with a number of copies (a digest of the sorted shingles).
2. A set whose rarest shingles (as many as a partner could lack, plus one) occur in no other
   set has no partner. Rarity is counted on a fixed part of the hash range, the same for all
   sets that could be partners, so this drops nothing that links. The sets left are few.
3. Families: each set joins the pivot that most of its MinHash buckets name, if they are
   alike. Against the pivot only the difference is kept. For two sets of a family
   |A n B| = |P| - |P\\A| - |P\\B| + |D_A n D_B|: the pivot's computed answers give those of
   the whole family, bounds on the differences settle most pairs, and the rest need only
   the small differences.
4. Across families: the index lists of rare-first prefixes hold one block per family with
   the range of its sizes and positions. A set skips a whole block when size or position
   rule every member out; where it can't, it visits the block's family as a guest.
5. Families are compared in pairs of chunks of bounded size, so a family that holds a third
   of all rows is many tasks. Pairs are counted where they are found and never listed; each
   chunk pair returns counts and a spanning forest of its links.

Only keys, counts and forests are shuffled besides the sets still in question. Null or
wordless texts have an empty set and no links. A text with fewer words than a shingle is
one shingle. Repeated rows count as copies. A component's id ignores null ids, and is null if it has no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgrid.llm.components import components
from signalgrid.llm.tables import materialise, partitions
from signalgrid.llm.text import column, giving_back, list_array, list_parts, mix, shingle_sets, slices, split_words

SMALL = 64  # sets up to this size are judged on all their shingles
HASHES = 8
ALIKE = 0.1
CHUNK = 512


def least_overlap(size: Column, t: int) -> Column:
    """Shingles that a set must share with any partner at 100 J >= t."""
    return F.ceil(size * t / 100)


def _least(a: int | np.ndarray, b: int | np.ndarray, t: int):
    """Smallest overlap i with 100 i >= t (a + b - i)."""
    return -(-(t * (a + b)) // (100 + t))


def _bound(part: float) -> int:
    return min(2**64 - 1, int(part * 2.0**64))


def sets(docs: DataFrame, n: int, part: float, full: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, sid, size, tokens, *keep): the set's digest, its size, and all its shingles (`full`) or those that
    step 2 looks at: all of sets up to a little over SMALL, else those in the first `part` of the hash range."""
    bound = np.uint64(_bound(part))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(column(batch, "text")):
                found = shingle_sets(split_words(column(batch, "text").slice(a, b - a)), n)
                sid = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None for s in found]
                kept = found if full else [s if len(s) <= 2 * SMALL else s[: np.searchsorted(s, bound)] for s in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sid, pa.int64()), pa.array([len(s) for s in found], pa.int64()), list_array(kept),
                     *[column(batch, c).slice(a, b - a) for c in keep]], ["doc_id", "sid", "size", "tokens", *keep])

    schema = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(F.col("doc_id").cast("bigint"), "text", *keep).mapInArrow(giving_back(kernel), "doc_id bigint, sid bigint, size bigint, tokens array<bigint>" + schema)


def live_sets(rows: DataFrame, t: int, part: float) -> DataFrame:
    """(sid, size, copies, first) of the sets that may have a partner (step 2)."""
    token = F.explode("tokens").alias("token")
    # min = max: all holders are copies of one set.
    holders = rows.where("sid IS NOT NULL").select("sid", "size", token).groupBy("token").agg(
        F.min("sid").alias("sid"), F.max("sid").alias("other"), F.max("size").alias("size"))
    # Larger sets are judged on the part of the hash range that all their partners emit.
    judged = (F.col("size") <= SMALL) | (F.col("token").bitwiseXOR(F.lit(-(2**63))) < F.lit(_bound(part) - 2**63))
    lone = holders.where((F.col("sid") == F.col("other")) & judged).groupBy("sid").agg(F.count(F.lit(1)).alias("lone"))
    each = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id")).alias("first"))
    # A set of up to SMALL shingles has partners of up to 100 SMALL / t, which are below 2 SMALL and emit all theirs.
    may_lack = F.col("size") - least_overlap(F.col("size"), t)
    return each.join(lone, "sid", "left").where(F.coalesce("lone", F.lit(0)) <= may_lack).select("sid", "size", "copies", "first")


def prefixes(tokens: DataFrame, t: int) -> DataFrame:
    """Index entries (token, sid, size, pos) of rare-first prefixes; shingles of one set only need no entry."""
    flat = tokens.select("sid", "size", F.explode("tokens").alias("token"))
    known = flat.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = flat.join(known, "token")
    order = Window.partitionBy("sid").orderBy("df", "token")  # one set: as many rows as the text has shingles
    counted = shared.withColumn("rank", F.row_number().over(order) - 1).withColumn("shared", F.count(F.lit(1)).over(Window.partitionBy("sid")))
    return counted.withColumn("pos", F.col("size") - F.col("shared") + F.col("rank")).where(
        F.col("pos") <= F.col("size") - least_overlap(F.col("size"), t)).select("token", "sid", "size", "pos")


def pivots(tokens: DataFrame, hashes: int = HASHES) -> DataFrame:
    """(sid, pivot): the smallest set of the MinHash bucket; of several buckets' answers the most frequent."""
    salts = np.random.default_rng(7).integers(0, 2**64, hashes, np.uint64)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = list_parts(column(batch, "tokens"))
            if not len(flat):
                continue
            least = np.array([np.minimum.reduceat(mix(flat.view(np.uint64) ^ s), offsets[:-1]) for s in salts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "sid"), list_array(list(least.T))], ["sid", "mins"])

    mins = tokens.select("sid", "tokens").mapInArrow(giving_back(kernel), "sid bigint, mins array<bigint>").select("sid", F.posexplode("mins").alias("slot", "least"))
    named = mins.join(mins.groupBy("slot", "least").agg(F.min("sid").alias("pivot")), ["slot", "least"])
    votes = named.groupBy("sid", "pivot").agg(F.count(F.lit(1)).alias("votes"))
    return votes.groupBy("sid").agg(F.max(F.struct("votes", (-F.col("pivot")).alias("p"))).alias("best")).select("sid", (-F.col("best.p")).alias("pivot"))


def differences(pairs: DataFrame) -> DataFrame:
    """From (sid, size, tokens, fam, ptokens, ...): minus (|P\\A|) and diff (sorted P\\A and A\\P) instead of the sets."""
    kept = [c for c in pairs.columns if c not in ("tokens", "ptokens")]
    schema = pairs.select(*kept, F.lit(0).cast("bigint").alias("psize"), F.lit(0).cast("bigint").alias("minus"), F.col("tokens").alias("diff")).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, a = list_parts(column(batch, "tokens"))
            other, b = list_parts(column(batch, "ptokens"))
            minus, diff = [], []
            for i in range(batch.num_rows):
                x, p = mine[a[i]: a[i + 1]], other[b[i]: b[i + 1]]
                d = np.setxor1d(x, p, assume_unique=True)
                minus.append((len(d) - (len(x) - len(p))) // 2)
                diff.append(d)
            yield pa.RecordBatch.from_arrays(
                [*[column(batch, c) for c in kept], pa.array(np.diff(b), pa.int64()), pa.array(minus, pa.int64()), list_array(diff)], schema.names)

    return pairs.select(*kept, "tokens", "ptokens").mapInArrow(giving_back(kernel), schema)


def compare_chunks(left: dict, right: dict | None, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of two chunks of a family (or of one: i < j), and how many needed their differences.

    A chunk holds arrays size, minus, psize, guest and a list diff. Sizes and bounds decide first."""
    other = right or left
    a, b = left["size"][:, None], other["size"][None, :]
    need = _least(a, b, t)
    known = left["psize"][:, None] - left["minus"][:, None] - other["minus"][None, :]
    na, nb = np.array([len(d) for d in left["diff"]]), np.array([len(d) for d in other["diff"]])
    ask = ~(left["guest"][:, None] & other["guest"][None, :])
    if right is None:
        ask &= np.arange(len(na))[:, None] < np.arange(len(nb))[None, :]
    linked = ask & (known >= need)
    open_ = ask & ~linked & (known + np.minimum(na[:, None], nb[None, :]) >= need)
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if len(rows):
        common = _common([left["diff"][i] for i in rows], [other["diff"][j] for j in cols])
        spot = np.ix_(rows, cols)
        linked[spot] |= open_[spot] & (known[spot] + common >= need[spot])
    i, j = np.nonzero(linked)
    return i, j, open_


def _common(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sorted arrays, as products of 0/1 matrices over slabs of the values both sides have."""
    la, ra = np.concatenate(left), np.concatenate(right)
    li, ri = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(la, ra)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(both):
        return out.astype(np.int64)
    sides = []
    for values, owner in ((la, li), (ra, ri)):
        spot = np.searchsorted(both, values)
        hit = both[np.minimum(spot, len(both) - 1)] == values
        order = np.argsort(spot[hit], kind="stable")
        sides.append((spot[hit][order], owner[hit][order]))
    for low in range(0, len(both), columns):
        slabs = []
        for (spot, owner), n in zip(sides, (len(left), len(right))):
            x, y = np.searchsorted(spot, [low, low + columns])
            slab = np.zeros((n, min(columns, len(both) - low)), np.float32)
            slab[owner[x:y], spot[x:y] - low] = 1
            slabs.append(slab)
        out += slabs[0] @ slabs[1].T
    return np.rint(out).astype(np.int64)


def _forest(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Spanning forest of links between numbered sets."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist()):
        p, q = root(x), root(y)
        if p != q:
            parent[p] = q
            out.append((x, y))
    return out


def family_links(members: DataFrame, t: int) -> DataFrame:
    """From members and guests (fam, sid, size, copies, guest, psize, minus, diff): rows (sid, n, other) where n
    counts documents linked to sid, and other (if not null) is a set of the spanning forest linked to it."""
    sizes = members.groupBy("fam").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    spread = members.join(sizes, "fam").withColumn("_k", F.ceil(F.col("_m") / CHUNK).cast("int")).withColumn(
        "_c", F.pmod(F.xxhash64("sid"), F.col("_k")).cast("int"))
    other = F.sequence(F.lit(0), F.col("_k") - 1)
    dealt = spread.withColumn("_o", F.explode(other)).select(
        "fam", F.least("_c", "_o").alias("_lo"), F.greatest("_c", "_o").alias("_hi"), F.col("_c").alias("_own"), "sid", "size", "copies", "guest", "psize", "minus", "diff")

    def kernel(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        own = table["_own"].to_numpy()

        def chunk(which: np.ndarray) -> dict:
            part = table.take(pa.array(which)).combine_chunks()
            flat, offsets = list_parts(part["diff"].chunk(0)) if part.num_rows else (np.zeros(0, np.int64), np.zeros(1, np.int64))
            return {**{c: part[c].to_numpy() for c in ("sid", "size", "copies", "psize", "minus")}, "guest": np.asarray(part["guest"].to_numpy(zero_copy_only=False), bool),
                    "diff": [flat[offsets[k]: offsets[k + 1]] for k in range(part.num_rows)]}

        left = chunk(np.flatnonzero(own == low))
        right = chunk(np.flatnonzero(own == high)) if high != low else None
        other = right or left
        if not len(left["sid"]) or not len(other["sid"]):
            return pa.table({"sid": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        i, j, _ = compare_chunks(left, right, t)
        ids = np.concatenate([left["sid"], other["sid"]])
        n = np.concatenate([np.bincount(i, other["copies"][j], len(left["sid"])), np.bincount(j, left["copies"][i], len(other["sid"]))]).astype(np.int64)
        shift = len(left["sid"]) if right else 0
        edges = _forest(i, j + shift)
        hit = np.flatnonzero(n)
        return pa.table({"sid": pa.array(np.concatenate([ids[hit], [ids[x] for x, _ in edges]]).astype(np.int64)),
                         "n": pa.array(np.concatenate([n[hit], np.zeros(len(edges))]).astype(np.int64)),
                         "other": pa.array([None] * len(hit) + [int(ids[y]) for _, y in edges], pa.int64())})

    # Families without company are out; chunk pairs are dealt by key, so groups of two chunks are one task's work.
    return dealt.repartition(partitions(members.sparkSession), "fam", "_lo", "_hi").groupBy("fam", "_lo", "_hi").applyInArrow(kernel, "sid bigint, n bigint, other bigint")


def linked(docs: DataFrame, n: int = 5, t: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document: sets of n-word shingles, linked at 100 J >= t."""
    return families(docs, n, t).drop("root")


def families(docs: DataFrame, n: int = 5, t: int = 80, keep: tuple[str, ...] = ()) -> DataFrame:
    """`linked`, and `root`, a number that the rows of one component share (null without words), and the columns
    in `keep`. Components of different texts may have one component_id if ids repeat, but never one root."""
    part = min(1.0, (100 - t) / 100 * 2)
    rows = materialise(sets(docs, n, part, keep=keep), "shingle-sets")
    live = materialise(live_sets(rows, t, part), "live-sets")
    ids = F.coalesce(F.col("first.doc_id"), F.lit(-(2**63)))
    wanted = live.select("sid", "size", ids.alias("_id"))
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("_id"), "text").join(wanted.select("_id").distinct(), "_id")
    tokens = materialise(sets(texts.withColumnRenamed("_id", "doc_id"), n, part, full=True).dropDuplicates(["sid"]).join(
        live.select("sid", "copies"), "sid").select("sid", "size", "copies", "tokens"), "live-tokens")
    entries = materialise(prefixes(tokens, t), "prefixes")
    asked = entries.select("sid").distinct()
    wide = tokens.join(asked, "sid")
    pivot = pivots(wide)
    reference = tokens.select(F.col("sid").alias("fam"), F.col("tokens").alias("ptokens"))
    near = differences(wide.join(pivot, "sid").withColumnRenamed("pivot", "fam").join(reference, "fam"))
    plus = F.size("diff") - F.col("minus")
    alike = F.col("psize") - F.col("minus") >= ALIKE * (F.col("psize") + plus)
    own = F.struct(F.col("size").alias("psize"), F.lit(0).cast("bigint").alias("minus"), F.array().cast("array<bigint>").alias("diff"))
    members = materialise(near.select("sid", "size", "copies", F.when(alike, F.col("fam")).otherwise(F.col("sid")).alias("fam"), F.when(
        alike, F.struct("psize", "minus", "diff")).otherwise(own).alias("d")).select(
        "fam", "sid", "size", "copies", F.lit(False).alias("guest"), "d.psize", "d.minus", "d.diff"), "members")
    # Step 4. Each pair of families is looked at from the smaller one.
    placed = entries.join(members.select("sid", "fam"), "sid")
    block = placed.groupBy("token", F.col("fam").alias("fam2")).agg(
        F.min("size").alias("lo"), F.max("size").alias("hi"), F.max(F.col("size") - F.col("pos")).alias("rest"))
    shared = block.groupBy("token").agg(F.count(F.lit(1)).alias("families")).where("families > 1").select("token")
    visits = placed.join(shared, "token").join(block.join(shared, "token"), "token").where(
        (F.col("fam") < F.col("fam2")) & (100 * F.col("hi") >= t * F.col("size")) & (100 * F.col("size") >= t * F.col("lo"))
        & (F.least(F.col("size") - F.col("pos"), F.col("rest")) >= least_overlap(F.greatest("size", "lo"), t))).select("sid", "fam2").distinct()
    guests = differences(tokens.join(visits, "sid").withColumnRenamed("fam2", "fam").join(reference, "fam"))
    most = members.groupBy("fam").agg(F.max(F.size("diff") - F.col("minus")).alias("_plus"))
    guests = guests.join(most, "fam").where(F.col("psize") - F.col("minus") + F.least(F.size("diff") - F.col("minus"), F.col("_plus")) >= least_overlap(F.col("size"), t)).select(
        "fam", "sid", "size", "copies", F.lit(True).alias("guest"), "psize", "minus", "diff")
    found = materialise(family_links(members.unionByName(guests), t), "links")
    counts = found.groupBy("sid").agg(F.sum("n").alias("n"))
    component = components(found.where("other IS NOT NULL").select(F.col("sid").alias("a"), F.col("other").alias("b")))
    each = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    label = each.join(component, each["sid"] == component["node"], "left").withColumn("_root", F.coalesce("root", "sid"))
    least = label.groupBy("_root").agg(F.min("first").alias("component_id"))
    of_set = label.join(least, "_root").join(counts, "sid", "left").select(
        F.col("sid").alias("_sid"), F.col("_root").alias("root"), "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = rows.select("doc_id", "sid", F.col("size").alias("n_shingles"), *keep).join(of_set, F.col("sid") == F.col("_sid"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "root", *keep)


def op4_jaccard_join(docs: DataFrame) -> DataFrame:
    return linked(docs.select("doc_id", "text"), 3, 90)
