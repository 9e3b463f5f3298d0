"""Language-model scores from a subword lattice.

A word is spelled by pieces of an existing vocabulary in many ways; its probability is the
sum over all of them, computed by forward recursion in log space over the byte positions
of the word. A document's probability is the product over its words and one end symbol.
The vocabulary's own scores give the first piece weights; passes of expectation and
maximisation over the words of the training documents fit them to the corpus, each spread
over the distinct words with their counts. Only the piece table (vocabulary size) is sent to tasks.

A plain add-one word score stands beside it. Its counts cover every training word: frequent
words (`FREQUENT` at most) go to the tasks as a table, the others are joined by shuffle.

Null or empty texts are one end symbol. Words of any length are scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.llm.tables import materialise
from signalgrid.llm.text import Words, column, list_array, slices, split_words

FREQUENT = 400_000
PASSES = 2
FLOOR = 0.01
END = 0x5851F42D4C957F2D  # stands for the end symbol among the word hashes
_P = np.uint64(0x9E3779B97F4A7C55)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def _spell(codes: np.ndarray) -> int:
    h = 0
    for c in codes.tolist():
        h = (h * int(_P) + c + 1) & (2**64 - 1)
    return h


@dataclass
class Pieces:
    """Pieces as hashes of their bytes in an open table; entry = piece number, -1 when empty."""

    keys: np.ndarray
    entry: np.ndarray
    mask: int
    longest: int

    @staticmethod
    def of(pieces: list[bytes]) -> Pieces:
        size = 1 << max(12, (4 * len(pieces)).bit_length())
        keys, entry = np.zeros(size, np.uint64), np.full(size, -1, np.int64)
        for i, p in enumerate(pieces):
            h = _spell(np.frombuffer(p, np.uint8))
            at = ((h * int(_SPREAD)) & (2**64 - 1)) >> 40 & (size - 1)
            while entry[at] >= 0:
                at = (at + 1) & (size - 1)
            keys[at], entry[at] = h, i
        return Pieces(keys, entry, size - 1, max(map(len, pieces), default=1))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = ((hashes * _SPREAD) >> np.uint64(40) & np.uint64(self.mask)).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.entry[at], -1)
        # Go on past other keys, as long as any place probed is taken.
        open_ = np.flatnonzero((self.keys[at] != hashes) & (self.entry[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            here = at[open_]
            match = self.keys[here] == hashes[open_]
            out[open_[match]] = self.entry[here[match]]
            open_ = open_[~match & (self.entry[here] >= 0)]
        return out


@dataclass
class Vocabulary:
    """Pieces that begin a word, pieces that go on, and the log weight of each (begin ones first)."""

    begin: Pieces
    inner: Pieces
    n_begin: int
    weights: np.ndarray


def vocabulary(model_path: str) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """Pieces of a sentencepiece model that lower-cased words can contain, with first weights from its scores.

    Scores that are ranks (whole numbers) are read as a Zipf law; others as log probabilities. Single bytes
    are always pieces, so every word has a spelling; the mark of a word's begin alone is a begin piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    begin, inner = {b"": 0.0}, {bytes([i]): 0.0 for i in range(256)}
    scores = [model.get_score(i) for i in range(model.get_piece_size())]
    ranks = all(s == round(s) for s in scores)
    for i, s in enumerate(scores):
        if model.is_control(i) or model.is_unknown(i):
            continue
        piece = model.id_to_piece(i)
        weight = 1.0 / (10.0 - s) if ranks else math.exp(s)
        if model.is_byte(i):
            inner[bytes([int(piece[3:5], 16)])] += 1e-7
            continue
        where, body = (begin, piece[1:]) if piece.startswith("▁") else (inner, piece)
        if "▁" in body or any("A" <= c <= "Z" for c in body):
            continue
        where[body.encode()] = where.get(body.encode(), 0.0) + weight
    weights = np.array([*begin.values(), *inner.values()])
    return list(begin), list(inner), weights


def _blocks(at: np.ndarray, size: np.ndarray, cells: int = 1 << 20) -> Iterator[np.ndarray]:
    """Words in blocks of like length, of about `cells` padded positions each."""
    order = np.argsort(size, kind="stable")
    i = 0
    while i < len(order):
        step = max(1, cells // max(1, int(size[order[i]]) + 4))
        part = order[i: i + step]
        part = part[size[part] <= max(2 * int(size[part[0]]), 8)]
        yield part
        i += len(part)


def word_scores(letters: np.ndarray, at: np.ndarray, size: np.ndarray, vocab: Vocabulary, counts: np.ndarray | None = None,
                expected: np.ndarray | None = None) -> np.ndarray:
    """Log probability of each word; with `expected`, adds counts-weighted expected uses of the pieces to it."""
    out = np.zeros(len(size))
    for part in _blocks(at, size):
        n, width = len(part), int(size[part].max())
        lens = size[part]
        codes = np.zeros((width, n), np.uint64)
        for k in range(width):
            alive = lens > k
            codes[k, alive] = letters[at[part[alive]] + k].astype(np.uint64) + np.uint64(1)
        # edges[l][i]: piece of length l that starts at position i, by word.
        edges: list[np.ndarray] = []
        heads = np.full((min(vocab.begin.longest, width) + 1, n), 0, np.int64)
        spelled = np.zeros((width, n), np.uint64)
        for length in range(1, min(max(vocab.inner.longest, vocab.begin.longest), width) + 1):
            spelled = spelled[: width - length + 1] * _P + codes[length - 1:]
            if length <= vocab.begin.longest:
                found = vocab.begin.find(spelled[0])
                heads[length] = np.where(lens >= length, found, -1)
            if length <= vocab.inner.longest:
                found = vocab.inner.find(spelled.ravel()).reshape(spelled.shape)
                within = lens[None, :] >= np.arange(length, width + 1)[:, None]
                edges.append(np.where(within & (found >= 0), found + vocab.n_begin, -1))
        padded = np.append(vocab.weights, -np.inf)
        alpha = np.full((width + 1, n), -np.inf)
        for j in range(width + 1):
            options = [padded[heads[j]]] if j < len(heads) else []
            options += [alpha[j - k - 1] + padded[edges[k][j - k - 1]] for k in range(min(j, len(edges)))]
            alpha[j] = _logsum(options)
        total = alpha[lens, np.arange(n)]
        out[part] = total
        if expected is None:
            continue
        beta = np.full((width + 1, n), -np.inf)
        beta[lens, np.arange(n)] = 0.0
        for i in range(width - 1, -1, -1):
            reach = [beta[i + k + 1] + padded[edges[k][i]] for k in range(min(width - i, len(edges)))]
            beta[i] = np.where(lens == i, 0.0, _logsum(reach))
        weight = np.log(counts[part]) - total
        for j in range(len(heads)):
            _add(expected, heads[j], padded[heads[j]] + beta[j] + weight)
        for k, edge in enumerate(edges):
            for i in range(len(edge)):
                _add(expected, edge[i], alpha[i] + padded[edge[i]] + beta[i + k + 1] + weight)
    return out


def _logsum(options: list[np.ndarray]) -> np.ndarray:
    if len(options) == 1:
        return options[0]
    stack = np.array(options)
    top = stack.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stack - safe).sum(axis=0))


def _add(expected: np.ndarray, pieces: np.ndarray, log_uses: np.ndarray) -> None:
    hit = (pieces >= 0) & (log_uses > -50)
    expected += np.bincount(pieces[hit], np.exp(log_uses[hit]), len(expected))


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """One word of each kind, and the kind of every word."""
    _, pick, kind = np.unique(words.hash, return_index=True, return_inverse=True)
    return pick, kind


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, word, c) of all distinct words of `docs`, exact."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text")
            for a, b in slices(texts, 4 << 20):
                words = split_words(texts.slice(a, b - a))
                pick, kind = _distinct(words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words.hash[pick].view(np.int64)), words.picked(pick), pa.array(np.bincount(kind, minlength=len(pick)))], ["h", "word", "c"])

    return docs.select("text").mapInArrow(kernel, "h bigint, word binary, c bigint").groupBy("h", "word").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, n_docs: int, model_path: str, passes: int = PASSES) -> tuple[Vocabulary, float]:
    """Piece weights for the words of the corpus, and the log weight of the end symbol."""
    begin, inner, weights = vocabulary(model_path)
    heads, tails, n = Pieces.of(begin), Pieces.of(inner), len(begin)
    context = counts.sparkSession.sparkContext
    weights = np.log((weights + 1e-7) / (weights + 1e-7).sum())
    end = math.log(0.01)
    for _ in range(passes):
        shared = context.broadcast(Vocabulary(heads, tails, n, weights))

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab = shared.value  # noqa: B023 - used before the next pass
            total = np.zeros(len(vocab.weights))
            for batch in batches:
                for a, b in slices(column(batch, "word"), 1 << 20):
                    part = column(batch, "word").slice(a, b - a)
                    offsets = np.frombuffer(part.buffers()[1], np.int32)[part.offset: part.offset + len(part) + 1].astype(np.int64)
                    letters = np.frombuffer(part.buffers()[2], np.uint8)
                    c = column(batch, "c").slice(a, b - a).to_numpy().astype(float)
                    word_scores(letters, offsets[:-1], np.diff(offsets), vocab, c, total)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "uses"])

        sums = counts.select("word", "c").mapInArrow(kernel, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.full(len(weights), FLOOR)
        for row in sums.toLocalIterator():  # at most one row per piece of the vocabulary
            uses[row["piece"]] += row["uses"]
        total = uses.sum() + n_docs + 1
        weights, end = np.log(uses / total), math.log((n_docs + 1) / total)
    return Vocabulary(heads, tails, n, weights), end


def frequent(counts: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes and counts of all words more frequent than a cutoff, which lets at most `most` words pass."""
    by_count = counts.groupBy(F.least("c", F.lit(1 << 16)).alias("c")).count().collect()  # 65,536 rows at most
    cutoff, size = 1 << 16, 0
    for c, n in sorted(((r["c"], r["count"]) for r in by_count), reverse=True):
        if size + n > most:
            break
        cutoff, size = c, size + n
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), 2**63 - 1  # above every count: all words are joined
    table = counts.where(F.col("c") >= cutoff).select("h", "c").toArrow()
    h, c = table["h"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order], cutoff


def add_one(n: int, v: int) -> int:
    """Denominator of add-one smoothing with one place for unseen tokens: N + 1 * (V + 1)."""
    return n + (v + 1)


def score(docs: DataFrame, model_path: str, most_frequent: int = FREQUENT, passes: int = PASSES,
          denominator: Callable[[int, int], int] = lambda n, v: (n + 1) * (v + 1)) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    `denominator` of (training tokens, distinct ones) divides a token's count plus one in the base score."""
    context = docs.sparkSession.sparkContext
    train = docs.where(~held_out() | F.col("doc_id").isNull())
    counts = materialise(word_counts(train), "word-counts")
    n_docs = train.count()
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    vocab, end = fit(counts, n_docs, model_path, passes)
    top_h, top_c, cutoff = frequent(counts, most_frequent)
    shared = context.broadcast((vocab, top_h, top_c))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, top_h, top_c = shared.value
        for batch in batches:
            for a, b in slices(column(batch, "text")):
                part = batch.slice(a, b - a)
                words = split_words(column(part, "text"))
                pick, kind = _distinct(words)
                logs = word_scores(words.letters, words.at[pick], words.size[pick], vocab)
                doc = np.repeat(np.arange(b - a), np.diff(words.first))
                scores = np.bincount(doc, logs[kind], b - a) if len(kind) else np.zeros(b - a)
                h = words.hash[pick]
                spot = np.minimum(np.searchsorted(top_h, h), max(0, len(top_h) - 1))
                common = top_h[spot] == h if len(top_h) else np.zeros(len(h), bool)
                gain = np.where(common, np.log10((top_c[spot] if len(top_h) else 0) + 1.0), 0.0)
                base = np.bincount(doc, gain[kind], b - a) if len(kind) else np.zeros(b - a)
                known = np.bincount(doc, common[kind], b - a) if len(kind) else np.zeros(b - a)
                rare_h, rare_n = [], []
                for d in range(b - a):
                    mine = kind[words.first[d]: words.first[d + 1]]
                    mine, times = np.unique(mine[~common[mine]], return_counts=True)
                    rare_h.append(h[mine].view(np.int64))
                    rare_n.append(times.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*[column(part, c) for c in ("rid", "doc_id", "held_out")], pa.array(np.diff(words.first) + 1, pa.int64()), pa.array(known.astype(np.int64)),
                     pa.array(base), pa.array(scores), list_array(rare_h), list_array(rare_n, pa.int32())],
                    ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "lattice", "rare", "times"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    scored = materialise(rows.mapInArrow(
        kernel, "rid bigint, doc_id bigint, held_out boolean, n_tokens bigint, known bigint, base double, lattice double, rare array<bigint>, times array<int>"), "lattice-scores")
    rare = scored.select("rid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("rid", F.col("x.rare").alias("h"), F.col("x.times").alias("times"))
    # Training words below the cutoff; a word that is not there has never been seen.
    found = rare.join(counts.where(F.col("c") < cutoff).select("h", "c"), "h").groupBy("rid").agg(
        F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_base"))
    unit = math.log10(denominator(n, v))
    end_gain = math.log10(n_docs + 1)
    return scored.drop("rare", "times").join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + int(n_docs > 0)).cast("bigint").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_gain - F.col("n_tokens") * unit).alias("base_score"),
        ((F.col("lattice") + end) / math.log(10)).alias("score"))


def op8_subword_lattice(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return score(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), denominator=add_one)
