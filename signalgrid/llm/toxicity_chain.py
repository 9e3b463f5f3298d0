"""Toxicity by a chain of linear classifiers.

The label columns are predicted one after the other. Each later model sees the words of the
text and the probabilities of the categories before it. For training, those probabilities
are out-of-fold: a row's come from a model that did not see the row, so later models learn
from values as good as those they will meet. The cut-off for a rejection is chosen on
out-of-fold probabilities as well.

Models are fitted on `SAMPLE` labelled rows at most, picked by the hash of the id (the bound
is the stated parameter), in one task. All documents are scored whole, in one projection
without a shuffle. Null or empty texts have no words and get the probability of the
intercepts. Without labels of both classes a category is constant. Of repeated labels of an
id the largest counts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalgrid.llm.tables import materialise
from signalgrid.llm.text import column, giving_back

SAMPLE = 8_000
FOLDS = 3
FEATURES = 1024
LEAST_DOCUMENTS = 5
PREFIXES = (4, 5)
RIDGE = 0.5


def terms(text: Column) -> Column:
    """Distinct lower-cased words without punctuation, and their first letters (marked by ^)."""
    blank = F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\u000b\f\r.,;:!?\"()[]", " " * 15)
    return F.array_distinct(F.filter(F.split(blank, " "), lambda w: w != ""))


@dataclass
class Link:
    """One model of the chain: logit = intercept + weights of terms + weights of earlier probabilities."""

    label: str
    intercept: float
    weights: dict[str, float]
    earlier: list[float]
    cut: float


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 80, memory: int = 8) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge-penalised logistic regression, by L-BFGS."""
    n, ones = len(y), float(y.sum())
    if not 0 < ones < n:
        return (10.0 if n and ones == n else -10.0), np.zeros(x.shape[1])
    theta = np.zeros(x.shape[1] + 1)
    theta[0] = np.log(ones / (n - ones))
    penalty = np.full(len(theta), ridge)
    penalty[0] = 0.0

    def value(t: np.ndarray) -> tuple[float, np.ndarray]:
        z = t[0] + (x @ t[1:].astype(np.float32)).astype(float)
        error = 1 / (1 + np.exp(-z)) - y
        gradient = np.concatenate([[error.sum()], (error.astype(np.float32) @ x).astype(float)]) + penalty * t
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (penalty * t * t).sum()), gradient

    loss, slope = value(theta)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        step, stack = slope.copy(), []
        for s, d, r in reversed(pairs):
            stack.append(r * (s @ step))
            step -= stack[-1] * d
        step *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(slope).sum())
        for s, d, r in pairs:
            step += s * (stack.pop() - r * (d @ step))
        rate, drop = 1.0, slope @ step
        while True:
            new_loss, new_slope = value(theta - rate * step)
            if new_loss <= loss - 1e-4 * rate * drop or rate < 1e-8:
                break
            rate /= 2
        move, change = -rate * step, new_slope - slope
        if move @ change > 1e-12:
            pairs = [*pairs, (move, change, 1 / (move @ change))][-memory:]
        theta, done = theta + move, loss - new_loss < 1e-6 * max(1.0, abs(loss))
        loss, slope = new_loss, new_slope
        if done:
            break
    return float(theta[0]), theta[1:]


class _Sample:
    """Labelled rows as (row, term number) pairs; terms of fewer than LEAST_DOCUMENTS rows are left out."""

    def __init__(self, term_lists: pa.Array):
        offsets = np.asarray(term_lists.offsets)
        coded = term_lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        row = np.repeat(np.arange(len(term_lists), dtype=np.int32), np.diff(offsets))
        code, names = np.asarray(coded.indices), coded.dictionary.to_pylist()
        del coded
        # A word's first letters are terms as well, so inflections share weight. Kinds of terms are worked off
        # one by one and leave only terms of enough rows, which holds the pairs of one kind at a time.
        every = {w: i for i, w in enumerate(names)}
        kinds = [np.arange(len(names), dtype=np.int32)]
        for k in PREFIXES:
            kinds.append(np.array([every.setdefault("^" + w[:k], len(every)) if len(w) > k else -1 for w in names], np.int32))
        self.rows, self.names, rows, codes = len(term_lists), np.array(list(every), object), [], []
        span = np.int64(max(1, len(every)))
        for head in kinds[1:] + kinds[:1]:
            term = head[code]
            has = term >= 0
            pairs = row[has] * span + term[has]
            if head is not kinds[0]:
                # A word that reads like the mark of first letters ("^abcd") is that term and counts with it.
                twin = np.zeros(len(names) + 1, bool)
                twin[head[(head >= 0) & (head < len(names))]] = True
                kinds[0][twin[:-1]] = -1
                same = twin[code]
                pairs = np.concatenate([pairs, row[same] * span + code[same]])
            pairs = np.unique(pairs)
            term = (pairs % span).astype(np.int32)
            often = (np.bincount(term, minlength=len(every)) >= LEAST_DOCUMENTS)[term] if len(term) else np.zeros(0, bool)
            rows.append((pairs[often] // span).astype(np.int32))
            codes.append(term[often])
        self.row, self.code = np.concatenate(rows), np.concatenate(codes)

    def chosen(self, y: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The FEATURES terms with the largest chi-square against y, over the rows `among`."""
        use = among[self.row]
        n, ones = among.sum(), y[among].sum()
        seen = np.bincount(self.code[use], minlength=len(self.names))
        hit = np.bincount(self.code[use], y[self.row[use]], len(self.names))
        expected = seen * ones / max(1, n)
        spread = expected * (1 - ones / max(1, n)) * (1 - seen / max(1, n))
        chi = np.where((seen > 0) & (spread > 0), (hit - expected) ** 2 / np.maximum(spread, 1e-12), 0.0)
        return np.sort(np.argsort(-chi, kind="stable")[:FEATURES][np.sort(-chi)[:FEATURES] < 0])

    def matrix(self, columns: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, len(columns) + before.shape[1]), np.float32)
        spot = np.full(len(self.names), -1)
        spot[columns] = np.arange(len(columns))
        hit = spot[self.code] >= 0
        out[self.row[hit], spot[self.code[hit]]] = 1
        out[:, len(columns):] = before
        return out


def fit_chain(term_lists: pa.Array, labels: dict[str, np.ndarray], fold: np.ndarray) -> list[Link]:
    """The models of the chain, each on the out-of-fold probabilities of those before it."""
    sample, links = _Sample(term_lists), []
    before = np.zeros((sample.rows, 0), np.float32)
    for label, y in labels.items():
        held = np.zeros(sample.rows)
        for k in range(FOLDS):
            train = fold != k
            columns = sample.chosen(y, train)
            x = sample.matrix(columns, before)
            intercept, weights = logistic(x[train], y[train])
            held[~train] = 1 / (1 + np.exp(-(intercept + x[~train] @ weights)))
        columns = sample.chosen(y, np.ones(sample.rows, bool))
        intercept, weights = logistic(sample.matrix(columns, before), y)
        names = sample.names[columns]
        links.append(Link(label, intercept, {str(w): float(v) for w, v in zip(names, weights)}, [float(v) for v in weights[len(names):]], best_cut(held, y)))
        before = np.column_stack([before, held]).astype(np.float32)
    return links


def best_cut(p: np.ndarray, y: np.ndarray) -> float:
    """The probability, in hundredths, with the best F1; the middle of equally good ones."""
    cuts = np.arange(5, 100) / 100
    score = np.array([2 * y[p >= c].sum() / max(1.0, (p >= c).sum() + y.sum()) for c in cuts])
    best = cuts[score >= score.max() - 1e-9]
    return float(best[len(best) // 2])


def fit(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...], sample: int = SAMPLE) -> list[Link]:
    known = labels.select(F.col("doc_id").alias("_id"), *[F.col(c).cast("double").alias(c) for c in chain]).dropna().groupBy("_id").agg(
        *[F.max(c).alias(c) for c in chain])
    # The smallest hashes of the ids: the same rows on every run. Only ids and labels are sorted.
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # Of documents with one id, the text with the smallest hash counts; no whole text is sorted.
    rows = docs.join(F.broadcast(picked), docs["doc_id"] == picked["_id"]).select("doc_id", *chain, F.sha2("text", 256).alias("_h"), terms(F.col("text")).alias("terms"))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("_h"))).where("_n = 1").select(
        "doc_id", *chain, "terms", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [b for b in batches if b.num_rows]
        if not table:
            return
        whole = pa.Table.from_batches(table).sort_by("doc_id").combine_chunks()
        table.clear()
        y = {c: whole[c].to_numpy() for c in chain}
        links = fit_chain(whole["terms"].chunk(0), y, whole["fold"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps([asdict(k) for k in links])])], ["links"])

    found = materialise(materialise(rows, "chain-sample").coalesce(1).mapInArrow(giving_back(kernel), "links string"), "chain-models").collect()
    if not found:
        return [Link(c, -10.0, {}, [0.0] * k, 0.5) for k, c in enumerate(chain)]
    return [Link(**k) for k in json.loads(found[0]["links"])]


def score(docs: DataFrame, links: list[Link]) -> DataFrame:
    """`docs` with p_<label> of every category. The weights (FEATURES terms a model) go to the tasks."""
    table: dict[str, list[float]] = {w: [link.weights.get(w, 0.0) for link in links] for link in links for w in link.weights}
    shared = docs.sparkSession.sparkContext.broadcast(table)
    kept, schema = docs.columns, docs.select("*", F.array(F.lit(0.0)).alias("_sums")).schema

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, zero = shared.value, np.zeros(len(links))

        def heads(word: str) -> list[str]:
            return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]

        for batch in batches:
            lists = column(batch, "_terms")
            offsets = np.asarray(lists.offsets)
            coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
            # Terms that carry weight, by distinct word of the batch; a term counts once in a text.
            numbers: dict[str, int] = {}
            carried = [[numbers.setdefault(t, len(numbers)) for t in heads(w) if t in weights] for w in coded.dictionary.to_pylist()]
            code = np.asarray(coded.indices)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            size = np.array([len(c) for c in carried], np.int64)
            flat = np.array([t for c in carried for t in c], np.int64)
            first = np.cumsum(size) - size
            times = size[code] if len(code) else np.zeros(0, np.int64)
            at = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first[code] if len(code) else times, times)
            pairs = np.unique(np.repeat(row, times) * np.int64(len(numbers) + 1) + (flat[at] if len(at) else 0)) if len(at) else np.zeros(0, np.int64)
            value = np.array([weights[t] for t in numbers] + [zero], float)
            sums = np.zeros((batch.num_rows, len(links)))
            np.add.at(sums, pairs // (len(numbers) + 1), value[pairs % (len(numbers) + 1)])
            out = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(links)), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in kept], out], schema.names)

    out = docs.withColumn("_terms", terms(F.col("text"))).mapInArrow(giving_back(kernel), schema)
    for k, link in enumerate(links):
        logit = F.lit(link.intercept) + F.col("_sums")[k]
        for earlier, weight in zip(links, link.earlier):
            logit = logit + F.col(f"p_{earlier.label}") * weight
        out = out.withColumn(f"p_{link.label}", 1 / (1 + F.exp(-logit)))
    return out.drop("_sums")


def chain_scores(docs: DataFrame, labels: DataFrame, chain: tuple[str, ...] = ("quality", "toxic"), sample: int = SAMPLE) -> DataFrame:
    """`docs` with p_<label> per category and `rejected`: the last category reaches its cut-off."""
    own = {"_terms", "_sums", "rejected", *(f"p_{c}" for c in chain)}
    links = fit(docs, labels, chain, sample)
    scored = score(docs.select(*[c for c in docs.columns if c.lower() not in own]), links)
    return scored.withColumn("rejected", F.col(f"p_{chain[-1]}") >= links[-1].cut)


def op2_toxicity_chain(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return chain_scores(docs.select("doc_id", "text"), labels).select(
        "doc_id", "p_quality", "p_toxic", F.col("rejected").alias("toxic"))
