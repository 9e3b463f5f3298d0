"""Memory that tasks hold and leave behind, and the terms of the chain's sample."""

import collections
import random
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from signalgrid.llm import text, toxicity_chain


def anonymous_mb() -> float:
    return int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1e3


def test_a_finished_task_gives_memory_back():
    def kernel(batches):
        blocks = [np.ones(12_000) for _ in range(2_000)]  # 192 MB in pieces below the allocator's own limit for single maps
        left.append(blocks[-1])
        yield from batches

    left: list = []
    before = anonymous_mb()
    assert list(text.giving_back(kernel)(iter([1, 2]))) == [1, 2]
    assert anonymous_mb() < before + 60


def test_sample_terms_against_brute_force():
    rnd = random.Random(5)
    words = ["abcd", "abcde", "abcdef", "^abcd", "^abcde", "^abc", "wxyz", "wxyzu", "q", "^", "ßüöäx"]
    lists = [rnd.sample(words, rnd.randint(0, 6)) for _ in range(60)]
    heads = [{t for w in ws for t in (w, *("^" + w[:k] for k in toxicity_chain.PREFIXES if len(w) > k))} for ws in lists]
    often = {t for t, n in collections.Counter(t for h in heads for t in h).items() if n >= toxicity_chain.LEAST_DOCUMENTS}
    got = toxicity_chain._Sample(pa.array(lists, pa.list_(pa.string())))
    pairs = sorted((int(r), str(got.names[c])) for r, c in zip(got.row, got.code))
    assert pairs == sorted((i, t) for i, h in enumerate(heads) for t in h & often)
    assert len(toxicity_chain._Sample(pa.array([[], []], pa.list_(pa.string()))).row) == 0


def test_sample_holds_pairs_of_one_kind_at_a_time():
    rng = np.random.default_rng(3)
    flat = pa.array([f"word{i:06d}" for i in range(20_000)]).take(pa.array(rng.integers(0, 20_000, 600_000)))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 600_001, 300, dtype=np.int32)), flat)
    tracemalloc.start()
    toxicity_chain._Sample(lists)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak
