"""The contracts' exact columns against brute force on rows unlike the given ones."""

import collections
import math
import random
import zlib

from signalgrid.llm import lattice
from tests.llm.test_operators import words_of


def test_subword_lattice_contract(spark):
    rnd = random.Random(4)
    alphabet = ["a", "B", "ß", "日", "😀", "\u0085", " ", "\x00", "\x1c", "\x1f", "\x7f", "İ"]
    rows = []
    for i in range(120):
        words = ["".join(rnd.choices(alphabet, k=rnd.randint(1, 4))) for _ in range(rnd.randint(0, 30))]
        rows.append((rnd.choice([i, i, i - 1, -i, 10**12 + i]), rnd.choice([None, "", " \t"]) if i % 10 == 0 else rnd.choice(" \t\n\v\f\r").join(words)))
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    c = collections.Counter(t for d, text in rows if not held(d) for t in [*words_of(text), None])
    n, v = sum(c.values()), len(c)
    want = []
    for d, text in rows:
        tokens = [*words_of(text), None]
        want.append((d, held(d), len(tokens), sum(c[t] > 0 for t in tokens), n, round(sum(math.log10((c[t] + 1) / (n + 1 * (v + 1))) for t in tokens), 6)))
    got = lattice.op8_subword_lattice(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((*r[:5], round(r["base_score"], 6)) for r in got) == sorted(want)


def test_merged_is_leftmost_by_rank():
    from signalgrid.llm import prefix_bpe

    rnd = random.Random(8)
    ranks = {bytes([i]): i for i in range(256)}
    for _ in range(60):
        ranks.setdefault(rnd.choice([k for k in ranks if k[:1] in b"abc"]) + rnd.choice([k for k in ranks if k[:1] in b"abc"]), len(ranks))
    bpe = prefix_bpe.PrefixBpe(ranks)
    for _ in range(300):
        data = bytes(rnd.choices(b"abc", k=rnd.randint(1, 14)))
        parts = [data[i: i + 1] for i in range(len(data))]
        while True:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i: i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merged(data) == [ranks[p] for p in parts]


def test_merged_looks_up_new_neighbours_only():
    from signalgrid.llm import prefix_bpe

    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    ranks = Counted({bytes([i]): i for i in range(256)} | {b"a" * 2 ** i: 255 + i for i in range(1, 9)})
    bpe = prefix_bpe.PrefixBpe(ranks)
    ranks.asked = 0
    assert bpe.merged(b"a" * 256) == [263]
    assert ranks.asked <= 3 * 256  # two new neighbours a merge
