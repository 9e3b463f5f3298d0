"""Pairs of tokens by taking back merges, beside the merges themselves."""

import numpy as np
import public_tokenizers

from signalgrid.llm import prefix_bpe


def pairs(bpe, n):
    rng, ids = np.random.default_rng(2), np.array(sorted(bpe.size))
    drawn = ids[rng.integers(0, len(ids), (n, 2))]
    # Cuts of tokens, so that pairs the merges join are among them.
    cuts = [(bpe.ranks[t[:i]], bpe.ranks[t[i:]]) for t in list(bpe.ranks)[:: max(1, len(ids) // n)] for i in range(1, len(t)) if t[:i] in bpe.ranks and t[i:] in bpe.ranks]
    return np.concatenate([drawn, np.array(cuts)])


def test_pairs_are_answered_without_merging_them(monkeypatch):
    bpe = prefix_bpe.PrefixBpe(prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    some = pairs(bpe, 5000)
    want = [bpe.merged(bpe.bytes[a] + bpe.bytes[b]) == [a, b] for a, b in some.tolist()]
    assert (bpe.left[sorted(bpe.size)] >= 0).all()
    monkeypatch.setattr(bpe, "merged", None)
    assert bpe.keeps_many(some[:, 0], some[:, 1]).tolist() == want and 0 < sum(want) < len(want)


def test_tokens_that_no_merge_makes():
    # "abc" cannot be made of two tokens; in the second vocabulary single bytes come last.
    for order in ([b"a", b"b", b"c", b"abc", b"ca", b"aa", b"caa"], [b"ab", b"aa", b"aab", b"a", b"b"]):
        bpe = prefix_bpe.PrefixBpe({b: i for i, b in enumerate(order)})
        every = np.array([(a, b) for a in bpe.size for b in bpe.size])
        want = [bpe.merged(bpe.bytes[a] + bpe.bytes[b]) == [a, b] for a, b in every.tolist()]
        assert bpe.keeps_many(every[:, 0], every[:, 1]).tolist() == want
