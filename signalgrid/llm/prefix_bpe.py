"""Byte-level BPE encoding by prefix dynamic programming.

Every byte prefix has exactly one valid encoding, and that encoding is the valid encoding
of a shorter prefix plus one token. So one number per prefix, its last token, stores the
encodings of all prefixes: a token t may end prefix j if its bytes end there and the pair
(last token of the prefix before t, t) is one that the merges leave as it is. Appending
bytes only adds entries; after an edit, entries are recomputed from the first changed
byte on. The merges never join bytes across matches of the splitting pattern, so a text
is a list of such matches, each with its own table. Tables of many short matches are
filled together, a column of all of them per step.

Null texts are empty and encode to nothing. Work is per row: nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalgrid.llm.text import column, giving_back, mix, slices

#: Entries (some 200 bytes each) of the younger of two generations of a cache; slices are learned whole, so one may exceed it.
GENERATION = 40_000
#: Answers on single pairs of tokens; the tables of many matches keep theirs in arrays of a fixed size.
PAIR_ENTRIES = 40_000
#: Matches of up to so many bytes are filled together, so many at a time; longer ones one by one.
SHORT, TOGETHER = 48, 32_768
#: Base of the rolling hash that finds tokens by their bytes (any odd number); results are compared with the bytes.
BASE = 0x9E3779B97F4A7C15


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixTable:
    """Last tokens of all prefixes of one byte string, for exact appends and edits."""

    def __init__(self, bpe: PrefixBpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        begin, self.data = len(self.data), self.data + more
        self.last += self.bpe.extend(self.data, self.last, begin)

    def replace(self, begin: int, end: int, new: bytes) -> None:
        """Replace data[begin:end]; entries before the edit stay as they are."""
        self.data = self.data[:begin] + new + self.data[end:]
        del self.last[begin:]
        self.last += self.bpe.extend(self.data, self.last, begin)

    def tokens(self) -> list[int]:
        out, j = [], len(self.data)
        while j:
            out.append(self.last[j - 1])
            j -= self.bpe.size[self.last[j - 1]]
        return out[::-1]


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int], splits: tuple[np.ndarray, np.ndarray] | None = None):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.stable: dict[tuple[int, int], bool] = {}
        # Lengths of tokens by their final two bytes: few candidates per position.
        self.ends: dict[bytes, list[int]] = {}
        for b in ranks:
            self.ends.setdefault(b[-2:], [])
            if len(b) not in self.ends[b[-2:]]:
                self.ends[b[-2:]].append(len(b))
        for sizes in self.ends.values():
            sizes.sort(reverse=True)
        self.powers = np.array([pow(BASE, n, 2**64) for n in range(SHORT + 1)], np.uint64)
        short = sorted((b for b in ranks if len(b) <= SHORT), key=len, reverse=True)
        length = np.array([len(b) for b in short], np.int64)
        found = self._rolled(short)[length, np.arange(len(short))] if short else np.zeros(0, np.uint64)
        order = np.argsort(found)
        self.token_hash, self.token_id = found[order], np.array([ranks[b] for b in short], np.int64)[order]
        self.may_be = np.zeros(1 << 20, bool)  # whether any token's hash has these leading bits
        self.may_be[found >> np.uint64(44)] = True
        self.sizes = np.ones(max(self.size, default=0) + 1, np.int64)
        self.sizes[list(self.size)] = list(self.size.values())
        self.names = np.full(len(self.sizes), None, object)
        for i, b in self.bytes.items():
            self.names[i] = b
        # Answers of `keeps` by place; a later pair overwrites an earlier one.
        self.pair, self.pair_kept = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)
        self.left, self.right = self.split() if splits is None else splits
        token = np.flatnonzero((self.left >= 0) & (self.sizes > 1))
        key = (self.left[token] << 32) | self.right[token]
        order = np.argsort(key)
        # One pair that never occurs, so that searches have a place to end in.
        self.joined, self.joined_id = np.append(key[order], 1 << 62), np.append(token[order], 0)

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """The two tokens that the last merge of each token joins (single bytes: themselves; -1: the merges do not make it)."""
        left, right = np.full(len(self.sizes), -1, np.int64), np.full(len(self.sizes), -1, np.int64)
        composed = [b for b in self.ranks if len(b) > 1]
        single = [i for b, i in self.ranks.items() if len(b) == 1]
        # The walk of `keeps_split` compares ids as times of merges, so single bytes must come first.
        if single and (not composed or max(single) < min(map(self.ranks.__getitem__, composed))):
            left[single] = right[single] = single
            for b in composed:
                parts = self.merged(b, self.ranks[b])
                if len(parts) == 2:
                    left[self.ranks[b]], right[self.ranks[b]] = parts
        return left, right

    def merged(self, data: bytes, below: int = 1 << 30) -> list[int]:
        """Merges of ranks under `below` applied by rank, leftmost first: the definition, used on single tokens and pairs of tokens."""
        rank, none = self.ranks.get, 1 << 30
        parts = [data[i: i + 1] for i in range(len(data))]
        joined = [rank(data[i: i + 2], none) for i in range(len(data) - 1)]  # rank of each part with the next
        while joined:
            low = min(joined)
            if low >= min(below, none):
                break
            best = joined.index(low)
            parts[best: best + 2] = [parts[best] + parts[best + 1]]
            del joined[best]
            if best < len(joined):
                joined[best] = rank(parts[best] + parts[best + 1], none)
            if best:
                joined[best - 1] = rank(parts[best - 1] + parts[best], none)
        return [self.ranks[p] for p in parts]

    def keeps(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a, b side by side."""
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) >= PAIR_ENTRIES:
                self.stable.clear()
            known = self.stable[a, b] = self.merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def extend(self, data: bytes, last: list[int], begin: int) -> list[int]:
        """Last tokens of the prefixes of data that are longer than `begin`; `last` holds those up to it."""
        last = last[:]
        ranks, ends, keeps = self.ranks, self.ends, self.keeps
        for j in range(begin + 1, len(data) + 1):
            tail = data[j - 2: j] if j > 1 else data[:1]
            for n in (*ends.get(tail, ()), 1):
                if n > j:
                    continue
                token = ranks.get(data[j - n: j])
                if token is not None and (n == j or keeps(last[j - n - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token for byte {data[j - 1]}")
        return last[begin:]

    @staticmethod
    def _rolled(pieces: list[bytes]) -> np.ndarray:
        """Hashes of all prefixes: row j has those of the first j bytes of each piece."""
        width = max(map(len, pieces))
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width).T.astype(np.uint64)
        out = np.zeros((width + 1, len(pieces)), np.uint64)
        for j in range(width):
            out[j + 1] = out[j] * np.uint64(BASE) + flat[j] + np.uint64(1)
        return out

    def keeps_many(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        place = (mix(key.view(np.uint64)) >> np.uint64(44)).astype(np.int64)
        kept, known = self.pair_kept[place], self.pair[place] == key
        if not known.all():
            new = np.flatnonzero(~known)
            distinct, back = np.unique(key[new], return_inverse=True)
            first, second = distinct >> 32, distinct & 0xFFFFFFFF
            answers = np.zeros(len(distinct), bool)
            made = (self.left[first] >= 0) & (self.left[second] >= 0)
            answers[made] = self.keeps_split(first[made], second[made])
            for i in np.flatnonzero(~made).tolist():
                x, y = int(first[i]), int(second[i])
                answers[i] = self.merged(self.bytes[x] + self.bytes[y]) == [x, y]
            answers = answers[back]
            kept[new] = answers
            self.pair[place[new]], self.pair_kept[place[new]] = key[new], answers
        return kept

    def keeps_split(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`keeps` for pairs of tokens that the merges make, by taking back merges at their common border, latest first:
        the pair stays unless the two tokens met there would have been joined before the merge just taken back."""
        kept, todo = np.zeros(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(todo):
            key = (a << 32) | b
            at = np.searchsorted(self.joined, key)
            go = ~((self.joined[at] == key) & (self.joined_id[at] < limit))
            a, b, todo = a[go], b[go], todo[go]
            right, left = self.right[a], self.left[b]
            whole_a, whole_b = right == a, left == b
            end = whole_a & whole_b
            kept[todo[end]] = True
            first = ((a > b) | whole_b) & ~whole_a  # the merge that made a is taken back
            # Equal ranks are joined leftmost first, so a pair left of the merge of b goes before it.
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, right, a), np.where(first, b, left)
            a, b, limit, todo = a[~end], b[~end], limit[~end], todo[~end]
        return kept

    def encode_many(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids (little-endian, 32 bits) of distinct pieces of 1 to SHORT bytes, with all their prefix tables filled in step."""
        if not pieces:
            return {}
        pieces = sorted(pieces, key=len, reverse=True)
        length = np.array([len(p) for p in pieces], np.int64)
        rolled, width = self._rolled(pieces), len(pieces[0])
        last = np.full(rolled.shape, -1, np.int64)
        for j in range(1, width + 1):
            open_ = np.arange(np.searchsorted(-length, -j, "right"))
            for n in range(j, 0, -1):
                wanted = rolled[j, open_] - rolled[j - n, open_] * self.powers[n]
                some = np.flatnonzero(self.may_be[wanted >> np.uint64(44)])
                at = np.minimum(np.searchsorted(self.token_hash, wanted[some]), len(self.token_hash) - 1)
                same = self.token_hash[at] == wanted[some]
                spot, token = open_[some[same]], self.token_id[at[same]]
                if n < j and len(spot):
                    kept = self.keeps_many(last[j - n, spot], token)
                    spot, token = spot[kept], token[kept]
                if len(spot):
                    last[j, spot] = token
                    open_ = open_[last[j, open_] < 0]
                if not len(open_):
                    break
            if len(open_):
                raise ValueError(f"no token ends {pieces[open_[0]][:j]!r}")
        steps, at, every = [], length.copy(), np.arange(len(pieces))
        while at.any():
            token = np.where(at > 0, last[at, every], -1)
            steps.append(token)
            at = np.where(at > 0, at - self.sizes[token], 0)
        steps = np.array(steps)[::-1].T  # ids right-aligned, piece by piece
        real = steps >= 0
        ids, ends = steps[real].astype("<u4"), np.cumsum(real.sum(axis=1))
        flat, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        out = {piece: flat[a:b] for piece, a, b in zip(pieces, cuts[:-1], cuts[1:], strict=True)}
        if self.decoded(ids) != b"".join(pieces):  # two strings of one hash somewhere
            for piece, got in out.items():
                if self.decoded(np.frombuffer(got, "<u4")) != piece:
                    out[piece] = np.array(self.encode_piece(piece), "<u4").tobytes()
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(self.names[ids])

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else PrefixTable(self, data).tokens()


#: White space as the pattern's \\s means it (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A space inside or at the end of a longer run of white space: there, chunks cannot be cut at spaces.
RUN = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)")


class Cache(dict):
    """A mapping in two generations. `turn` makes the entries the old generation once they are many;
    what is used again moves to the young one, and the rest goes with the next turn."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def turn(self) -> None:
        if len(self) > GENERATION:
            self.old = dict(self)
            self.clear()

    def recalled(self, key) -> bool:
        if key in self:
            return True
        if key in self.old:
            self[key] = self.old[key]
            return True
        return False

    def unknown(self, keys: set) -> set:
        """The keys that neither generation holds; those of the old one move to the young one."""
        keys = keys - self.keys()
        if self.old:
            again = keys & self.old.keys()
            self.update(zip(again, map(self.old.__getitem__, again), strict=True))
            keys -= again
        return keys

    def forget(self) -> None:
        self.clear()
        self.old = {}


class TextEncoder(Cache):
    """Token bytes of whole texts; as a mapping, of a space followed by the key.

    A text without long runs of white space is cut at its spaces, where the pattern always
    starts a new match; other texts are split by the pattern itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, splits: tuple[np.ndarray, np.ndarray] | None = None):
        import regex

        super().__init__()
        self.bpe = PrefixBpe(ranks, splits)
        self.match = regex.compile(pattern.replace(r"[^\s", rf"[^{SPACE}").replace(r"(?!\S)", rf"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]"))
        self.pieces = Cache()

    def piece(self, text: str) -> bytes:
        if self.pieces.recalled(text):
            return self.pieces[text]
        got = np.array(self.bpe.encode_piece(text.encode("utf-8")), "<u4").tobytes()
        if len(text) < 64:
            self.pieces[text] = got
        return got

    def split(self, text: str) -> bytes:
        return b"".join(self.piece(m) for m in self.match.findall(text))

    def learn(self, texts: list[str]) -> None:
        """Fill the caches for some texts, their new matches together."""
        self.turn()
        self.pieces.turn()
        words, matches = set(), set()
        for text in texts:
            if "  " in text or RUN.search(text):
                matches.update(self.match.findall(text))
            else:
                head, *rest = text.split(" ")
                words.update(rest)
                matches.update(self.match.findall(head))
        find = self.match.findall
        cut = {w: find(" " + w) for w in self.unknown(words) if len(w) < 64}
        matches.update(chain.from_iterable(cut.values()))
        new = [m.encode("utf-8") for m in self.pieces.unknown(matches) if len(m) < 64]
        short = [b for b in new if len(b) <= SHORT and b not in self.bpe.ranks]
        for a in range(0, len(short), TOGETHER):
            ids = self.bpe.encode_many(short[a: a + TOGETHER])
            for b, got in ids.items():
                self.pieces[b.decode("utf-8")] = got
        known = self.pieces.get
        for word, found in cut.items():
            if len(found) == 1:
                self[word] = known(found[0]) or self.piece(found[0])
            else:
                self[word] = b"".join(map(self.piece, found))

    def release(self) -> None:
        """Drop what was learned; the vocabulary's tables stay."""
        self.forget()
        self.pieces.forget()
        self.bpe.stable.clear()

    def __missing__(self, word: str) -> bytes:
        got = self.split(" " + word)
        if len(word) < 64:
            self[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "  " in text or RUN.search(text):
            return self.split(text)
        head, *rest = text.split(" ")
        return self.split(head) + b"".join(map(self.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return self.bpe.decoded(np.frombuffer(ids, "<u4"))


_ENCODERS: dict[int, TextEncoder] = {}


def encoder_of(shared) -> TextEncoder:
    """One encoder per worker process and broadcast vocabulary; tasks release what it learned."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = TextEncoder(*shared.value)
    return _ENCODERS[shared.id]


class _Shared:
    """The vocabulary as tasks see it: a broadcast and a key for the worker's cache."""

    def __init__(self, broadcast, key: int):
        self.broadcast, self.id = broadcast, key

    @property
    def value(self):
        return self.broadcast.value


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and the ids (`tokens`) of each text, or digests of the ids and of the decoded bytes.

    The vocabulary file is read once, on the driver, and broadcast; its size is fixed."""
    import public_tokenizers

    ranks = read_ranks(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    bpe = PrefixBpe(ranks)
    value = (ranks, pattern or public_tokenizers.PATTERN, (bpe.left, bpe.right))
    shared = _Shared(docs.sparkSession.sparkContext.broadcast(value), hash((len(ranks), value[1], ranks_path)))
    schema = "doc_id bigint, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "tokens array<bigint>")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_of(shared)
        for batch in batches:
            for begin, end in slices(column(batch, "text")):
                part = batch.slice(begin, end - begin)
                n, a, b = [], [], []
                texts = [t or "" for t in column(part, "text").to_pylist()]
                enc.learn(texts)
                for text in texts:
                    ids = enc.encode(text)
                    n.append(len(ids) // 4)
                    if digests:
                        a.append(hashlib.sha256(ids).hexdigest())
                        b.append(hashlib.sha256(enc.decode(ids)).hexdigest())
                    else:
                        a.append(np.frombuffer(ids, "<u4").astype(np.int64))
                out = [column(part, "doc_id"), pa.array(n, pa.int64())]
                out += [pa.array(a, pa.string()), pa.array(b, pa.string())] if digests else [pa.array(a, pa.list_(pa.int64()))]
                names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["tokens"])]
                yield pa.RecordBatch.from_arrays(out, names)
        enc.release()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(giving_back(kernel), schema)


def op10_byte_bpe(docs: DataFrame) -> DataFrame:
    return encode(docs, digests=True)
