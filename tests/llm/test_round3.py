"""License rules, Merkle manifest and vector codes on odd rows, against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from signalgrid.llm import license_rules, merkle_manifest, vector_codes
from signalgrid.llm.license_rules import op11_license_rules
from signalgrid.llm.merkle_manifest import op12_merkle_manifest
from signalgrid.llm.vector_codes import op13_vector_codes

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, words string, tree int, label string"


# op11


def brute_licenses(text):
    """(n_words, places of the phrases, labels) by trying every rule at every word, and comparing all pairs of detections."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]
    places = [(i, label) for phrase, _, label in license_rules.PHRASES for i in range(len(words)) if words[i: i + len(phrase.split())] == phrase.split()]
    found = []
    for i, w in enumerate(words):
        before = "".join(x + " " for x in words[max(0, i - license_rules.BEFORE): i])
        after = "".join(x + " " for x in words[i: i + license_rules.AFTER])
        for r in license_rules.RULES:
            if r.keyword == w and (right := re.search(r.after, after)) and (left := re.search(r.before, before)):
                found.append((i - left.group(1).count(" "), i + right.group(1).count(" "), r))
    kept = [a for a in found if not any(b[0] <= a[0] and b[1] >= a[1] and (b[2].priority, b[0] - b[1], b[2].rank) < (a[2].priority, a[0] - a[1], a[2].rank) for b in found)]
    return len(words), places, sorted({x for _, x in places} | {r.label for *_, r in kept if r.label}), max([r.confidence for *_, r in kept], default=0.0), len(kept)


TEXTS = [
    None, "", " \n--", "Licensed under the Apache License, Version 2.0.", "This is not licensed under the GNU General Public License v3.",
    "CC BY-NC 4.0. cc by cc BY: cc by-sa 4.0", "SPDX-License-Identifier: GPL-2.0-or-later", "the GNU General Public License, version 2 or any later version",
    "All rights reserved. all  RIGHTS\treserved", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and",
    "mit license " * 400, "gnu " * 50 + "general public license", "İKİ mıt license ＣＣ by", "x" * 50000 + " mit license",
    "released under the MIT license or the BSD 3-Clause license, www.apache.org/licenses/LICENSE-2.0", "licensed " * 30 + "under the terms of the mozilla public license v. 2.0",
]


def test_license_rules(spark):
    rng = random.Random(3)
    pool = sorted({w for r in license_rules.RULES for w in re.findall("[a-z0-9]+", r.after + " " + r.before)}) + ["All", "Rights", "Reserved", "CC", "BY", "Public"]
    texts = TEXTS + [rng.choice([" ", "\n", "-", ". "]).join(rng.choice(pool) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += [" ".join(t for _ in range(8) for t in rng.choice(license_rules.NAMES)[1].replace("{v}", "version ").replace("(?:", "").replace(")?", "").replace(")", "").split("|")) for _ in range(60)]
    rows = spark.createDataFrame([(i, t, "en", None, None, "clash", 1, "x") for i, t in enumerate(texts)] + [(None, "cc by", None, None, None, None, None, None)] * 2, DOC)
    got = sorted(op11_license_rules(rows).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert len(got) == len(texts) + 2
    for r, text in zip(got, [*texts, "cc by", "cc by"]):
        n, places, labels, score, found = brute_licenses(text)
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["labels"], r["score"], r["n_found"]) == (n, len(places), ",".join(labels), score, found), text[:200]
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))


def test_license_rules_table():
    assert len(license_rules.RULES) > 300
    for r in license_rules.RULES:
        assert re.fullmatch("[a-z0-9]+", r.keyword) and re.match(rf"\^\(\(\?:{r.keyword}\b", r.after), r
        assert "'" not in r.before + r.after and "{v}" not in r.after, r


def test_license_rules_empty(spark):
    assert op11_license_rules(spark.createDataFrame([], DOC)).count() == 0


# op12


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """One row per input row, in the order of (source, doc_id, leaf)."""
    def leaf(doc_id, text, lang, source, n_chars):
        return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h("".join(levels[-1][i: i + 3])) for i in range(0, len(levels[-1]), 3)])
        return levels

    def path(levels, i):
        out = []
        for level in levels[:-1]:
            run = i // 3 * 3
            out.append(("".join(level[run:i]), "".join(level[i + 1: run + 3])))
            i //= 3
        return out

    trees = {}
    for r in rows:
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r[:5]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(trees[s], key=lambda x: x[:3]) for s in order}
    levels = {s: tree([x[2] for x in trees[s]]) for s in order}
    top = tree([levels[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, _, own, r) in enumerate(trees[s]):
            steps = path(levels[s], i) + path(top, k)
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None:
                node = leaf(r[0], r[1].replace("\n", ""), *r[2:5])
            for left, right in steps:
                node = h(left + node + right)
            out.append((r[0], own, levels[s][-1][0], top[-1][0], h("".join(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


@pytest.mark.parametrize("n", [1, 2, 27, 28, 800])
def test_merkle(spark, n):
    rng = random.Random(n)
    sources = [None, "", "z", "ä", "b", *(f"s{i}" for i in range(40))]
    rows = [(rng.choice([None, *range(n)]), rng.choice([None, "", "one\ntwo\n", "x" * 3000, "日本\n"]), rng.choice([None, "en"]),
             rng.choice(["hot", rng.choice(sources)]), rng.choice([None, 5]), "clash", 1, "clash") for _ in range(n)]
    rows += rows[:3]
    got = op12_merkle_manifest(spark.createDataFrame(rows, DOC))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute_manifest(rows), key=key)


def test_merkle_stores_every_third_level(spark):
    rows = spark.range(1000).selectExpr("0 as tree", "id as pos", "sha2(cast(id as string), 256) as digest")
    levels = merkle_manifest.stored_levels(rows)
    assert [t.selectExpr("sum(size(kids))").first()[0] for t in levels] == [1000, 38, 2, 1]


def test_merkle_empty(spark):
    assert op12_merkle_manifest(spark.createDataFrame([], DOC)).count() == 0


# op13


def brute_codes(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], ""
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    v = [[math.floor(256 * float(np.float32(x))) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in kept]
    v = [[x[p * width: (p + 1) * width] for p in range(parts)] for x in v]
    books = [[v[i][p] for i in range(min(entries, len(v)))] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            mine = {}
            for x in v:
                mine.setdefault(nearest(p, x[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else e for k, e in enumerate(books[p])]
    out, sums = [], {}
    for r, x in zip(kept, v):
        found = [nearest(p, x[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), r[2]))
        sums[r[2]] = sums.get(r[2], 0) + out[-1][2]
    return [(i, code, e, sums[label]) for i, code, e, label in out], h(",".join(str(c) for b in books for e in b for c in e))


def vectors(rng, n, size, spread):
    out = []
    for i in range(n):
        x = [rng.choice([round(rng.gauss(0, spread), 2), 0.0, -0.5]) for _ in range(size)]
        out.append((rng.choice([None, i, i // 2]), x, rng.choice([None, 1, 1, 2, i])))
    out += [(0, None, 1), (1, [None] * size, 1), (2, [float("nan")] * size, None), (3, [float("inf")] * size, 2), (4, [-float("inf"), *[0.0] * (size - 1)], 2), (5, [1.0] * (size + 1), 2)]
    return out + out[:5]


@pytest.mark.parametrize("n, size, spread", [(5, 16, 1), (300, 32, 1), (200, 40, 1000), (64, 16, 0.001)])
def test_vector_codes(spark, n, size, spread):
    rows = vectors(random.Random(n), n, size, spread)
    table = spark.createDataFrame([(*r, "clash", 7) for r in rows], "vec_id bigint, embedding array<float>, label int, code string, v int").repartition(7)
    got = [tuple(r) for r in op13_vector_codes(table).collect()]
    want, digest = brute_codes(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert {r[4] for r in got} == {digest}
    assert sorted((r[:4] for r in got), key=key) == sorted(want, key=key)


def test_bounds_decide_like_all_distances(spark):
    """Five passes with bounds against plain passes: the same codes, and most parts keep their entry unseen at the end."""
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 32))
    rows = [(int(i), [float(x) for x in centres[i % 12] + rng.normal(0, 0.05, 32)], int(i % 3)) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    coded, books = vector_codes.encode(table, parts=4, entries=12, rounds=5)
    want, digest = brute_codes(rows, 4, 12, 5)
    assert h(",".join(map(str, books.ravel().tolist()))) == digest
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in coded.collect()) == sorted(r[:3] for r in want)


def test_b_adapts():
    rng = np.random.default_rng(6)
    books = rng.integers(-500, 500, (1, 64, 4)) * 10
    setup = vector_codes.Pass(books, np.zeros((1, 64), np.int64), np.array([4.0]), [8], [8])
    v = books[0][rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 4))
    own, best, near, low, outer = setup.first(0, v)
    gaps = [setup.gaps(0, best, low, outer)]
    assert vector_codes.adapted(setup, gaps, np.full((1, 64), 1)) == [2]
    assert vector_codes.adapted(setup, gaps, np.full((1, 64), 60000)) == [8]
    assert (np.diff(low, axis=1) >= 0).all() and (outer >= low[:, -1]).all()


def test_vector_codes_empty_and_large(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert op13_vector_codes(spark.createDataFrame([], kind)).count() == 0
    assert op13_vector_codes(spark.createDataFrame([(1, None, 1)], kind)).count() == 0
    with pytest.raises(Exception, match="a component of"):
        op13_vector_codes(spark.createDataFrame([(1, [3e6] * 16, 1)], kind)).collect()


# earlier operators: odd values


def test_article_keeps_what_a_name_only_hints_at():
    from signalgrid.llm.line_blocks import main_text

    page = ('<article><h2 class="section-header">Results</h2><p>One.</p><div class="share-of-market"><p>Two.</p></div><p class="text-banner-free">Three.</p>'
            '<section class="related-work">Four.</section><div id="comment-on-policy">Five</div><div class="site-footer">no</div><div class="share-buttons">no</div>'
            '<ul class="related-to-this"><li><a href=1>no</a><li><a href=2>no</a></ul></article>')
    assert main_text(page) == "Results\nOne.\nTwo.\nThree.\nFour.\nFive"


def test_deep_nesting_needs_linear_memory():
    import tracemalloc

    from signalgrid.llm.line_blocks import main_text

    tracemalloc.start()
    assert main_text("<div>x" * 20000 + "</div>" * 20000).count("x") == 20000
    assert tracemalloc.get_traced_memory()[1] < 50e6
    tracemalloc.stop()


def test_records_with_other_value_types(spark):
    from signalgrid.llm.chat_format import format_records

    records = ['{"messages":["hi"]}', '{"prompt":5,"completion":"x"}', '{"messages":[{"role":"user","content":5}]}', '{"messages":[{"role":"user","content":"a"},"b"]}',
               '{"data":{"question":[],"answer":"x"}}', "[]", "5", "null", None, "{", '{"messages":[{"role":"user","content":null}]}']
    got = format_records(spark.createDataFrame(list(enumerate(records)), "conv_id bigint, record string"))
    assert {r["conv_id"]: r["formatted"] is not None for r in got.collect()} == {i: i == 10 for i in range(len(records))}


def test_benchmark_items_without_id_and_equal_short_items(spark):
    from signalgrid.llm.spaced_seeds import contaminated

    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "some short item here"), (3, "clean")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, item), (7, "short item"), (8, "Short, item!"), (9, ""), (None, None)], "item_id bigint, text string")
    got = {r["doc_id"]: (r["contaminated"], sorted(r["items"]), r["n_overlaps"]) for r in contaminated(docs, bench).collect()}
    assert got == {1: (True, [], 1), 2: (True, [7, 8], 2), 3: (False, [], 0)}


def test_caches_stay_small():
    import public_tokenizers
    import tiktoken

    from signalgrid.llm import prefix_bpe

    ranks = prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc, rng = prefix_bpe.TextEncoder(ranks, public_tokenizers.PATTERN), random.Random(1)
    for _ in range(4):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(30000))
        enc.learn([text])
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == want.encode_ordinary(text)
        assert len(enc) + len(enc.old) <= 2 * prefix_bpe.GENERATION + 2 * 30000 and len(enc.bpe.stable) <= prefix_bpe.PAIR_ENTRIES
    enc.release()
    assert not enc and not enc.old and not enc.pieces and not enc.pieces.old
