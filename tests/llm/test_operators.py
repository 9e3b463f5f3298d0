"""The operators against brute force, on small tables with every kind of odd row."""

import collections
import hashlib
import itertools
import json
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from signalgrid.llm import chat_format, histogram_sort, jaccard_join, lattice, line_blocks, line_chunks, prefix_bpe, quality_rules, spaced_seeds, toxicity_chain
from signalgrid.llm.components import components
from signalgrid.llm.queries import QUERIES, SQL
from tests.compare import compare, connect

SF_DIR = "/root/testdata/sf0.001"
WHITE = " \t\n\u000b\f\r"
RANKS = prefix_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in WHITE:
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, QUERIES[name], SQL[name], SF_DIR)[0] == ""


# op1


def test_main_text():
    page = ('<html><head><title>T</title><script>var a="<p>no</p>"</script></head><body><header>Top</header><nav><ul><li><a href=/>Menu</a></ul></nav>'
            '<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>First   one<br>goes on.<p>Second <b>bold</b></p><aside>Side</aside>'
            '<div class="ad">Buy</div><p>End.</p><form><input><label>Mail</label></form><section id="comments"><p>Nice!</p></section></article><footer>&copy; X</footer>')
    assert line_blocks.main_text(page) == "A & B\nFirst one goes on.\nSecond bold\nEnd."
    plain = '<body><div class=menu><a href=1>Home</a> <a href=2>News</a></div><div><p>' + "long words here " * 20 + "</p><p>short</p></div><div id=footer>Bye</div>"
    assert line_blocks.main_text(plain) == ("long words here " * 20).strip() + "\nshort"
    assert line_blocks.main_text(None) == line_blocks.main_text("") == line_blocks.main_text("<div") == ""
    assert line_blocks.main_text("just text") == "just text"


def test_main_text_without_article():
    long = ("long words here " * 20).strip()
    ad, links = "<div class=ad>Buy <a href=1>now</a></div>", "<ul>" + "<li><a href=1>One of them</a>" * 4 + "</ul>"
    assert line_blocks.main_text(f"<body><div><p>{long}</p>{ad}<p>The end.</p></div></body>") == f"{long}\nThe end."
    assert line_blocks.main_text(f"<body><p>{long}</p><nav>Menu</nav>{ad}<p>The end.</p></body>") == f"{long}\nThe end."
    assert line_blocks.main_text(f"<body><div><p>{long}</p>{ad}<div><figure><figcaption>A caption</figcaption></figure></div></div></body>") == f"{long}\nA caption"
    assert line_blocks.main_text(f"<body><div><p>{long}</p>{links}<p>The end.</p></div></body>") == f"{long}\nThe end."
    assert line_blocks.main_text(f"<body><div><h1><a href=1>Title</a></h1>{ad}<p>{long}</p></div></body>") == f"Title\n{long}"
    assert line_blocks.main_text(f"<body><div><p>{long}</p></div>{ad}<div>Powered by X</div></body>") == long
    assert line_blocks.main_text(f"<body><div>{links}</div><div><p>{long}</p></div></body>") == long


def test_hidden():
    for attrs in ('class="overflow-hidden"', 'title="hidden gems"', "data-hidden=1", 'hidden="false"', 'title="display: none"'):
        assert line_blocks.main_text(f"<article><p>One.</p><div {attrs}>Two.</div></article>") == "One.\nTwo.", attrs
    for attrs in ("hidden", 'hidden=""', 'class="a hidden b"', "class=hidden", 'aria-hidden="true"', 'style="color: red; display:none"'):
        assert line_blocks.main_text(f"<article><p>One.</p><div {attrs}>Two.</div></article>") == "One.", attrs


def test_distribution():
    lengths = [0, 5, 0, 0, 0, 40, 50, 0, 0, 0]
    assert line_blocks.distribution(lengths) == [sum(lengths[i: i + 3]) for i in range(10)]
    assert line_blocks.spans(lengths, 60) == [(5, 7)]


def test_extract_odd(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, "<p>x</p>", "old")], "page_id bigint, url string, html string, text string")
    assert sorted(r["text"] for r in line_blocks.extract(pages).collect()) == ["", "", "x"]
    assert line_blocks.extract(pages.limit(0)).count() == 0


# op2


def test_chain(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        bad, low = i % 5 == 0, i % 7 == 0
        words = [f"w{rnd.randint(0, 400)}" for _ in range(30)] + ["awful", "horrid"] * bad + ["zz"] * 5 * low
        rows.append((i, " ".join(words)))
        if i < 200:
            labels.append((i, int(not low), int(bad)))
    got = toxicity_chain.chain_scores(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert all(r["rejected"] == (r["doc_id"] % 5 == 0) for r in got.collect())


def test_chain_odd(odd, none, spark):
    labels = spark.createDataFrame([(1, 1, 1), (None, 0, 0), (2, None, 1)], "doc_id bigint, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        got = toxicity_chain.chain_scores(odd, table)
        assert got.count() == 9 and got.where("p_toxic IS NULL").count() == 0
    assert toxicity_chain.chain_scores(none, labels).count() == 0


def test_out_of_fold():
    import pyarrow as pa

    terms = pa.array([["a", "b"] if i % 2 else ["b", "c"] for i in range(60)])
    y = np.array([i % 2 for i in range(60)], float)
    first, second = toxicity_chain.fit_chain(terms, {"q": y, "t": 1 - y}, np.arange(60) % 3)
    assert first.weights["a"] > 0 > first.weights["c"] and len(second.earlier) == 1 and second.earlier[0] < 0


# op3


def check_shards(rows, shards=8):
    slots = collections.defaultdict(list)
    sizes = [0] * shards
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return sizes


def test_shards(docs):
    rows = histogram_sort.shard(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sizes = check_shards(rows)
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    for r in rows:
        assert (r["size"], r["text_crc32"]) == (len((texts[r["doc_id"]] or "").encode()) + 1, zlib.crc32((texts[r["doc_id"]] or "").encode()))


def test_shards_hot_and_odd(spark, odd, none):
    hot = spark.range(3000).selectExpr("id doc_id", "if(id % 3 = 0, 'the same text', concat('t', id)) text")
    sizes = check_shards(histogram_sort.shard(hot).collect())
    assert max(sizes) - min(sizes) <= 60
    assert len(histogram_sort.shard(odd).collect()) == 9 and histogram_sort.shard(none).count() == 0
    check_shards(histogram_sort.shard(odd).collect())


# op4


def brute_links(rows, n, t):
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= t * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return sorted(((d if d is not None else -1, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=-1), links[i])
                   for i, (d, _) in enumerate(rows)))


@pytest.mark.parametrize("n,t", [(3, 90), (5, 80)])
def test_jaccard(spark, n, t):
    rnd = random.Random(n)
    line = " ".join(f"c{i}" for i in range(30))
    rows, base = [], [f"b{rnd.randint(0, 10 ** 6)}" for _ in range(200)]
    for i in range(160):  # near copies around one base, so families, guests and chains occur
        w = base[:]
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(200)] = f"e{rnd.randint(0, 40)}"
        rows.append((i, " ".join(w) + ("\n" + line) * (i % 3 == 0)))
    rows += [(1000 + i, " ".join(f"u{rnd.randint(0, 10 ** 6)}" for _ in range(rnd.choice((1, 2, 20, 150)))) + "\n" + line * (i % 2)) for i in range(60)]
    rows += [(2000 + i, rows[i][1].upper()) for i in range(20)] + [rows[0], (None, rows[1][1]), (None, None), (7000, ""), (7001, " \n"), (7002, "one"), (7003, "one")]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2] if r[2] is not None else -1, r[3]) for r in jaccard_join.linked(frame, n, t).collect())
    assert got == brute_links(rows, n, t)


def test_jaccard_odd(odd, none):
    assert jaccard_join.linked(odd).count() == 9 and jaccard_join.linked(none).count() == 0


def test_compare_chunks_matches_sets():
    rnd = np.random.default_rng(1)
    pivot = np.arange(100)
    sets = [np.union1d(np.setdiff1d(pivot, rnd.choice(100, rnd.integers(0, 9), False)), 1000 + rnd.choice(30, rnd.integers(0, 6), False)) for _ in range(40)]
    chunk = {"size": np.array([len(s) for s in sets]), "psize": np.full(40, 100), "minus": np.array([len(np.setdiff1d(pivot, s)) for s in sets]),
             "guest": np.zeros(40, bool), "diff": [np.setxor1d(s, pivot) for s in sets]}
    i, j, _ = jaccard_join.compare_chunks(chunk, None, 90)
    want = [(a, b) for a, b in itertools.combinations(range(40), 2) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 90 * len(np.union1d(sets[a], sets[b]))]
    assert sorted(zip(i.tolist(), j.tolist())) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(200, 100), (100, 150), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 150: 100, 200: 100}


# op5


def test_seeds(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(40))
    changed = item.split()
    changed[9] = changed[21] = "other"
    bench = spark.createDataFrame([(1, item), (2, "Tiny item here"), (3, None), (None, "x y z")], "item_id bigint, text string")
    rows = [(1, "noise " * 50 + " ".join(changed).upper() + " tail"), (2, " ".join(f"q{i * 7 % 40}" for i in range(40))), (3, "see: tiny, item HERE!"), (4, "tiny other here"), (5, None)]
    got = {r["doc_id"]: r for r in spaced_seeds.contaminated(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert [got[k]["items"] for k in (1, 2, 3, 4, 5)] == [[1], [], [2], [], []] and got[1]["overlap_words"] == 40
    assert spaced_seeds.contaminated(odd, bench).count() == 9 and spaced_seeds.contaminated(none, bench).count() == 0
    assert spaced_seeds.contaminated(odd, bench.limit(0)).where("contaminated").count() == 0


def test_seed_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(9)], "item_id bigint, text string")
    frame = spark.createDataFrame([(0, "i3 " + " ".join(f"i3w{k}" for k in range(20)) + " and " + " ".join(f"i8w{k}" for k in range(20)))], "doc_id bigint, text string")
    whole = spaced_seeds.contaminated(frame, bench).collect()
    blocks = spaced_seeds.blocks
    monkeypatch.setattr(spaced_seeds, "blocks", lambda b, m: blocks(b, m, 300))
    assert spaced_seeds.contaminated(frame, bench).collect() == whole and whole[0]["items"] == [3, 8]


def test_seeds_find_all_verbatim(docs, spark):
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    items = [r["text"] for r in bench.collect()]
    want = {r["doc_id"] for r in docs.collect() if r["text"] and any(x in r["text"] for x in items)}
    assert {r["doc_id"] for r in spaced_seeds.contaminated(docs, bench).where("contaminated").collect()} >= want


# op6


def brute_chunks(spark, docs):
    """Removal by definition, from the chunks of every document."""
    texts = {(r["_id"], r["_th"]): r["text"] for r in line_chunks.keyed(docs).collect()}
    first, spots = {}, []
    for r in line_chunks.chunks(docs).collect():
        key, body = (r["_id"], r["_th"]), tuple(texts[(r["_id"], r["_th"])].split("\n")[r["begin"]: r["begin"] + r["count"]])
        spots.append((key, r["begin"], body))
        first[body] = min(first.get(body, (key, r["begin"])), (key, r["begin"]))
    gone = collections.defaultdict(set)
    for key, begin, body in spots:
        if first[body] != (key, begin):
            gone[key].update(range(begin, begin + len(body)))
    return {k: t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) for k, t in texts.items()}


def test_line_chunks(spark, docs):
    got = {(r["_id"], r["_th"]): r["text"] for r in line_chunks.keyed(docs).select("_id", "_th", "doc_id").join(
        line_chunks.remove(docs).select("doc_id", "text"), "doc_id").collect()}
    assert got == brute_chunks(spark, docs)


def test_line_chunks_passage(spark, odd, none):
    passage = [f"passage line {i} with several words in it" for i in range(12)]
    long = " ".join(f"l{i}" for i in range(60))
    rows = [(i, "\n".join([f"own {i} {k}" for k in range(i)] + passage + [long] + [f"end {i}"])) for i in range(1, 9)]
    got = {r["doc_id"]: r["text"] for r in line_chunks.remove(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1] == rows[0][1]
    for i in range(2, 9):
        left = got[i].split("\n")
        assert long not in left and sum(x in left for x in passage) <= 4 and f"end {i}" in left and all(f"own {i} {k}" in left for k in range(i))
    out = line_chunks.remove(odd).collect()
    assert sorted(str(r["text"]) for r in out) == sorted(str(r["text"]) for r in odd.collect()) and not any(r["emptied"] for r in out)
    assert line_chunks.remove(none).count() == 0


def test_line_chunks_whole(spark):
    """Exact copies are emptied, and repeated runs of over 50 words go whole, wherever the cuts fall."""
    texts = [[f"copy {d} line {k} has words" for k in range(d)] for d in range(1, 13)] + [["", "copy with blanks", "", "", "in and around it", ""]]
    copies = [(100 * c + d, "\n".join(t)) for c in (1, 2, 3) for d, t in enumerate(texts)]
    runs = [[" ".join(f"r{n}w{k}x{j}" for j in range(52 // n + 1)) for k in range(n)] for n in range(2, 14)] + [["r " * 30, "", "s " * 30]]
    placed = [(1000 * c + n, "\n".join([f"own {c} {n}", *run, f"end {c} {n}"])) for c in (1, 2, 3) for n, run in enumerate(runs)]
    lone = [(9001, "one own\nmore\n\nanother own"), (9002, "two own\nmore\n\nelse own")]
    got = {r["doc_id"]: r for r in line_chunks.remove(spark.createDataFrame(copies + placed + lone, "doc_id bigint, text string")).collect()}
    for i, text in copies:
        assert (got[i]["text"], got[i]["emptied"]) == ((text, False) if i < 200 else ("", True))
    for i, text in placed:
        assert got[i]["text"] == (text if i < 2000 else f"own {i // 1000} {i % 1000}\nend {i // 1000} {i % 1000}")
    assert got[9002]["text"].startswith("two own\n") and got[9002]["text"].endswith("else own") and not got[9002]["emptied"]


# op7


def brute_quality(text):
    text = text or ""
    w = [x for x in "".join(" " if c in WHITE else c for c in text).split(" ") if x]
    runs = [tuple(w[i: i + 8]) for i in range(len(w) - 7)]
    times = collections.Counter(runs)
    covered = {k for i, r in enumerate(runs) if times[r] > 1 for k in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality(odd, none):
    got = quality_rules.op7_quality_rules(odd).collect()
    texts = collections.Counter((r["doc_id"], brute_quality(r["text"])) for r in odd.collect())
    assert collections.Counter((r["doc_id"], tuple(r[1:6])) for r in got) == texts
    assert not any(r["kept"] for r in got if r["base_failed"]) and quality_rules.op7_quality_rules(none).count() == 0


# op8


def lattice_brute(word, begin, inner):
    alpha = [begin.get(word[:j], 0.0) for j in range(len(word) + 1)]
    for j in range(len(word) + 1):
        alpha[j] += sum(alpha[k] * inner.get(word[k:j], 0.0) for k in range(j))
    return math.log(alpha[-1])


def test_lattice():
    begin, inner, weights = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    p = np.log((weights + 1e-7) / (weights + 1e-7).sum())
    vocab = lattice.Vocabulary(lattice.Pieces.of(begin), lattice.Pieces.of(inner), len(begin), p)
    words = [b"the", b"thinking", "größe".encode(), b"x" * 40, b"\xf0\x9f\x98\x80", b"a", b"internationalisation"]
    size = np.array([len(w) for w in words])
    letters = np.frombuffer(b"".join(words), np.uint8)
    uses = np.zeros(len(p))
    got = lattice.word_scores(letters, np.cumsum(size) - size, size, vocab, np.ones(len(words)), uses)
    b, i = dict(zip(begin, np.exp(p))), dict(zip(inner, np.exp(p[len(begin):])))
    assert np.allclose(got, [lattice_brute(w, b, i) for w in words])
    lengths = np.array([len(x) for x in begin + inner])
    assert math.isclose(float(uses @ lengths), size.sum(), rel_tol=1e-6)  # expected pieces spell the words


def test_frequent_without_room(spark):
    counts = spark.createDataFrame([(1, 65_537), (2, 3)], "h bigint, c bigint")
    h, c, cutoff = lattice.frequent(counts, 0)
    assert len(h) == len(c) == 0 and counts.where(f"c < {cutoff}").count() == 2


def test_scores(docs, odd, none):
    def check(frame, got):
        rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
        held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
        c = collections.Counter()
        for d, t in rows:
            if not held(d):
                c.update([*words_of(t), None])
        n, v = sum(c.values()), len(c)
        want = []
        for d, t in rows:
            tokens = [*words_of(t), None]
            want.append((-1 if d is None else d, held(d), len(tokens), sum(c[x] > 0 for x in tokens), n, round(sum(math.log10((c[x] + 1) / ((n + 1) * (v + 1))) for x in tokens), 5)))
        have = sorted((-1 if r["doc_id"] is None else r["doc_id"], *r[1:5], round(r["base_score"], 5)) for r in got)
        want.sort()
        assert [h[:5] for h in have] == [w[:5] for w in want] and np.allclose([h[5] for h in have], [w[5] for w in want])
        assert all(r["score"] < 0 for r in got)

    path = public_tokenizers.path("piece_bpe_32k.model")
    check(docs, lattice.score(docs, path).collect())
    check(docs, lattice.score(docs, path, most_frequent=50, passes=1).collect())
    check(odd, lattice.score(odd.select("doc_id", "text"), path, passes=1).collect())
    assert lattice.score(none, path, passes=1).count() == 0


# op9


def test_chat(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(900, 0, None, None), (901, 0, "user", "a\\[INST]\\l<s>"), (901, 1, "assistant", None), (902, 0, "human", "x"), (902, 0, "human", "x"), (None, 1, "user", "q")]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    rows += [(-7, i, r, chat_format.PROBE) for i, r in enumerate(("user", "assistant"))]
    want = {}
    for conv, group in itertools.groupby(sorted(((r[0] if r[0] is not None else -1, r[1], r[2] or "", r[3] or "") for r in rows)), lambda r: r[0]):
        turns = [(r[2], r[3]) for r in group]
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert {r[0] if r[0] is not None else -1: tuple(r[1:5]) for r in chat_format.op9_chat_format(frame).collect()} == want
    assert [r["conv_id"] for r in chat_format.op9_chat_format(frame.limit(0)).collect()] == [-7]


def test_layouts(spark):
    records = [{"id": 1, "prompt": "p", "completion": "c"}, {"instruction": "i", "input": "x", "output": "o"}, {"data": {"question": "q", "answer": "a"}},
               {"messages": [{"role": "user", "content": "m"}]}, {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, {"messages": []}, {"odd": 1}]
    got = chat_format.format_records(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(7, "{broken"), (8, None)], "conv_id bigint, record string"))
    template = chat_format.Template()
    turns = [template.read(r["formatted"]) if r["formatted"] is not None else None for r in got.orderBy("conv_id").collect()]
    assert turns == [[("user", "p"), ("assistant", "c")], [("user", "i\n\nx"), ("assistant", "o")], [("user", "q"), ("assistant", "a")], [("user", "m")],
                     [("user", "h"), ("assistant", "g")], [], None, None, None]


# op10


def test_bpe(docs, odd, none):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    for frame in (docs, odd):
        want = collections.Counter()
        for r in frame.collect():
            ids = enc.encode_ordinary(r["text"] or "")
            want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
        assert collections.Counter(map(tuple, prefix_bpe.op10_byte_bpe(frame).collect())) == want
    assert prefix_bpe.op10_byte_bpe(none).count() == 0 and prefix_bpe.encode(docs).select("tokens").first()[0]


def test_bpe_appends_and_edits():
    rnd, bpe = random.Random(2), prefix_bpe.PrefixBpe(RANKS)
    for _ in range(60):
        data = "".join(rnd.choice("theing atsr") for _ in range(rnd.randint(0, 20))).encode()
        table = prefix_bpe.PrefixTable(bpe, data[:5])
        table.append(data[5:])
        assert table.tokens() == bpe.merged(data)
        if data:
            at = rnd.randrange(len(data))
            table.replace(at, min(len(data), at + 2), b"er")
            assert table.data == data[:at] + b"er" + data[at + 2:] and table.tokens() == bpe.merged(table.data)


def test_bpe_white_space():
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    own, rnd = prefix_bpe.TextEncoder(RANKS, public_tokenizers.PATTERN), random.Random(3)
    parts = [*"abT 1'.,\n\té中😀\x1c\x85\xa0　", "  ", "   ", " \n", "\n\n", "'s", "'re"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == enc.encode_ordinary(text)
