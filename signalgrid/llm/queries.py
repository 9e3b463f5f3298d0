"""The queries of this subpackage and the SQL that says what they must return."""

from __future__ import annotations

from signalgrid.llm.chat_format import op9_chat_format
from signalgrid.llm.histogram_sort import op3_histogram_shards
from signalgrid.llm.jaccard_join import op4_jaccard_join
from signalgrid.llm.lattice import op8_subword_lattice
from signalgrid.llm.license_rules import AFTER, BEFORE, KEYWORDS, PHRASES, RULES as LICENSE_RULES, op11_license_rules
from signalgrid.llm.line_blocks import op1_line_blocks
from signalgrid.llm.line_chunks import op6_line_chunks
from signalgrid.llm.merkle_manifest import op12_merkle_manifest
from signalgrid.llm.prefix_bpe import op10_byte_bpe
from signalgrid.llm.quality_rules import RULES, STOP_WORDS, op7_quality_rules
from signalgrid.llm.spaced_seeds import op5_spaced_seeds
from signalgrid.llm.tables import read
from signalgrid.llm.toxicity_chain import op2_toxicity_chain
from signalgrid.llm.vector_codes import ENTRIES, PARTS, ROUNDS, op13_vector_codes

QUERIES = {
    "op1_line_blocks": lambda spark, d: op1_line_blocks(read(spark, d, "pages")),
    "op2_toxicity_chain": lambda spark, d: op2_toxicity_chain(read(spark, d, "documents"), read(spark, d, "labels")),
    "op3_histogram_shards": lambda spark, d: op3_histogram_shards(read(spark, d, "documents")),
    "op4_jaccard_join": lambda spark, d: op4_jaccard_join(read(spark, d, "documents")),
    "op5_spaced_seeds": lambda spark, d: op5_spaced_seeds(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op6_line_chunks": lambda spark, d: op6_line_chunks(read(spark, d, "documents")),
    "op7_quality_rules": lambda spark, d: op7_quality_rules(read(spark, d, "documents")),
    "op8_subword_lattice": lambda spark, d: op8_subword_lattice(read(spark, d, "documents")),
    "op9_chat_format": lambda spark, d: op9_chat_format(read(spark, d, "conversations")),
    "op10_byte_bpe": lambda spark, d: op10_byte_bpe(read(spark, d, "documents")),
    "op11_license_rules": lambda spark, d: op11_license_rules(read(spark, d, "documents")),
    "op12_merkle_manifest": lambda spark, d: op12_merkle_manifest(read(spark, d, "documents")),
    "op13_vector_codes": lambda spark, d: op13_vector_codes(read(spark, d, "embeddings")),
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_RULES = " OR ".join(f"{name} {op} {limit}" for name, op, limit in RULES)

QUALITY_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
runs AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS run
         FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT rid, run FROM runs GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS at FROM runs JOIN twice USING (rid, run)),
rep AS (SELECT rid, count(*) AS n FROM hit GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(words) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(rep.n, 0) AS n_repeat_words,
        len(list_filter(words, lambda x: lower(x) IN ({', '.join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals
      FROM w LEFT JOIN rep ON w.rid = rep.rid),
r AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines FROM m),
q AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio,
        n_stop_words / greatest(n_words, 1) AS stop_word_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
        n_capitals / greatest(word_chars, 1) AS shouting_ratio,
        n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({_RULES}) AS kept, n_lines, n_stop_words, n_capitals FROM q
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
      ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(list_slice(words, i, i + 2), ' '))) END AS sh FROM w),
x AS (SELECT rid, len(sh) AS n, unnest(sh) AS sh FROM s),
o AS (SELECT a.rid AS a, b.rid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
      FROM x a JOIN x b ON a.sh = b.sh AND a.rid <> b.rid AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM o WHERE 100 * i >= 90 * (na + nb - i)),
reach(a, b) AS (SELECT rid, rid FROM s UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT reach.a, min(s.doc_id) AS component_id FROM reach JOIN s ON reach.b = s.rid GROUP BY reach.a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM s JOIN comp ON s.rid = comp.a LEFT JOIN n ON s.rid = n.a
"""


def _listed(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_RULE_ROWS = ", ".join(f"({r.rank}, {r.priority}, {r.confidence}::DOUBLE, '{r.label}', '{r.keyword}', '{r.before}', '{r.after}')" for r in LICENSE_RULES)
_PHRASE_ROWS = ", ".join(f"('{words}', {len(words.split())}, '{label}')" for words, _, label in PHRASES)

LICENSE_SQL = rf"""
WITH rules(rank, priority, confidence, label, keyword, before, after) AS (VALUES {_RULE_ROWS}),
phrases(phrase, size, label) AS (VALUES {_PHRASE_ROWS}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words FROM documents),
k AS (SELECT rid, words, unnest(list_filter(range(1, len(words) + 1), lambda i: words[i] IN ({_listed([*KEYWORDS, *(p[0].split()[0] for p in PHRASES)])}))) AS i FROM d),
a AS (SELECT rid, i, words[i] AS w, array_to_string(list_slice(words, greatest(1, i - {BEFORE}), i - 1), ' ') || ' ' AS b4,
        array_to_string(list_slice(words, i, i + {AFTER - 1}), ' ') || ' ' AS on_ FROM k),
p AS (SELECT rid, i - 1 AS start, label FROM a JOIN phrases ON starts_with(on_, phrase || ' ')),
t AS (SELECT rid, i - 1 AS i, r.*, CASE WHEN r.before = '()$' THEN '' ELSE regexp_extract(b4, r.before, 1) END AS left_, regexp_extract(on_, r.after, 1) AS right_
      FROM a JOIN rules r ON a.w = r.keyword),
h AS (SELECT *, i - (length(left_) - length(replace(left_, ' ', ''))) AS s, i + length(right_) - length(replace(right_, ' ', '')) AS e
      FROM t WHERE right_ <> '' AND (before = '()$' OR left_ <> '')),
f AS (SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.rid = h.rid AND b.s <= h.s AND b.e >= h.e AND
        (b.priority, h.e - h.s - (b.e - b.s), b.rank) < (h.priority, 0, h.rank))),
base AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM p GROUP BY rid),
own AS (SELECT rid, count(*) AS n_found, max(confidence) AS score, list(label) FILTER (label <> '') AS labels FROM f GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(own.labels, [])))), ',') AS labels,
       coalesce(score, 0.0) AS score, coalesce(n_found, 0) AS n_found
FROM d LEFT JOIN base USING (rid) LEFT JOIN own USING (rid)
"""


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END"


# crc32 by its bits: each byte is folded in, then eight shifts.
_CRC = ("xor(list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),"
        " lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)")

MERKLE_SQL = rf"""
WITH RECURSIVE l AS (SELECT row_number() OVER () AS rid, doc_id, source, {_CRC} % 2 = 0 AS tampers,
    sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', 'text'))}) AS leaf,
    sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', 'n_chars'))} || {_field("replace(text, chr(10), '')")}) AS changed FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l),
up(source, lvl, pos, n, node) AS (SELECT source, 0, pos, n, leaf FROM n
    UNION ALL SELECT source, lvl + 1, pos // 3, any_value(n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, lvl, pos // 3),
subs AS (SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, pos, n, node) AS (SELECT 0, pos, n, subroot FROM subs
    UNION ALL SELECT lvl + 1, pos // 3, any_value(n + 2) // 3, sha256(string_agg(node, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3),
sides AS (SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM up a JOIN up b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.source, a.lvl, a.pos),
over_ AS (SELECT a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM top a JOIN top b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.lvl, a.pos),
steps AS (SELECT rid, s.lvl, s.l, s.r FROM n JOIN sides s ON n.source IS NOT DISTINCT FROM s.source AND s.pos = n.pos // (3 ** s.lvl)::BIGINT
    UNION ALL SELECT rid, 1000 + o.lvl, o.l, o.r FROM n JOIN subs ON n.source IS NOT DISTINCT FROM subs.source JOIN over_ o ON o.pos = subs.pos // (3 ** o.lvl)::BIGINT),
paths AS (SELECT rid, list({{'l': l, 'r': r}} ORDER BY lvl) AS path, string_agg(l || r, '' ORDER BY lvl) AS siblings FROM steps GROUP BY rid),
fold(rid, k, node) AS (SELECT rid, 0, CASE WHEN tampers THEN changed ELSE leaf END FROM n
    UNION ALL SELECT fold.rid, k + 1, sha256(path[k + 1].l || node || path[k + 1].r) FROM fold JOIN paths USING (rid) WHERE k < len(path)),
root AS (SELECT node AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, fold.node AS folded_root, fold.node = root AS verified
FROM n JOIN subs ON n.source IS NOT DISTINCT FROM subs.source CROSS JOIN root LEFT JOIN paths USING (rid)
JOIN fold ON fold.rid = n.rid AND fold.k = coalesce(len(path), 0)
"""


def _nearest(name: str, books: str, shown: str) -> str:
    """CTE `name`: each part with its nearest entry in `books` and the squared distance."""
    return f"""{name} AS (SELECT rid, p, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM (
      SELECT x.rid, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM {shown} x JOIN {books} b ON x.p = b.p AND x.i = b.i GROUP BY x.rid, x.p, b.e) GROUP BY rid, p)"""


def _codes_sql() -> str:
    steps, books = [], "b0"
    for k in range(ROUNDS):
        steps.append(_nearest(f"a{k}", books, "x"))
        steps.append(f"s{k} AS (SELECT x.p, a.e, x.i, sum(x.v)::BIGINT AS s, count(*) AS c FROM x JOIN a{k} a ON x.rid = a.rid AND x.p = a.p GROUP BY x.p, a.e, x.i)")
        steps.append(f"b{k + 1} AS (SELECT b.p, b.e, b.i, coalesce((s.s - ((s.s % s.c) + s.c) % s.c) // s.c, b.v) AS v FROM {books} b LEFT JOIN s{k} s ON b.p = s.p AND b.e = s.e AND b.i = s.i)")
        books = f"b{k + 1}"
    steps.append(_nearest("last_", books, "x"))
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT rid, (j - 1) // (n // {PARTS}) AS p, (j - 1) % (n // {PARTS}) AS i, floor(256 * embedding[j]::DOUBLE)::BIGINT AS v
    FROM (SELECT *, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS j FROM kept)),
b0 AS (SELECT p, rid AS e, i, v FROM x WHERE rid < {ENTRIES}),
{", ".join(steps)},
digest AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM {books}),
coded AS (SELECT rid, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM last_ GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (rid) CROSS JOIN digest
"""


SQL = {
    "op7_quality_rules": QUALITY_SQL, "op4_jaccard_join": JACCARD_SQL, "op11_license_rules": LICENSE_SQL, "op12_merkle_manifest": MERKLE_SQL,
    "op13_vector_codes": _codes_sql(),
}
