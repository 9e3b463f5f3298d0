"""Line de-duplication by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where chunks of lines begin
and end. Each test looks only at lines on the chunk's own side of the cut, so a passage
that is moved into another document is cut at the same places there. Several salted rounds
of cuts cover edges that one round misses. What the cuts leave over is covered by three more
kinds of chunks: each line with words together with the next such line and the blank lines in
between, each long line (over `LONG_BLANKS` blanks), and the whole document. Neighbouring pairs
that repeat overlap, so a repeated run of two or more lines with words goes from its first such
line to its last, wherever its cuts fall, and an exact copy goes whole. A chunk that occurs
again anywhere keeps its first place, by document id, and goes from the others once its text
has been compared byte by byte. A single short line that repeats without a neighbour stays.

Everything is DataFrame functions. Hash counts, combined on the map side, tell which chunks
repeat; only these carry their text through a shuffle, one row per place against one row of
the first place. Null or empty texts have no lines to remove and stay as they are. Repeated
rows (same id and text) are one document: they are treated alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgrid.llm.quality_rules import let
from signalgrid.llm.tables import materialise

DIVISOR = 3
ROUNDS = 3
LONG_BLANKS = 50
KEY = ["_id", "_th"]


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with the key of a document: its id (null: below all others) and the hash of its text."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)))).withColumn("_th", F.xxhash64("text"))


def _starts(hashes: str, long: str, salt: int, divisor: int) -> Column:
    """Positions at which a chunk begins: 0, where the pair of the line and its follower or of the two lines
    before hashes to a cut, and around every long line."""
    pair = lambda a, b: F.pmod(F.xxhash64(F.lit(salt), a, b), F.lit(divisor)) == 0
    line = lambda i: F.get(F.col(hashes), i)
    is_long = lambda i: F.coalesce(F.get(F.col(long), i), F.lit(False))

    def cut(i: Column) -> Column:
        opens = (i + 1 < F.size(hashes)) & pair(line(i), line(i + 1))
        closes = (i >= 2) & pair(line(i - 1), line(i - 2))
        return (i == 0) | opens | closes | is_long(i) | is_long(i - 1)

    return F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), cut)


def _spans(starts: Column, hashes: str) -> Column:
    """(begin, count) of the chunks between starts; the last one ends with the lines."""
    def between(s: Column) -> Column:
        ends = F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(hashes)))
        return F.zip_with(s, ends, lambda a, b: F.struct(a.alias("begin"), (b - a).alias("count")))

    return let(starts, between)


def has_words(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, " \t\n\u000b\f\r", "")) > 0, F.lit(False))


def _neighbours(full: str, hashes: str) -> Column:
    """(begin, count) of each line with words up to the next one, and of the whole text if it has words."""
    def between(at: Column) -> Column:
        pairs = F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.size(at)),
                           lambda a, b: F.struct(a.alias("begin"), (b - a + 1).alias("count")))
        whole = F.array(F.struct(F.lit(0).alias("begin"), F.size(hashes).alias("count")))
        return F.concat(pairs, F.filter(whole, lambda _: F.size(at) > 0))

    return let(F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.get(F.col(full), i)), between)


def chunks(docs: DataFrame, divisor: int = DIVISOR, rounds: int = ROUNDS, long_blanks: int = LONG_BLANKS) -> DataFrame:
    """(_id, _th, begin, count, h) of all chunks, each span of a document once."""
    blanks = lambda x: F.length(x) - F.length(F.translate(x, " \t", ""))
    lines = keyed(docs.where(F.length("text") > 0)).select(*KEY, F.split("text", "\n").alias("lines"))
    hashed = lines.select(*KEY, F.transform("lines", lambda x: F.struct(
        F.xxhash64(x).alias("h"), (blanks(x) >= long_blanks).alias("long"), has_words(x).alias("full"))).alias("x")).select(
        *KEY, F.col("x.h").alias("hs"), F.col("x.long").alias("long"), F.col("x.full").alias("full"))
    found = F.flatten(F.array(*[_spans(_starts("hs", "long", salt, divisor), "hs") for salt in range(rounds)]))
    several = F.concat(F.filter(found, lambda s: (s["count"] > 1) | F.get(F.col("long"), s["begin"])), _neighbours("full", "hs"))
    # As numbers, spans are made distinct with a hash set; structs would be compared each with each.
    codes = F.array_distinct(F.transform(several, lambda s: s["begin"].cast("bigint") * F.lit(2**31) + s["count"]))
    spans = F.transform(codes, lambda c: F.struct(
        F.shiftright(c, 31).cast("int").alias("begin"), c.bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("count")))
    named = F.transform(spans, lambda s: F.struct(
        s["begin"].alias("begin"), s["count"].alias("count"), F.xxhash64(F.slice(F.col("hs"), s["begin"] + 1, s["count"])).alias("h")))
    return hashed.select(*KEY, F.explode(named).alias("s")).select(*KEY, "s.*")


def _struct(*names: str) -> Column:
    return F.struct(*names)


def marked(docs: DataFrame, divisor: int = DIVISOR, rounds: int = ROUNDS, long_blanks: int = LONG_BLANKS) -> DataFrame:
    """`docs` with `_spots`: places (begin, count, h, first) of chunks whose hash occurs more than once."""
    spans = materialise(chunks(docs, divisor, rounds, long_blanks), "line-chunks")
    firsts = spans.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(_struct(*KEY, "begin", "count")).alias("f")).where("n > 1").select("h", "f")
    spots = spans.join(firsts, "h").withColumn("first", _struct(*KEY, "begin", "count") == F.col("f")).groupBy(*KEY).agg(
        F.collect_set(_struct("begin", "count", "h", "first")).alias("_spots"))  # as many as the text has chunks
    # Where the whole text goes, no other chunk of it needs to be compared.
    n_lines = F.size(F.split("text", "\n"))
    whole = let(n_lines, lambda n: F.filter("_spots", lambda x: ~x["first"] & (x["begin"] == 0) & (x["count"] == n)))
    rows = keyed(docs).join(spots, KEY, "left").withColumn(
        "_spots", F.when(F.size("_spots") > 0, let(whole, lambda w: F.when(F.size(w) > 0, w).otherwise(F.col("_spots")))))
    return materialise(rows, "line-marked")


def unequal(rows: DataFrame) -> DataFrame:
    """Keys and hashes of later places whose bytes differ from those of the first place."""
    body = lambda s: let(F.split("text", "\n"), lambda lines: F.transform(s, lambda x: F.struct(
        x["h"].alias("h"), x["begin"].alias("begin"), F.array_join(F.slice(lines, x["begin"] + 1, x["count"]), "\n").alias("body"))))
    parts = lambda keep: rows.where(F.size("_spots") > 0).select(*KEY, F.explode(body(F.filter("_spots", keep))).alias("s")).select(*KEY, "s.*")
    original = parts(lambda x: x["first"]).groupBy("h").agg(F.min("body").alias("original"))
    return parts(lambda x: ~x["first"]).join(original, "h").where(F.col("body") != F.col("original")).select(*KEY, "h", "begin").distinct()


def remove(docs: DataFrame, divisor: int = DIVISOR, rounds: int = ROUNDS, long_blanks: int = LONG_BLANKS) -> DataFrame:
    """`docs` with repeated chunks taken out of `text`, plus `removed_lines` and `emptied` (all its words were repeated)."""
    own = {"_id", "_th", "_spots", "_bad", "_text", "removed_lines", "emptied"}
    columns = [c for c in docs.columns if c.lower() not in own]
    rows = marked(docs.select(*columns), divisor, rounds, long_blanks)
    bad = materialise(unequal(rows).groupBy(*KEY).agg(F.collect_list(_struct("h", "begin")).alias("_bad")), "line-unequal")
    later = F.filter("_spots", lambda x: ~x["first"] & ~F.coalesce(F.array_contains("_bad", F.struct(x["h"].alias("h"), x["begin"].alias("begin"))), F.lit(False)))
    gone = F.array_distinct(F.flatten(F.transform(later, lambda x: F.sequence(x["begin"], x["begin"] + x["count"] - 1))))
    # The indices that stay are found with a hash set, so the work is linear in the lines.
    stay = lambda lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.get(lines, i)), "\n")
    cleaned = rows.join(bad, KEY, "left").withColumn("_text", F.when(F.size("_spots") > 0, let(F.split("text", "\n"), stay)).otherwise(F.col("text")))
    return cleaned.select(
        *[F.col("_text").alias(c) if c == "text" else F.col(c) for c in columns],
        F.when(F.size("_spots") > 0, F.size(gone)).otherwise(0).cast("bigint").alias("removed_lines"),
        (has_words(F.col("text")) & ~has_words(F.col("_text"))).alias("emptied"))


def op6_line_chunks(docs: DataFrame) -> DataFrame:
    return remove(docs.select("doc_id", "text"))
