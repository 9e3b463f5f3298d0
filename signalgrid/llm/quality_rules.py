"""Quality rules: a table of thresholds compiled into one Spark projection.

All measures and the verdict are built-in column expressions; nothing is shuffled, so
hot sources and copies are ordinary rows. Null or empty texts have zero words and fail
the base rule. Work per text is n log n in its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalgrid.llm.tables import white_words

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Frequent short words of the corpus languages (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "on",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "auf",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "que",
    "el", "los", "las", "y", "del", "por", "con", "se", "para", "no",
)

#: Rules of the verdict: measure, comparison that rejects, threshold. A text is kept when none applies.
RULES: tuple[tuple[str, str, float], ...] = (
    ("n_words", "<", 20),
    ("mean_word_length", "<", 2.0),
    ("mean_word_length", ">", 25.0),
    ("symbol_ratio", ">", 0.2),
    ("stop_word_ratio", "<", 0.01),
    ("dup_line_ratio", ">", 0.5),
    ("shouting_ratio", ">", 0.15),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows of `window` words occurring at least twice in the array.

    Windows are sorted by their hash next to their position, so equal ones are neighbours;
    the covered words follow from the gaps between the positions found.
    """
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def covered(spots: Column) -> Column:
        gaps = F.zip_with(F.slice(spots, 1, F.size(spots) - 1), F.slice(spots, 2, F.size(spots)), lambda a, b: F.least(F.lit(window), b - a))
        return F.when(F.size(spots) == 0, 0).otherwise(F.aggregate(gaps, F.lit(window), lambda total, gap: total + F.coalesce(gap, F.lit(0))))

    def found(ordered: Column) -> Column:
        flags = F.transform(ordered, lambda x, i: F.when(
            (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["i"]))
        return let(F.sort_array(F.filter(flags, lambda i: i.isNotNull())), covered)

    def per_text(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        # Most texts repeat nothing; a hash set finds that out without sorting.
        return let(runs, lambda r: F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(r, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), found)))

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(hashes, per_text)).cast("bigint")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the base measures and the ratios that the rules use."""
    value = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.length(F.translate(x, " \t\u000b\f\r", "")) > 0)
    caps = F.length(value) - F.length(F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    with_words = docs.withColumn("_words", white_words(F.col(text)))
    counted = with_words.select(
        *docs.columns,
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.translate(value, " \t\n\u000b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.length(value) - F.length(F.translate(value, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        let(lines, lambda x: F.size(x)).cast("bigint").alias("n_lines"),
        repeated_window_words(F.col("_words")).alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*STOP_WORDS))).cast("bigint").alias("n_stop_words"),
        caps.cast("bigint").alias("n_capitals"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return counted.select(
        "*", per("word_chars", "n_words").alias("mean_word_length"), per("n_symbols", "n_words").alias("symbol_ratio"),
        per("n_stop_words", "n_words").alias("stop_word_ratio"), per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        per("n_capitals", "word_chars").alias("shouting_ratio"))


def compile_rules(rules: tuple[tuple[str, str, float], ...] = RULES) -> Column:
    """One boolean expression: true when any rule rejects."""
    ops = {"<": lambda c, v: c < v, ">": lambda c, v: c > v, "<=": lambda c, v: c <= v, ">=": lambda c, v: c >= v}
    out = F.lit(False)
    for name, op, limit in rules:
        out = out | ops[op](F.col(name), F.lit(limit))
    return out


def judge(docs: DataFrame, text: str = "text", rules: tuple[tuple[str, str, float], ...] = RULES) -> DataFrame:
    """`docs` with measures, `base_failed` and `kept`. Columns of the input that clash with a measure are replaced."""
    new = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_stop_words", "n_capitals",
           "mean_word_length", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "shouting_ratio", "base_failed", "kept", "_words"}
    measured = measures(docs.select(*[c for c in docs.columns if c == text or c.lower() not in new]), text)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & ~compile_rules(rules))


def op7_quality_rules(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words", "n_capitals")
