"""Whole-text statistics as Spark column expressions (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm._common import BLANKS, count_chars, let, text_of, words_of

SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, first occurrences included.

    Windows are 64-bit hashes sorted with their places, so equal windows are
    neighbours; the union of the marked windows is measured from gaps between places.
    Linear memory, n log n time in the words of one text.
    """

    def marked(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = let(
            pairs,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])),
                    lambda x: x["i"],
                )
            ),
        )
        return let(
            places,
            lambda q: F.aggregate(
                F.transform(q, lambda p, i: F.least(F.lit(3), F.get(q, i + 1) - p)), F.lit(0), lambda a, b: a + b
            ),
        )

    windows = F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)),
    )
    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(marked(h)))


def with_text_stats(df: DataFrame, text: str = "text", as_col: str = "_lm_stats") -> DataFrame:
    """Add a struct of counts over the whole of ``text`` (null counts as empty).

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words,
    n_upper (upper-case letters), n_digits, n_exclaim, n_distinct_words, n_chars; all long.
    """
    t = text_of(text)
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    counts = let(
        words_of(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        ),
    )
    by_line = let(
        lines,
        lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        ),
    )
    return (
        df.withColumn("_lm_w", counts)
        .withColumn("_lm_l", by_line)
        .withColumn(
            as_col,
            F.struct(
                "_lm_w.n_words",
                F.length(F.translate(t, BLANKS, "")).cast("long").alias("word_chars"),
                count_chars(t, SYMBOLS).cast("long").alias("n_symbols"),
                "_lm_l.n_lines",
                "_lm_l.n_dup_lines",
                "_lm_w.n_repeat_words",
                F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")).cast("long").alias("n_upper"),
                count_chars(t, "0123456789").cast("long").alias("n_digits"),
                count_chars(t, "!").cast("long").alias("n_exclaim"),
                "_lm_w.n_distinct_words",
                F.length(t).cast("long").alias("n_chars"),
            ),
        )
        .drop("_lm_w", "_lm_l")
    )
