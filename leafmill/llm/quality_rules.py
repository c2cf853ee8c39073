"""Quality rules with thresholds learned from the corpus itself (operator 6).

Every document gets integer ratios (symbols, repeated lines, repeated 3-word windows,
upper-case letters, exclamation marks: per mille; word length: per cent). For each
(lang, source) a mergeable quantile sketch holds how often each value occurs, rounded
down to six significant bits (relative error below 1/32), so sketches of any two sets of
rows merge by adding counts, in any order, with the same result. The quartiles read from
a sketch give Tukey fences ``q25 - spread_factor * iqr`` and ``q75 + spread_factor * iqr``;
a document outside a fence is rejected. A smallest spread for each ratio stands in where the
quartiles say nothing: ratios that are 0 in three quarters of a group's documents have no
interquartile range, and that of a ratio which varies cannot be told below the sketch's rounding.
Groups of fewer than ``min_docs`` documents take the merged sketch of their language, then
that of the whole corpus.

Defined results: null or empty text has no words and fails the base rule; null ``lang``
or ``source`` is the group ''; repeated rows are each judged, with equal verdicts; an
empty table gives an empty result; other columns are ignored. Everything runs as Spark
column expressions and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.llm._common import FEW_FILES, materialize, read_table
from leafmill.llm._stats import with_text_stats

MIN_DOCS = 30
SPREAD_FACTOR = 8

#: Ratio: (numerator, denominator, scale, smallest spread, whether low values fail too).
RATIOS = {
    "symbols": ("n_symbols", "n_words", 1000, 8, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 45, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 56, False),
    "upper": ("n_upper", "n_chars", 1000, 4, False),
    "exclaim": ("n_exclaim", "n_words", 1000, 19, False),
    "word_length": ("word_chars", "n_words", 100, 16, True),
}


def base_failed(s: str = "_lm_stats") -> Column:
    """Fewer than 50 words, or over half of them in repeated 3-word windows."""
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def _ratio(name: str, s: str = "_lm_stats") -> Column:
    top, below, scale, _, _ = RATIOS[name]
    return F.expr(f"{scale} * {s}.{top} div greatest({s}.{below}, 1)")


def _rounded(v: Column) -> Column:
    """``v`` >= 0 rounded down to six significant bits."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, source, ratio, value, n): counts for each rounded value, of rows that pass the base rule."""
    pairs = F.array(
        *(F.struct(F.lit(k).alias("ratio"), _rounded(_ratio(k)).alias("value")) for k in RATIOS)
    )
    return (
        stats.where(~base_failed())
        .select(
            F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
            F.coalesce(F.col("source"), F.lit("")).alias("source"),
            F.inline(pairs),
        )
        .groupBy("lang", "source", "ratio", "value")
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, min_docs: int = MIN_DOCS, spread_factor: int = SPREAD_FACTOR) -> DataFrame:
    """(lang, source, <ratio>_low, <ratio>_high) for each group of ``sketch``."""
    by_group = sketch.select("lang", "source", "ratio", "value", "n", F.lit(0).alias("level"))
    by_lang = sketch.groupBy("lang", "ratio", "value").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("ratio", "value").agg(F.sum("n").alias("n"))
    levels = by_group.unionByName(
        by_lang.select("lang", F.lit("").alias("source"), "ratio", "value", "n", F.lit(1).alias("level"))
    ).unionByName(
        by_all.select(
            F.lit("").alias("lang"), F.lit("").alias("source"), "ratio", "value", "n", F.lit(2).alias("level")
        )
    )
    key = ["level", "lang", "source", "ratio"]
    upto = Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = levels.withColumn("upto", F.sum("n").over(upto)).withColumn(
        "docs", F.sum("n").over(Window.partitionBy(*key))
    )
    factor, spread = F.lit(spread_factor), F.create_map(*(F.lit(x) for k, v in RATIOS.items() for x in (k, v[3])))
    quartiles = (
        ranked.groupBy(*key)
        .agg(
            F.max("docs").alias("docs"),
            F.min(F.when(4 * F.col("upto") >= F.col("docs"), F.col("value"))).alias("q25"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("docs"), F.col("value"))).alias("q75"),
        )
        .withColumn("width", factor * F.greatest(F.col("q75") - F.col("q25"), spread[F.col("ratio")].cast("long")))
        .select(*key, "docs", (F.col("q25") - F.col("width")).alias("low"), (F.col("q75") + F.col("width")).alias("high"))
    )
    pick = lambda level, cols, tag: quartiles.where(F.col("level") == level).select(
        *cols, *(F.col(c).alias(f"{c}{tag}") for c in ("docs", "low", "high"))
    )
    own = pick(0, ["lang", "source", "ratio"], "0")
    joined = own.join(pick(1, ["lang", "ratio"], "1"), ["lang", "ratio"]).join(pick(2, ["ratio"], "2"), "ratio")
    of = lambda c: (
        F.when(F.col("docs0") >= min_docs, F.col(f"{c}0"))
        .when(F.col("docs1") >= min_docs, F.col(f"{c}1"))
        .otherwise(F.col(f"{c}2"))
    )
    chosen = joined.select("lang", "source", "ratio", of("low").alias("low"), of("high").alias("high"))
    return chosen.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("ratio") == k, F.col(c))).alias(f"{k}_{c}") for k in RATIOS for c in ("low", "high"))
    )


def judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``_lm_base_failed`` and ``_lm_kept``, joined with the fences of each row's group."""
    limits = limits.select(
        F.col("lang").alias("_lm_lang"),
        F.col("source").alias("_lm_source"),
        *(F.col(c).alias(f"_lm_{c}") for c in limits.columns if c not in ("lang", "source")),
    )
    outside = F.lit(False)
    for k, (_, _, _, _, both) in RATIOS.items():
        outside = outside | F.coalesce(_ratio(k) > F.col(f"_lm_{k}_high"), F.lit(False))
        if both:
            outside = outside | F.coalesce(_ratio(k) < F.col(f"_lm_{k}_low"), F.lit(False))
    same = (F.coalesce(F.col("lang"), F.lit("")) == F.col("_lm_lang")) & (
        F.coalesce(F.col("source"), F.lit("")) == F.col("_lm_source")
    )
    return (
        stats.join(limits, same, "left")
        .withColumn("_lm_base_failed", base_failed())
        .withColumn("_lm_kept", ~base_failed() & ~outside)
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns."""
    # Written with their statistics: the optimiser would otherwise compute these anew wherever they are named.
    stats = materialize(with_text_stats(docs), "stats")
    limits = materialize(fences(sketches(stats)), "fences", FEW_FILES)
    return judged(stats, limits).where("_lm_kept").select(*docs.columns)


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """One row for each of ``docs``: its counts and whether the rules keep it."""
    stats = materialize(with_text_stats(docs).select("doc_id", "lang", "source", "_lm_stats"), "stats")
    limits = materialize(fences(sketches(stats)), "fences", FEW_FILES)
    s = "_lm_stats"
    return judged(stats, limits).select(
        "doc_id",
        *(f"{s}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        F.col("_lm_base_failed").alias("base_failed"),
        F.col("_lm_kept").alias("kept"),
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents"))
