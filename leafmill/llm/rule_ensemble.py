"""Quality classifier: a sparse ensemble of rules compiled to column expressions (operator 10).

Statistics of the whole text are Spark column expressions. Small regression trees, grown
by boosting on the labelled rows, give paths; every path from a root is a rule, a
conjunction of bounds on statistics. A lasso logistic regression weighs the rules and the
winsorised statistics themselves and sets most weights to exactly zero. The rest becomes
one Spark expression: scoring runs without Python.

Labels come only from rows with crc32(doc_id as text) mod 5 other than 0, at most
``TRAIN_ROWS`` of them: those with the least 64-bit hash of doc_id, which is a bounded
sample of labelled rows that does not depend on their order. ``lang``, ``source``, the
labels and doc_id itself are never inputs of a score.

Defined results: null text is scored as empty text; without a labelled row, or with one
class only, every score is that class's (smoothed) share, 0.5 without any; a null doc_id
is not held out and not learned from; repeated rows are each scored; labels that repeat
count once for each pair of rows; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm._common import read_table
from leafmill.llm._stats import with_text_stats

TRAIN_ROWS = 20_000
TREES, DEPTH, MIN_LEAF = 40, 3, 8
RATE = 0.3
PENALTY = 0.002
STEPS = 600
THRESHOLD = 0.3
SEED = 10

#: Statistic: expression over the struct ``s`` of ``_stats.with_text_stats``.
STATISTICS = {
    "log_words": "ln(1 + s.n_words)",
    "word_length": "s.word_chars / greatest(s.n_words, 1)",
    "symbols": "s.n_symbols / greatest(s.n_words, 1)",
    "dup_lines": "s.n_dup_lines / greatest(s.n_lines, 1)",
    "repeats": "s.n_repeat_words / greatest(s.n_words, 1)",
    "upper": "s.n_upper / greatest(s.n_chars, 1)",
    "digits": "s.n_digits / greatest(s.n_chars, 1)",
    "exclaims": "s.n_exclaim / greatest(s.n_words, 1)",
    # Herdan's measure: unlike the plain share of distinct words it does not fall with a text's length.
    "distinct": "if(s.n_words > 0, ln(1 + s.n_distinct_words) / ln(1 + s.n_words), 1.0)",
    "words_per_line": "s.n_words / greatest(s.n_lines, 1)",
    "blank": "1 - s.word_chars / greatest(s.n_chars, 1)",
}

Condition = tuple[int, bool, float]  # statistic, whether above, bound


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the array ``_lm_x`` of the statistics, in their order."""
    s = with_text_stats(docs, as_col="_lm_s")
    x = F.array(*(F.expr(e.replace("s.", "_lm_s.")).cast("double") for e in STATISTICS.values()))
    return s.withColumn("_lm_x", x).drop("_lm_s")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def grow(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rng: np.random.Generator, depth: int = DEPTH):
    """A regression tree: nested (statistic, bound, below, above) with values at the leaves."""
    total, mass = (target * weight).sum(), weight.sum()
    if depth == 0 or len(target) < 2 * MIN_LEAF:
        return float(total / max(mass, 1e-9))
    best = (1e-9, 0, 0.0)
    for j in rng.permutation(x.shape[1])[: max(4, x.shape[1] * 2 // 3)]:
        order = np.argsort(x[:, j], kind="stable")
        v, t, w = x[order, j], np.cumsum((target * weight)[order]), np.cumsum(weight[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        cut = cut[(cut + 1 >= MIN_LEAF) & (len(v) - cut - 1 >= MIN_LEAF)]
        if len(cut):
            gain = t[cut] ** 2 / w[cut] + (total - t[cut]) ** 2 / np.maximum(mass - w[cut], 1e-9) - total**2 / mass
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(j), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[0] <= 1e-9:
        return float(total / max(mass, 1e-9))
    _, j, bound = best
    up = x[:, j] > bound
    return (
        j,
        bound,
        grow(x[~up], target[~up], weight[~up], rng, depth - 1),
        grow(x[up], target[up], weight[up], rng, depth - 1),
    )


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, bound, below, above = tree
    up = x[:, j] > bound
    out = np.empty(len(x))
    out[up], out[~up] = predict(above, x[up]), predict(below, x[~up])
    return out


def paths(tree, so_far: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Every path from the root to a node below it."""
    if not isinstance(tree, tuple):
        return []
    j, bound, below, above = tree
    out = []
    for up, child in ((False, below), (True, above)):
        path = (*so_far, (j, up, bound))
        out += [path, *paths(child, path)]
    return out


def fires(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), np.bool_)
    for j, up, bound in rule:
        hit &= (x[:, j] > bound) if up else (x[:, j] <= bound)
    return hit


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient descent."""
    n = len(y)
    v = np.ones(z.shape[1])
    for _ in range(30):
        v = z.T @ (z @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (0.25 * (np.linalg.norm(z @ v) ** 2 / n + 1))
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    wy, by, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ wy + by, -30, 30)))
        step = wy - rate * (z.T @ (p - y)) / n
        new_w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new_b = by - rate * float((p - y).mean())
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        wy, by = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return w, b


class RuleEnsemble:
    """``rules`` with ``weights``, linear terms (statistic, low, high, weight), and an intercept."""

    def __init__(self, rules, weights, linear, intercept: float):
        self.rules, self.weights, self.linear, self.intercept = rules, weights, linear, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
        if not len(y) or y.min() == y.max():
            share = (y.sum() + 1) / (len(y) + 2)
            return cls([], [], [], float(np.log(share / (1 - share))))
        rng = np.random.default_rng(SEED)
        found: dict[tuple[Condition, ...], None] = {}
        margin = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            rows = np.flatnonzero(rng.random(len(y)) < 0.7)
            if len(rows) < 2 * MIN_LEAF:
                rows = np.arange(len(y))
            weight = np.maximum(p * (1 - p), 1e-3)
            tree = grow(x[rows], ((y - p) / weight)[rows].clip(-4, 4), weight[rows], rng)
            margin = margin + RATE * predict(tree, x)
            found |= dict.fromkeys(paths(tree))
        rules, columns = [], []
        seen: set[bytes] = set()
        for rule in found:
            hit = fires(rule, x)
            key = np.packbits(hit).tobytes()
            if 0 < hit.sum() < len(y) and key not in seen:
                seen |= {key, np.packbits(~hit).tobytes()}
                rules.append(rule)
                columns.append(hit.astype(np.float64))
        low, high = np.quantile(x, 0.025, axis=0), np.quantile(x, 0.975, axis=0)
        flat = x.clip(low, high)
        spread = flat.std(axis=0)
        used = np.flatnonzero(spread > 1e-9)
        # Friedman and Popescu's scale: a linear term counts like a typical rule.
        z = np.column_stack([*columns, *(0.4 * flat[:, j] / spread[j] for j in used)])
        mean = z.mean(axis=0)
        w, b = lasso_logistic(z - mean, y)
        b -= float(w @ mean)
        k = len(rules)
        return cls(
            [r for r, v in zip(rules, w[:k], strict=True) if v],
            [float(v) for v in w[:k] if v],
            [(int(j), float(low[j]), float(high[j]), float(0.4 * v / spread[j])) for j, v in zip(used, w[k:], strict=True) if v],
            b,
        )

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights, strict=True):
            out += w * fires(rule, x)
        for j, low, high, w in self.linear:
            out += w * x[:, j].clip(low, high)
        return 1 / (1 + np.exp(-out.clip(-30, 30)))

    def column(self, x: Column) -> Column:
        """The score as one expression over the array of statistics."""
        terms = [F.lit(self.intercept)]
        for rule, w in zip(self.rules, self.weights, strict=True):
            hit = F.lit(True)
            for j, up, bound in rule:
                hit = hit & ((x[j] > bound) if up else (x[j] <= bound))
            terms.append(F.when(hit, F.lit(w)).otherwise(0.0))
        for j, low, high, w in self.linear:
            terms.append(w * F.least(F.greatest(x[j], F.lit(low)), F.lit(high)))
        total = F.aggregate(F.array(*terms), F.lit(0.0), lambda a, b: a + b)
        return 1 / (1 + F.exp(-F.least(F.greatest(total, F.lit(-30.0)), F.lit(30.0))))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``rows`` rows to learn from, drawn by hash from the labels and again from their documents."""
    chosen = (
        labels.where("quality is not null and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .select("doc_id", F.col("quality").cast("double").alias("_lm_y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # A doc_id may have any number of rows in either table: their sample is bounded again, by a hash of the rows.
    found = with_statistics(texts).select("_lm_x", "_lm_y", "doc_id")
    got = found.orderBy(F.xxhash64("doc_id", "_lm_x", "_lm_y"), "doc_id", "_lm_x", "_lm_y").limit(rows).collect()
    got.sort(key=lambda r: (r["doc_id"], r["_lm_y"], r["_lm_x"]))
    return np.array([r["_lm_x"] for r in got]).reshape(len(got), len(STATISTICS)), np.array([r["_lm_y"] for r in got])


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = RuleEnsemble.fit(*training_rows(docs, labels))
    scored = with_statistics(docs.select("doc_id", "text")).withColumn("score", model.column(F.col("_lm_x")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
