"""Sequential operators against plain loops over lists."""

import random

import pytest

from leafmill.functions import models
from leafmill.operators import budget, dedup
from pyspark.sql import functions as F


def costs(spark, seed, top=60):
    rng = random.Random(seed)
    rows = [(g, i, rng.choice([0, rng.randint(1, 9), rng.randint(1, top)])) for g in ("a", "b", "c") for i in range(40)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "g string, o long, c long").repartition(3), sorted(rows)


def by_group(rows):
    out = {}
    for g, o, c in rows:
        out.setdefault(g, []).append((o, c))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_batches(spark, seed):
    df, rows = costs(spark, seed)
    want = {}
    for g, items in by_group(rows).items():
        batches, current, used = [], [], 0
        for o, c in items:
            if c > 40:
                if current:
                    batches.append(current)
                batches.append([o])
                current, used = [], 0
            else:
                if current and used + c > 40:
                    batches.append(current)
                    current, used = [], 0
                current.append(o)
                used += c
        if current:
            batches.append(current)
        want |= {(g, o): n for n, b in enumerate(batches) for o in b}
    got = budget.greedy_batches(df, ["g"], "o", "c", 40).collect()
    assert {(r["g"], r["o"]): r["batch"] for r in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_greedy_batches_with_base(spark, seed):
    df, rows = costs(spark, seed)
    want = {}
    for g, items in by_group(rows).items():
        n = used = count = 0
        used = 5
        for o, c in items:
            if count and used + c > 40:
                n, used, count = n + 1, 5, 0
            used, count = used + c, count + 1
            want[g, o] = n
    got = budget.greedy_batches_base(df, ["g"], "o", "c", 40, 5).collect()
    assert {(r["g"], r["o"]): r["batch"] for r in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_fill_skipping(spark, seed):
    df, rows = costs(spark, seed)
    want = set()
    for g, items in by_group(rows).items():
        used = 0
        for o, c in items:
            if used + c <= 100:
                used += c
                want.add((g, o))
    assert {(r["g"], r["o"]) for r in budget.fill_skipping(df, ["g"], "o", "c", 100).collect()} == want


def test_prefix_and_suffix(spark):
    df, rows = costs(spark, 9)
    want, newest = set(), set()
    for g, items in by_group(rows).items():
        used = 10
        for o, c in items:
            used += c
            if used > 100:
                break
            want.add((g, o))
        used = 0
        for o, c in items[::-1][:10]:
            used += c
            if used > 50:
                break
            newest.add((g, o))
    assert {(r["g"], r["o"]) for r in budget.prefix_within(df, ["g"], "o", "c", 100, 10).collect()} == want
    assert {(r["g"], r["o"]) for r in budget.suffix_within(df, ["g"], "o", "c", 50).collect()} == newest


def test_feedback_batches(spark):
    df, rows = costs(spark, 4)
    want = {}
    for g, items in by_group(rows).items():
        batch, generated, current = 0, 0, []
        for o, c in items:
            if current and sum(current) + c > 60 - generated:
                generated += sum(current) // 4
                batch, current = batch + 1, []
            current.append(c)
            want[g, o] = batch
    got = budget.feedback_batches(df, ["g"], "o", "c", 60, lambda costs, so_far: sum(costs) // 4).collect()
    assert {(r["g"], r["o"]): r["batch"] for r in got} == want


def test_refined(spark):
    df, rows = costs(spark, 6)

    def step(so_far, c):
        if c == 0:
            raise ValueError(c)
        return so_far + str(c)

    want = {g: ("".join(str(c) for _, c in items if c), sum(c == 0 for _, c in items)) for g, items in by_group(rows).items()}
    got = models.refined(df, "g", "o", "c", step).collect()
    assert {r["g"]: (r["result"], r["failures"]) for r in got} == want
    assert models.refined(df.limit(0), "g", "o", "c", step).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_url_or_content(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *"abcdefghij"]), str(rng.randint(0, 40))) for i in range(200)]
    urls, contents, want = set(), set(), []
    for i, u, c in rows:
        if (u is not None and u in urls) or c in contents:
            continue
        urls.add(u)
        contents.add(c)
        want.append(i)
    df = spark.createDataFrame(rows, "o long, u string, c string").repartition(4)
    got = dedup.url_or_content(df, "u", "c", "o").collect()
    assert sorted(r["o"] for r in got) == want
    assert dedup.url_or_content(df.limit(0), "u", "c", "o").count() == 0


def test_empty_groups(spark):
    none = spark.createDataFrame([], "g string, o long, c long")
    for df in (budget.greedy_batches(none, ["g"], "o", "c", 4), budget.fill_skipping(none, ["g"], "o", "c", 4)):
        assert df.count() == 0
    assert dedup.first_wins(none, F.col("g"), "o").count() == 0


def plain_url_or_content(rows):
    us, cs, kept = set(), set(), []
    for o, u, c in sorted(rows):
        if (u is None or u not in us) and (c is None or c not in cs):
            kept.append(o)
            us.add(u)
            cs.add(c)
    return kept


def test_url_or_content_of_a_long_chain(spark):
    """Each row shares its url with the one before or its content with the one after; rounds do not grow with the chain."""
    rows = [(i, f"u{i // 2}", f"c{(i + 1) // 2}") for i in range(10_000)]
    df = spark.createDataFrame(rows, "o long, u string, c string")
    got = sorted(r["o"] for r in dedup.url_or_content(df, "u", "c", "o").collect())
    assert got == plain_url_or_content(rows)


def test_url_or_content_of_large_components(spark):
    """Components too large for one task go on in rounds."""
    rng = random.Random(3)
    rows = [(i, rng.choice([None, f"u{i // 2}"]) if i % 9 == 0 else f"u{i // 2}", f"c{(i + 1) // 2}") for i in range(60)]
    rows += [(100 + i, f"x{rng.randrange(12)}", f"y{rng.randrange(12)}") for i in range(80)] + [(300, None, None), (301, None, None)]
    df = spark.createDataFrame(rows, "o long, u string, c string")
    got = sorted(r["o"] for r in dedup.url_or_content(df, "u", "c", "o", local_rows=5).collect())
    assert got == plain_url_or_content(rows)


def test_running_sums_of_groups_over_ranges(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([None, *range(9)])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, c long").repartition(5)
    total, n, want = {}, {}, []
    for g, o, c in sorted(rows, key=lambda r: r[1]):
        total[g], n[g] = total.get(g, 0) + (c or 0), n.get(g, 0) + 1
        want.append((o, total[g], (n[g] - 1) // 7))
    sums = {r["o"]: r["s"] for r in budget.running_sums(df, ["g"], "o", "c", "s").collect()}
    batches = {r["o"]: r["batch"] for r in budget.fixed_batches(df, ["g"], "o", 7).collect()}
    assert [(o, sums[o], batches[o]) for o, _, _ in want] == want
    assert budget.running_sums(df.limit(0), ["g"], "o", "c", "s").count() == 0
