"""The Merkle manifest, the license scan and the divergence of sources, against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leafmill.llm import divergence, licenses, merkle

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_climb(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 16]) for i in range(0, len(below), 16)])
    return levels


def siblings(levels, i):
    """For each level below the root: (left siblings, right siblings)."""
    out = []
    for below in levels[:-1]:
        first = i // 16 * 16
        out.append((below[first:i], below[i + 1 : first + 16]))
        i //= 16
    return out


def plain_leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_manifest(rows):
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append((plain_leaf(*r), r))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[s] = plain_climb([leaf for leaf, _ in by_source[s]])
    top = plain_climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (leaf, r) in enumerate(by_source[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            forged = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            fold = plain_leaf(*r[:4], lower(r[4])) if forged else leaf
            for left, right in path:
                fold = H(*left, fold, *right)
            proof = H(*(x for left, right in path for x in left + right))
            root = top[-1][0]
            out.append((r[0], leaf, trees[s][-1][0], root, proof, fold, fold == root))
    return out


def manifest(df):
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = merkle.merkle_proofs(df, F.coalesce(tamper, F.lit(False))).collect()
    return [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in rows]


ordered = lambda rows: sorted(map(str, rows))


def test_manifest_of_many_sizes(spark):
    """Sources of 1 to 4097 rows over unaligned ranges."""
    sizes = {None: 18, "": 1, "a": 15, "b": 16, "c": 17, "Ä": 255, "d": 256, "e": 257, "f": 272, "g": 4097, "h": 33, "\U0001f600": 2, "￿": 3}
    rows, n = [], 0
    for s, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append(((n * 7919) % 100_003 - 50, s, "en" if n % 3 else None, n, f"Text Number {n} É" if n % 11 else None))
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    found = manifest(df)
    assert ordered(found) == ordered(plain_manifest(rows))
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("rows", [[(5, "s", "en", 3, "Abc")], [(i, None, None, None, None) for i in (None, None, 1, 1, 2)]])
def test_manifest_of_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert ordered(manifest(df)) == ordered(plain_manifest(rows))


def test_manifest_of_odd_rows(spark, odd_docs, no_docs):
    df = odd_docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("tree", F.lit(1)).withColumn("leaves", F.lit("x"))
    rows = [tuple(r) for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert ordered(manifest(df)) == ordered(plain_manifest(rows))
    assert manifest(no_docs) == []


@pytest.mark.parametrize("first, last, total", [(0, 600, 600), (5, 300, 600), (16, 32, 600), (17, 31, 600), (590, 600, 600), (255, 273, 289)])
def test_stretches_give_each_node_once(first, last, total):
    """Whatever a stretch holds, its records have every leaf once, and whole runs only where all children are there."""
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(total)]
    peaks = merkle.MountainRange(total)
    for i in range(first, last):
        peaks.push(i, digests[i], i)
    peaks.close()
    assert sorted(m for r in peaks.records for m in r[5]) == list(range(first, last))
    for level, parent, at, run, digest, _ in peaks.records:
        size = merkle.level_sizes(total)[level]
        children = min(16, size - 16 * parent)
        assert (digest is not None) == (len(run) == 32 * children and at == 0)
    pieces = Counter(r[0] for r in peaks.records if r[4] is None)
    assert all(n <= 2 for n in pieces.values())  # at most one at each edge of a level


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_places(words, notices):
    """All places of all notices by the distance of every run of words, then the best apart."""
    out = []
    for k, notice in enumerate(notices):
        hits = []
        for i in range(len(words)):
            for j in range(i, len(words)):
                span = " ".join(words[i : j + 1])
                if len(span) > len(notice.text) + notice.edits:
                    break
                if len(span) >= len(notice.text) - notice.edits and all(f" {n} " in f" {span} " for n in notice.names):
                    d = plain_distance(span, notice.text)
                    if d <= notice.edits:
                        hits.append((d, i, j))
        kept = []
        for d, i, j in sorted(hits):
            if all(j < a or i > b for _, a, b in kept):
                kept.append((d, i, j))
        out += [(k, i, j, d) for d, i, j in kept]
    return sorted(out)


def test_notices_like_all_runs_of_words():
    """Notices with edits at random places among other words, joined, cut and repeated."""
    rng = random.Random(5)
    notices = (*licenses.NOTICES[:1], *licenses.NOTICES[3:6], licenses.NOTICES[8], licenses.NOTICES[9])
    scanner = licenses.Scanner(notices)
    near = 0
    for _ in range(60):
        words = []
        for _ in range(3):
            words += [rng.choice(["the", "license", "public", "version", "2", "3", "under", "gnu", "wort", "mit", "é"]) for _ in range(rng.randint(0, 4))]
            notice = rng.choice(notices)
            chars = list(notice.text)
            for _ in range(rng.randint(0, notice.edits + 1)):
                at = rng.randrange(len(chars))
                kind = rng.randrange(3)
                if kind == 0:
                    del chars[at]
                else:
                    chars[at : at + (kind == 1)] = rng.choice("abcexyz 0")
            words += "".join(chars).split()
        text = " ".join(words)
        ends = [m.end() for m in re.finditer(r"\S+", text)]
        starts = [m.start() for m in re.finditer(r"\S+", text)]
        found = sorted((p.notice, p.first_word, p.last_word, p.edits) for p in scanner.places(text, starts, ends))
        assert found == plain_places(words, notices)
        near += sum(p[3] > 0 for p in found)
    assert near > 30


def test_seeds_cover_a_notice():
    for notice in licenses.NOTICES:
        pieces = licenses.seeds(notice)
        assert len(pieces) == notice.edits + 1 and "".join(p for _, p in pieces) == notice.text
        assert all(notice.text.startswith(p, at) for at, p in pieces) and all(len(p) > 5 for _, p in pieces)
        assert all(licenses.has_words(notice.text, (n,)) for n in notice.names)


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [
        (i, label)
        for phrase, label in licenses.BASE_PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_license_scan_of_texts(spark, odd_docs, no_docs):
    texts = [
        "Released under the MIT License. Under the MIT license!\nunder-the_mit LICENSE",
        "CC BY-NC CC BY NC cc by nc cc",
        "Licenced under the Apach License, Version 2.0.",  # the name is lost
        "Licenced undr the Apache License, Version 2.0.",
        "Licensed under the GNU General Public License, version 2, not version 3.",
        "Ich bin mit der Lizenz unter dem MIT-Gebäude.",
        "under the mit licenseÉ and apache license version 20",
        "x" * 3000 + " " + "Redistribution and use in source and binary forms, with or without modifcation, are permited.",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in licenses.license_scan(df).collect()}
    assert [rows[i]["labels"] for i in range(8)] == ["mit", "cc-by-nc", "", "apache-2", "gpl-2", "", "", "bsd"]
    assert rows[0]["score"] == rows[3]["score"] == 1.0 and 0.9 < rows[7]["score"] < 1 and rows[2]["score"] == 0
    assert rows[0]["n_base"] == 3 and (rows[0]["first_word"], rows[0]["last_word"]) == (1, 9)
    for r in rows.values():
        assert all(texts[r["doc_id"]][s["first_char"] : s["last_char"]] == s["text"] for s in r["spans"])
    assert [s["text"] for s in rows[3]["spans"]] == ["Licenced undr the Apache License, Version 2.0"]
    base = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    for data in (df, odd_docs.withColumn("spans", F.lit(1))):
        want = sorted(str((r["doc_id"], *plain_base(r["text"]))) for r in data.collect())
        found = licenses.license_scan(data).collect()
        assert sorted(str((r["doc_id"], *(r[c] for c in base))) for r in found) == want
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
    assert licenses.license_scan(no_docs).collect() == []


def plain_divergence(rows, min_docs=3, top=200):
    """From (lang, source, text), with Python's whole numbers."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    rows = [tuple(v or "" for v in r) for r in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        df[lang].update(set(terms(text)))
        counts[lang, source].update(terms(text))
    out = []
    for lang in {r[0] for r in rows}:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        sources = sorted(s for g, s in counts if g == lang)

        def share(c, kept=kept):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(items[:most], 1)]
    return out


def audit(df):
    return [tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in divergence.source_divergence(df).collect()]


def test_divergence_against_whole_numbers(spark, monkeypatch):
    rng = random.Random(9)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Été", "été", "über", "\U0001f600x"]
    rows = []
    for k in range(300):
        lang = rng.choice(["en", "de", None])
        at = rng.randrange(60)
        text = " ".join(rng.choice(words[at : at + 30]) for _ in range(rng.randint(0, 40)))
        rows.append((lang, rng.choice(["a", "b", "C", "é", None]), rng.choice([text, text.upper(), None])))
    rows += [("xx", "one", "rare words only"), ("xx", "two", None), ("yy", "lone", "a b a b"), ("en", "only here", "9 9 9")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    want = ordered(plain_divergence(rows))
    assert ordered(audit(df)) == want
    monkeypatch.setattr(divergence, "BLOCK", 16)
    assert ordered(audit(df)) == want
    assert ordered(divergence.term_counts(df, held=50).collect()) == ordered(divergence.term_counts(df).collect())


def test_divergence_of_tiles():
    """Pairs of tiles together give what all sources at once give, and slabs change nothing."""
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 9, (30, 40)) * (rng.random((30, 40)) < 0.3)
    n, kept = counts.sum(1), 40
    terms = pa.table(
        {
            "term": [f"t{(i * 7) % 40:02}" for i in range(40)],
            "total": counts.sum(0),
            "places": [np.flatnonzero(c).astype("int32").tolist() for c in counts.T],
            "counts": [c[c > 0].tolist() for c in counts.T],
        }
    )
    groups = pa.table({"place": pa.array(range(30), pa.int32()), "n": n, "kept": [kept] * 30, "lang_n": [int(n.sum())] * 30})
    whole = sorted(map(str, divergence.block_parts(terms, groups, 0, 0)))
    assert len([x for x in whole if "None, None" not in x]) and len(whole) > 30 * 29
    old = divergence.TILE, divergence.SLAB
    try:
        divergence.TILE, divergence.SLAB = 8, 100
        parts = []
        for i in range(4):
            for j in range(4):
                mine = groups.filter(pa.array([p // 8 in (i, j) for p in range(30)]))
                parts += divergence.block_parts(terms, mine, i, j)
    finally:
        divergence.TILE, divergence.SLAB = old
    assert sorted(map(str, parts)) == whole


def test_shares_of_large_counts():
    counts = np.array([0, 1, 10**12, 7 * 10**14], np.int64)
    total = np.int64(8 * 10**14)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // int(total) for c in counts]


def test_greatest_keeps_earlier_ties():
    rng = random.Random(1)
    for _ in range(50):
        values = [rng.randrange(5) for _ in range(rng.randrange(12))]
        want = sorted(range(len(values)), key=lambda i: (-values[i], i))[:4]
        assert divergence.greatest(np.array(values, np.int64), 4).tolist() == want


def test_divergence_of_odd_rows(spark, odd_docs, no_docs):
    rows = [tuple(r) for r in odd_docs.select("lang", "source", "text").collect()]
    df = odd_docs.withColumn("place", F.lit(1)).withColumn("term", F.lit("x")).withColumn("value", F.lit(2))
    assert ordered(audit(df)) == ordered(plain_divergence(rows))
    assert audit(no_docs) == []
