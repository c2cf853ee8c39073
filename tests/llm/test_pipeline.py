"""The rows that each stage of the pipeline keeps, against plain Python on its own input."""

import random
import re
from collections import Counter
from itertools import pairwise

import pytest
from test_pages_and_benchmark import plain_coverage
from test_text_operators import TOKENIZER, crc, edited, ids_of, plain_line_dedup, plain_similar

import corpus_pipeline
from leafmill.llm import _tokens, decontamination, packing, quality_rules
from leafmill.llm._common import new_dir, read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = r"[\x20\x09-\x0d]+"


def corpus(seed):
    """(documents, benchmark items): clean texts, and some for each stage to take or to leave."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8)))
    text = lambda n, a_line=9: "\n".join(" ".join(word() for _ in range(min(a_line, n - i))) for i in range(0, n, a_line))
    items = [text(40, 40), text(60, 60), text(4, 4)]
    docs = [(text(rng.randint(60, 130)), "en", "web") for _ in range(34)]
    docs += [(text(rng.randint(60, 90)), "fr", "web") for _ in range(5)]
    docs += [(text(70), None, "web"), (None, "en", "web"), ("", "en", None)]
    # quality: too short, repetitive, symbols, capitals, long words
    docs += [(text(49), "en", "web"), (text(50), "en", "web"), ("on and on " * 40, "en", "web")]
    docs += [(text(60).replace(" ", " # "), "en", "web"), (text(60).upper(), "en", "web"), (text(60).upper(), "de", "web")]
    docs += [(" ".join(word() * 4 for _ in range(60)), "en", "web")]
    # line runs: a long line, two short lines that count together, one that does not
    pair, lone = "a short line here\nand a second one after it", "a short line alone"
    for shared in (text(10, 10), text(10, 10), pair, pair, lone, lone):
        docs.append((f"{text(50)}\n{shared}\n{text(20)}", "en", "web"))
    docs += [docs[0], docs[0], docs[3]]
    docs += [(f"{text(60)}\n{docs[5][0]}", "en", "web")]
    # near copies on one line, so that line runs leave them: similarities about 0.95 to 0.6, and a chain
    for n in (60, 100, 200):
        words = text(n, n).split()
        chain = words
        docs.append((" ".join(words), "en", "web"))
        for times in (1, 2, 3):
            docs.append((" ".join(edited(rng, words, times, f"e{n}t{times}")), "en", "web"))
            chain = edited(rng, chain, max(1, n // 80), f"c{n}t{times}")
            docs.append((" ".join(chain), "en", "web"))
    # benchmark items: whole, in parts the other way round, less than half, and the very short one
    for item in items[:2]:
        w = item.split()
        half = len(w) // 2
        for part in (w, w[half:] + ["between"] + w[:half], w[:half], w[: half - 1], w[half:][:8]):
            docs.append((f"{text(55)}\n{' '.join(part)} {text(30)}", "en", "web"))
    docs.append((f"{text(55)} {items[2]} {text(20)}", "en", "web"))
    rng.shuffle(docs)
    return [(7 * i + 3, t, *rest, len(t or "")) for i, (t, *rest) in enumerate(docs)], list(enumerate(items))


def plain_ratios(text):
    """The ratios of ``RATIOS``, or None where the base rule fails."""
    words = [w for w in re.split(BLANK, text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.sub(BLANK, "", x)]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    if len(words) < 50 or 100 * len(marked) > 50 * len(words):
        return None
    return {
        "symbols": 1000 * sum(text.count(c) for c in "#*$%&|<>") // len(words),
        "dup_lines": 1000 * (len(lines) - len(set(lines))) // len(lines),
        "repeats": 1000 * len(marked) // len(words),
        "upper": 1000 * sum(c.isupper() for c in text) // len(text),
        "exclaim": 1000 * text.count("!") // len(words),
        "word_length": 100 * sum(map(len, words)) // len(words),
    }


def plain_quality(rows):
    """doc_ids that are kept: values are compared with quartiles of values rounded down to six bits."""
    found = {r[0]: (r[2] or "", r[3] or "", plain_ratios(r[1])) for r in rows}
    passed = {k: v for k, v in found.items() if v[2]}
    kept = set()
    for doc_id, (lang, source, ratios) in passed.items():
        own = [v[2] for v in passed.values() if v[:2] == (lang, source)]
        of_lang = [v[2] for v in passed.values() if v[0] == lang]
        group = next((g for g in (own, of_lang) if len(g) >= 30), [v[2] for v in passed.values()])
        fits = True
        for name, (_, _, _, least, both) in quality_rules.RATIOS.items():
            values = sorted(v >> max(0, v.bit_length() - 6) << max(0, v.bit_length() - 6) for v in (g[name] for g in group))
            q25, q75 = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
            width = quality_rules.SPREAD_FACTOR * max(q75 - q25, least)
            fits &= ratios[name] <= q75 + width and not (both and ratios[name] < q25 - width)
        if fits:
            kept.add(doc_id)
    return kept


def plain_clean(text, items):
    words = re.findall(r"\w+", text.lower())
    for _, item in items:
        want = re.findall(r"\w+", item.lower())
        if plain_coverage(words, want, min(decontamination.MIN_TILE, len(want))) >= decontamination.COVERAGE * len(want):
            return False
    return True


@pytest.fixture(scope="module")
def stages(spark):
    """The benchmark's items, and (doc_id, text, lang, source, n_chars) before and after each stage; the last one's rows."""
    docs, items = corpus(3)
    folder = new_dir(spark, "tables")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, out = read_table(spark, folder, "documents"), [sorted(docs)]
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.materialize(stage(spark, at, folder), name)
        out.append(sorted(map(tuple, at.collect())) if name != "packing" else [r.asDict() for r in at.collect()])
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "piece", "start", "length").collect()
    return items, out, whole


def test_quality_rules_keep_the_plain_rows(stages):
    _, (before, after, *_), _ = stages
    kept = plain_quality(before)
    # without words (2), 49 words, repetitive, symbols, capitals (2), long words
    assert len(before) - len(kept) == 8
    assert after == [r for r in before if r[0] in kept]


def test_line_dedup_keeps_the_plain_lines(stages):
    _, (_, before, after, *_), _ = stages
    left = plain_line_dedup([r[:2] for r in before])
    assert sum(not t for t in left.values()) >= 3 and any(t and t != r[1] for r in before for t in [left[r[0]]])
    assert after == [(r[0], left[r[0]], r[2], r[3], len(left[r[0]])) for r in before if left[r[0]]]


def test_near_dedup_keeps_one_of_each_group(stages):
    _, (_, _, before, after, *_), _ = stages
    root = plain_similar([r[:2] for r in before])
    want = {min(before[j][0] for j in range(len(before)) if root[j] == r) for r in set(root)}
    assert 5 < len(before) - len(want)
    assert after == [r for r in before if r[0] in want]


def test_decontamination_keeps_clean_documents(stages):
    items, (_, _, _, before, after, _), _ = stages
    clean = [r for r in before if plain_clean(r[1], items)]
    assert 4 < len(before) - len(clean) < 10
    assert after == clean


def test_packing_holds_every_document_once(stages):
    _, (*_, before, rows), whole = stages
    library = _tokens.load(TOKENIZER)
    pieces = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(pieces) == len(rows)
    sizes = []
    for doc_id, text, *_ in before:
        ids, start = [*ids_of(library, text), 0], 0
        for piece in range(sum(k[0] == doc_id for k in pieces)):
            r = pieces[doc_id, piece]
            assert r["start"] == start and r["ids_crc32"] == crc(ids[start : start + r["length"]])
            sizes.append(r["length"])
            start += r["length"]
        assert start == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= packing.CAPACITY and all(a[1] == b[0] for a, b in pairwise(spans))
    space = []
    for size in sorted(sizes, reverse=True):  # best fit, the longest first
        fits = [k for k, s in enumerate(space) if s >= size]
        if fits:
            space[min(fits, key=lambda k: space[k])] -= size
        else:
            space.append(packing.CAPACITY - size)
    assert -(-sum(sizes) // packing.CAPACITY) <= len(sequences) <= len(space)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == sorted(map(tuple, whole))
