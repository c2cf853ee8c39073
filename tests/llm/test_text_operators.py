"""Operators 2 to 6, 8 and 10 on odd rows, empty tables and against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from checking import SMALL, same
from pyspark.sql import functions as F

from leafmill.llm import _tokens, line_dedup, near_text, packing, quality_rules, registry, rule_ensemble, simhash, sstable, token_counts
from leafmill.llm._common import new_dir, read_table
from leafmill.llm._graph import connected_components

TOKENIZER = _tokens.tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return _tokens.load(TOKENIZER)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["op6_quality_rules", "op7_warc", "op8_line_dedup"])
def test_against_sql(spark, duck, name):
    same(registry.queries()[name](spark, SMALL), duck.sql(registry.oracle_sql()[name]))


# ---- encoding ----


def test_encoder_equals_library(library, odd_docs):
    rng = random.Random(1)
    alphabet = "ab éßØ'’12½  \n\t.,<|>endoftext€中𝔘 \x85\x1f"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += [r["text"] for r in odd_docs.collect()] + ["<|endoftext|>", "a<|endoftext|> b", "it's we'll I'M"]
    for entries in (10**6, 50):
        enc = _tokens.CachedEncoder(TOKENIZER, entries)
        assert [list(np.frombuffer(x, "<u4")) for x in enc.ids(texts)] == [ids_of(library, t) for t in texts]
        assert len(enc.cache) <= max(2 * entries, len({w for t in texts if t and enc.plain(t) for w in _tokens.PreTokens([t]).words(slice(None))}))


def test_packing_places_every_id(spark, library, odd_docs):
    got = packing.pack(odd_docs, TOKENIZER).collect()
    rows = odd_docs.collect()
    want = Counter()
    for r in rows:
        ids = ids_of(library, r["text"]) + [0]
        for k, (a, n) in enumerate(packing.cut(len(ids), 2048)):
            want[r["doc_id"], k, a, n, crc(ids[a : a + n])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_is_whole_and_bounded():
    rng = random.Random(2)
    for _ in range(150):
        capacity, n = rng.choice([10, 30, 100, 2048]), rng.choice([1, 5, 30, 150])
        counts = Counter(rng.randint(1, capacity) for _ in range(n))
        bins = packing.complete_bins(counts, capacity, 500)
        got = Counter()
        for items, k in bins:
            assert sum(items) <= capacity and k > 0
            for s in items:
                got[s] += k
        assert got == counts
        best = sum(k for _, k in bins)
        assert packing.lower_bound(counts, capacity) <= best <= sum(k for _, k in packing.best_fit_decreasing(counts, capacity))


def fewest_bins(items, capacity):
    """The optimum by trying all assignments of few items."""
    best = len(items)

    def put(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(items):
            best = len(free)
            return
        for i in {free[i]: i for i in range(len(free)) if free[i] >= items[k]}.values():
            put(k + 1, free[:i] + [free[i] - items[k]] + free[i + 1 :])
        put(k + 1, [*free, capacity - items[k]])

    put(0, [])
    return best


def test_search_is_exact_on_few_items():
    rng = random.Random(6)
    for _ in range(250):
        capacity = rng.choice([12, 30, 100])
        items = sorted((rng.randint(1, max(2, capacity * 2 // 3)) for _ in range(rng.randint(1, 11))), reverse=True)
        assert sum(n for _, n in packing.complete_bins(Counter(items), capacity, 10**6)) == fewest_bins(items, capacity)


def test_fillings_are_the_undominated_ones():
    """Against all fillings and Martello and Toth's criterion by its definition for single items."""
    from itertools import combinations

    rng = random.Random(7)
    for _ in range(200):
        room, items = rng.randint(5, 25), [rng.randint(1, 14) for _ in range(rng.randint(1, 7))]
        left = np.bincount(items, minlength=room + 20)
        every = {tuple(sorted(c, reverse=True)) for n in range(len(items) + 1) for c in combinations(items, n) if sum(c) <= room}

        def dominated(f):
            over = Counter(items) - Counter(f)
            return any(
                sum(part) <= x <= sum(part) + room - sum(f) and part != (x,)
                for n in range(len(f) + 1) for part in combinations(f, n) for x in over
            )

        got = list(packing._Room(left, room))
        assert len(got) == len(set(got)) and set(got) == {f for f in every if not dominated(f)}
        assert [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_search_beats_best_fit_decreasing():
    rng, better = random.Random(4), 0
    for _ in range(300):
        counts = Counter(rng.randint(15, 60) for _ in range(12))
        first = sum(k for _, k in packing.best_fit_decreasing(counts, 100))
        best = sum(k for _, k in packing.complete_bins(counts, 100))
        assert best <= first
        better += best < first
    assert better


def test_empty_table_gives_empty_results(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        packing.pack(no_docs, TOKENIZER),
        token_counts.token_counts(no_docs, TOKENIZER),
        sstable.read_shards(sstable.write_shards(no_docs, new_dir(spark, "t"), TOKENIZER)),
        simhash.near_duplicates(no_docs),
        simhash.keep_one_of_each(no_docs),
        quality_rules.quality_verdicts(no_docs),
        quality_rules.quality_filter(no_docs),
        line_dedup.dedup_lines(no_docs),
        rule_ensemble.quality_scores(no_docs, labels),
    ):
        assert df.count() == 0


def test_token_counts(library, odd_docs):
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(odd_docs, TOKENIZER).collect())
    want = Counter()
    for r in odd_docs.collect():
        n = len(ids_of(library, r["text"]))
        want[r["doc_id"], len((r["text"] or "").encode()), n, n > 512] += 1
    assert got == want


def test_token_counts_with_sentencepiece(spark):
    import sentencepiece

    path = _tokens.tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([(1, "Some words here."), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, path).collect()}
    assert got == {1: len(model.encode("Some words here.")), 2: 0}


def test_shards(spark, library, odd_docs):
    manifest = sstable.write_shards(odd_docs, new_dir(spark, "t"), TOKENIZER, shard_bytes=20_000)
    hashed = odd_docs.withColumn("hash", F.xxhash64("text")).collect()
    rows = sorted(hashed, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["hash"]))
    want, start = [], 0
    for r in rows:
        ids = ids_of(library, r["text"]) + [2]
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    got = [tuple(r) for r in sstable.read_shards(manifest).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    assert [len(x) for x in sstable.lookup(manifest, 3)] == [len(ids_of(library, "one")) + 1]
    assert len(sstable.lookup(manifest, 5)) == 2
    assert sstable.lookup(manifest, 99) == []


def test_shard_refuses_damage(tmp_path):
    import pyarrow.fs as fs

    path = str(tmp_path / "x.sst")
    with fs.LocalFileSystem().open_output_stream(path) as f:
        w = sstable.Writer(f, 2)
        for i in range(1000):
            w.add(sstable.key_of(i), np.arange(50))
        w.close()
        with pytest.raises(ValueError):
            w.add(sstable.key_of(0), np.arange(1))
    with fs.LocalFileSystem().open_input_file(path) as f:
        r = sstable.Reader(f)
        assert len(r.index) > 1 and [sstable.id_of(k) for k, _ in r] == list(range(1000))
        assert len(r.get(77)) == 1 and r.get(-1) == [] and r.get(5000) == []
    data = bytearray(open(path, "rb").read())
    data[40] ^= 1
    open(path, "wb").write(data)
    with fs.LocalFileSystem().open_input_file(path) as f, pytest.raises(Exception):
        list(sstable.Reader(f).block(0))


def test_shards_of_many_tiny_documents(spark):
    docs = spark.range(30_000).select(F.floor(F.col("id") / 3).alias("doc_id"), F.lit("").alias("text"))
    manifest = sstable.write_shards(docs, new_dir(spark, "t"), TOKENIZER, shard_entries=1000)
    assert manifest.agg(F.max("n_entries")).first()[0] == 1000
    got = sorted(map(tuple, sstable.read_shards(manifest).collect()), key=lambda r: r[1])
    assert [(r[0], r[1], r[2]) for r in got] == [(i // 3, i, 1) for i in range(30_000)]
    assert [len(sstable.lookup(manifest, i)) for i in (0, 333, 9_999, 10_000)] == [3, 3, 3, 0]


def test_rows_of_one_id_are_dealt_to_several_ranges(spark):
    docs = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    manifest = sstable.write_shards(docs, new_dir(spark, "t"), TOKENIZER)
    assert manifest.agg(F.max("n_entries")).first()[0] < 10_000
    assert sstable.read_shards(manifest).count() == 20_000


# ---- near duplicates ----


def plain_fingerprint(text):
    import xxhash

    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def reach(fps: dict, bits=2):
    """Least key that each key reaches over links of at most ``bits`` bits."""
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(fps)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprints_of_odd_texts(odd_docs):
    for r in odd_docs.collect():
        assert simhash.fingerprint(r["text"]) == plain_fingerprint(r["text"])


@pytest.mark.parametrize("bucket_limit", [simhash.BUCKET_LIMIT, 3])
def test_components_lose_no_link(spark, bucket_limit):
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        seed = rng.getrandbits(64)
        fps.append(seed)
        for _ in range(rng.choice([0, 1, 25])):
            x = rng.choice(fps[-6:])
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
                x ^= 1 << bit
            fps.append(x)
    rows = {i: f for i, f in enumerate(fps)}
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in rows.items()], "doc_id long, fp long")
    got = df.join(simhash.components(df, bucket_limit), "fp").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == reach(rows)


def test_linked_pairs_share_a_bucket():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    one, two = rng.integers(0, 64, (2, 4000)).astype(np.uint64)
    b = a ^ (np.uint64(1) << one) ^ (np.uint64(1) << two)
    assert (simhash.bucket_keys(a) == simhash.bucket_keys(b)).any(axis=1).all()
    gap = np.abs(simhash.distances(a).astype(int) - simhash.distances(b)).max(axis=(1, 2))
    assert gap.max() <= simhash.MAX_BITS


def test_near_duplicates_of_odd_rows(odd_docs):
    rows = odd_docs.collect()
    fps = {i: plain_fingerprint(r["text"]) for i, r in enumerate(rows)}
    groups = reach(fps)
    least = {}
    for i, g in groups.items():
        if rows[i]["doc_id"] is not None:
            least[g] = min(least.get(g, 10**9), rows[i]["doc_id"])
    want = Counter((rows[i]["doc_id"], f"{fps[i]:016x}", least.get(groups[i])) for i in groups)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == want
    kept = simhash.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(set(groups.values()))


def plain_shingles(text, size=5):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_similar(rows):
    """Positions of ``rows`` (doc_id, text) by the least position they reach over similarities of at least 0.8."""
    sets, root = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if root[i] != root[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited(rng, words, times, tag):
    """``words`` with so many of them replaced, far enough apart to change five shingles each."""
    out = list(words)
    for k, at in enumerate(rng.sample(range(5, len(words) - 5, 6), times)):
        out[at] = f"{tag}x{k}"
    return out


def similar_rows(seed):
    """Texts, near copies of similarity 0.5 to 1, chains of them, and unlike texts that share a passage."""
    rng, rows = random.Random(seed), []
    passage = " ".join(f"p{i}" for i in range(30))
    for g in range(14):
        words = [f"g{g}w{rng.randint(0, 5000)}" for _ in range(rng.choice([40, 90, 130, 400, 700]))]
        chain = words
        for k in range(rng.choice([1, 2, 6, 25])):
            few = rng.randint(0, max(1, len(words) // 50))
            rows.append((len(rows), " ".join(edited(rng, words, few, f"k{k}"))))
            chain = edited(rng, chain, few, f"c{k}")
            rows.append((len(rows), " ".join(chain)))
    rows += [(len(rows) + i, f"{passage} " + " ".join(f"u{i}n{j}" for j in range(25))) for i in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block", [(1, None), (2, 7)])
def test_similar_texts_against_all_pairs(spark, seed, block):
    rows = similar_rows(seed)
    sets = [plain_shingles(t) for _, t in rows]
    close = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.8 <= j < 0.95 for j in close) > 20 and sum(0.6 < j < 0.8 for j in close) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    root = plain_similar(rows)
    want = {min(rows[j][0] for j in range(len(rows)) if root[j] == r) for r in set(root)}
    got = near_text.keep_one_of_similar(docs, *([block] if block else []))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(want)


def test_bounds_lose_no_similar_set():
    rng = np.random.default_rng(4)
    for n in (1, 7, 60, 127, 128, 500, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            cut = rng.integers(0, n // 4 + 1, 2)
            b = np.unique(np.r_[a[cut[0] :], rng.integers(0, 1 << 63, cut[1], dtype=np.uint64)])
            if len(b) and near_text.similar(a, b):
                assert near_text.may_be_similar(len(a), near_text.parities(a), len(b), near_text.parities(b))
                assert set(a[: len(a) // 5 + 1].tolist()) & set(b[: len(b) // 5 + 1].tolist())


def test_similar_texts_of_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    root = plain_similar([(r["doc_id"], r["text"]) for r in rows])
    kept = near_text.keep_one_of_similar(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(set(root))
    assert near_text.keep_one_of_similar(no_docs).count() == 0


def test_fingerprints_join_near_copies_before_the_exact_join(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(6):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(300)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:150] + ["changed"] + words[150:]))]
    sets = {near_text.set_id(near_text.shingle_set(t)): i for i, t in rows}
    compared, own = [], near_text.passing

    def seen(pairs, merged, bits):
        compared.append({tuple(sorted(sets[x % 2**64] for x in r)) for r in pairs.collect()})
        compared.append({tuple(sorted(sets[x % 2**64] for x in r)) for r in own(pairs, merged, bits).collect()})
        return own(pairs, merged, bits)

    monkeypatch.setattr(near_text, "passing", seen)
    kept = near_text.keep_one_of_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 12, 2))
    near = {(2 * i, 2 * i + 1) for i in range(6)}
    assert near == compared[0] & near == compared[1] and not any(x & near for x in compared[3::2])



def test_connected_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(7, None), (3, 3)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(k):
        root.setdefault(k, k)
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        if b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in root}


# ---- quality ----


def test_quality_of_odd_rows(odd_docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality_rules.quality_verdicts(odd_docs).collect()}
    for r in odd_docs.collect():
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", r["text"] or "") if w]
        grams = Counter(zip(words, words[1:], words[2:], strict=False))
        marked = set()
        for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if grams[g] > 1:
                marked |= {i, i + 1, i + 2}
        row = got[r["doc_id"], len(words)]
        assert row["n_repeat_words"] == len(marked)
        assert row["word_chars"] == sum(map(len, words))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(marked) > 50 * len(words))
        assert not (row["base_failed"] and row["kept"])
    assert quality_rules.quality_filter(odd_docs).columns == odd_docs.columns


def test_fences_do_not_depend_on_partitions(spark):
    docs = read_table(spark, SMALL, "documents")
    from leafmill.llm._stats import with_text_stats

    some = [sorted(map(tuple, quality_rules.fences(quality_rules.sketches(with_text_stats(d))).collect())) for d in (docs.repartition(1), docs.repartition(7))]
    assert some[0] == some[1] and some[0]


def test_fences_follow_the_spread_of_a_group(spark):
    """The same long words are an outlier where words are alike, and none where they vary."""
    long = " ".join(["abcdefgh"] * 2 + [f"word{k:04d}" for k in range(58)])
    rows = [(100 * g + i, " ".join(f"{k:0{3 + (i % 2 + i % 3 if wide else 0)}d}" for k in range(60)), "en", f"s{g}") for g, wide in enumerate((False, True)) for i in range(40)]
    rows += [(900 + g, long, "en", f"s{g}") for g in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_verdicts(docs).collect()}
    assert [i for i, kept in got.items() if not kept] == [900]


def test_rules_follow_labels(spark):
    verdicts = quality_rules.quality_verdicts(read_table(spark, SMALL, "documents")).join(read_table(spark, SMALL, "labels"), "doc_id")
    good = verdicts.where("quality = 1 and not base_failed")
    assert good.where("not kept").count() == 0


# ---- line runs ----


def plain_line_dedup(rows, min_chars=line_dedup.MIN_CHARS):
    """Text of each (id, text): lines go where a run of enough characters through them occurred earlier."""
    seq = []
    for doc_id, text in rows:
        seq += [(doc_id, i, s) for i, s in enumerate(text.split("\n")) if s.strip(" \t\n\x0b\x0c\r")] + [(None, None, object())]
    dead = set()
    for p in range(len(seq)):
        for q in range(p):
            n = chars = 0
            while p + n < len(seq) and seq[p + n][0] is not None and seq[p + n][2] == seq[q + n][2]:
                chars += len(seq[p + n][2])
                n += 1
            if chars >= min_chars:
                dead |= {seq[p + k][:2] for k in range(n)}
    out = {}
    for doc_id, text in rows:
        gone = {i for d, i in dead if d == doc_id}
        left = [s for i, s in enumerate(text.split("\n")) if i not in gone]
        out[doc_id] = "\n".join(left) if not gone or any(s.strip(" \t\n\x0b\x0c\r") for s in left) else ""
    return out


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    lines = ["short", "a bit longer line", "tiny", "", "  ", "a line that is long enough to count on its own, really", "mid size line, twenty"]
    texts = ["\n".join(rng.choice(lines[: rng.choice([3, 7])]) for _ in range(rng.randint(0, 14))) for _ in range(25)]
    rows = list(enumerate(texts))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain_line_dedup(rows)


@pytest.mark.parametrize("min_chars", [3, 11])
def test_line_dedup_of_short_lines(spark, min_chars):
    """Runs that count only from many lines on, across borders of documents that could be read on."""
    rng = random.Random(min_chars)
    texts = ["\n".join(rng.choice(["a", "b", "cc", f"once {rng.random()}"][: rng.choice([2, 4])]) for _ in range(rng.randint(0, 30))) for _ in range(20)]
    rows = list(enumerate(texts + texts[:2]))
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), min_chars)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == plain_line_dedup(rows, min_chars)


def test_line_dedup_of_odd_rows(odd_docs):
    got = line_dedup.dedup_lines(odd_docs)
    rows = got.collect()
    assert len(rows) == odd_docs.count() and set(odd_docs.columns) <= set(got.columns)
    by_id = defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert by_id[0][0]["text"] is None and by_id[0][0]["_lm_lines"] == 0
    assert [r["text"].count("same line") for r in by_id[5]] == [1, 1]  # a repeated row is the same document
    assert by_id[6][0]["text"] == "other"


# ---- rule ensemble ----


def test_rules_learn_and_compile(spark):
    docs, labels = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels")
    x, y = rule_ensemble.training_rows(docs, labels)
    model = rule_ensemble.RuleEnsemble.fit(x, y)
    assert ((model.score(x) >= 0.3) == y).mean() > 0.95
    assert 0 < len(model.rules) < 400
    scored = rule_ensemble.with_statistics(docs).select("_lm_x", model.column(F.col("_lm_x")).alias("score")).collect()
    direct = model.score(np.array([r["_lm_x"] for r in scored]))
    assert np.allclose(direct, [r["score"] for r in scored], atol=1e-9)


def test_weights_meet_the_conditions_of_a_lasso():
    """Where a weight is zero the loss falls by less than the penalty either way, elsewhere by just as much."""
    rng = np.random.default_rng(4)
    z = rng.normal(size=(400, 12))
    y = (z[:, 0] - 0.7 * z[:, 3] + 0.3 * rng.normal(size=400) > 0).astype(float)
    penalty = 0.02
    w, b = rule_ensemble.lasso_logistic(z, y, penalty, 4000)
    gap = 1 / (1 + np.exp(-(z @ w + b))) - y
    slope = z.T @ gap / len(y)
    assert abs(gap.mean()) < 1e-5 and 0 < (w != 0).sum() < 12
    assert np.all(np.abs(slope[w == 0]) <= penalty + 1e-5) and np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5)
    loss = lambda v, c: np.mean(np.logaddexp(0, z @ v + c) - y * (z @ v + c)) + penalty * np.abs(v).sum()
    for _ in range(200):  # no step nearby does better
        assert loss(w + rng.normal(size=12) * 0.02, b + rng.normal() * 0.02) >= loss(w, b) - 1e-9


def test_paths_of_trees_are_all_their_conjunctions():
    """Rules of grown trees against walks of every row: a rule fires where the row passes its node."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (300, 4)).astype(float)
    target = (x[:, 0] > 2) * 1.0 + (x[:, 1] <= 1) - 0.5 * (x[:, 2] > 4)
    tree = rule_ensemble.grow(x, target, np.ones(300), rng)

    def passed(node, row, so_far=()):
        while isinstance(node, tuple):
            j, bound, below, above = node
            up = bool(row[j] > bound)
            so_far, node = (*so_far, (j, up, bound)), above if up else below
            yield so_far

    rules = rule_ensemble.paths(tree)
    assert len(rules) == len(set(rules)) > 4
    walks = [set(passed(tree, row)) for row in x]
    assert set().union(*walks) <= set(rules)
    for rule in rules:
        assert rule_ensemble.fires(rule, x).tolist() == [rule in walk for walk in walks]


def test_training_rows_stay_bounded(spark):
    """However often doc_ids are repeated in documents or labels."""
    docs = spark.createDataFrame([(i % 7 + 1, f"text {i} " * 9) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 7 + 1, i % 2) for i in range(60)], "doc_id long, quality int")
    x, y = rule_ensemble.training_rows(docs, labels, 40)
    assert len(x) == len(y) == 40
    again = rule_ensemble.training_rows(docs.repartition(5), labels.repartition(3), 40)
    assert np.array_equal(again[0], x) and np.array_equal(again[1], y)


def test_held_out_accuracy(spark):
    scored = rule_ensemble.op10_quality_classifier(spark, "/root/testdata/sf0.01")
    held = scored.where("held_out").join(read_table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").collect()
    assert len(held) > 40
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_held_out_rows_and_lang_do_not_matter(spark):
    docs, labels = read_table(spark, SMALL, "documents"), read_table(spark, SMALL, "labels")
    out = rule_ensemble.held_out(F.col("doc_id"))
    changed = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = rule_ensemble.quality_scores(docs, labels).collect()
    b = rule_ensemble.quality_scores(docs.withColumn("lang", F.lit(None).cast("string")), changed).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert all(r["held_out"] == rule_ensemble.is_held_out(r["doc_id"]) for r in a)


def test_scores_of_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(11)] + [(None, 1, 1), (3, None, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    got = rule_ensemble.quality_scores(odd_docs, labels).collect()
    assert len(got) == odd_docs.count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    none = rule_ensemble.quality_scores(odd_docs, labels.where("quality = 5")).collect()
    assert {r["score"] for r in none} == {0.5}


def test_narrow_ids(spark, library):
    docs = spark.createDataFrame([(1, "some words"), (2, "some more words")], "doc_id int, text string")
    assert {r["doc_id"] for r in packing.pack(docs, TOKENIZER).collect()} == {1, 2}
    assert {r["doc_id"] for r in token_counts.token_counts(docs, TOKENIZER).collect()} == {1, 2}
    assert simhash.near_duplicates(docs).count() == 2


def test_a_third_of_rows_alike(spark):
    """Copies, near copies and one shared line that make up most rows."""
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 400)}" for _ in range(600)]
    rows = []
    for i in range(240):
        if i % 3 == 0:
            text = " ".join(base)
        elif i % 3 == 1:
            words = list(base)
            words[rng.randrange(600)] = f"x{i}"
            text = " ".join(words)
        else:
            text = "this line stands in very many of the documents\n" + " ".join(f"u{rng.randint(0, 9999)}" for _ in range(80))
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = reach({i: plain_fingerprint(t) for i, t in rows})
    for limit in (simhash.BUCKET_LIMIT, 8):
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, limit).collect()}
        assert got == want
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == plain_line_dedup(rows)
