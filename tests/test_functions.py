"""Scalar functions, splitters, JSON scanners, markup and model calls."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import chunks, jsonx, models, text
from leafmill.sources import html

FENCED = '```json\n[{"id": 1, "value": "]"}]\n```'


@pytest.mark.parametrize(
    ("said", "mode", "want"),
    [
        (f"[not JSON] then {FENCED}", "auto", '[{"id": 1, "value": "]"}]'),
        ('one {"name": "a"} and {"name": "b"}', "auto", '[{"name": "a"},{"name": "b"}]'),
        ("a list [1, 2, 3].", "auto", "[1, 2, 3]"),
        ("broken [1,2", "auto", None),
        ("no JSON here", "auto", None),
        ('{"id":0}, [1,2], ```json[{"id":99}]```', "auto", '[{"id":99}]'),
        ('{"id":0}, [1,2]', "auto", "[1,2]"),
        ('x [{"a": {"v": [10, 20]}}, {"b": 2}] y', "auto", '[{"a": {"v": [10, 20]}}, {"b": 2}]'),
        ('[{"k": "has [x] and {y}"}]', "auto", '[{"k": "has [x] and {y}"}]'),
        ("first [1, 2], second [3, 4]", "array", "[1, 2]"),
        ("wrong [1, 2,]", "auto", None),
        ('{"a":1,}', "auto", None),
        ('```json[{"a":1,}]```', "auto", None),
        ('{"a":1}{"b":2,"c":{"d":3}}', "objects", '[{"a":1},{"b":2,"c":{"d":3}}]'),
        ('bad [1, 2,]. good {"status": "ok"}', "auto", '[{"status": "ok"}]'),
        ("none fenced", "jsonblock", None),
        (None, "auto", None),
    ],
)
def test_json_array(said, mode, want):
    assert jsonx.find_json_array(said, mode) == want


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ('```json\n{"x": true}\n```', '{"x": true}'),
        ('a {"x": false, "r": "n"} b', '{"x": false, "r": "n"}'),
        ('{"a": 1} {"b": 2}', '{"a": 1}'),
        ("text {bad json} more", None),
        ('{"o": {"i": {"v": 1}}}', '{"o": {"i": {"v": 1}}}'),
        ('{"m": "has {braces}"}', '{"m": "has {braces}"}'),
    ],
)
def test_json_object(said, want):
    assert jsonx.find_json_object(said) == want


@given(st.text(alphabet="[]{}\",:1a \\", max_size=60))
@settings(max_examples=300, deadline=None)
def test_found_json_is_valid(said):
    for found in (jsonx.find_json_array(said), jsonx.find_json_object(said)):
        if found is not None:
            json.loads(found)


@given(st.text(alphabet="ab c.,\n。一二 ", max_size=400), st.integers(5, 60))
@settings(max_examples=200, deadline=None)
def test_splitters_bound_their_chunks(said, size):
    for c in chunks.split_chars(said, size):
        assert 0 < len(c) <= size or c == said
    whole = chunks.split_tokens(said, size)
    assert "".join(whole) == said
    assert all(chunks.count_tokens(c) <= size for c in whole)
    fast = chunks.split_fast(said, size)
    assert all(chunks.count_tokens(c) <= size for c in fast)
    assert "".join("".join(fast).split()) == "".join(said.split())


def test_splitter_edges():
    assert chunks.split_chars(None) == [] and chunks.split_chars("short") == ["short"]
    assert chunks.split_chars("aaaa. bbbb. cccc", 6) == ["aaaa", "bbbb", "cccc"]
    assert chunks.split_chars("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    with pytest.raises(ValueError):
        chunks.split_tokens("x", 5, 5)


def plain_chars(t, size, separators):
    """The rule of ``split_chars`` without overlap, one field after the other."""
    if len(t) <= size:
        return [t.strip()] if t.strip() else []
    sep = next(s for s in separators if s == "" or sum(bool(x.strip()) for x in t.split(s)) > 1)
    fields = [x for x in t.split(sep) if x.strip()] if sep else list(t)
    out, now = [], None
    for x in fields:
        if now is not None and len(now + sep + x) <= size:
            now += sep + x
            continue
        out += [now.strip()] if now is not None else []
        now = x
        if len(x) > size:
            out += plain_chars(x, size, separators[separators.index(sep) + 1 :])
            now = None
    return [x for x in out + ([now.strip()] if now is not None else []) if x]


@given(st.text(alphabet="ab c.,\n。一二 ", max_size=300), st.integers(3, 60))
@settings(max_examples=200, deadline=None)
def test_split_chars_by_the_rule(said, size):
    want = ([said] if said else []) if len(said) <= size else plain_chars(said, size, chunks.CHAR_SEPARATORS)
    assert chunks.split_chars(said, size) == want


@given(st.text(alphabet="ab c.,\n。一二 ", max_size=200), st.integers(3, 40))
@settings(max_examples=200, deadline=None)
def test_split_tokens_takes_as_much_as_fits(said, size):
    got = chunks.split_tokens(said, size)
    for a, b in zip(got, got[1:], strict=False):
        # Nothing up to b's first separator of the same or a more preferred kind would have fitted.
        assert chunks.count_tokens(a + b) > size or a[-1] in "".join(chunks.TOKEN_SEPARATORS)


def test_overlaps():
    assert chunks.split_chars("aaaa. bbbb. cc", 6, 2) == ["aaaa", "aabbbb", "bbcc"]
    assert chunks.split_chars("a.bbbbb.cc", 5, 2) == ["a", "bbbbb", "bbcc"]  # what is no longer than the overlap is not repeated
    assert chunks.split_tokens("a b c d ", 2, 1) == ["a b ", " c d "]
    assert all(chunks.count_tokens(x) <= 4 for x in chunks.split_fast("a b c d e f g h i j", 4, 3))


def test_hostile_json_is_read_in_linear_time():
    for said in ("[" * 200_000, "[" * 100_000 + "x" + "]" * 100_000, "{" * 100_000 + "}" * 100_000):
        assert jsonx.find_json_array(said) in (None, "[{}]")


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    url = F.col("u")
    assert one(spark, text.netloc(url), u="http://User:1@Example.COM:80/p") == "user:1@example.com:80"
    assert one(spark, text.netloc(url), u="no scheme/here") == ""
    for u, want in (("http://a.b/c.PDF", ".PDF"), ("http://a.b/c", ".html"), ("http://a.com", ".com"), ("x/.hidden", ".html"), ("x/a.tar.gz?q=1", ".gzq1"), (None, ".html")):
        assert one(spark, text.extension(url), u=u) == want
    assert one(spark, text.is_blacklisted(url), u="https://www.zhihu.com/x") is True
    assert one(spark, text.clean_links(F.col("t")), t="a ![i](x) [b](http://y) <a href='q'>c</a> www.z.com  d") == "a b c d"
    assert one(spark, text.clean_links(F.col("t")), t=None) == ""
    assert one(spark, text.normalize_section(F.col("t")), t=" 三、x") == "三、基本面分析"
    assert one(spark, text.normalize_section(F.col("t")), t="other") == "other"
    assert [one(spark, text.numeral_value(F.col("t")), t=t) for t in ("一", "十", "十一", "x")] == [1, 10, 0, 0]
    assert one(spark, text.safe_filename(F.col("t")), t="A b/c: 四?  ") == "A_bc_四"
    assert one(spark, text.referenced_ids(F.col("t")), t="【数据3】 (数据1) [数据3] 引用数据12") == ["1", "12", "3"]
    assert one(spark, text.first_html_block(F.col("t")), t="so ```html\n<p>x</p>\n``` end") == "<p>x</p>"
    assert one(spark, text.input_kind(F.col("t")), t="<!DOCTYPE html>") == "html"
    assert one(spark, text.input_kind(F.col("t")), t="a/b.html") == "path"
    assert one(spark, text.table_spacing(F.col("t")), t="text\n| a |\n| - |") == "text\n\n| a |\n| - |"
    assert one(spark, text.first_filled("a", "b"), a="", b="x") == "x"
    block = text.hidden_paths(F.create_map(F.lit("k"), F.lit("a:b.png")))
    assert one(spark, text.parse_hidden_paths(block), t="") == {"k": "a:b.png"}


@pytest.mark.parametrize(
    ("body", "url", "reason"),
    [
        ("404 Not Found " * 200, "http://a/b", "page_error"),
        ("字" * 60, "http://a/b", "han"),
        ("word " * 99, "http://a/b", "too_short"),
        ("word " * 120, "http://a/about", "generic_url"),
        ("word " * 120, "http://a/b", "passed"),
        ("x" * 250_001, "http://a/b", "too_long"),
        (None, None, "too_short"),
    ],
)
def test_rule_cascade(spark, body, url, reason):
    got = one(spark, text.rule_verdict(F.col("t"), F.col("u")), t=body, u=url)
    assert got["reason"] == reason and got["is_high_quality"] == (reason in ("han", "passed"))


def test_markdown():
    assert html.html_to_markdown("<h1>T</h1><p>a <b>b</b> <a href='/c'>d</a></p><ul><li>x<li>y</ul>", "http://h/") == (
        "# T\n\na **b** [d](http://h/c)\n\n* x\n* y"
    )
    assert "| a | b |\n| --- | --- |\n| 1 | 2 |" in html.html_to_markdown("<table><tr><th>a<th>b</tr><tr><td>1<td>2</td></tr></table>".replace("<th>b", "</th><th>b</th>").replace("<td>2", "</td><td>2"))
    assert 'colspan="2"' in html.html_to_markdown('<table class="x"><tr><td colspan="2" style="y">1</td></tr></table>')
    assert html.html_to_markdown("<img src='a.png' alt='z'>", None, True) == "z"
    assert html.html_to_markdown(None) == ""
    assert html.table_rows("<table><tr><th>k</th><th>v</th></tr><tr><td>1</td><td>2</td></tr></table>") == [{"k": "1", "v": "2"}]


def test_docx():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = f"<w:document {ns}><w:body><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>b</w:t></w:r></w:p></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    assert html.docx_text(data.getvalue()) == "a\n\nb"
    assert html.docx_text(b"junk") == "" and html.docx_text(None) == ""


def test_model_calls(spark):
    asked = []
    df = spark.createDataFrame([(1, "a", ""), (2, "bad", ""), (3, "a", "own"), (4, None, None)], "i long, content string, summary string")

    def call(said):
        if said == "bad":
            raise RuntimeError("no")
        return said.upper()

    got = {r["i"]: (r["x"], r["x_error"]) for r in models.model_call(df, F.col("content"), call, "x").collect()}
    assert got == {1: ("A", None), 2: (None, "RuntimeError: no"), 3: ("A", None), 4: (None, None)}
    filled = {r["i"]: r["summary"] for r in models.summarised(df, call).collect()}
    assert filled == {1: "A", 2: "bad", 3: "own", 4: ""}
    assert models.with_retries(lambda t: asked.append(t) or "", 3)("q") == "" and len(asked) == 3
    assert models.until_long(lambda t: "abc", 7)("q") == "abcabcabc"


def test_few_texts_are_held_at_once(spark):
    """A batch is worked off in parts that are bounded by number and by length, in order and whole."""
    import pandas as pd

    texts = pd.Series(["x" * 10] * 1000 + [None] + ["y" * 700_000] * 3)
    parts = list(chunks.few_at_once(texts))
    assert max(map(len, parts)) == 256 and [len(p) for p in parts[-2:]] == [1, 1]
    assert [t for p in parts for t in p] == texts.tolist() and list(chunks.few_at_once(texts[:0])) == []
    assert [len(a) for a, b in chunks.few_at_once(texts[:300], texts[:300])] == [256, 44]
    df = spark.range(700).selectExpr("id", "concat('a b ', id)  as t").coalesce(1)
    got = df.select("id", chunks.chunked(df["t"], "tokens", 2).alias("c")).collect()
    assert [r["c"] for r in got] == [["a b ", str(i)] for i in range(700)]


def test_outline_counts_in_bounded_memory():
    """Common words of many sections are counted in slabs of their hits, with the results of one item at a time."""
    import random
    import tracemalloc

    import pyarrow as pa

    from leafmill.operators.allocation import Outline

    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    sections = [rng.sample(words, 60) for _ in range(200)]
    outline = Outline(list(range(200)), [60] * 200, [w for s in sections for w in s], [i for i, s in enumerate(sections) for _ in s])
    lists = [rng.sample(words, 120) for _ in range(3000)] + [None, [], ["other"], ["w1", "w1"]]
    column = pa.array(lists, pa.list_(pa.string()))
    tracemalloc.start()
    section, share = outline.best(column)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    for i in [*range(0, 3000, 100), 3000, 3001, 3002, 3003]:
        shares = [len(set(lists[i] or []) & set(s)) / 60 for s in sections]
        assert (section[i], share[i]) == (shares.index(max(shares)) if max(shares) else -1, max(shares))


def test_token_splitters_read_a_text_once(monkeypatch):
    """Chunks like those from counting every piece anew, whatever the text; a long text's tokens are found once."""
    import random
    import re

    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice("ab é中文1_.,。 \n\n!\t𐐨") for _ in range(rng.randint(0, 60)))
        size = rng.randint(1, 6)
        for split in (chunks.split_fast, chunks.split_tokens):
            overlap = rng.randint(0, size - 1)
            assert split(text, size, overlap) == split(text, size, overlap, lambda t: chunks.count_tokens(t))
    read = []

    class Reader:
        def findall(self, text, plain=chunks._TOKEN):
            read.append(len(text))
            return plain.findall(text)

        def finditer(self, text, plain=chunks._TOKEN):
            read.append(len(text))
            return plain.finditer(text)

    monkeypatch.setattr(chunks, "_TOKEN", Reader())
    text = " ".join(rng.choice(["one", "two", "three.", "four\n"]) for _ in range(20_000))
    for split in (chunks.split_fast, chunks.split_tokens):
        read.clear()
        assert re.sub(r"\s", "", "".join(split(text, 200))) == re.sub(r"\s", "", text)
        assert sum(read) <= 2 * len(text)
