"""Dataset folders, sinks, provider dumps and the streaming forms."""

import json

import pytest
from checking import SMALL, rows_of, same
from pyspark.sql import functions as F

from leafmill.operators import allocation, records, report, retrieval
from leafmill.sources import datasets
from leafmill.streaming import cache


def test_dataset_folder(spark, tmp_path):
    folder = str(tmp_path)
    assert not datasets.is_complete(spark, folder)
    with pytest.raises(FileNotFoundError):
        datasets.load_dataset(spark, folder)
    (tmp_path / "outline.json").write_text("{broken")
    (tmp_path / "report_outline.json").write_text(json.dumps({"reportOutline": [{"title": "a", "points": ["x"]}], "companyName": "n"}))
    (tmp_path / "flattened_data.json").write_text(json.dumps([{"id": "1", "content": "c"}, {"id": "2"}]))
    got = datasets.load_dataset(spark, folder)
    assert set(got) == {"outline", "records"} and got["records"].count() == 2
    assert got["outline"].first()["reportOutline"][0]["title"] == "a"
    assert datasets.is_complete(spark, folder)


def test_read_or_compute(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []
    for _ in range(2):
        assert datasets.read_or_compute(spark, path, lambda: calls.append(1) or spark.range(3).toDF("x")).count() == 3
    assert len(calls) == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r", "# T")], "report_id string, markdown string")
    datasets.write_report(df, str(tmp_path / "r.md"))
    datasets.write_report(df, str(tmp_path / "r.json"))
    assert datasets.read_text(spark, str(tmp_path / "r.md")).first()["text"].strip() == "# T"
    assert spark.read.json(str(tmp_path / "r.json")).first()["markdown"] == "# T"
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    datasets.write_index(docs, str(tmp_path / "index"))
    assert spark.read.parquet(str(tmp_path / "index/doc_len")).count() == docs.count()


def test_dumps(spark):
    page = lambda t, md: {"title": t, "url": "u", "md": md, "data_source_type": "html"}
    rows = [("c", [page("a", "x"), page("b", "")], [page("n", "y")])]
    got = records.flatten_provider(spark.createDataFrame(rows, datasets.PROVIDER)).collect()
    assert [(r["kind"], r["pos"], r["title"]) for r in got] == [("navs", 0, "a"), ("navs", 1, "b"), ("news", 0, "n")]
    dump = [([[{"results": [page("a", "x"), page("b", "")]}, {"results": []}], [{"results": [page("c", "z")]}]],)]
    schema = f"groups ARRAY<ARRAY<STRUCT<results: ARRAY<{datasets.PAGE}>>>>"
    assert [r["title"] for r in records.flatten_search_dump(spark.createDataFrame(dump, schema)).collect()] == ["a", "c"]


def test_outline_and_sections(spark):
    s = "report_id long, reportOutline array<struct<title: string, points: array<string>>>, outline array<struct<title: string, points: array<string>>>"
    got = records.outline_sections(spark.createDataFrame([(1, [("a", []), ("b", ["p"])], None), (2, None, [("c", [])])], s))
    assert [(r["report_id"], r["section_index"], r["title"]) for r in got.collect()] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]
    sections = spark.createDataFrame([(0, "a"), (1, "b")], "section_index int, title string")
    info = records.section_info(sections, spark.createDataFrame([(0,), (0,)], "section_index int"), spark.createDataFrame([(1,)], "section_index int"))
    assert {r["number"]: (r["data_count"], r["chart_count"], r["has_data"]) for r in info.collect()} == {1: (2, 0, True), 2: (0, 1, False)}


def test_consecutive_ids(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("o"))
    got = records.consecutive_ids(df, "o", 5).collect()
    assert all(r["_id"] == r["o"] + 5 for r in got) and len(got) == 1000
    assert records.consecutive_ids(df.limit(0), "o").count() == 0


def test_lookup_semantics(spark):
    recs = spark.createDataFrame([("1", "a", 0), ("1", "b", 1), ("2", "c", 2)], "id string, v string, ord long")
    asked = spark.createDataFrame([(9, ["2", "1", "x", "1"])], "request_id long, ids array<string>")
    got = sorted((r["pos"], r["v"]) for r in allocation.lookup_by_ids(asked, recs).collect())
    assert got == [(0, "c"), (1, "b"), (3, "b")]


def test_empty_statistics(spark):
    none = spark.createDataFrame([], "data_id long, section_index int, confidence double, error boolean")
    row = allocation.match_stats(none).first()
    assert row["total_items"] == 0 and row["match_rate"] == 0.0 and row["avg_confidence"] == 0.0
    assert report.structure_check(spark.createDataFrame([], "content string")).first()["average_length"] == 0


def test_zero_vectors(spark):
    v = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = retrieval.vector_topk(v, [2.0, 0.0], 5).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 1.0), (0, 0.0)]


@pytest.mark.parametrize("form", [cache.sliding_expiry_sessions, cache.hourly_buckets])
def test_stream_equals_table(spark, tmp_path, form):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    name = f"t_{form.__name__}"
    started = form(stream).writeStream.outputMode("complete").format("memory").queryName(name).start()
    started.processAllAvailable()
    started.stop()
    assert rows_of(spark.table(name)) == rows_of(form(events))


def test_one_request_at_a_time(spark):
    df = spark.createDataFrame([(f"d{i % 3}", i) for i in range(12)], "domain string, n long")
    got = cache.one_at_a_time(df, lambda it: (p.assign(n=p.n * 2) for p in it), "domain string, n long")
    assert sorted(r["n"] for r in got.collect()) == [2 * i for i in range(12)]


def test_intermediates_can_be_removed(spark):
    from leafmill import storage

    df = storage.materialize(spark.range(5).toDF("x"), "t")
    path = df.inputFiles()[0]
    assert datasets.exists(spark, path)
    storage.remove_intermediates(spark)
    assert not datasets.exists(spark, path)


def test_chart_folder(spark, tmp_path):
    one = {"metadata": {"target_name": "acme"}, "charts": [{"chart_title": "a", "section": "s", "priority": "high", "png_path": "p"}]}
    (tmp_path / "a.json").write_text(json.dumps(one))
    (tmp_path / "b.json").write_text(json.dumps(one | {"metadata": {"target_name": "other"}}))
    (tmp_path / "c.json").write_text("{broken")
    assert [r["chart_title"] for r in datasets.chart_folder(spark, str(tmp_path), "acme").collect()] == ["a"]


def test_provider_pages(spark):
    df = spark.createDataFrame([("Company page", '<a href="u">x</a>'), ("latest news", "")], "title string, html string")
    got = {r["title"]: (r["kind"], r["links"]) for r in datasets.split_provider_pages(df, ("news", "report")).collect()}
    assert got == {"Company page": ("navs", ["u"]), "latest news": ("news", [])}


def test_front_matter_and_docx_columns(spark):
    from leafmill.sources import html

    df = spark.createDataFrame([('a "b"', "u", "2024-05-01 10:00:00", "text", bytearray(b"junk"))], "t string, u string, d string, b string, f binary")
    row = df.select(
        html.front_matter(F.col("t"), F.col("u"), F.col("d"), F.col("b")).alias("m"),
        html.front_matter(F.col("t"), F.col("u"), F.lit("soon"), F.col("b")).alias("n"),
        html.docx_of(F.col("f")).alias("x"),
    ).first()
    assert row["m"] == '---\ntitle: "a \\"b\\""\nurl: "u"\ndate: 2024-05-01T10:00:00Z\n---\n\ntext'
    assert "date" not in row["n"] and row["x"] == ""


def test_chart_blocks_and_titles(spark):
    df = spark.createDataFrame([("t", "p.png", ""), ("u", None, "d")], "t string, p string, d string")
    got = df.select(report.chart_block(F.col("t"), F.col("p"), F.col("d")).alias("x")).collect()
    assert [r["x"] for r in got] == ["### t\n![t](p.png)", "### u\nd"]
    titles = spark.range(1).select(*(report.section_title(F.lit("T"), F.lit(12), s).alias(s) for s in ("chinese", "arabic", "plain"))).first()
    assert tuple(titles) == ("## 12、T", "## 12. T", "## T")


def test_objects_of_variants(spark):
    from leafmill.functions import jsonx

    v = F.array(*(F.parse_json(F.lit(s)) for s in ('{"a":1}', "[1]", "2")))
    row = spark.range(1).select(F.transform(jsonx.only_objects(v), lambda x: F.to_json(x)).alias("o"), F.to_json(jsonx.parsed_or(F.lit("{bad"), "[]")).alias("d")).first()
    assert row["o"] == ['{"a":1}'] and row["d"] == "[]"


@pytest.mark.parametrize("name", ["cached_pages", "searched_pages"])
def test_pages_that_share_a_url(spark, tmp_path, name):
    """Two and three pages of one url, cached, fetched and not found, against the query's SQL."""
    import duckdb

    from leafmill.plans import catalog

    urls = ["a", "b", "b", "c", "c", "d", "d", "d", "e", "e"]
    pages = spark.createDataFrame([(i, u, f"html {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    same(catalog.QUERIES[name](spark, str(tmp_path)), duck.sql(catalog.SQL[name]))


def test_repeated_pages_do_not_multiply_requests(spark):
    from leafmill.sources import datasets

    pages = spark.createDataFrame([("u", "x"), ("u", "w"), ("v", "y"), ("v", "z")], "url string, html string")
    asked = spark.createDataFrame([("u",), ("u",), ("v",), ("n",)], "url string")
    got = datasets.cached_pages(asked, pages.where("url = 'u'"), pages)
    assert sorted(map(tuple, got.collect())) == [("u", "w"), ("u", "w"), ("v", "y")]


def test_report_of_texts_joins_each_text_once(spark):
    """The same reports as from joined sections, nulls and empty texts included, in one aggregation of all texts."""
    rows = [(r, n, o, t) for r in "ab" for n in (1, 2) for o, t in enumerate(["x", None, "", "y"])] + [("b", 3, 0, None)]
    texts = spark.createDataFrame(rows, "report_id string, number int, ord long, text string")
    sections = spark.createDataFrame([(r, f"t{n}", n) for r, n in (("a", 1), ("a", 2), ("b", 1), ("b", 2), ("b", 3), ("c", 1))], "report_id string, title string, number int")
    refs = spark.createDataFrame([("a", 1, "t1", "u"), ("a", 2, None, "v"), ("a", 3, "t", "w"), ("z", 1, "t", "u")], "report_id string, ref_num int, title string, url string")
    joined = report.joined_in_order(texts, ["report_id", "number"], "ord", F.col("text"), "\n", "content")
    whole = sections.join(joined, ["report_id", "number"], "left").na.fill("", ["content"])
    made = report.markdown_of_texts(sections, texts, refs)
    assert rows_of(made) == rows_of(report.markdown(whole, refs))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1


def test_long_reports_are_joined_as_they_come(spark):
    """The same reports as those of ``markdown_of_texts``, of few and of many batches; nothing gathers a report's pieces in a list."""
    rows = [(r, n, o, t) for r in ("a", "b", None, "ü") for n in (1, 2) for o, t in enumerate(["x", None, "", "中y", "z" * 50])]
    texts = spark.createDataFrame(rows, "report_id string, number int, ord long, text string")
    sections = spark.createDataFrame([(r, f"t{n}", n) for r, n in (("a", 1), ("a", 2), ("b", 2), ("c", 1), (None, 1), ("ü", 1))], "report_id string, title string, number int")
    refs = spark.createDataFrame([("a", 1, "t1", "u"), ("a", 2, None, "v"), ("z", 1, "t", "u"), (None, 1, "t", "u")], "report_id string, ref_num int, title string, url string")
    want = rows_of(report.markdown_of_texts(sections, texts, refs))
    plan = None
    for size in ("10000", "1"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            made = report.markdown_of_long_texts(sections, texts, refs)
            assert rows_of(made) == want
            plan = made._jdf.queryExecution().optimizedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in plan
    from leafmill.plans import catalog

    query = catalog.QUERIES["markdown_report"](spark, "/root/testdata/sf0.001")
    assert "collect_list" not in query._jdf.queryExecution().optimizedPlan().toString()
