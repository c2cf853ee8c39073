"""Charts and search queries: defaults, error codes and fallbacks."""

from leafmill.functions import search_queries as sq
from leafmill.operators import charts


def test_charts_have_defaults_codes_and_fallbacks(spark):
    def generate(told):
        import json

        asked = json.loads(told)
        if asked["chart_title"] == "breaks":
            raise RuntimeError("no: model")
        return "" if asked["chart_title"] == "blank" else f"{asked['visualization_type']}|{'+'.join(x['content'] for x in asked['data'])}"

    def describe(html):
        if "c2" in html:
            raise ValueError("x")
        return "" if "c3" in html else f"shows {html}"

    records = [("1", "one", "u1", "acme", "c1"), ("2", "", None, "acme", "c2"), ("3", None, "u3", None, "c3"), ("1", "one", "u1", "acme", "c1")]
    records = spark.createDataFrame(records, "id string, title string, url string, target string, content string")
    rows = [
        (1, ["1"], "t", "bar"), (2, ["2", "1", "2", "9", None], None, None), (3, ["3"], "", "pie"), (4, [], "t", "bar"), (5, None, "t", "bar"),
        (6, ["9"], "t", "bar"), (7, ["1"], "breaks", "bar"), (8, ["1"], "blank", "bar"),
    ]
    suggestions = spark.createDataFrame(rows, "suggestion_id int, data_ids array<string>, chart_title string, visualization_type string")
    made = {r["suggestion_id"]: r for r in charts.processed(suggestions, records, generate, describe).collect()}
    assert {i: r["error"] for i, r in made.items()} == {
        1: None, 2: None, 3: None, 4: "no_data_ids", 5: "no_data_ids", 6: "no_raw_data_found", 7: "generation_exception: no: model", 8: "chart_generation_failed",
    }
    assert all(r["success"] == (r["error"] is None) for r in made.values())
    assert (made[1]["chart_html"], made[1]["image_description"]) == ("bar|c1", "shows bar|c1")
    assert [tuple(x) for x in made[2]["references"]] == [(1, "2", "acme 数据", ""), (2, "1", "one", "u1")] and made[2]["raw_data_count"] == 2
    assert made[2]["chart_title"] == "Unknown" and made[2]["priority"] == "medium" and made[2]["image_description"] == "unknown Unknown"
    assert [tuple(x) for x in made[3]["references"]] == [(1, "3", " 数据", "u3")] and made[3]["image_description"] == "pie "
    assert all(made[i]["references"] is None and made[i]["chart_html"] is None and made[i]["raw_data_count"] == 0 for i in (4, 5, 6, 7, 8))


def test_default_queries_by_kind(spark):
    rows = [("company", "acme", "1.HK"), ("company", "acme", ""), ("company", "acme", None), ("industry", "tea", None), ("macro", "宏观：trade ", None), ("other", "x", None)]
    df = spark.createDataFrame(rows, "kind string, name string, code string")
    found = sq.default_queries(df).collect()
    count = lambda kind, code: sum(r["kind"] == kind and r["code"] == code for r in found)
    assert (count("company", "1.HK"), count("company", ""), count("company", None), count("industry", None), count("macro", None)) == (10, 8, 8, 8, 15)
    texts = {(r["kind"], r["code"], r["no"]): r["query"] for r in found}
    assert texts["company", "1.HK", 9] == "1.HK acme 股票分析 投资价值" and texts["industry", None, 1].startswith("中国tea ")
    assert texts["macro", None, 15].startswith("trade 可持续发展")
    two = sq.section_queries(spark.createDataFrame([("a", "s")], "name string, section string"), most=2).collect()
    assert [r["query"] for r in two] == ["a s", "a s 分析"]
