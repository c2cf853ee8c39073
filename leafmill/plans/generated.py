"""Queries over what calls generate: search queries from templates, charts from suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafmill.functions import search_queries as sq
from leafmill.operators import charts, outlines
from leafmill.plans.registered import query
from leafmill.storage import read_table


def _filled_sql(templates, name: str, code: str = "''") -> str:
    texts = (t.replace("'", "''").replace("{name}", f"' || {name} || '").replace("{code}", f"' || {code} || '") for t in templates)
    return "[" + ", ".join(f"'{t}'" for t in texts) + "]"


@query(
    "template_queries",
    f"""WITH s AS (SELECT s_name AS name, {_filled_sql(sq.COMPANY, "s_name")} || CASE WHEN s_suppkey % 2 = 0 THEN
            {_filled_sql(sq.COMPANY_CODE, "s_name", "s_suppkey")} ELSE [] END AS qs FROM supplier
        UNION ALL SELECT n_name, {_filled_sql(sq.INDUSTRY, "n_name")} FROM nation
        UNION ALL SELECT '宏观：' || r_name || ' ', {_filled_sql(sq.MACRO, "r_name")} FROM region)
        SELECT name, unnest(range(1, len(qs) + 1))::INT AS no, unnest(qs) AS query FROM s""",
)
def template_queries(spark, d):
    companies = read_table(spark, d, "supplier").select(
        F.lit("company").alias("kind"), F.col("s_name").alias("name"), F.expr("if(s_suppkey % 2 = 0, cast(s_suppkey as string), '')").alias("code")
    )
    none = F.lit(None).cast("string").alias("code")
    industries = read_table(spark, d, "nation").select(F.lit("industry").alias("kind"), F.col("n_name").alias("name"), none)
    themes = read_table(spark, d, "region").select(F.lit("macro").alias("kind"), F.concat(F.lit(sq.THEME_PREFIX), "r_name", F.lit(" ")).alias("name"), none)
    return sq.default_queries(companies.unionByName(industries).unionByName(themes)).select("name", "no", "query")


@query(
    "section_queries",
    """SELECT n_name AS name, r_name AS section, unnest([1, 2, 3])::INT AS no,
       unnest([n_name || ' ' || r_name, n_name || ' ' || r_name || ' 分析', n_name || ' ' || r_name || ' 发展']) AS query
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def section_queries(spark, d):
    regions = read_table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("section"))
    sections = read_table(spark, d, "nation").join(F.broadcast(regions), F.expr("n_regionkey = r_regionkey"))
    return sq.section_queries(sections.select(F.col("n_name").alias("name"), "section"))


@query(
    "processed_charts",
    """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, min(l_linenumber) AS pos FROM lineitem GROUP BY ALL),
       r AS (SELECT o, list(p ORDER BY pos, p) AS found, list(p_name ORDER BY pos, p) AS names FROM l JOIN part ON p_partkey = p AND p_size % 3 = 0 GROUP BY o),
       n AS (SELECT DISTINCT o FROM l),
       s AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 OR n.o IS NULL THEN 'no_data_ids' WHEN found IS NULL THEN 'no_raw_data_found'
             WHEN o_orderkey % 7 = 0 THEN 'generation_exception: no chart' WHEN o_orderkey % 7 = 1 THEN 'chart_generation_failed' END AS error, found, names
             FROM orders LEFT JOIN n ON n.o = o_orderkey LEFT JOIN r ON r.o = o_orderkey)
       SELECT o_orderkey AS suggestion_id, error IS NULL AS success, error, CASE WHEN error IS NULL THEN array_to_string(found, '+') END AS chart_html,
              CASE WHEN error IS NULL THEN len(found) ELSE 0 END::INT AS raw_data_count,
              CASE WHEN error IS NULL THEN array_to_string(list_transform(range(1, len(found) + 1), lambda i: i || ':' || found[i] || ':' || names[i]), ' ') END AS refs FROM s""",
)
def processed_charts(spark, d):
    """Orders as suggestions, their parts as data; a made-up generator joins the ids, fails for some titles and says nothing for others."""
    lines = read_table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    ids = F.when(F.col("o_orderkey") % 10 != 0, F.col("l.l_partkey"))
    orders = read_table(spark, d, "orders").join(lines, F.expr("o_orderkey = l_orderkey"), "left")
    suggestions = orders.select(F.col("o_orderkey").alias("suggestion_id"), ids.alias("data_ids"), F.col("o_orderkey").cast("string").alias("chart_title"))
    parts = read_table(spark, d, "part").where("p_size % 3 = 0")
    records = parts.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("").alias("url"), F.col("p_brand").alias("target"), F.col("p_type").alias("content")
    )

    def generate(told: str) -> str:
        import json

        asked = json.loads(told)
        rest = int(asked["chart_title"]) % 7
        if rest == 0:
            raise ValueError("no chart")
        return "" if rest == 1 else "+".join(str(x["id"]) for x in asked["data"])

    made = charts.processed(suggestions, records, generate, lambda html: f"chart of {html}")
    refs = F.array_join(F.transform("references", lambda x: F.concat_ws(":", x["ref_num"], x["data_id"], x["title"])), " ")
    return made.select("suggestion_id", "success", "error", "chart_html", "raw_data_count", refs.alias("refs"))


@query("document_outline")
def document_outline(spark, d):
    """Eight sections of all documents; tests compare trees and unions with plain versions."""
    sections, placed = outlines.outline(read_table(spark, d, "documents"), 8)
    return placed.join(F.broadcast(sections.select("section_index", "title")), "section_index").select("doc_id", "section_index", "title")
