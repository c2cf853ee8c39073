"""Projections of pages, search hits, charts and outlines to the flat tables the other operators read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leafmill.storage import materialize

from leafmill.functions.text import first_filled, forward_slashes, truncated

#: Places of sections and priorities in sorted chart lists.
SECTION_ORDER = {"核心财务数据": 1, "业务发展": 2, "市场表现": 3, "风险评估": 4, "未分类": 5}
PRIORITY_ORDER = {"high": 1, "medium": 2, "low": 3}


def flatten_hits(hits: DataFrame, company: str, query: str, start_id: int, ord_col: str = "ord") -> DataFrame:
    """Search hits as flattened records with ids from ``start_id`` in order.

    The ids come from per-range counts, not from a window over all rows: rows are dealt by
    ranges of ``ord`` and each range starts where the ones before it end.
    """
    numbered = consecutive_ids(hits, ord_col, start_id)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in hits.columns else F.lit("")
    return numbered.select(
        F.col("_id").cast("string").alias("id"),
        F.lit(company).alias("company_name"),
        F.lit("").alias("company_code"),
        F.lit("").alias("market"),
        F.lit("").alias("tonghuashun_total_code"),
        text("url").alias("url"),
        text("title").alias("title"),
        (F.coalesce(F.col("data_source_type"), F.lit("html")) if "data_source_type" in hits.columns else F.lit("html")).alias("data_source_type"),
        text("md").alias("content"),
        F.lit(query).alias("search_query"),
        F.lit("search").alias("data_source"),
    )


def consecutive_ids(df: DataFrame, ord_col: str, start: int = 0, buckets: int | None = None) -> DataFrame:
    """``_id``: ``start`` for the row of least ``ord_col``, then one more for each, without one task that sees all rows.

    Rows are sorted in ``buckets`` ranges, as many as there are shuffle partitions unless
    given, and written; a row's id is its place in its range plus the rows of those before.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numbered = materialize(
        df.repartitionByRange(buckets, ord_col)
        .sortWithinPartitions(ord_col)
        .withColumn("_bucket", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    sizes = numbered.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    return (
        numbered.join(F.broadcast(before), "_bucket")
        .withColumn("_id", F.col("_before") + F.col("_row") + start)
        .drop("_bucket", "_row", "_before")
    )


def max_id(records: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: the greatest id that is a number, 0 without one."""
    return records.agg(F.coalesce(F.max(F.expr(f"try_cast({id_col} as bigint)")), F.lit(0)).alias("max_id"))


def merge_rekeyed(existing: DataFrame, new: DataFrame, ord_col: str = "ord") -> DataFrame:
    """The union of both, new rows numbered on after the greatest existing id."""
    top = existing.agg(F.coalesce(F.max(F.expr("try_cast(id as bigint)")), F.lit(0)).alias("m"))
    numbered = consecutive_ids(new, ord_col, 1)
    rekeyed = numbered.join(F.broadcast(top)).withColumn("id", (F.col("_id") + F.col("m")).cast("string"))
    return existing.unionByName(rekeyed.select(*existing.columns))


def flatten_provider(companies: DataFrame) -> DataFrame:
    """Pages of (company, navs, news) as rows: navs before news, ``kind`` and ``pos`` give the order."""
    part = lambda name: companies.select(
        "company", F.lit(name).alias("kind"), F.posexplode(name).alias("pos", "page")
    ).select("company", "kind", "pos", "page.*")
    return part("navs").unionByName(part("news"))


def flatten_search_dump(dump: DataFrame) -> DataFrame:
    """Pages of a three-level search dump (array of arrays of results) that have content, with their places."""
    return (
        dump.select(F.posexplode("groups").alias("a", "g"))
        .select("a", F.posexplode("g").alias("b", "r"))
        .select("a", "b", F.posexplode("r.results").alias("c", "page"))
        .select("a", "b", "c", "page.*")
        .where("coalesce(md, '') <> ''")
    )


def digest(items: DataFrame) -> DataFrame:
    """What a chart planner sees of each item: at most 500 characters of its summary."""
    return items.withColumn("summary", truncated(first_filled("summary", "content"), 500))


def effective_text(*names: str) -> Column:
    """The first filled of an item's texts."""
    return first_filled(*names)


def usable_charts(charts: DataFrame) -> DataFrame:
    """Successful charts with an image and a section, old and new field names merged, paths with forward slashes."""
    return charts.where("success and has_png and coalesce(section, '') <> ''").withColumn(
        "png_path", forward_slashes(first_filled("chart_png_path", "png_path"))
    )


def outline_sections(outlines: DataFrame) -> DataFrame:
    """(report_id, section_index, title, points) from outlines whose array is under either name."""
    return outlines.select(
        "report_id", F.posexplode(F.coalesce("reportOutline", "outline")).alias("section_index", "s")
    ).select("report_id", "section_index", "s.title", "s.points")


def section_info(sections: DataFrame, data: DataFrame, charts: DataFrame) -> DataFrame:
    """Each section (from 1) with its numbers of items and charts and whether it has any."""
    d = data.groupBy("section_index").agg(F.count("*").alias("data_count"))
    c = charts.groupBy("section_index").agg(F.count("*").alias("chart_count"))
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return (
        sections.join(d, "section_index", "left")
        .join(c, "section_index", "left")
        .select((F.col("section_index") + 1).alias("number"), "title", zero("data_count"), zero("chart_count"))
        .withColumn("has_data", F.col("data_count") > 0)
        .withColumn("has_charts", F.col("chart_count") > 0)
    )


def _place(column: str, order: dict[str, int], otherwise: int) -> Column:
    out = F.lit(otherwise)
    for name, at in order.items():
        out = F.when(F.col(column) == name, at).otherwise(out)
    return out


def priority_place(column: str = "priority") -> Column:
    """1 for high, 2 for medium and anything else, 3 for low."""
    return _place(column, PRIORITY_ORDER, 2)


def section_place(column: str = "section") -> Column:
    return _place(column, SECTION_ORDER, 5)


def sorted_charts(charts: DataFrame) -> DataFrame:
    """Charts by section, priority and title; ``ord`` settles ties."""
    return charts.orderBy(section_place(), priority_place(), F.coalesce("title", F.lit("")), "ord")


def placed_charts(charts: DataFrame) -> DataFrame:
    """``charts`` with ``place``, from 1, in the order of ``sorted_charts`` among the charts of equal section and priority."""
    own = Window.partitionBy(section_place(), priority_place()).orderBy(F.coalesce("title", F.lit("")), "ord")
    return charts.withColumn("place", F.row_number().over(own).cast("long"))


def with_fields(df: DataFrame, *names: str) -> DataFrame:
    """Rows in which every named field is there and not empty (zero and false are empty too)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0", "0.0", "false")
    kept = df
    for name in names:
        kept = kept.where(~filled(name))
    return kept


def pdf_first(df: DataFrame, group: str, ord_col: str = "ord") -> DataFrame:
    """``place`` in each group: PDFs first and in reverse, the others after them in order."""
    key = F.when(F.col("is_pdf"), -F.col(ord_col)).otherwise(F.col(ord_col))
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("is_pdf"), key)).cast("long"))
