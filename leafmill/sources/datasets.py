"""Readers and writers of report datasets: outlines, records, allocations, charts and reports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "STRUCT<title: STRING, url: STRING, md: STRING, data_source_type: STRING>"
OUTLINE = "reportOutline ARRAY<STRUCT<title: STRING, points: ARRAY<STRING>>>, companyName STRING, companyCode STRING"
RECORD = (
    "id STRING, company_name STRING, company_code STRING, market STRING, tonghuashun_total_code STRING, url STRING,"
    " title STRING, data_source_type STRING, content STRING, search_query STRING, data_source STRING,"
    " section_title STRING, summary STRING, quality_assessment STRUCT<is_high_quality: BOOLEAN, reason: STRING,"
    " source: STRING, assessed_for: STRING>"
)
CHART = (
    "success BOOLEAN, error STRING, chart_title STRING, visualization_type STRING, reason STRING, priority STRING,"
    " section STRING, report_value STRING, data_ids ARRAY<STRING>, chart_png_path STRING, image_description STRING,"
    " has_png BOOLEAN, raw_data_count INT, created_at STRING, timestamp BIGINT"
)
PROVIDER = f"company STRING, navs ARRAY<{PAGE}>, news ARRAY<{PAGE}>"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, by Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents with a fixed schema; damaged ones and those without any of its fields are left out."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    some = F.lit(False)
    for c in df.columns:
        some = some | F.col(c).isNotNull()
    return df.where(some)


def first_readable(spark: SparkSession, folder: str, names: list[str], schema: str) -> DataFrame | None:
    """The first of the candidate files that exists and has a readable document."""
    for name in names:
        path = f"{folder}/{name}"
        if exists(spark, path):
            df = read_json(spark, path, schema)
            if df.take(1):
                return df
    return None


#: Each input's candidate files, and whether a report can do without it.
INPUTS = {
    "outline": (["outline.json", "report_outline.json"], OUTLINE, True),
    "records": (["flattened_data.json", "flattened.json"], RECORD, True),
    "charts": (["visualization_results.json", "charts.json"], CHART, False),
}


def load_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every input of a dataset folder; a missing required one raises."""
    found = {}
    for name, (files, schema, required) in INPUTS.items():
        df = first_readable(spark, folder, files, schema)
        if df is None and required:
            raise FileNotFoundError(f"{name}: none of {files} in {folder}")
        if df is not None:
            found[name] = df
    return found


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether every required input has a file."""
    return all(any(exists(spark, f"{folder}/{f}") for f in files) for files, _, required in INPUTS.values() if required)


def read_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it is there and has rows, else computed and written there."""
    if exists(spark, path):
        df = spark.read.parquet(path)
        if not df.isEmpty():
            return df
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def chart_folder(spark: SparkSession, folder: str, target: str, name_field: str = "target_name") -> DataFrame:
    """Charts of all asset files of a folder that are for ``target``."""
    charts = f"metadata STRUCT<{name_field}: STRING>, charts ARRAY<STRUCT<chart_title: STRING, section: STRING, priority: STRING, png_path: STRING>>"
    df = read_json(spark, folder, charts).where(F.col(f"metadata.{name_field}") == target)
    return df.select(F.explode("charts").alias("c")).select("c.*")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def cached_pages(requests: DataFrame, cache: DataFrame, fetched: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """A page for each request: from the cache by md5(url), else from what was fetched; one with neither goes.

    ``also`` are columns that tell pages of one url apart. Of several pages with the same url (and these) that
    of the least html is taken, so that repeated requests are not multiplied.
    """
    key = ["key", *also]
    one = lambda df: df.select(F.md5("url").alias("key"), *also, "html").groupBy(*key).agg(F.min("html").alias("html"))
    keyed = requests.withColumn("key", F.md5("url"))
    hit = keyed.join(one(cache), key)
    miss = keyed.join(cache.select(F.md5("url").alias("key"), *also), key, "left_anti").join(one(fetched), key)
    return hit.select("url", "html").unionByName(miss.select("url", "html"))


def searched_pages(hits: DataFrame, pages: DataFrame, keep_snippets: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """Hits with their pages; without one a hit goes, or stays with its snippet as text.

    ``also`` are columns of both that tell pages of one url apart. Of several pages with the same url (and these)
    that of the least text is taken.
    """
    one = pages.groupBy("url", *also).agg(F.min("md").alias("md"))
    kept = hits.where("coalesce(url, '') <> ''").join(one, ["url", *also], "left" if keep_snippets else "inner")
    if not keep_snippets:
        return kept
    return kept.withColumn(
        "data_source_type", F.when(F.col("md").isNull(), "search_summary").otherwise(F.col("data_source_type"))
    ).withColumn("md", F.coalesce("md", "snippet"))


def split_provider_pages(items: DataFrame, words: tuple[str, str]) -> DataFrame:
    """``kind``: 'navs' for items whose title has neither word, else 'news'; with the links in their html."""
    has = F.contains("title", F.lit(words[0])) | F.contains("title", F.lit(words[1]))
    links = F.regexp_extract_all("html", F.lit('(?i)href="([^"]+)"'), F.lit(1))
    return items.withColumn("kind", F.when(has, "news").otherwise("navs")).withColumn("links", links)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report: Markdown text where the path ends in '.md', else JSON."""
    if path.endswith(".md"):
        report.select(F.col("markdown").alias("value")).write.mode("overwrite").text(path)
    else:
        report.write.mode("overwrite").json(path)


def chart_assets(charts: DataFrame, target: str, created_at: str) -> DataFrame:
    """One JSON document of the sorted charts of a target with its counts."""
    from leafmill.operators.records import priority_place, section_place

    key = F.struct(
        section_place().alias("s"), priority_place().alias("p"), F.coalesce("title", F.lit("")).alias("t"), "ord",
        F.struct("title", "section", "priority", "png_path").alias("chart"),
    )
    good = F.when(F.col("success"), key)
    doc = charts.agg(F.array_sort(F.collect_list(good)).alias("c"), F.count_if(~F.col("success")).alias("failed"))
    return doc.select(
        F.to_json(
            F.struct(
                F.struct(
                    F.lit(created_at).alias("created_at"), F.lit(target).alias("target_name"),
                    F.size("c").alias("total_charts"), F.col("failed").alias("failed_charts"),
                ).alias("metadata"),
                F.transform("c", lambda x: x["chart"]).alias("charts"),
            )
        ).alias("value")
    )


def write_index(docs: DataFrame, path: str) -> None:
    """The inverted index of ``docs``: postings, document frequencies and lengths, each dealt by its key."""
    from leafmill.operators.retrieval import document_frequency, document_length, postings

    postings(docs).write.mode("overwrite").parquet(f"{path}/postings")
    written = docs.sparkSession.read.parquet(f"{path}/postings")
    document_frequency(written).write.mode("overwrite").parquet(f"{path}/df")
    document_length(docs).write.mode("overwrite").parquet(f"{path}/doc_len")
