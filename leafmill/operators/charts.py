"""Chart suggestions made into charts: typed rows, with an error code where one could not be made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.models import model_call
from leafmill.storage import materialize

#: Error codes, and what stands for fields that a suggestion lacks.
NO_IDS, NO_DATA, FAILED, EXCEPTION = "no_data_ids", "no_raw_data_found", "chart_generation_failed", "generation_exception: "
DEFAULTS = {
    "chart_title": "Unknown",
    "visualization_type": "unknown",
    "reason": "",
    "priority": "medium",
    "section": "未分类",
    "report_value": "数据展示",
}
DATA_TITLE = "{} 数据"


def processed(
    suggestions: DataFrame,
    records: DataFrame,
    generate: Callable[[str], str],
    describe: Callable[[str], str],
    description: Column | None = None,
    suggestion: str = "suggestion_id",
) -> DataFrame:
    """One row for each suggestion: ``success``, ``error``, its fields, ``chart_html``, ``image_description`` and ``references``.

    ``suggestions`` has an id, ``data_ids`` and any of ``DEFAULTS``; ``records`` has ``id``, ``title``, ``url``,
    ``target`` and ``content``, of rows with one id any is taken. Records are looked up by a join, in the order of the ids, repeated
    ids once. ``generate`` gets a JSON object of the fields and the records; an empty answer and an exception are
    errors. ``describe`` gets the chart; where it fails or says nothing there is ``description``.
    """
    fields = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in suggestions.columns else F.lit(v).alias(c) for c, v in DEFAULTS.items()]
    ids = F.array_distinct(F.filter(F.coalesce("data_ids", F.array().cast(suggestions.schema["data_ids"].dataType)), lambda x: x.isNotNull()))
    asked = materialize(suggestions.select(suggestion, ids.alias("data_ids"), *fields), "suggestions")
    one = records.groupBy("id").agg(F.first(F.struct("title", "url", "target", "content")).alias("r"))
    found = asked.select(suggestion, F.posexplode("data_ids").alias("pos", "id")).join(materialize(one, "records"), "id")
    kept = found.groupBy(suggestion).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "r"))).alias("found"))

    def reference(x: Column, i: Column) -> Column:
        own = F.when(F.coalesce(x["r"]["title"], F.lit("")) != "", x["r"]["title"])
        other = F.concat(F.coalesce(x["r"]["target"], F.lit("")), F.lit(DATA_TITLE.format("")))
        return F.struct(
            (i + 1).cast("int").alias("ref_num"), x["id"].alias("data_id"), F.coalesce(own, other).alias("title"), F.coalesce(x["r"]["url"], F.lit("")).alias("url")
        )

    rows = asked.join(kept, suggestion, "left")
    rows = rows.withColumn("references", F.transform("found", reference)).withColumn("raw_data_count", F.coalesce(F.size("found"), F.lit(0)))
    contents = F.transform("found", lambda x: F.struct(x["id"].alias("id"), x["r"]["content"].alias("content")))
    told = F.when(F.col("found").isNotNull(), F.to_json(F.struct(*DEFAULTS, contents.alias("data"))))
    rows = model_call(rows.withColumn("told", told).drop("found"), F.col("told"), generate, "chart_html").drop("told")
    html = F.when(F.col("chart_html") != "", F.col("chart_html"))
    error = (
        F.when(F.size("data_ids") == 0, NO_IDS)
        .when(F.col("references").isNull(), NO_DATA)
        .when(F.col("chart_html_error").isNotNull(), F.concat(F.lit(EXCEPTION), F.regexp_replace("chart_html_error", "^[A-Za-z_.]+: ", "")))
        .when(html.isNull(), FAILED)
    )
    rows = rows.withColumn("error", error).withColumn("chart_html", F.when(error.isNull(), html)).drop("chart_html_error")
    rows = model_call(rows, F.col("chart_html"), describe, "image_description").drop("image_description_error")
    fallback = description if description is not None else F.concat_ws(" ", "visualization_type", "chart_title")
    ok = F.col("error").isNull()
    return rows.select(
        suggestion,
        ok.alias("success"),
        "error",
        *DEFAULTS,
        "data_ids",
        "chart_html",
        F.when(ok, F.coalesce(F.nullif("image_description", F.lit("")), fallback)).alias("image_description"),
        F.when(ok, F.col("raw_data_count")).otherwise(0).alias("raw_data_count"),
        F.when(ok, F.col("references")).alias("references"),
    )
