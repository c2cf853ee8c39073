"""Joins between data items, report sections and charts, and the statistics of allocation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from leafmill.functions.text import NUMERALS, numeral_value, strip
from leafmill.operators.dedup import first_wins
from leafmill.storage import broadcast_blocks, is_small, materialize

#: Least score of a keyword match, and the borders of the confidence classes.
MIN_OVERLAP, HIGH, MEDIUM = 0.2, 0.8, 0.5


def lookup_by_ids(requests: DataFrame, records: DataFrame, request: str = "request_id", ids: str = "ids", key: str = "id", ord_col: str = "ord") -> DataFrame:
    """Records for each id of an array, in the array's order; repeats stay, unknown ids go, the last record of an id wins."""
    value = [c for c in records.columns if c != key]
    last = materialize(records.groupBy(key).agg(F.max_by(F.struct(*value), ord_col).alias("r")), "last")
    return (
        requests.select(request, F.posexplode(ids).alias("pos", key)).join(last, key).select(request, "pos", key, "r.*")
    )


def semi_allocated(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Records whose id is asked for; repeated records stay, repeated ids count once."""
    return records.join(ids.select(key), key, "left_semi")


def title_join(sections: DataFrame, allocations: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Sections with the ids allocated under their title; the last allocation of a title wins, none gives an empty array."""
    last = allocations.groupBy("title").agg(F.max_by("ids", ord_col).alias("ids"))
    return sections.join(last, "title", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))


def positional_join(sections: DataFrame, allocations: DataFrame) -> DataFrame:
    """Sections with the ids at the same index."""
    return sections.join(allocations.select("section_index", "ids"), "section_index", "left").withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<bigint>"))
    )


def _against(df: DataFrame, outline: DataFrame) -> DataFrame:
    """Every row with every row of an outline, which is sent to all tasks, in parts where it is large."""
    return reduce(DataFrame.unionByName, [df.crossJoin(part) for part in broadcast_blocks(outline)])


def _keywords(title: Column) -> Column:
    """Maximal runs of Han characters, the enumeration comma deleted."""
    return F.array_distinct(F.regexp_extract_all(F.replace(title, F.lit("、"), F.lit("")), F.lit("[一-鿿]+"), F.lit(0)))


def _leading_number(title: Column) -> Column:
    """1 to 10 for titles that start with one numeral and '、', else 0."""
    return numeral_value(F.regexp_extract(title, f"^([{NUMERALS}]+)、", 1))


def match_sections(charts: DataFrame, sections: DataFrame, chart: str = "chart_id") -> DataFrame:
    """The section of each chart by ranked rules: (chart, section, matched_title, rule), null and 0 where none applies.

    Rules: 1 a lone numeral; 2 a number from 1 to 10; 3 equal leading numbers; 4 the best
    share of common keywords above ``MIN_OVERLAP``. The first rule wins, then the higher
    share, then the earlier section. Sections are few: an outline, read once.
    """
    name = strip(F.col("section"))
    alone = numeral_value(name)
    number = F.when(F.rlike(name, F.lit(r"^\d+$")), F.expr("try_cast(trim(section) as int)")).otherwise(0)
    number = F.when(F.coalesce(number, F.lit(0)).between(1, 10), number).otherwise(0)
    own = charts.select(
        chart,
        "section",
        alone.alias("alone"),
        number.alias("number"),
        _leading_number(name).alias("leading"),
        _keywords(name).alias("words"),
    )
    titles = sections.select(
        "section_index",
        F.col("title").alias("matched_title"),
        _leading_number(F.col("title")).alias("t_leading"),
        F.substring("title", 1, 2).alias("t_head"),
        _keywords(F.col("title")).alias("t_words"),
    )
    common = F.size(F.array_intersect("words", "t_words"))
    share = F.coalesce(F.try_divide(common, F.greatest(F.size("words"), F.size("t_words"))), F.lit(0.0))
    head = lambda n: F.concat(F.substring(F.lit(NUMERALS), n, F.lit(1)), F.lit("、"))
    rule = (
        F.when((F.col("alone") > 0) & (F.col("t_head") == head(F.col("alone"))), 1)
        .when((F.col("number") > 0) & (F.col("t_head") == head(F.col("number"))), 2)
        .when((F.col("leading") > 0) & (F.col("leading") == F.col("t_leading")), 3)
        .when(share > MIN_OVERLAP, 4)
    )
    scored = (
        _against(own, titles)
        .withColumn("rule", rule)
        .withColumn("share", F.when(F.col("rule") == 4, share).otherwise(0.0))
        .where("rule is not null")
    )
    best = scored.groupBy(chart).agg(
        F.min_by(F.struct("matched_title", "rule"), F.struct("rule", (-F.col("share")).alias("s"), "section_index")).alias("b")
    )
    return charts.select(chart, "section").join(best, chart, "left").select(
        chart, "section", "b.matched_title", F.coalesce("b.rule", F.lit(0)).alias("rule")
    )


def match_sections_loosely(titles: DataFrame, keys: DataFrame) -> DataFrame:
    """(title, key) where the title contains the key, or any of the numerals one to six with '、'."""
    hit = F.contains("title", F.col("key")) | F.rlike("title", F.lit(f"[{NUMERALS[:6]}]、"))
    return _against(titles, keys).where(hit)


def overlap_score(words: Column, of: Column) -> Column:
    """Share of the distinct ``of`` that ``words`` has too."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, of)), F.size(F.array_distinct(of))), F.lit(0.0))


def allocate(items: DataFrame, sections: DataFrame, score: Column, item: str = "data_id") -> DataFrame:
    """(item, section_index, confidence): the section of the best score, the earlier on ties; -1 where every score is 0.

    ``items`` and ``sections`` have what ``score`` reads. Sections are an outline: few, and
    sent to every task; the arg-max is taken before the shuffle.
    """
    scored = _against(items, sections).select(item, "section_index", score.alias("s"))
    best = scored.groupBy(item).agg(F.max(F.struct("s", (-F.col("section_index")).alias("i"))).alias("b"))
    return best.select(
        item,
        F.when(F.col("b.s") > 0, -F.col("b.i")).otherwise(-1).cast("int").alias("section_index"),
        F.col("b.s").alias("confidence"),
    )


#: Cells of counts, items by sections, and hits that a task holds at once.
COUNT_CELLS = 1 << 20
#: Items whose words are looked up at once.
SLICE = 1024


class Outline:
    """The words of a few sections, from each word to the sections that have it."""

    def __init__(self, sections: list[int], sizes: list[int], words: list[str], of: list[int]):
        """``words[k]`` is a word of the section numbered ``of[k]``; sections ascend."""
        order = np.argsort(np.array(words, object), kind="stable")
        known, first = np.unique(np.array(words, object)[order], return_index=True)
        self.sections, self.sizes = np.array(sections, np.int64), np.array(sizes, np.int64)
        self.words = pa.array(known.tolist(), pa.string())
        self.first = np.append(first, len(words))
        self.of = np.array(of, np.int64)[order]

    def best(self, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """(section, or -1; share of its words) for each list of words, in slabs of about ``COUNT_CELLS`` counts and hits."""
        n, width = len(lists), len(self.sections)
        section, share = np.full(n, -1, np.int64), np.zeros(n)
        if not width or not n:
            return section, share
        number = pc.fill_null(pc.index_in(lists.flatten(), self.words), -1).to_numpy(zero_copy_only=False)
        cut = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
        # A word that many sections have is a hit in each of them.
        hits = np.append(0, np.cumsum(np.where(number >= 0, self.first[number + 1] - self.first[number], 0)))
        a = 0
        while a < n:
            most = int(np.searchsorted(hits[cut], hits[cut[a]] + COUNT_CELLS, "right")) - 1
            b = min(n, a + max(1, COUNT_CELLS // width), max(a + 1, most))
            section[a:b], share[a:b] = self._best_of(number[cut[a] : cut[b]], np.diff(cut[a : b + 1]))
            a = b
        return section, share

    def _best_of(self, number: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        width = len(self.sections)
        row = np.repeat(np.arange(len(lengths)), lengths)
        pair = np.unique((row * np.int64(len(self.words)) + number)[number >= 0])  # a repeated word counts once
        row, number = np.divmod(pair, len(self.words))
        hits = self.first[number + 1] - self.first[number]
        at = np.repeat(self.first[number] - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())
        cell = np.repeat(row, hits) * width + self.of[at]
        shares = np.bincount(cell, minlength=len(lengths) * width).reshape(len(lengths), width) / self.sizes
        found = shares.argmax(axis=1)
        best = shares[np.arange(len(lengths)), found]
        return np.where(best > 0, self.sections[found], -1), best


def allocate_by_overlap(items: DataFrame, sections: DataFrame, item: str = "data_id") -> DataFrame:
    """``allocate`` with the share of a section's distinct words (``of``) that the item's ``words`` have.

    ``item`` tells rows apart. An outline whose size is counted first goes to every task, where
    an item's sections are counted in one row of a dense array and the best one is taken: nothing
    is shuffled. A larger outline is joined by words.
    """
    wanted = materialize(
        sections.select("section_index", F.size(F.array_distinct("of")).alias("size"), F.explode(F.array_distinct("of")).alias("word")),
        "outline",
    )
    if not is_small(wanted):
        words = items.select(item, F.explode(F.array_distinct("words")).alias("word"))
        return _allocated_by_words(items, words, wanted, item)
    told = wanted.toArrow().sort_by("section_index")
    index, place = np.unique(told["section_index"].to_numpy(), return_inverse=True)
    size = np.zeros(len(index), np.int64)
    size[place] = told["size"].to_numpy()
    outline = Outline(index.tolist(), size.tolist(), told["word"].to_pylist(), place.tolist())
    shared = items.sparkSession.sparkContext.broadcast(outline)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(a, SLICE) for a in range(0, len(batch), SLICE)):
                section, share = shared.value.best(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(section, pa.int32()), pa.array(share)], [item, "section_index", "confidence"]
                )

    schema = StructType([items.schema[item], StructField("section_index", IntegerType()), StructField("confidence", DoubleType())])
    return items.select(item, "words").mapInArrow(run, schema)


def _allocated_by_words(items: DataFrame, words: DataFrame, wanted: DataFrame, item: str) -> DataFrame:
    shared = words.join(wanted, "word").groupBy(item, "section_index", "size").agg(F.count("*").alias("n"))
    best = shared.groupBy(item).agg(
        F.max(F.struct((F.col("n") / F.col("size")).alias("s"), (-F.col("section_index")).alias("i"))).alias("b")
    )
    return items.select(item).join(best, item, "left").select(
        item,
        F.coalesce(-F.col("b.i"), F.lit(-1)).cast("int").alias("section_index"),
        F.coalesce("b.s", F.lit(0.0)).alias("confidence"),
    )


def distribute(matches: DataFrame, sections: DataFrame, n_sections: int, item: str = "data_id") -> DataFrame:
    """Each section's items in order, and the bucket ``n_sections`` for indexes out of range; errors go."""
    index = F.when(F.col("section_index").between(0, n_sections - 1), F.col("section_index")).otherwise(n_sections)
    ok = matches.where("not coalesce(error, false)") if "error" in matches.columns else matches
    grouped = ok.select(index.cast("int").alias("section_index"), item).groupBy("section_index").agg(
        F.array_sort(F.collect_list(item)).alias("ids")
    )
    return sections.join(grouped, "section_index", "left").withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<bigint>"))
    )


def match_stats(matches: DataFrame) -> DataFrame:
    """One row of counts: matched means an index of at least 0, even one out of range; the mean is over matched rows."""
    ok = ~F.coalesce(F.col("error"), F.lit(False)) if "error" in matches.columns else F.lit(True)
    hit = ok & (F.col("section_index") >= 0)
    c = F.col("confidence")
    return matches.agg(
        F.count("*").alias("total_items"),
        F.count_if(hit).alias("matched_count"),
        F.count_if(ok & ~hit).alias("unmatched_count"),
        F.count_if(~ok).alias("failed_count"),
        F.round(F.coalesce(F.try_divide(F.count_if(hit) * 100.0, F.count("*")), F.lit(0.0)), 6).alias("match_rate"),
        F.round(F.coalesce(F.avg(F.when(hit, c)), F.lit(0.0)), 6).alias("avg_confidence"),
        F.count_if(hit & (c >= HIGH)).alias("high"),
        F.count_if(hit & (c >= MEDIUM) & (c < HIGH)).alias("medium"),
        F.count_if(hit & (c < MEDIUM)).alias("low"),
    )


def coverage(allocated: DataFrame) -> DataFrame:
    """One row: sections, those with and without ids, and the rate in per cent."""
    full = F.size("ids") > 0
    return allocated.agg(
        F.count("*").alias("sections"),
        F.count_if(full).alias("filled"),
        F.count_if(~full).alias("empty"),
        F.round(F.coalesce(F.try_divide(F.count_if(full) * 100.0, F.count("*")), F.lit(0.0)), 6).alias("rate"),
    )


def back_join(raw: DataFrame, assessed: DataFrame, key: str = "url", ord_col: str = "ord", fall_back: bool = True) -> DataFrame:
    """Raw rows whose key has a good assessment, with the first such assessment; rows share it by key.

    Where no assessment at all is good, every raw row stays with a null reason, unless ``fall_back`` is false.
    """
    good = materialize(
        assessed.where("is_high_quality").groupBy(key).agg(F.min_by("reason", ord_col).alias("reason")), "good"
    )
    if fall_back and good.isEmpty():
        return raw.withColumn("reason", F.lit(None).cast("string"))
    return raw.join(good, key)


def unseen(hits: DataFrame, seen: DataFrame, key: str = "url", ord_col: str = "ord") -> DataFrame:
    """Hits whose key was not seen before, neither in ``seen`` nor earlier in ``hits``."""
    return first_wins(hits.join(seen.select(key), key, "left_anti").where(F.col(key).isNotNull()), F.col(key), ord_col)


def first_successful_try(tries: DataFrame, group: str = "section_id", ord_col: str = "try_no") -> DataFrame:
    """Of each group's tries the first that matched."""
    first = tries.where("matched").groupBy(group).agg(F.min(ord_col).alias(ord_col))
    return tries.join(first, [group, ord_col], "left_semi")


def with_chart_rank(charts: DataFrame, group: str = "section") -> DataFrame:
    """``chart_no`` from 1 in each section."""
    return charts.withColumn("chart_no", F.row_number().over(Window.partitionBy(group).orderBy("ord")))


def lookup_or_empty(requests: DataFrame, records: DataFrame, key: str = "id") -> DataFrame:
    """Each request with its record as a struct; an unknown id has a null one."""
    value = [c for c in records.columns if c != key]
    return requests.join(records.select(key, F.struct(*value).alias("record")), key, "left")


def with_section_charts(sections: DataFrame, charts: DataFrame) -> DataFrame:
    """Sections whose allocated ``charts`` are followed by those listed under their title."""
    listed = charts.groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chart"))), lambda x: x["chart"]).alias("more"))
    none = F.array().cast("array<string>")
    return (
        sections.join(listed, "title", "left")
        .withColumn("charts", F.concat(F.coalesce("charts", none), F.coalesce("more", none)))
        .drop("more")
    )


def chunks_of_referenced(chunks: DataFrame, referenced: DataFrame) -> DataFrame:
    """Every chunk of the documents that a reference names."""
    return chunks.join(referenced.select("doc_id"), "doc_id", "left_semi")


def known_only(points: DataFrame, known: DataFrame, ids: str = "ids", key: str = "id", pos: str = "point_id") -> DataFrame:
    """(point, ids): each point's known ids in order, repeats kept; a point without any keeps an empty array."""
    good = (
        points.select(pos, F.posexplode(ids).alias("p", key))
        .join(known.select(key).distinct(), key)
        .groupBy(pos)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("p", key))), lambda x: x[key]).alias("kept"))
    )
    return points.select(pos).join(good, pos, "left").select(
        pos, F.coalesce("kept", F.array().cast("array<bigint>")).alias(ids)
    )
