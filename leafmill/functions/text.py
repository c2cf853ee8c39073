"""Text, URL and citation functions as Spark columns; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blocked hosts, generic paths, page errors and refused extensions.
BLOCKED_DOMAINS = ("zhihu.com", "zhuanlan.zhihu.com", "chinabgao.com")
GENERIC_PATHS = ("/", "/about", "/about/", "/contact", "/contact/", "/events", "/events/", "/research")
PAGE_ERRORS = (
    "This site can’t be reached",
    "took too long to respond",
    "ERR_CONNECTION_TIMED_OUT",
    "404 Not Found",
)
REFUSED_EXTENSIONS = tuple(
    ".xls .xlsx .csv .ppt .pptx .jpg .jpeg .png .gif .bmp .webp .svg .asp .txt .doc .rtf .odt .log .json .xml .js .css"
    " .zip .rar .7z .tar .gz .exe .apk .bin .dll .iso .mp3 .mp4 .avi .mov .wmv .flv .mkv .wav .wps".split()
)
#: Limits of the quality rules, in characters and words.
MAX_CHARS, MIN_WORDS, MIN_STRIPPED, MODEL_BELOW = 250_000, 100, 50, 500
HAN_FROM, HAN_RATIO, HAN_COUNT = 50, 0.6, 150
#: Chinese numerals of section titles, and the standard sections of each kind of report.
NUMERALS = "一二三四五六七八九十"
SECTIONS = {
    "company": (
        "一、投资摘要与核心观点",
        "二、竞争格局与对比分析",
        "三、基本面分析",
        "四、财务状况分析",
        "五、估值分析与投资建议",
    ),
    "industry": (
        "一、行业概况与发展现状",
        "二、市场规模与增长趋势",
        "三、竞争格局与关键厂商",
        "四、技术趋势与创新动向",
        "五、投资机会与风险分析",
    ),
    "macro": (
        "一、宏观经济环境概述",
        "二、主要经济指标分析",
        "三、货币政策与财政政策",
        "四、市场表现与资金流向",
        "五、前景展望与投资策略",
    ),
}


def first_filled(*values: Column | str) -> Column:
    """The first value that is neither null nor empty, else ''."""
    cols = [F.col(v) if isinstance(v, str) else v for v in values]
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(""))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_links(text: Column) -> Column:
    """Text without images, links (their text stays), bare URLs and runs of white space; null gives ''."""
    steps = (
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"(?i)<img[^>]+>", ""),
        (r"(?is)<a[^>]*>(.*?)</a>", "$1"),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]*)\]\(\s*data:[^)]*\)", "$1"),
        (r'(?iU)\b(?:https?://|www\.)[^\s<>"]+', ""),
        (r"<\s*>", ""),
        (r"(?U)\s{2,}", " "),
    )
    out = F.coalesce(text, F.lit(""))
    for pattern, by in steps:
        out = F.regexp_replace(out, pattern, by)
    return strip(F.replace(out, F.lit("/* "), F.lit("")))


def netloc(url: Column) -> Column:
    """Lower-cased authority (user and port included); '' where there is none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))


def is_blacklisted(url: Column, domains: tuple[str, ...] = BLOCKED_DOMAINS) -> Column:
    """Whether the authority contains a blocked domain."""
    host = netloc(url)
    hit = F.lit(False)
    for d in domains:
        hit = hit | F.contains(host, F.lit(d))
    return hit


def extension(url: Column) -> Column:
    """Extension of the whole URL's last path part, letters, digits and dots only, at most 10 characters; '.html' if none."""
    name = F.element_at(F.split(F.coalesce(url, F.lit("")), "/"), -1)
    bare = F.regexp_replace(name, r"^\.+", "")
    has = F.contains(bare, F.lit("."))
    raw = F.when(has, F.concat(F.lit("."), F.element_at(F.split(name, r"\."), -1))).otherwise("")
    cut = F.substring(F.regexp_replace(raw, "[^0-9a-zA-Z.]+", ""), 1, 10)
    return F.when(cut == "", ".html").otherwise(cut)


def extension_refused(url: Column) -> Column:
    return F.lower(extension(url)).isin(*REFUSED_EXTENSIONS)


def word_count(text: Column) -> Column:
    """Unicode words."""
    return F.regexp_count(text, F.lit(r"(?U)\b\w+\b"))


def han_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[一-鿿]"))


def rule_verdict(text: Column, url: Column) -> Column:
    """Struct (is_high_quality, reason) of the rule cascade; the first rule that applies decides.

    Reasons: too_long, page_error, han, too_short, generic_url, passed.
    """
    t = F.coalesce(text, F.lit(""))
    errors = F.lit(False)
    for e in PAGE_ERRORS:
        errors = errors | F.contains(t, F.lit(e))
    han, n = han_count(t), F.length(t)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    reason = (
        F.when(n > MAX_CHARS, "too_long")
        .when(errors, "page_error")
        .when((n > HAN_FROM) & ((han / F.greatest(n, F.lit(1)) > HAN_RATIO) | (han > HAN_COUNT)), "han")
        .when(word_count(t) < MIN_WORDS, "too_short")
        .when(path.isin(*GENERIC_PATHS), "generic_url")
        .otherwise("passed")
    )
    return F.struct(reason.isin("han", "passed").alias("is_high_quality"), reason.alias("reason"))


def route(text: Column, url: Column) -> Column:
    """Where hybrid assessment decides: 'blank' (low), 'model' (short), 'rule' (passed), 'model_head' (rules failed)."""
    blank = strip(F.coalesce(text, F.lit(""))) == ""
    return (
        F.when(blank, "blank")
        .when(F.length(text) < MODEL_BELOW, "model")
        .when(rule_verdict(text, url)["is_high_quality"], "rule")
        .otherwise("model_head")
    )


def truncated(text: Column, n: int) -> Column:
    """At most ``n`` characters, then '...' if any were cut."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def normalize_section(section: Column, kind: str = "company") -> Column:
    """The standard section whose numeral the trimmed name starts with, else the trimmed name."""
    name = strip(section)
    out = None
    for standard in SECTIONS[kind]:
        test = F.startswith(name, F.lit(standard[0]))
        out = F.when(test, standard) if out is None else out.when(test, standard)
    return out.otherwise(name)


def numeral_value(text: Column) -> Column:
    """1 to 10 for one Chinese numeral, else 0."""
    return F.when(F.length(text) == 1, F.instr(F.lit(NUMERALS), text)).otherwise(0)


def is_numbered(title: Column, any_numeral: bool = True) -> Column:
    """Whether a title has a number: any numeral character, or only '一、' to '十、' and leading '1.'."""
    return F.rlike(title, F.lit(f"[{NUMERALS}]" if any_numeral else f"[{NUMERALS}]、|^\\d+\\."))


def safe_filename(title: Column) -> Column:
    kept = F.regexp_replace(title, r"[^\p{L}\p{N} _-]", "")
    return F.left(F.replace(F.rtrim(kept), F.lit(" "), F.lit("_")), F.lit(50))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


#: The ways a text refers to a data item.
REFERENCE_PATTERNS = (r"【数据(\d+)】", r"\[数据(\d+)\]", r"\(数据(\d+)\)", r"数据ID[:：]\s*(\d+)", r"引用数据(\d+)")


def referenced_ids(text: Column) -> Column:
    """Distinct ids that a text refers to, sorted as strings."""
    t = F.coalesce(text, F.lit(""))
    return F.array_sort(
        F.array_distinct(F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in REFERENCE_PATTERNS)))
    )


def replace_in_turn(text: Column, refs: Column) -> Column:
    """Replace '[from]' by '[to]' for each struct (from, to) of ``refs`` in turn; a result can be replaced again."""
    wrap = lambda x: F.concat(F.lit("["), x.cast("string"), F.lit("]"))
    return F.aggregate(refs, text, lambda acc, r: F.replace(acc, wrap(r["from"]), wrap(r["to"])))


def replace_data_marks(text: Column, numbers: Column) -> Column:
    """Replace every 【数据N】 by [n] in one pass, with ``numbers`` a map of ids to numbers; unknown ids stay N."""
    ids = F.regexp_extract_all(text, F.lit(r"【数据(\d+)】"), F.lit(1))
    gaps = F.split(text, r"【数据\d+】")
    number = lambda i: F.coalesce(F.try_element_at(numbers, F.get(ids, i)).cast("string"), F.get(ids, i))
    pieces = F.transform(
        gaps,
        lambda g, i: F.concat(g, F.when(i < F.size(ids), F.concat(F.lit("["), number(i), F.lit("]"))).otherwise("")),
    )
    return F.array_join(pieces, "")


def first_html_block(text: Column) -> Column:
    """The first HTML in a text: fenced, from a doctype, from <html>, else the whole trimmed text."""
    found = (
        r"(?is)```html\s*(.*?)```",
        r"(?is)(<!doctype html.*?</html>)",
        r"(?is)(<html.*?</html>)",
    )
    return F.coalesce(*(F.nullif(strip(F.regexp_extract(text, p, 1)), F.lit("")) for p in found), strip(text))


def key_facts(text: Column) -> Column:
    """Struct: up to five distinct years in order, and up to five of the first ten numbers."""
    t = F.coalesce(text, F.lit(""))
    years = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(r"20\d{2}"), F.lit(0)))), 1, 5)
    hits = F.slice(
        F.regexp_extract_all(t, F.lit(r"[\d,]+\.?\d*(?:万|亿|千万|billion|million)?"), F.lit(0)), 1, 10
    )
    numbers = F.slice(F.filter(hits, lambda x: F.rlike(x, F.lit(r"\d"))), 1, 5)
    return F.struct(F.array_join(years, ", ").alias("years"), F.array_join(numbers, ", ").alias("numbers"))


def cache_key(*parts: Column) -> Column:
    """MD5 over the parts joined by '|'."""
    return F.md5(F.concat_ws("|", *parts))


def table_spacing(md: Column) -> Column:
    """A blank line before the first row of every Markdown table that lacks one."""
    lines = F.split(F.coalesce(md, F.lit("")), "\n")
    row = lambda s: F.startswith(F.ltrim(F.coalesce(s, F.lit(""))), F.lit("|"))
    return F.array_join(
        F.transform(
            lines,
            lambda s, i: F.when(
                row(s) & (i > 0) & ~row(F.get(lines, i - 1)) & (F.trim(F.get(lines, i - 1)) != ""),
                F.concat(F.lit("\n"), s),
            ).otherwise(s),
        ),
        "\n",
    )


def hidden_paths(paths: Column) -> Column:
    """A map of chart names to paths as a hidden comment block."""
    rows = F.transform(
        F.map_entries(paths), lambda e: F.concat(e["key"], F.lit(": "), e["value"])
    )
    return F.concat(F.lit("<!-- chart_paths\n"), F.array_join(rows, "\n"), F.lit("\n-->"))


def parse_hidden_paths(text: Column) -> Column:
    """The map in the hidden comment block; each line splits at its first colon, later names win."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)<!-- chart_paths\n(.*?)\n-->", 1)
    lines = F.filter(F.split(body, "\n"), lambda s: F.contains(s, F.lit(":")))
    pairs = F.transform(
        lines,
        lambda s: F.struct(
            F.trim(F.split(s, ":", 2)[0]).alias("key"), F.trim(F.split(s, ":", 2)[1]).alias("value")
        ),
    )
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]),
    )
    return F.map_from_entries(last)


def input_kind(text: Column) -> Column:
    """'html' or 'path', by what a string looks like."""
    t = F.lower(strip(F.coalesce(text, F.lit(""))))
    return (
        F.when(F.startswith(t, F.lit("<!doctype")) | F.startswith(t, F.lit("<html")), "html")
        .when(F.rlike(t, F.lit(r"\.html?$")) & ~F.contains(t, F.lit("<")), "path")
        .when(F.contains(t, F.lit("<")), "html")
        .otherwise("path")
    )


#: A retrieval token of a lower-cased text: a run of a-z, or one Han character (no word list is at hand).
TOKEN = "[a-z]+|[一-鿿]"


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z, and every Han character on its own."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Substitute token count: Han characters plus Unicode words."""
    t = F.coalesce(text, F.lit(""))
    return (han_count(t) + F.regexp_count(F.regexp_replace(t, "[一-鿿]", " "), F.lit(r"(?U)\w+"))).cast("long")
