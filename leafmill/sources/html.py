"""HTML and DOCX to Markdown, with the standard library only, as Arrow functions."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions.chunks import few_at_once

_BLOCKS = frozenset("address article aside blockquote body div dl dd dt figure footer form header html main nav ol p section ul".split())
_HIDDEN = frozenset("script style head template noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_WRAP = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`"}


class _Table:
    def __init__(self):
        self.rows: list[list[str]] = []
        self.markup: list[str] = []
        self.spans = False

    def markdown(self) -> str:
        if self.spans:
            return "<table>" + "".join(self.markup) + "</table>"
        width = max((len(r) for r in self.rows), default=0)
        if not width:
            return ""
        rows = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in self.rows]
        return "\n".join([rows[0], "| " + " | ".join(["---"] * width) + " |", *rows[1:]])


class _Markdown(HTMLParser):
    def __init__(self, base: str | None, skip_images: bool):
        super().__init__(convert_charrefs=True)
        self.base, self.skip_images = base, skip_images
        self.out: list[list[str]] = [[]]
        self.hidden = 0
        self.links: list[tuple[str, str | None]] = []
        self.lists: list[list] = []
        self.tables: list[_Table] = []

    def put(self, text: str) -> None:
        self.out[-1].append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        self.hidden += tag in _HIDDEN
        if self.hidden:
            return
        if self.tables and tag in ("tr", "td", "th"):
            table = self.tables[-1]
            spans = "".join(f' {k}="{escape(v or "")}"' for k, v in attrs if k in ("colspan", "rowspan"))
            table.spans |= bool(spans)
            table.markup.append(f"<{tag}{spans}>")
            if tag == "tr":
                table.rows.append([])
            else:
                self.out.append([])
        elif tag == "table":
            self.tables.append(_Table())
        elif re.fullmatch("h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.put("\n\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            mark = "* "
            if self.lists:
                self.lists[-1][1] += 1
                mark = f"{self.lists[-1][1]}. " if self.lists[-1][0] == "ol" else mark
            self.put("\n" + "  " * max(0, len(self.lists) - 1) + mark)
        elif tag == "br":
            self.put("  \n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "a":
            self.links.append((a.get("href") or "", a.get("title")))
            self.out.append([])
        elif tag == "img":
            alt, src, title = a.get("alt") or "", a.get("src") or "", a.get("title")
            if src and not self.skip_images:
                src = urljoin(self.base, src) if self.base else src
                more = ' "' + title.replace('"', '\\"') + '"' if title else ""
                self.put(f"![{alt}]({src}{more})")
            else:
                self.put(alt)
        elif tag in _WRAP:
            self.put(_WRAP[tag])
        elif tag in _BLOCKS:
            self.put("\n\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if self.hidden:
            return
        if self.tables and tag in ("tr", "td", "th"):
            table = self.tables[-1]
            if tag != "tr" and len(self.out) > 1:
                text = " ".join("".join(self.out.pop()).split())
                table.markup.append(escape(text))
                if table.rows:
                    table.rows[-1].append(text.replace("|", "\\|"))
            table.markup.append(f"</{tag}>")
        elif tag == "table" and self.tables:
            self.put("\n\n" + self.tables.pop().markdown() + "\n\n")
        elif tag == "a" and self.links:
            href, title = self.links.pop()
            text = "".join(self.out.pop()) if len(self.out) > 1 else ""
            inner = text.strip()
            if inner and href:
                href = urljoin(self.base, href) if self.base else href
                more = ' "' + title.replace('"', '\\"') + '"' if title else ""
                lead, tail = (" " if text[:1].isspace() else ""), (" " if text[-1:].isspace() else "")
                self.put(f"<{href}>" if inner == href and not title else f"{lead}[{inner}]({href}{more}){tail}")
            else:
                self.put(text)
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.put("\n\n" if not self.lists else "")
        elif tag in _WRAP:
            self.put(_WRAP[tag])
        elif tag in _BLOCKS or re.fullmatch("h[1-6]", tag):
            self.put("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.put(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None, base: str | None = None, skip_images: bool = False) -> str:
    """Markdown of a page. Tables with merged cells stay HTML with only their spans; others become pipes."""
    parser = _Markdown(base, skip_images)
    parser.feed(html or "")
    parser.close()
    while len(parser.out) > 1:  # what was never closed
        tail = "".join(parser.out.pop())
        parser.put(tail)
    text = "".join(parser.out[0])
    text = re.sub(r"[ \t]+\n(?!\n)", lambda m: "  \n" if m[0].startswith("  ") else "\n", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def table_rows(html: str | None) -> list[dict[str, str]]:
    """Rows of the first table with a header, as maps from header to cell."""
    parser = _Markdown(None, True)
    tables: list[_Table] = []
    parser.tables = _Kept(tables)
    parser.feed(html or "")
    parser.close()
    for t in tables:
        if len(t.rows) > 1:
            return [dict(zip(t.rows[0], r, strict=False)) for r in t.rows[1:]]
    return []


class _Kept(list):
    """A stack of tables that remembers every table."""

    def __init__(self, seen: list):
        super().__init__()
        self.seen = seen

    def append(self, table) -> None:
        self.seen.append(table)
        super().append(table)


def docx_text(data: bytes | None) -> str:
    """Non-blank paragraphs of a DOCX file, a blank line between them; '' for anything else."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    lines = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
    return "\n\n".join(x for x in lines if x.strip())


def markdown_of(html: Column, url: Column | None = None, skip_images: bool = False) -> Column:
    """``html_to_markdown`` over columns."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages, urls in batches:
            for part in few_at_once(pages, urls):
                yield pd.Series([html_to_markdown(h, u, skip_images) for h, u in zip(*part, strict=True)])

    return run(html, url if url is not None else F.lit(None).cast("string"))


def docx_of(content: Column) -> Column:
    @F.pandas_udf("string")
    def run(files: pd.Series) -> pd.Series:
        return files.map(docx_text)

    return run(content)


def front_matter(title: Column, url: Column, published: Column, body: Column) -> Column:
    """Markdown with a YAML head; the date in UTC, left out where it is no time."""
    when = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(published), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat_ws(
        "\n",
        F.lit("---"),
        F.concat(F.lit("title: "), quoted(title)),
        F.concat(F.lit("url: "), quoted(url)),
        F.concat(F.lit("date: "), when),
        F.lit("---\n"),
        body,
    )
