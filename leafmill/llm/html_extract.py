"""Main-text extraction with a recurrent block labeller (operator 9).

A page becomes the sequence of its leaf blocks: runs of text that no block-level tag
interrupts, with character references decoded and white space collapsed. Each block is a
vector of its tag path (hashed tags, classes, ids and roles of its ancestors), its hashed
words and a few measures. A bidirectional LSTM, in numpy, reads all blocks of the page in
both directions and labels each as main text or not; the main blocks are joined by line
feeds in page order. Scripts, styles, templates and comments are no text at all; formulas,
drawings and the contents of embedded objects are text of the block that they stand in.

A page of any nesting and number of blocks takes time in proportion to its length: what a
block needs of its ancestors (which buckets of the path vector they fill, the last four
tokens, the depth) is kept up as elements open and close, vectors are made for
``STEP_CELLS`` blocks at a time, and the network keeps one number for each block. An element
whose end tag may be left out is looked for among the ``CLOSE_WITHIN`` innermost elements
that are not inline.

The weights in ``html_labeller.npz`` come from ``html_train.py``: pages made by its
generator from a fixed seed, so training needs no other data and repeats exactly.

Defined results: null or empty html, and pages without a main block, give the empty
string; unclosed, misnested and truncated markup is read as far as it goes; pages are
handled whole at any length; repeated rows are each extracted; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm._common import map_batches, read_table

PATH_SIZE, WORD_SIZE, HIDDEN = 192, 48, 24
MEASURES = 10
BATCH_CHARS = 4_000_000
STEP_CELLS = 20_000
WEIGHTS = os.path.join(os.path.dirname(__file__), "html_labeller.npz")

#: Fixed values of HTML: tags that do not interrupt a run of text, tags without an end, tags whose content is no text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr audio canvas iframe math noscript object svg video"
    " annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt"
    " mstyle msub msubsup msup mtext munder munderover semantics text tspan".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template".split())
#: Fixed values of HTML: a start of the first ends an open element of the second.
ENDS = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",),
}
_NO_P_INSIDE = frozenset(
    "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol section table ul".split()
)
_TOKEN = re.compile(r"[a-z]+")
_WORD = re.compile(r"\w+")
_DIGIT = re.compile(r"\d")
_STOPS = ".,;:!?"


def _ends_in_value(attributes: str) -> bool:
    """Whether the last character of a start tag belongs to a value without quotes; looks at its last run without blanks."""
    before, *last = attributes.rsplit(None, 1)
    last = last[0] if last else before
    value = last[last.rfind(">") + 1 :]
    if _BARE_VALUE.search(value):
        return True
    return before is not last and before.endswith("=") and value is last and last[0] not in "\"'"


#: Elements beyond which an optional end tag is not supplied.
_KEEPS_OPEN = frozenset("ul ol dl table div section article select".split())


class Block:
    """A run of text and what its vector needs of the elements around it that are not inline.

    ``path``: a bit for each bucket of their tokens; ``near``: the buckets of the last four tokens.
    """

    __slots__ = ("text", "path", "near", "tag", "depth", "link_chars")

    def __init__(self, text: str, place: tuple[int, tuple[int, ...], str, int], link_chars: int):
        self.text, self.link_chars = text, link_chars
        self.path, self.near, self.tag, self.depth = place


#: Where markup begins: a tag, a comment, a CDATA section, or another declaration that ends at the next '>'.
_MARKUP = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|(!\[CDATA\[)|[!?/])")
#: The rest of a start tag; quotes only count behind '='.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")
_BARE_VALUE = re.compile(r"""=[^\s"'>]""")
_COMMENT_END = re.compile(r"-->|(?<!<!)--!>")
#: Elements whose content is not parsed.
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style")}
_PATH_ATTRIBUTES = frozenset(("class", "id", "role", "itemprop"))


class _Blocks:
    """Reads a page once from left to right; markup that is not ended ends the page."""

    def __init__(self):
        self.stack: list[str] = []
        self.outer: list[tuple[int, int]] = []  # of each element that is not inline: its place in the stack, its tokens
        self.at: defaultdict[str, list[int]] = defaultdict(list)  # places in the stack of those of a tag
        self.keeps: list[int] = []  # and of those that keep others open
        self.trail: list[int] = []  # buckets of all their tokens
        self.count = [0] * PATH_SIZE
        self.path = 0
        self.open: Counter = Counter()
        self.inline_open: list[Counter] = [Counter()]  # inline elements since each element that is not inline
        self.parts: list[str] = []
        self.blocks: list[Block] = []
        self.silent = self.links = self.link_chars = 0
        self.place: tuple[int, tuple[int, ...], str, int] | None = None

    def flush(self) -> None:
        if self.place is not None:
            self.blocks.append(Block(" ".join("".join(self.parts).split()), self.place, self.link_chars))
        self.parts, self.link_chars, self.place = [], 0, None

    def _push(self, tag: str, attributes: str) -> None:
        self.open[tag] += 1
        self.silent += tag in SILENT
        self.links += tag == "a"
        self.stack.append(tag)
        if tag in INLINE:
            self.inline_open[-1][tag] += 1
            return
        tokens = [tag]
        for name, *values in _ATTRIBUTE.findall(attributes):
            if (name := name.lower()) in _PATH_ATTRIBUTES:
                tokens += [f"{name[0]}:{t}" for t in _TOKEN.findall(unescape("".join(values)).lower())]
        for token in tokens:
            at = _paths[token]
            self.trail.append(at)
            self.count[at] += 1
            self.path |= 1 << at
        self.outer.append((len(self.stack) - 1, len(tokens)))
        self.at[tag].append(len(self.stack) - 1)
        if tag in _KEEPS_OPEN:
            self.keeps.append(len(self.stack) - 1)
        self.inline_open.append(Counter())

    def _pop(self) -> None:
        tag = self.stack.pop()
        self.open[tag] -= 1
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        if tag in INLINE:
            self.inline_open[-1][tag] -= 1
            return
        self.at[tag].pop()
        if tag in _KEEPS_OPEN:
            self.keeps.pop()
        for _ in range(self.outer.pop()[1]):
            at = self.trail.pop()
            self.count[at] -= 1
            if not self.count[at]:
                self.path &= ~(1 << at)
        self.inline_open.pop()

    def _pop_to(self, at: int) -> None:
        while len(self.stack) > at:
            self._pop()

    def _close(self, tags: tuple[str, ...]) -> None:
        """Close the nearest open element of ``tags``, unless a list, table or section stands between."""
        nearest = max((self.at[t][-1] for t in tags if self.at[t]), default=-1)
        if nearest >= 0 and (not self.keeps or nearest >= self.keeps[-1]):
            self._pop_to(nearest)

    def read(self, html: str) -> None:
        at = 0
        while at < len(html):
            mark = _MARKUP.search(html, at)
            stop = mark.start() if mark else len(html)
            if stop > at:
                self.data(unescape(html[at:stop]))
            if not mark:
                break
            at = self._markup(html, mark)
        self.flush()

    def _markup(self, html: str, mark: re.Match) -> int:
        """Handle what begins at ``mark``; returns where it ends."""
        at, tag = mark.end(), (mark[2] or "").lower()
        if tag and not mark[1]:
            rest = _REST.match(html, at)
            if not rest:
                return len(html)
            self.start(tag, rest[1])
            if rest[1].endswith("/") and not _ends_in_value(rest[1]):
                if tag not in VOID:
                    self.end(tag)
            elif tag in _RAW_END:
                raw_end = _RAW_END[tag].search(html, rest.end())
                return raw_end.start() if raw_end else len(html)
            return rest.end()
        if mark[3]:
            end = _COMMENT_END.search(html, mark.start() + 2)
            return end.end() if end else len(html)
        if mark[4] and (end := html.find("]]>", at)) >= 0:
            return end + 3
        end = html.find(">", at - (not tag))
        if tag and end >= 0:
            self.end(tag)
        return end + 1 if end >= 0 else len(html)

    def start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.flush()
            if tag in ENDS:
                self._close(ENDS[tag])
            elif tag in _NO_P_INSIDE:
                self._close(("p",))
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            self._push(tag, attributes)

    def end(self, tag: str) -> None:
        """Close the nearest such element; an inline one only if none that is not inline stands between."""
        if tag not in INLINE:
            self.flush()
        elif not self.inline_open[-1][tag]:
            return
        if self.open[tag]:
            while self.stack[-1] != tag:
                self._pop()
            self._pop()

    def data(self, data: str) -> None:
        if self.silent:
            return
        if self.place is None and not data.isspace():
            tag = self.stack[self.outer[-1][0]] if self.outer else ""
            self.place = self.path, tuple(self.trail[-4:]), tag, len(self.outer)
        if self.links:
            self.link_chars += len(data)
        self.parts.append(data)


def blocks_of(html: str | None) -> list[Block]:
    reader = _Blocks()
    reader.read(html or "")
    return reader.blocks


class _Buckets(dict):
    """Token to one of ``size`` buckets; starts again empty beyond 300,000 tokens."""

    def __init__(self, size: int):
        self.size = size

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[token] = at = zlib.crc32(token.encode("utf-8", "replace")) % self.size
        return at


_paths, _words = _Buckets(PATH_SIZE), _Buckets(WORD_SIZE)


def vectors(blocks: list[Block]) -> np.ndarray:
    """(blocks, PATH_SIZE + WORD_SIZE + MEASURES) in float32."""
    out = np.zeros((len(blocks), PATH_SIZE + WORD_SIZE + MEASURES), np.float32)
    paths = np.frombuffer(b"".join([b.path.to_bytes(PATH_SIZE // 8, "little") for b in blocks]), np.uint8)
    out[:, :PATH_SIZE] = 0.7 * np.unpackbits(paths.reshape(-1, PATH_SIZE // 8), axis=1, bitorder="little")
    out[np.repeat(np.arange(len(blocks)), [len(b.near) for b in blocks]), [at for b in blocks for at in b.near]] = 1
    for row, b in zip(out, blocks, strict=True):
        words = _WORD.findall(b.text.lower())
        places = np.fromiter(map(_words.__getitem__, words), np.int64, len(words))
        counts = np.bincount(places, minlength=WORD_SIZE)
        row[PATH_SIZE : PATH_SIZE + WORD_SIZE] = counts / np.sqrt((counts * counts).sum() or 1.0)
        n, text = len(b.text), b.text
        last = b.tag
        row[PATH_SIZE + WORD_SIZE :] = (
            np.log1p(len(words)) / 5,
            np.log1p(n) / 7,
            min(1.0, b.link_chars / n),
            sum(map(text.count, _STOPS)) / max(1, len(words)),
            text[-1] in ".!?…\"'”»",
            _DIGIT.search(text) is not None,
            last == "p",
            last in ("h1", "h2", "h3", "h4", "h5", "h6"),
            last in ("li", "dt", "dd", "td", "th"),
            b.depth / 10,
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def cell(z: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gates i, f, o and g, the new state and its tangent, from the gates' inputs and the state."""
    size = c.shape[-1]
    gates = _sigmoid(z[..., : 3 * size])
    i, f, o = gates[..., :size], gates[..., size : 2 * size], gates[..., 2 * size :]
    g = np.tanh(z[..., 3 * size :])
    new = f * c + i * g
    return i, f, o, g, new, np.tanh(new)


def scores(pages: list, weights: dict[str, np.ndarray], rows: Callable = lambda page, a, b: page[a:b]) -> list[np.ndarray]:
    """For each page the probability of every block to be main text.

    ``rows(page, a, b)`` are the vectors of its blocks a to b. Pages of like length are read
    together, in both directions at once, ``STEP_CELLS`` blocks at a time.
    """
    out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
    order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
    w, u, b = (np.stack([weights[k + "f"], weights[k + "b"]]) for k in "wub")
    wo = weights["wo"].reshape(2, -1, 1)
    at = 0
    while at < len(order):
        part: list[int] = []
        while at < len(order) and len(part) < 256 and (not part or len(pages[order[at]]) * (len(part) + 1) <= STEP_CELLS):
            part.append(order[at])
            at += 1
        length = np.array([len(pages[i]) for i in part])
        steps = int(length[-1])

        def given(a: int, z: int, part=part) -> np.ndarray:
            x = np.zeros((z - a, len(part), w.shape[1]), np.float32)
            for k, i in enumerate(part):
                n = min(z, len(pages[i])) - a
                if n > 0:
                    x[:n, k] = rows(pages[i], a, a + n)
            return x

        h = c = np.zeros((2, len(part), u.shape[1]), np.float32)
        total = np.full((steps, len(part)), weights["bo"], np.float32)
        each = max(1, STEP_CELLS // len(part))
        for a in range(0, steps, each):
            n = min(each, steps - a)
            ahead = given(a, a + n)
            behind = ahead if n == steps else given(steps - a - n, steps - a)
            z = np.stack([ahead @ w[0] + b[0], behind[::-1] @ w[1] + b[1]], axis=1)
            time = np.arange(a, a + n)
            live = (np.stack([time, steps - 1 - time], axis=1)[:, :, None] < length)[..., None].astype(np.float32)
            state = np.empty((n, *h.shape), np.float32)
            for t in range(n):
                _, _, o, _, new, tangent = cell(z[t] + h @ u, c)
                h, c = live[t] * (o * tangent) + (1 - live[t]) * h, live[t] * new + (1 - live[t]) * c
                state[t] = h
            said = (state @ wo)[..., 0]
            total[a : a + n] += said[:, 0]
            total[steps - a - n : steps - a] += said[::-1, 1]
        for k, i in enumerate(part):
            out[i] = _sigmoid(total[: len(pages[i]), k])
    return out


_loaded: dict[str, np.ndarray] = {}


def weights() -> dict[str, np.ndarray]:
    if not _loaded:
        with np.load(WEIGHTS) as file:
            _loaded.update({k: file[k].astype(np.float32) for k in file.files})
    return _loaded


def main_texts(pages: list[str | None]) -> list[str]:
    """The main text of every page."""
    out: list[str] = []
    part: list[list[Block]] = []
    size = 0

    def label() -> None:
        for blocks, p in zip(part, scores(part, weights(), lambda page, a, b: vectors(page[a:b])), strict=True):
            out.append("\n".join(b.text for b, q in zip(blocks, p, strict=True) if q >= 0.5))
        part.clear()

    for html in pages:
        part.append(blocks_of(html))
        size += len(html or "")
        if size > BATCH_CHARS:
            label()
            size = 0
    label()
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = main_texts(part.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    return map_batches(
        pages.select(F.col("page_id").cast("long"), "url", "html"), _extract, "page_id long, url string, text string, n_chars long"
    )


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read_table(spark, sf_dir, "pages"))
