"""Encoding with a byte-level BPE of the ``tokenizers`` library through a pre-token cache.

Byte-level BPE never merges across pre-tokens, so a text's ids are its pre-tokens' ids in
order. A worker finds the borders of a slice's pre-tokens with numpy, by the tokenizer's own
pattern, looks every one up in a hash table and sends only those that it has not seen to the
library; no Python object is made for a pre-token that is known. A pre-token is told by 128
bits of hash. Texts that hold a special token's string, or characters outside the ranges
below (whose classes could depend on a library's version of Unicode), go to the library
whole, and so does every text where the tokenizer is of another kind.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence

import numpy as np

#: Letters and digits below U+0250 and white space, as the pre-token pattern of the byte-level BPE has them.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_SPACES = " \t\n\r"
#: Characters that Python's and the library's white space agree on; others go to the library.
_OTHER = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-―‘-‟•…]")
#: Where a pre-token begins whatever stands before and after.
_BORDER = re.compile(r"(?<=\S)(?=\s)")

_OTHERS, _LETTER, _DIGIT, _SPACE = range(4)
_CLASS = np.zeros(0x2027, np.uint8)
for _kind, _chars in ((_LETTER, f"[{_LETTERS}]"), (_DIGIT, f"[{_DIGITS}]"), (_SPACE, f"[{_SPACES}]")):
    _CLASS[[i for i in range(len(_CLASS)) if re.match(_chars, chr(i))]] = _kind

#: Pre-tokens that a worker's hash table holds at most (more only while one slice has more).
CACHE_ENTRIES = 1 << 20
SLICE_CHARS = 400_000
#: Pre-tokens that are sent to the library as one text: few, as its time for a text grows faster than the text.
BLOCK_WORDS = 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def slices(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about ``SLICE_CHARS`` characters; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > SLICE_CHARS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def parts(text: str) -> Iterator[str]:
    """A text in parts of about ``SLICE_CHARS`` characters whose pre-tokens are those of the text."""
    at = 0
    while len(text) - at > SLICE_CHARS and (border := _BORDER.search(text, at + SLICE_CHARS)):
        yield text[at : border.start()]
        at = border.start()
    yield text[at:]


class PreTokens:
    """The pre-tokens of some texts: where they begin and end, two hashes of each, and the first of every text."""

    def __init__(self, texts: Sequence[str]):
        self.text = "".join(texts)
        codes = np.frombuffer(self.text.encode("utf-32-le"), "<u4")
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        begins = self._begins(codes, edges)
        self.start = np.flatnonzero(begins)
        self.end = np.append(self.start[1:], len(codes))[: len(self.start)]
        self.first = np.searchsorted(self.start, edges)
        self.key, self.check = self._hashes(codes)

    @staticmethod
    def _begins(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
        n = len(codes)
        kind = _CLASS[codes]
        opens = np.zeros(n + 1, np.bool_)  # the first character of a text, and the end
        opens[edges] = True
        begins = opens[:n].copy()
        begins[1:] |= kind[1:] != kind[:-1]
        # White space before something else: its last character stands apart, and a space goes with what follows.
        last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~opens[1:n])
        begins[last] = True
        begins[last[codes[last] == ord(" ")] + 1] = False
        # Contractions: an apostrophe that begins a pre-token and these letters are one.
        mark = np.flatnonzero((codes[:-1] == ord("'")) & begins[:-1] & (kind[1:] == _LETTER) & ~opens[1:n])
        one = codes[mark + 1]
        two = np.where(mark + 2 < n, codes[np.minimum(mark + 2, n - 1)], 0)
        two[opens[np.minimum(mark + 2, n)]] = 0
        is_one = np.isin(one, [ord(c) for c in "stmd"])
        is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[mark[is_one | is_two] + 1] = False
        rest = np.concatenate([mark[is_one] + 2, mark[is_two] + 3])
        begins[rest[rest < n]] = True
        return begins

    def _hashes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of pseudo-random numbers for each character at its place in the pre-token."""
        if not len(self.start):
            return np.empty(0, np.uint64), np.empty(0, np.uint64)
        place = np.arange(len(codes), dtype=np.uint64)
        place -= np.repeat(self.start.astype(np.uint64), self.end - self.start)
        z = (place << np.uint64(32)) + codes + np.uint64(0x9E3779B97F4A7C15)
        other = np.empty_like(z)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            np.right_shift(z, np.uint64(shift), out=other)
            z ^= other
            z *= np.uint64(factor)
        np.right_shift(z, np.uint64(31), out=other)
        z ^= other
        key = np.add.reduceat(z, self.start)
        np.right_shift(z, np.uint64(32), out=other)
        z *= np.uint64(0xD6E8FEB86659FD93)
        z ^= other
        return np.maximum(key, np.uint64(1)), np.add.reduceat(z, self.start)

    def words(self, which: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist(), strict=True)]


class WordTable:
    """An open-addressed hash table from pre-tokens' hashes to where their ids are and how many they are.

    At most half of its slots are filled: then the entries that were found since the last
    time stay (unless they are most of all) and the others are forgotten.
    """

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.bits = max(6, (2 * entries - 1).bit_length())
        self._empty()

    def __len__(self) -> int:
        return self.entries

    def _empty(self) -> None:
        n = 1 << self.bits
        self.key, self.check = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.at, self.length, self.met = np.zeros(n, np.int64), np.zeros(n, np.int32), np.zeros(n, np.bool_)
        self.pool, self.n_pool, self.entries = np.empty(n, np.uint32), 0, 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The slot of each; -1 where there is none."""
        mask = np.uint64((1 << self.bits) - 1)
        found = np.full(len(key), -1, np.int64)
        todo, slot = np.arange(len(key)), (key & mask).astype(np.int64)
        while len(todo):
            there = self.key[slot]
            same = (there == key[todo]) & (self.check[slot] == check[todo])
            found[todo[same]] = slot[same]
            go = ~same & (there != 0)
            todo, slot = todo[go], (slot[go] + 1) & int(mask)
        return found

    def store(self, ids: np.ndarray) -> int:
        """Put ids into the pool; returns where."""
        at, need = self.n_pool, self.n_pool + len(ids)
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool[:at], np.empty(max(need, len(self.pool)), np.uint32)])
        self.pool[at:need] = ids
        self.n_pool = need
        return at

    def insert(self, key: np.ndarray, check: np.ndarray, at: np.ndarray, length: np.ndarray) -> None:
        """Add entries whose keys differ from each other and whose (key, check) are not there."""
        mask = (1 << self.bits) - 1
        todo, slot = np.arange(len(key)), (key & np.uint64(mask)).astype(np.int64)
        while len(todo):
            free = self.key[slot] == 0
            self.key[slot[free]] = key[todo[free]]  # of several for one slot, one wins
            won = free & (self.key[slot] == key[todo])
            mine, place = todo[won], slot[won]
            self.check[place], self.at[place], self.length[place] = check[mine], at[mine], length[mine]
            todo, slot = todo[~won], (slot[~won] + 1) & mask
        self.entries += len(key)

    def make_room(self, n: int) -> None:
        """Room for ``n`` more entries."""
        while 2 * n > 1 << self.bits:
            self.bits += 1
        if 2 * (self.entries + n) <= len(self.key):
            return
        kept = np.flatnonzero(self.met)
        if 2 * len(kept) > self.entries or 2 * (len(kept) + n) > len(self.key):
            kept = kept[:0]
        old = self.key[kept], self.check[kept], self.at[kept], self.length[kept].astype(np.int64)
        pool = self.pool
        self._empty()
        self.insert(old[0], old[1], np.cumsum(old[3]) - old[3], old[3])
        self.store(ragged(pool, old[2], old[3]))


def ragged(pool: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``at``, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(at - (ends - length), length) + np.arange(total)]


class CachedEncoder:
    """Encodes whole texts; ids are little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.library = load(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.by_words = self._is_byte_level()
        if self.by_words:
            vocabulary = self.library.get_vocab()
            self.begins = np.zeros(max(vocabulary.values()) + 1, np.bool_)
            self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
            self.feed = vocabulary["\u010a"]
        self.cache = WordTable(entries)

    def _is_byte_level(self) -> bool:
        """Whether the tokenizer is a byte-level BPE with the pattern above and nothing that changes texts before it."""
        spec = json.loads(self.library.to_str())
        split = spec.get("pre_tokenizer") or {}
        return (
            spec["model"]["type"] == "BPE"
            and not spec["model"].get("ignore_merges")
            and spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
        )

    def plain(self, text: str) -> bool:
        """Whether the text's ids are known to be those of its pre-tokens."""
        return self.by_words and not _OTHER.search(text) and not any(s in text for s in self.special)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def encoded(self, words: list[str], table: WordTable) -> tuple[np.ndarray, np.ndarray]:
        """Where ``table``'s pool has the ids of each word, and their number.

        A pre-token that begins with a space begins a new one wherever it stands, and one without
        white space is one between line feeds, so many go to the library as one text. No other
        token of such a text has the space or the line feed. Runs of white space are encoded alone.
        """
        at, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        spaced, plain = [], []
        for i, w in enumerate(words):
            if w.isspace():
                ids = self.whole(w)
                at[i], length[i] = table.store(ids), len(ids)
            else:
                (spaced if w[0] == " " else plain).append(i)
        for group, between in ((spaced, ""), (plain, "\n")):
            for k in range(0, len(group), BLOCK_WORDS):
                part = group[k : k + BLOCK_WORDS]
                ids = self.whole("".join([words[i] + between for i in part]))
                if between:
                    cuts = np.concatenate([[0], np.flatnonzero(ids == self.feed) + 1])
                else:
                    cuts = np.append(np.flatnonzero(self.begins[ids]), len(ids))
                if len(cuts) != len(part) + 1:
                    raise AssertionError("the library splits pre-tokens elsewhere")
                at[part] = table.store(ids) + cuts[:-1]
                length[part] = np.diff(cuts) - len(between)
        return at, length

    def slots(self, found: PreTokens, table: WordTable, which: np.ndarray | None = None) -> np.ndarray:
        """The slot of every pre-token (or of ``which``); those not in ``table`` are encoded and put there."""
        which = np.arange(len(found.start)) if which is None else which
        key, check = found.key[which], found.check[which]
        slot = table.find(key, check)
        while len(missing := np.flatnonzero(slot < 0)):
            table.met[slot[slot >= 0]] = True
            first = missing[np.unique(key[missing], return_index=True)[1]]
            entries = table.entries
            table.make_room(len(first))
            if table.entries < entries:  # some were forgotten
                slot = table.find(key, check)
                continue
            at, length = self.encoded(found.words(which[first]), table)
            table.insert(key[first], check[first], at, length)
            slot[missing] = table.find(key[missing], check[missing])
        table.met[slot] = True
        return slot

    def _ids(self, texts: list[str]) -> list[bytes]:
        found, table = PreTokens(texts), self.cache
        slot = self.slots(found, table)
        length = table.length[slot].astype(np.int64)
        data = ragged(table.pool, table.at[slot], length).astype("<u4", copy=False).tobytes()
        places = (4 * np.concatenate([[0], np.cumsum(length)])[found.first]).tolist()
        return [data[a:b] for a, b in zip(places, places[1:], strict=False)]

    def ids(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        """The ids of each text; null is empty."""
        for a, b in slices(texts):
            group = [t or "" for t in texts[a:b]]
            plain = [self.plain(t) for t in group]
            if b - a == 1 and plain[0]:
                yield b"".join(x for part in parts(group[0]) for x in self._ids([part]))
                continue
            known = iter(self._ids([t for t, p in zip(group, plain, strict=True) if p]))
            for text, p in zip(group, plain, strict=True):
                yield next(known) if p else self.whole(text).tobytes()


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """The worker's encoder, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]
