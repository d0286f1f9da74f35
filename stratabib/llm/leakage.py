"""Evaluation passages inside training documents, by q-gram lemma filtering.

Item and document are compared as strings of letters and digits alone, so case, punctuation, spacing,
line breaks and markup don't count. A passage may have one edit in EDIT_EVERY letters. One of L letters with at most e
edits shares at least L // q - e of the document's q-blocks laid end to end with the item, on neighbouring diagonals.
Shared q-grams are counted in overlapping diagonal bands; bands that meet the bound are verified by banded
alignment, and a document leaks an item if the aligned stretch holds the whole item or enough consecutive
words (characters in Chinese) of it. A stretch without edits is told from one with some.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabib.runtime import BROADCAST_BOUND, spread

MIN_WORDS, MIN_CHARS = 12, 24
#: Longest q-gram by item language; one edit is allowed in so many letters.
Q = {"en": 10, "zh": 5}
EDIT_EVERY = 30
#: Diagonals that the hits of one passage may drift over, and that an alignment may.
BAND, DRIFT = 4, 16
#: Letters of the items that one index holds, at 16 bytes each.
INDEX_LETTERS = 16_000_000
MISSING = {"", "nan"}

_MARKUP = re.compile(r"<[^<>]{1,200}>|!?\[([^\[\]]{0,200})\]\([^()\s]{0,300}\)")
_CJK = re.compile("[㐀-鿿豈-﫿]")
_NOT_LETTER = re.compile(r"[\W_]+")


def letters(text: str) -> str:
    """Letters and digits of a text in lower case, without markup."""
    if "<" in text or "](" in text:
        text = _MARKUP.sub(lambda m: m[1] or " ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _NOT_LETTER.sub("", text.casefold())


@dataclass
class Item:
    """An evaluation passage: its letters and where, in them, each word ends."""

    item_id: int
    lang: str
    text: str
    letters: str = ""
    ends: list[int] = field(default_factory=list)

    def __post_init__(self):
        self.lang = "zh" if len(_CJK.findall(self.text)) * 3 > len(self.text) else "en"
        words = list(letters(self.text)) if self.lang == "zh" else [w for w in map(letters, self.text.split()) if w]
        self.letters = "".join(words)
        at = 0
        for w in words:
            at += len(w)
            self.ends.append(at)

    def enough(self, start: int, end: int) -> bool:
        """Whether the letters from start to end hold the whole item or enough of its words in full."""
        if start == 0 and end == len(self.letters):
            return True
        # word i begins where word i - 1 ends
        first = bisect_left(self.ends, start) + 1 if start else 0
        return bisect_right(self.ends, end) - first >= (MIN_CHARS if self.lang == "zh" else MIN_WORDS)

    def shortest(self) -> int:
        """Fewest letters that a stretch of enough words has."""
        n = MIN_CHARS if self.lang == "zh" else MIN_WORDS
        starts = [0, *self.ends[:-1]]
        return min([len(self.letters), *(self.ends[i + n - 1] - starts[i] for i in range(len(self.ends) - n + 1))])


def allowed(letters: int) -> int:
    """Edits that a stretch of so many letters may have."""
    return letters // EDIT_EVERY


def filter_of(item: Item) -> tuple[int, int]:
    """(q, q-blocks that a leaking document shares with the item on a band): by the q-gram lemma, for passages of any length."""
    least = item.shortest()
    # a stretch of this length holds a q-block of the document whole, wherever it begins
    q = max(1, min(Q[item.lang], (least + 1) // (2 * (allowed(least) + 1))))
    return q, max(1, min((n + 1) // q - 1 - allowed(n) for n in range(least, least + 2 * EDIT_EVERY)))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


_SIEVE = 20


class _Grams:
    """All q-grams of some items as sorted hashes with the places they stand at."""

    def __init__(self, q: int, items: list[tuple[int, Item]]):
        self.q = q
        self.powers = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(q)], dtype=np.uint64)
        h, item, at = [], [], []
        for k, x in items:
            codes = _codes(x.letters)
            if len(codes) >= q:
                h.append(self._hash(np.lib.stride_tricks.sliding_window_view(codes, q)))
                item.append(np.full(len(h[-1]), k, dtype=np.int32))
                at.append(np.arange(len(h[-1]), dtype=np.int32))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
        hashes = join(h, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.h, self.item, self.at = hashes[order], join(item, np.int32)[order], join(at, np.int32)[order]
        self.sieve = np.zeros(1 << _SIEVE, dtype=bool)
        self.sieve[self._slot(self.h)] = True

    def _hash(self, windows: np.ndarray) -> np.ndarray:
        return ((windows + np.uint64(1)) * self.powers).sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - _SIEVE)).astype(np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, place in the array, place in the item) of the array's blocks laid end to end that stand in an item."""
        n = len(codes) // self.q
        blocks = self._hash(codes[: n * self.q].reshape(n, self.q))
        maybe = np.flatnonzero(self.sieve[self._slot(blocks)])
        first, last = np.searchsorted(self.h, blocks[maybe], "left"), np.searchsorted(self.h, blocks[maybe], "right")
        times = last - first
        at = np.repeat(first - np.append(0, np.cumsum(times)[:-1]), times) + np.arange(times.sum()) if len(maybe) else np.zeros(0, dtype=int)
        return self.item[at], np.repeat(maybe * self.q, times), self.at[at]


class Index:
    """q-grams of the items, by their q."""

    def __init__(self, items: list[Item]):
        self.items = [i for i in items if i.letters]
        self.filters = [filter_of(i) for i in self.items]
        self.band = max([BAND, *(allowed(i.shortest()) for i in self.items)])
        by_q: dict[int, list[tuple[int, Item]]] = defaultdict(list)
        for k, (item, (q, _)) in enumerate(zip(self.items, self.filters)):
            by_q[q].append((k, item))
        self.grams = [_Grams(q, own) for q, own in sorted(by_q.items())]

    def candidates(self, texts: list[str]) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
        """Shared q-blocks (document, item position) by text, item and diagonal band, where they reach the bound.

        All texts are laid end to end, apart from each other: where blocks begin doesn't matter to the lemma.
        """
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        codes = _codes("\0".join(texts))
        need = np.array([n for _, n in self.filters], dtype=np.int64)
        out: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
        for grams in self.grams:
            if len(codes) < grams.q:
                continue
            item, p, at = grams.hits(codes)
            text = np.searchsorted(starts, p, side="right") - 1
            p = p - starts[text]
            band = (p - at) // self.band
            band = np.concatenate([band, band + 1])  # bands overlap by half
            text, item, p, at = (np.concatenate([x, x]) for x in (text, item, p, at))
            order = np.lexsort((at, p, band, item, text))
            text, item, band, p, at = (x[order] for x in (text, item, band, p, at))
            begin = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1]))) if len(text) else np.zeros(0, dtype=int)
            size = np.diff(np.append(begin, len(text)))
            enough = size >= need[item[begin]]
            for b, n in zip(begin[enough].tolist(), size[enough].tolist()):
                out[int(text[b]), int(item[b]), int(band[b])] = list(zip(p[b : b + n].tolist(), at[b : b + n].tolist()))
        return out

    def leaks_of(self, texts: list[str]) -> dict[int, list[tuple[int, int, int, int, int]]]:
        """By text (item, first letter in item, last, first letter in document, edits) of each leaked item.

        The longest stretch without edits; if none is long enough, the longest with the edits allowed.
        """
        best: dict[tuple[int, int], tuple[bool, int, tuple[int, int, int, int]]] = {}
        for (which, k, _), found in self.candidates(texts).items():
            text, item, q, key = texts[which], self.items[k], self.filters[k][0], (which, k)
            done: dict[int, int] = {}  # by diagonal: where the run of equal letters last aligned ends in the item
            for p, at in found:
                if at < done.get(p - at, 0):
                    continue
                if text[p : p + q] != item.letters[at : at + q]:
                    continue  # equal hashes of different grams
                back, on = _run_back(text, item.letters, p, at), _run(text, item.letters, p + q, at + q)
                done[p - at] = at + q + on
                if item.enough(at - back, at + q + on):
                    self._keep(best, key, True, (at - back, at + q + on, p - back, 0))
                elif key not in best or not best[key][0]:
                    a, b, d, edits = align(text, item.letters, p, at, q)
                    if edits <= allowed(b - a) and item.enough(a, b):
                        self._keep(best, key, False, (a, b, d, edits))
        out: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        for (which, k), (_, _, stretch) in best.items():
            out[which].append((self.items[k].item_id, *stretch))
        return out

    def leaks(self, text: str) -> list[tuple[int, int, int, int, int]]:
        return self.leaks_of([text])[0]

    @staticmethod
    def _keep(best: dict, k: tuple[int, int], exact: bool, stretch: tuple[int, int, int, int]) -> None:
        size = stretch[1] - stretch[0]
        if k not in best or (exact, size) > best[k][:2]:
            best[k] = (exact, size, stretch)


def align(text: str, item: str, p: int, at: int, q: int) -> tuple[int, int, int, int]:
    """Banded alignment out from a shared q-gram: the stretch of the item it covers, where it begins in the text, and its edits.

    Each edit moves the alignment to a neighbouring diagonal within the band at most; it goes on while its edits are allowed.
    """
    a, d, left = _extend(text[max(0, p - len(item) - DRIFT) : p][::-1], item[:at][::-1])
    b, _, right = _extend(text[p + q : p + len(item) + DRIFT], item[at + q :])
    return at - a, at + q + b, p - d, left + right


def _extend(text: str, item: str) -> tuple[int, int, int]:
    """How far item and text go on alike, in item and text characters, and the edits spent: one in EDIT_EVERY letters at most."""
    reach = {0: _run(text, item, 0, 0)}  # by diagonal: item characters covered
    best = (reach[0], reach[0], 0)
    for edits in range(1, allowed(len(item)) + 1):
        if edits > allowed(max(reach.values())) + 1:
            break
        new: dict[int, int] = {}
        for diagonal, i in reach.items():
            for step, move in ((0, 1), (1, 0), (-1, 1)):  # replaced, inserted in text, left out of text
                x, y = i + move, i + move + diagonal + step
                if x <= len(item) and 0 <= y <= len(text) and abs(diagonal + step) <= DRIFT:
                    x += _run(text, item, y, x)
                    if x > new.get(diagonal + step, -1):
                        new[diagonal + step] = x
        if not new:
            break
        reach = new
        diagonal, i = max(reach.items(), key=lambda r: r[1])
        if edits <= allowed(i) and i > best[0] + 1:
            best = (i, i + diagonal, edits)
    return best


def _run_back(text: str, item: str, y: int, x: int) -> int:
    n, most = 0, min(y, x)
    while n < most and text[y - n - 1] == item[x - n - 1]:
        n += 1
    return n


def _run(text: str, item: str, y: int, x: int) -> int:
    n, most = 0, min(len(text) - y, len(item) - x)
    while n < most and text[y + n] == item[x + n]:
        n += 1
    return n


_OUT = pa.schema([("_id", pa.int64()), ("item_id", pa.int64()), ("matched", pa.int32()), ("item_share", pa.float64()), ("edits", pa.int32())])
_OUT_DDL = "_id bigint, item_id bigint, matched int, item_share double, edits int"


def _searcher(items: list[tuple[int, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([Item(*i) for i in items])
        length = {i.item_id: len(i.letters) for i in index.items}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            docs = [(doc, letters(text)) for doc, text in zip(*(c.to_pylist() for c in batch.columns)) if text and text not in MISSING]
            for which, found in index.leaks_of([t for _, t in docs]).items():
                for item, a, b, _, edits in found:
                    for column, x in zip(out, (docs[which][0], item, b - a, (b - a) / length[item], edits)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _OUT.types)], schema=_OUT)

    return run


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", index_letters: int = INDEX_LETTERS) -> DataFrame:
    """``(id_col, item_id, matched, item_share, edits)`` of every document that carries an item, wholly or in part.

    ``matched`` counts letters of the longest stretch; ``edits`` is 0 if it stands there letter by letter. The items are a stated query set: they are taken in
    blocks of about ``index_letters`` letters, within the bound for broadcast, and every block is held against all
    documents. Missing texts or items (NULL, '', ``nan``) match nothing; repeated items are reported once per
    id; texts of any length are searched whole.
    """
    named = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("item_text").cast("string").alias("text"))
    named = named.filter("item_id is not null and text is not null and trim(text) not in ('', 'nan')").distinct()
    size = named.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size["chars"] // min(index_letters, BROADCAST_BOUND // 4)))
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = spread(rows)
    parts = []
    for b in range(blocks):
        block = [tuple(r) for r in named.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        parts.append(rows.mapInArrow(_searcher(block), _OUT_DDL))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if size["n"] and named.select("item_id").distinct().count() < size["n"]:
        out = out.groupBy("_id", "item_id").agg(F.max_by("matched", F.struct(-F.col("edits"), "matched")).alias("matched"), F.max_by("item_share", F.struct(-F.col("edits"), "matched")).alias("item_share"), F.min("edits").alias("edits"))
    return out.withColumnRenamed("_id", id_col)
