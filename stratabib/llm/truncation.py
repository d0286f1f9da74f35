"""Text cut off by field limits, found at its end.

A backward character n-gram model is trained on all documents. At every position of every text it is seen whether the
text ends or a sentence or line closes there, or whether it goes on; both are counted by the last 1 to ORDER characters.
The log-odds that a text may end after its final context are interpolated from the shortest context to the longest.
Closing lines (tags, sources, page references) end without a full stop, after characters that elsewhere go on. For an end
without a stop the model therefore also reaches back over a gap to the opening of the last fragment: how often texts end
in a fragment that opens so, against how often a sentence that opens so is closed; both log-odds are added. The sums are
thresholded per language and source.

For ends that open as last lines do, contexts are counted inside such lines alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabib.runtime import small, spread, stage

MISSING = {"", "nan"}
#: Longest context of the model in characters.
ORDER = 8
#: Contexts kept: met in at least this share of the texts (twice at least), so at most about 1 / SUPPORT of each length,
#: whatever the size of the corpus; for an end in a rarer one the next shorter context decides.
SUPPORT, MIN_COUNT = 2e-6, 2
#: Characters of a fragment that its opening is looked for in.
OPENS = 40
#: Weight of the shorter context in the estimate of the longer.
KEEP = 4.0
DEFAULT_THRESHOLD = 0.0

_DIGITS = re.compile(r"\d+")
_SENTENCE = re.compile(r"(?<=[.?!])[\"”’')\]]*\s+|(?<=[。？！])[”’」）]*\s*|\n+")
_ELLIPSIS = re.compile(r"(?:\.\.\.|…+)\s*$")
_CJK = re.compile("[一-鿿]")
_TERMINATED = tuple(".?!。？！")


def language(text: str) -> str:
    """zh if a third of a text's characters are CJK, else en: the stated language is often missing or wrong."""
    if text.isascii():
        return "en"
    return "zh" if len(_CJK.findall(text)) * 3 >= len(text) else "en"


def opener(fragment: str, lang: str) -> str:
    """How a fragment opens, digits made alike."""
    fragment = _DIGITS.sub("0", fragment.lstrip()[:OPENS])
    if lang == "zh" and not fragment[:1].isascii():
        head = fragment[:4]
        return head[: head.index("：") + 1] if "：" in head else head[:3]
    words = fragment.split(None, 2)
    return words[0] if words and words[0][-1] in ":]" else " ".join(words[:2])


def _closed(fragment: str, lang: str) -> bool:
    tail = fragment.rstrip().rstrip("\"”’'」)）]")
    if not tail or (tail[-1] != fragment.rstrip()[-1] and fragment.rstrip()[-1] in ")）]" and tail[-1] not in _TERMINATED):
        return False
    return tail.endswith(_TERMINATED) and not (lang == "zh" and re.search(r"\d\.$", tail))


def without_mark(text: str) -> str:
    """A text without blanks and an ellipsis at its end."""
    body = text.rstrip()
    return _ELLIPSIS.sub("", body).rstrip() if body.endswith(("...", "…")) else body


def last_fragment(body: str) -> str:
    """What follows the last border of sentences or lines, found from the end backwards; ``body`` has no blanks behind."""
    size = 256
    while True:
        start = max(0, len(body) - size)
        parts = [f for f in _SENTENCE.split(body[start:]) if f and f.strip()]
        if len(parts) > 1 or not start:
            return parts[-1] if parts else ""
        size *= 4


def ending(text: str) -> tuple[str, str, str, str]:
    """(language, kind, opener of the last fragment, text up to its end) of a text's end.

    Kind is closed or open. An ellipsis at the end is no part of the text.
    """
    lang = language(text)
    body = without_mark(text)
    last = last_fragment(body)
    return lang, "closed" if _closed(last, lang) else "open", opener(last, lang), body


def without_mark(text: str) -> str:
    """A text without blanks and an ellipsis at its end."""
    body = text.rstrip()
    return _ELLIPSIS.sub("", body).rstrip() if body.endswith(("...", "…")) else body


def last_fragment(body: str) -> str:
    """What follows the last border of sentences or lines, found from the end backwards; ``body`` has no blanks behind."""
    size = 256
    while True:
        start = max(0, len(body) - size)
        parts = [f for f in _SENTENCE.split(body[start:]) if f and f.strip()]
        if len(parts) > 1 or not start:
            return parts[-1] if parts else ""
        size *= 4


def ending(text: str) -> tuple[str, str, str, str, str]:
    """(language, kind, opener, last fragment with digits alike, word before a final bare number) of a text's end.

    Kind is closed, number (closed by a dot after a bare number) or open.
    """
    lang = language(text)
    body = text.rstrip()
    cut_mark = _ELLIPSIS.search(body)
    last = last_fragment(_ELLIPSIS.sub("", body).rstrip())
    tail = _DIGITS.sub("0", last)
    if cut_mark:
        return lang, "marked", opener(last, lang), tail, ""
    if _closed(last, lang):
        number = re.search(r"(\w+)\s+\d+\.$", last)
        return lang, "number" if number else "closed", opener(last, lang), tail, number[1].lower() if number else ""
    return lang, "open", opener(last, lang), tail, ""


LANGUAGES = ("en", "zh")
#: Kinds of context by number: none, for all positions together; the last 1 to ORDER characters; the opening of a fragment; and, from GAPPED + 1 on, the last
#: characters of a fragment that opens in a certain way.
OPENING, GAPPED = ORDER + 1, 10
#: Lengths of the contexts that are counted inside last lines, by language: parts of words, and whole ones.
SIZES = ((5, 8, 12), (2, 4, 8))
_COUNTS_DDL = "lang int, n int, h bigint, ends bigint, goes_on bigint"
_COUNTS = pa.schema([("lang", pa.int32()), ("n", pa.int32()), ("h", pa.int64()), ("ends", pa.int64()), ("goes_on", pa.int64())])

_MIX = 0x9E3779B97F4A7C15
#: Powers of the base of the rolling hash, one for each character of a context.
_POWERS = [np.uint64(pow(0x100000001B3, n, 1 << 64)) for n in range(max(ORDER, *map(max, SIZES)))]
_SIEVE = 22
_STOPS, _WIDE_STOPS, _QUOTES = (np.array([ord(c) for c in cs], dtype=np.uint32) for cs in (".?!", "。？！", "\"”’'」)）]"))
#: Stands between texts of an array.
_BETWEEN = np.uint32(0)


def codes_of(texts: list[str]) -> np.ndarray:
    """Characters of texts as numbers, texts apart from each other; numbers are alike, and so are those inside words."""
    codes = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    digit = (codes >= 48) & (codes <= 57)
    before = np.append(np.uint32(0), codes[:-1]) | np.uint32(32)
    codes = np.where(digit, np.where((before >= 97) & (before <= 122), np.uint32(78), np.uint32(48)), codes)
    return codes[~(digit & np.append(False, digit[:-1]))]


def hashes(codes: np.ndarray, sizes: tuple[int, ...] = tuple(range(1, ORDER + 1))) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hash of the last n characters at each position) for each length of context."""
    wide = codes.astype(np.uint64)
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, max(sizes) + 1):
        if n <= len(codes):
            h[n - 1 :] += (wide[: len(wide) - n + 1] + np.uint64(1)) * _POWERS[n - 1]
        if n in sizes:
            yield n, (h * np.uint64(_MIX)).view(np.int64)


def _blank(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | (codes <= 13) | (codes == 0x3000) | (codes == 0xA0)


def borders(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions that a text, a line or a sentence ends at; positions after which it goes on)."""
    after = np.append(codes[1:], _BETWEEN)
    later = np.append(after[1:], _BETWEEN)
    stop, wide = np.isin(codes, _STOPS), np.isin(codes, _WIDE_STOPS)
    wide |= stop & (np.append(0, codes[:-1]) >= 0x2E80)
    quoted = np.isin(codes, _QUOTES) & np.append(False, (stop | wide)[:-1])
    # after a stop and a blank a small letter or a digit goes on: an abbreviation, a number
    small = ((later >= 97) & (later <= 122)) | (later == 48)
    ends = (after == _BETWEEN) | (after == 10) | ((stop | quoted) & (after == 32) & ~small) | wide | (quoted & (codes > 127))
    return ends & ~_blank(codes), ~_blank(codes) & ~ends


def _opening(head: str) -> int:
    return zlib.crc32(head.encode("utf-8", "surrogatepass"))


def _last_at(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero(codes[1:] == _BETWEEN)


def _final(bodies: list[str]) -> np.ndarray:
    """Hashes (texts x ORDER) of the final contexts of texts."""
    codes = codes_of([_DIGITS.sub("0", b[-8 * ORDER :])[-ORDER:] for b in bodies])
    at = _last_at(codes)
    return np.stack([h[at] for _, h in hashes(codes)], axis=1) if bodies else np.zeros((0, ORDER), dtype=np.int64)


def _rows(lang: int, n: int, h: np.ndarray, ends: np.ndarray, goes: np.ndarray) -> pa.RecordBatch:
    size = len(h)
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, lang, np.int32)), pa.array(np.full(size, n, np.int32)), pa.array(h), pa.array(ends.astype(np.int64)), pa.array(goes.astype(np.int64))], schema=_COUNTS)


def _summed(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes with how often each ends and goes on."""
    found, at = np.unique(h, return_inverse=True)
    n = np.bincount(at, minlength=len(found))
    e = np.bincount(at, weights=ends, minlength=len(found)).astype(np.int64)
    return found, e, n - e


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts that texts end in and openings of last fragments without a stop: what whole texts are searched for."""
    for batch in batches:
        found = [ending(t) for t in batch.column(0).to_pylist() if t and t not in MISSING]
        for k, lang in enumerate(LANGUAGES):
            own = [f for f in found if f[0] == lang]
            if own:
                table = _final([f[3] for f in own])
                for n in range(1, ORDER + 1):
                    yield _rows(k, n, *_summed(table[:, n - 1], np.ones(len(own))))
                heads = np.array([_opening(f[2]) for f in own if f[1] == "open"], dtype=np.int64)
                yield _rows(k, OPENING, *_summed(heads, np.ones(len(heads))))


class _Known:
    """Finds marked contexts among many: a sieve first, then the sorted marks."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.sieve = np.zeros(1 << _SIEVE, dtype=bool)
        self.sieve[self._slot(marks)] = True
        self.ends, self.goes = np.zeros(len(marks), dtype=np.int64), np.zeros(len(marks), dtype=np.int64)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - _SIEVE)).astype(np.int64)

    def count(self, h: np.ndarray, at_end: np.ndarray, on: np.ndarray) -> None:
        hit = np.flatnonzero(self.sieve[self._slot(h)] & (at_end | on))
        i = np.minimum(np.searchsorted(self.marks, h[hit]), len(self.marks) - 1)
        same = self.marks[i] == h[hit]
        i, ends = i[same], at_end[hit[same]]
        self.ends += np.bincount(i[ends], minlength=len(self.marks))
        self.goes += np.bincount(i[~ends], minlength=len(self.marks))


def _gapped(heads: list[int], lines: list[str], lang: int) -> Iterator[pa.RecordBatch]:
    """Counts inside last fragments that open in known ways: after which characters of it a value ends or goes on."""
    codes = codes_of(lines)
    begin = np.flatnonzero(codes == _BETWEEN)
    of = np.repeat(np.array([0, *heads], dtype=np.uint64), np.diff([-1, *begin]))
    words = np.isin(codes, np.array([c for c in np.unique(codes).tolist() if chr(c).isalnum() or c == 95], dtype=np.uint32))
    next_word, then_word = np.append(words[1:], False), np.append(words[2:], [False, False])
    after = np.append(codes[1:], _BETWEEN)
    goes = next_word | (_blank(after) & (after != _BETWEEN) & then_word)
    counted = (codes != _BETWEEN) & (goes | ~_blank(codes))
    depth = np.arange(len(codes)) - begin[np.searchsorted(begin, np.arange(len(codes)), side="right") - 1]
    for n, h in hashes(codes, SIZES[lang]):
        own = counted & (depth >= n)
        mixed = h[own] ^ (of[own] * np.uint64(_MIX)).view(np.int64)
        yield _rows(lang, GAPPED + n, *_summed(mixed, ~goes[own]))


def _tally(marked: dict[tuple[int, int], np.ndarray]):
    """Counts over whole texts: of marked contexts where a text, line or sentence ends and where it goes on, of openings how often a sentence opens so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {key: _Known(at) for key, at in marked.items() if len(at)}
        openings = [{h: i for i, h in enumerate(marked.get((k, OPENING), np.zeros(0, int)).tolist())} for k in range(2)]
        for batch in batches:
            texts: list[list[str]] = [[], []]
            lines: list[tuple[list[int], list[str]]] = [([], []), ([], [])]
            for text in batch.column(0).to_pylist():
                if not text or text in MISSING:
                    continue
                lang = language(text)
                k = LANGUAGES.index(lang)
                body = without_mark(text)
                texts[k].append(body)
                place = openings[k]
                if not place:
                    continue
                parts = [f for f in _SENTENCE.split(body) if f and f.strip()]
                for f in parts:
                    i = place.get(_opening(opener(f, lang)))
                    if i is not None and _closed(f, lang):
                        known[k, OPENING].goes[i] += 1
                if parts and (o := _opening(opener(parts[-1], lang))) in place and not _closed(parts[-1], lang):
                    lines[k][0].append(o)
                    lines[k][1].append(parts[-1].strip())
            for k in range(2):
                if texts[k]:
                    codes = codes_of(texts[k])
                    at_end, on = borders(codes)
                    yield _rows(k, 0, np.zeros(1, dtype=np.int64), np.array([at_end.sum()]), np.array([on.sum()]))
                    for n, h in hashes(codes):
                        if (k, n) in known:
                            known[k, n].count(h, at_end, on)
                if lines[k][0]:
                    yield from _gapped(*lines[k], k)
        for (k, n), found in known.items():
            met = np.flatnonzero(found.ends + found.goes)
            yield _rows(k, n, found.marks[met], found.ends[met], found.goes[met])

    return run


class Model:
    """Counts by language and kind of context, sorted by hash; their number is bounded by SUPPORT."""

    def __init__(self, counts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.counts = counts
        self.base = []
        for k in range(2):
            _, ends, goes = counts.get((k, 0), (np.zeros(0),) * 3)
            self.base.append((ends.sum() + 1.0) / (ends.sum() + goes.sum() + 2.0))

    def _of(self, k: int, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, goes on) of contexts, a text's own end left out."""
        if (k, n) not in self.counts or not len(wanted):
            return np.zeros(len(wanted)), np.zeros(len(wanted))
        at, ends, goes = self.counts[k, n]
        i = np.minimum(np.searchsorted(at, wanted), len(at) - 1)
        there = at[i] == wanted
        return np.maximum(np.where(there, ends[i], 0) - 1.0, 0.0), np.where(there, goes[i], 0).astype(float)

    def contexts(self, k: int, bodies: list[str]) -> np.ndarray:
        """Log-odds by the final characters: of the longest context ever met, drawn towards the next shorter one."""
        table = _final(bodies)
        odds = np.full(len(bodies), np.log(self.base[k] / (1.0 - self.base[k])))
        shorter = np.full(len(bodies), self.base[k])
        for n in range(1, ORDER + 1):
            ends, goes = self._of(k, n, table[:, n - 1])
            met = ends + goes > 0
            p = (ends + KEEP * shorter) / (ends + goes + KEEP)
            odds = np.where(met, np.log(p) - np.log1p(-p), odds)
            shorter = np.where(met, (ends + 0.5) / (ends + goes + 1.0), shorter)
        return odds

    def opened(self, k: int, heads: np.ndarray, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(log-odds that a fragment opening so is a whole last line, log-odds of its end after that opening)."""
        ends, goes = self._of(k, OPENING, heads)
        by_opening = np.log((ends + 0.2) / (goes + 1.0))
        lines = [_DIGITS.sub("0", x.strip()) for x in lines]
        codes = codes_of([x[-max(SIZES[k]) :] for x in lines])
        at, size = _last_at(codes), np.array([len(x) for x in lines])
        # without a context ever met the line counts as whole; a fragment that is nothing but an opening isn't a line
        longer = size > np.array([len(opener(x, LANGUAGES[k])) for x in lines])
        inside = np.where(longer, np.log(2.0), np.inf)
        for n, h in hashes(codes, SIZES[k]):
            e, g = self._of(k, GAPPED + n, h[at] ^ (heads.astype(np.uint64) * np.uint64(_MIX)).view(np.int64))
            inside = np.where(longer & (size >= n) & (e + g >= 2), np.log((2.0 * e + 0.4) / (g + 0.2)), inside)
        return by_opening, inside

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, log-odds that it may end there) of each text."""
        found = [ending(t) for t in texts]
        out: list[tuple[str, float]] = [("", 0.0)] * len(texts)
        for k, lang in enumerate(LANGUAGES):
            own = [i for i, f in enumerate(found) if f[0] == lang]
            scores = self.contexts(k, [found[i][3] for i in own])
            open_ = [j for j, i in enumerate(own) if found[i][1] == "open"]
            if open_:
                by_opening, inside = self.opened(k, np.array([_opening(found[own[j]][2]) for j in open_], dtype=np.int64), [last_fragment(found[own[j]][3]) for j in open_])
                # a line that opens as last lines do is judged by the contexts after that opening, any other end by its final context
                scores[open_] = np.where((by_opening >= 0) & np.isfinite(inside), np.minimum(by_opening, inside), np.minimum(scores[open_], 0.0) + by_opening)
            for i, s in zip(own, scores.tolist()):
                out[i] = (lang, s)
        return out


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """The model over all documents, copies of one text counted once.

    A first pass over all ends marks the contexts that are ever asked about; a second counts them over all whole texts.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("t")).filter("t is not null")
    once = stage(texts.groupBy(F.xxhash64("t").alias("h"), F.length("t").alias("l")).agg(F.min("t").alias("t")).select("t"), "texts-once")
    least = max(MIN_COUNT, SUPPORT * once.df.count())
    marks = _gathered(once.df.mapInArrow(_marks, _COUNTS_DDL), least)
    counts = _gathered(once.df.mapInArrow(_tally({key: at for key, (at, _, _) in marks.items()}), _COUNTS_DDL), least)
    once.drop()
    for key, (at, ends, _) in marks.items():
        if key[1] == OPENING:
            goes = np.zeros(len(at), dtype=np.int64)
            if key in counts:
                goes[np.searchsorted(at, counts[key][0])] = counts[key][2]
            counts[key] = (at, ends, goes)
    return Model(counts)


def _gathered(counts: DataFrame, least: float) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Summed counts by (language, kind), sorted by hash; contexts met ``least`` times, so a bounded number of them."""
    summed = counts.groupBy("lang", "n", "h").agg(F.sum("ends").alias("ends"), F.sum("goes_on").alias("goes_on"))
    found = summed.filter(F.col("ends") + F.col("goes_on") >= least).toArrow()
    return _by_kind(*(found.column(c).to_numpy() for c in ("lang", "n", "h", "ends", "goes_on")))


def _by_kind(lang, n, h, ends, goes) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = {}
    for k, m in sorted(set(zip(lang.tolist(), n.tolist()))):
        own = np.flatnonzero((lang == k) & (n == m))
        own = own[np.argsort(h[own], kind="stable")]
        out[k, m] = (h[own], ends[own], goes[own])
    return out


def _scorer(model: Model):
    schema = pa.schema([("_id", pa.int64()), ("_source", pa.string()), ("_lang", pa.string()), ("_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, t) for i, s, t in zip(*(c.to_pylist() for c in batch.columns)) if t and t not in MISSING]
            scored = model.score([t for _, _, t in rows])
            columns = ([r[0] for r in rows], [r[1] for r in rows], [s[0] for s in scored], [s[1] for s in scored])
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, schema.types)], schema=schema)

    return run


def thresholds(scores: DataFrame) -> dict[tuple[str, str | None], float]:
    """Per language and source: the middle of the emptiest stretch of log-odds around the default.

    Counts by half units are gathered, not scores; a source with too few ends to tell takes the default.
    """
    bins = scores.groupBy("_lang", "_source", F.floor(F.col("_score") * 2).alias("b")).agg(F.count(F.lit(1)).alias("n")).filter("b between -3 and 2").collect()
    held: dict = {}
    for r in bins:
        held.setdefault((r["_lang"], r["_source"]), Counter())[r["b"]] = r["n"]
    out = {}
    for key, counts in held.items():
        if sum(counts.values()) < 50:
            continue
        best = min(range(-2, 3), key=lambda b: (counts[b - 1] + counts[b], abs(b)))
        out[key] = best / 2
    return out


def score_ends(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id_col, source, lang, log_odds, truncated)`` for each document with a text.

    Missing texts (NULL, '', ``nan``) have no row. Texts are judged whole; copies of a text get the same answer.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).cast("string").alias("_text"))
    scores = stage(spread(rows).mapInArrow(_scorer(model), "_id bigint, _source string, _lang string, _score double"), "end-scores").df
    limit = thresholds(scores)
    keys, values = list(limit), list(limit.values())
    bounds = docs.sparkSession.createDataFrame(pa.table({"_l": pa.array([k[0] for k in keys], pa.string()), "_s": pa.array([k[1] for k in keys], pa.string()), "_bound": pa.array(values, pa.float64())}))
    judged = scores.join(small(bounds), (F.col("_lang") == F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn("_bound", F.coalesce("_bound", F.lit(DEFAULT_THRESHOLD)))
    return judged.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_score").alias("log_odds"), (F.col("_score") < F.col("_bound")).alias("truncated"))


def find_truncated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``score_ends`` under a model trained on the same documents. An empty table gives an empty result."""
    return score_ends(docs, train(docs, text_col), id_col, text_col, source_col)
