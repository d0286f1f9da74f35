"""Garbled text from wrong decoding: found and, where nothing was lost, restored.

States are texts; operations undo one wrong decoding (encode with what it was read as, decode with what it
is) or an escape. Best-first search with a visited set expands the cheapest text first; the cost of a text
is the sum of its characters' implausibility above that of ordinary text. Operations work on the stretch of
a text where they lower the cost, so partly garbled values are found as well.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabib.llm import charmodel
from stratabib.runtime import spread

#: A text is garbled if the search lowers its cost by at least this much, by a share of it, over at least two characters.
LEAST_GAIN, LEAST_SHARE = 5.0, 0.4
#: A step may make a text dearer by less than this if the step after it makes it cheaper.
SLACK = 2.0
#: Wrong decodings and escapes that may lie on top of each other.
DEPTH = 3
MISSING = {"", "nan"}

#: Marks of decoding that lost bytes: replacement and control characters, private ones, and replacement characters read
#: once more. No ordinary text holds them, so each costs as much as a text may gain at least.
LOST = re.compile("[�\u0080-\u0084\u0086-\u009f]|锟斤拷|[\ue000-\uf8ff]")
DAMAGE = 6.0

_C1 = {b: chr(b) for b in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
_W1252 = {bytes([b]).decode("cp1252"): chr(b) for b in range(0x80, 0xA0) if b not in _C1}
_TO_LATIN1 = str.maketrans(_W1252)
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xef][\x80-\xbf]{2}|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3})+")
_GBK = re.compile(rb"(?:[\x81-\xfe][\x40-\x7e\x80-\xfe])+")
_GB2 = re.compile(rb"(?:[\xa1-\xfe][\xa1-\xfe])+")
_BIG5 = re.compile(rb"(?:[\xa1-\xf9][\x40-\x7e\xa1-\xfe])+")
#: A stretch of characters that single-byte code pages give: anything but CJK and what they lack.
_SINGLE = re.compile("[\u0000-ɏˆ-˜Α-ωЀ-џ‐-⁄€№™←-⋿⌐-■]+")
_WIDE = re.compile("[·×ˇ-˙‐-※€①-⓿─-◿　-㏿一-鿿-豈-﫿︰-￯Α-ёⅠ-ⅻ←-⊙�]+")
#: A CJK character inside a word in Latin letters: plain characters that make no plausible text.
_INSIDE = re.compile("(?<=[a-zà-ÿ])[一-鿿]+(?=[a-zà-ÿ])|(?<=[A-Za-z])[一-鿿](?=[a-z])|(?<=[a-z]{3})[一-鿿](?![一-鿿])")
_ESCAPED = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[a-zA-Z]{2,8});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|(?:%[0-9A-Fa-f]{2}){2,}|(?:=[0-9A-F]{2}){3,}")


@dataclass
class Finding:
    garbled: bool
    restored: str | None
    gain: float
    #: The cheapest text reached, even if characters are lost in it.
    best: str | None = None


class Searcher:
    """Best-first search under one character model."""

    def __init__(self, costs: dict[str, float]):
        self.costs = costs
        self.clean = frozenset(c for c, v in costs.items() if v <= 1.0)
        self.latin = frozenset(c for c in costs if 0xC0 <= ord(c) <= 0x24F)

    def char(self, c: str) -> float:
        found = self.costs.get(c)
        return charmodel.prior(c) if found is None else found

    def cost(self, text: str) -> float:
        """Implausibility above ordinary text; an accented letter beside plain letters is ordinary."""
        total = 0.0
        odd = [(i, c) for i, c in enumerate(text) if c not in self.clean]
        for i, c in odd:
            v = self.char(c)
            if 0xC0 <= ord(c) <= 0x24F and v <= 3.0:
                a, b = text[i - 1 : i], text[i + 1 : i + 2]
                plain = (a.isascii() and a.isalpha()) or (b.isascii() and b.isalpha()) or (a in " ,;(-'" and b in self.latin)
                strange = any(x and not x.isascii() and not (0xC0 <= ord(x) <= 0x24F) for x in (a, b))
                v = 1.15 if plain and not strange else 3.0
            total += v - 1.0
        return total + 4.0 * len(_INSIDE.findall(text)) + (DAMAGE * text.count("锟斤拷") if "锟" in text else 0.0)

    def damage(self, text: str) -> float:
        """The part of a text's cost that no step can explain: characters that stand where bytes were lost."""
        return sum(max(DAMAGE, self.char(m[0]) - 1.0 if len(m[0]) == 1 else 0.0) for m in LOST.finditer(text))

    def _spans(self, raw: bytes, spans: re.Pattern, codec: str, back: str) -> str | None:
        """Bytes with the stretches that decode by another codec decoded; None if there are none."""
        out, last, hit = [], 0, False
        for m in spans.finditer(raw):
            if m[0].isascii():
                continue
            try:
                new = m[0].decode(codec)
            except UnicodeDecodeError:
                continue
            out += [raw[last : m.start()].decode(back, "replace"), new]
            last, hit = m.end(), True
        if not hit:
            return None
        return "".join(out) + raw[last:].decode(back, "replace")

    def _single(self, text: str, page: str, spans: re.Pattern, codec: str) -> str | None:
        """Undo reading multi-byte text by a single-byte code page, within stretches of its characters."""

        def undo(m: re.Match) -> str:
            piece = m[0]
            if piece.isascii():
                return piece
            try:
                if page == "cp1252":
                    raw = piece.translate(_TO_LATIN1).encode("latin-1")
                else:
                    raw = piece.encode(page)
            except UnicodeEncodeError:
                return "".join(self._loose(x, page, spans, codec) for x in re.split(r"(?<=\s)", piece)) if " " in piece else piece
            out, last = [], 0
            for s in spans.finditer(raw):
                if s[0].isascii():
                    continue
                try:
                    new = s[0].decode(codec)
                except UnicodeDecodeError:
                    continue
                out += [piece[last : s.start()], new]
                last = s.end()
            return "".join(out) + piece[last:]

        new = _SINGLE.sub(undo, text)
        return new if new != text else None

    def _loose(self, piece: str, page: str, spans: re.Pattern, codec: str) -> str:
        try:
            raw = piece.translate(_TO_LATIN1).encode("latin-1") if page == "cp1252" else piece.encode(page)
            new = self._spans(raw, spans, codec, "latin-1" if page == "cp1252" else page)
            return new if new is not None else piece
        except UnicodeEncodeError:
            return piece

    def _utf8_in_gbk(self, text: str) -> str | None:
        """Undo reading UTF-8 as GBK, on the stretches whose bytes are UTF-8."""

        def undo(m: re.Match) -> str:
            piece = m[0]
            parts, offset = [], []
            size = 0
            for c in piece:
                try:
                    b = c.encode("gb18030")
                except UnicodeEncodeError:
                    b = b"\xff"
                if len(b) == 4 or c == "�":
                    b = b"\xff" * (2 if c != "�" else 1)
                parts.append(b)
                offset.append(size)
                size += len(b)
            raw = b"".join(parts)
            out, last = [], 0
            starts = {o: k for k, o in enumerate(offset)} | {size: len(piece)}
            for s in _UTF8.finditer(raw):
                a, b = s.start(), s.end()
                # whole characters only: step inwards to where both readings have a border
                while a < b and a not in starts:
                    a += 1
                while a < b and (raw[a] & 0xC0) == 0x80:
                    a += 1
                    while a < b and a not in starts:
                        a += 1
                while b > a and b not in starts:
                    b -= 1
                if b - a < 6:
                    continue
                new = raw[a:b].decode("utf-8", "ignore")
                if len(new) < 2 or not any("一" <= x <= "鿿" for x in new):
                    continue
                out += [piece[last : starts[a]], new]
                last = starts[b]
            return "".join(out) + piece[last:]

        new = _WIDE.sub(undo, text)
        return new if new != text else None

    def _gbk_in_big5(self, text: str, read_as: str = "big5hkscs", is_in: str = "gbk") -> str | None:
        """Undo reading one double-byte code as another, on the stretch where that lowers the cost most."""

        def undo(m: re.Match) -> str:
            piece = m[0]
            gains, new = [], []
            for c in piece:
                try:
                    x = c.encode(read_as).decode(is_in)
                    if len(x) != 1:
                        raise UnicodeDecodeError("", b"", 0, 1, "")
                    gains.append(self.char(c) - self.char(x))
                except (UnicodeEncodeError, UnicodeDecodeError):
                    x = c
                    gains.append(-3.0 if self.char(c) <= 1 else 0.0)
                new.append(x)
            best = run = 0.0
            a = start = end = 0
            for i, g in enumerate(gains):
                if run <= 0:
                    run, a = 0.0, i
                run += g
                if run > best:
                    best, start, end = run, a, i + 1
            if best < LEAST_GAIN - 1 or end - start < 2:
                return piece
            # wholly garbled rather than partly, if the rest of the stretch loses nothing by it
            if all(x != c or self.char(c) > 1 for x, c in zip(new, piece)) and sum(gains) >= best - 0.5 * (len(piece) - (end - start)) - 2.0:
                start, end = 0, len(piece)
            return piece[:start] + "".join(new[start:end]) + piece[end:]

        new = _WIDE.sub(undo, text)
        return new if new != text else None

    @staticmethod
    def _unescape(text: str) -> str | None:
        if not _ESCAPED.search(text):
            return None
        new = html.unescape(text)
        if "\\" in new:
            new = re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1] or m[2], 16)), new)
        for pattern, sign in ((r"(?:%[0-9A-Fa-f]{2}){2,}", "%"), (r"(?:=[0-9A-F]{2}){3,}", "=")):
            def undo(m: re.Match, sign: str = sign) -> str:
                try:
                    return unquote_to_bytes(m[0].replace(sign, "%")).decode("utf-8")
                except UnicodeDecodeError:
                    return m[0]
            new = re.sub(pattern, undo, new)
        return new if new != text else None

    def _moves(self, text: str) -> Iterator[str]:
        single = any(0x80 <= ord(c) < 0x2600 for c in text)
        if single:
            for page in ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251"):
                if (new := self._single(text, page, _UTF8, "utf-8")) is not None:
                    yield new
            for spans, codec in ((_GB2, "gb2312"), (_GBK, "gbk"), (_BIG5, "big5")):
                if (new := self._single(text, "cp1252", spans, codec)) is not None:
                    yield new
        if any(c >= "⺀" for c in text):
            for new in (self._utf8_in_gbk(text), self._gbk_in_big5(text), self._gbk_in_big5(text, "gbk", "big5hkscs")):
                if new is not None:
                    yield new
        if (new := self._unescape(text)) is not None:
            yield new

    def search(self, text: str) -> Finding:
        """The cheapest text reachable; garbled if it is far cheaper, or if even it holds what stands for lost bytes.

        The cheapest text known is taken further first. A text that gained less than half of what the best one gained is
        left, so the search ends when all others within DEPTH steps are visited; single steps that gain nothing may lie between.
        """
        first = self.cost(text)
        if first < LEAST_GAIN - 1 and not _ESCAPED.search(text):
            return Finding(False, None, 0.0)
        heap, visited, best = [(first, 0, text, False, 0)], {hash(text)}, (first, text)
        while heap:
            cost, _, now, idle, depth = heapq.heappop(heap)
            if cost > best[0] + SLACK and 2.0 * (first - cost) < first - best[0]:
                break
            for new in self._moves(now):
                if (h := hash(new)) in visited:
                    continue
                visited.add(h)
                c = self.cost(new)
                if c < best[0]:
                    best = (c, new)
                if depth + 1 < DEPTH and (c < cost or (not idle and c < cost + SLACK)):
                    heapq.heappush(heap, (c, len(visited), new, c >= cost, depth + 1))
            if best[0] <= 0.0:
                break
        gain = first - best[0]
        found = gain >= LEAST_GAIN and gain >= LEAST_SHARE * first
        short = gain >= 1.5 and gain >= 0.8 * first and best[1].isascii() is False and first <= 12 and len(text) - len(best[1]) >= 1
        lost = self.damage(best[1]) >= LEAST_GAIN
        garbled = lost or found or short
        whole = best[1] if (found or short) and not lost else None
        self.visited = len(visited)
        return Finding(garbled, whole if garbled else None, gain, best[1])


_OUT = pa.schema([("_id", pa.int64()), ("field_name", pa.string()), ("garbled", pa.string()), ("restored", pa.string())])


def _finder(columns: list[str], costs: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(costs)
        clean = searcher.clean
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            ids = None
            for k, name in enumerate(columns, 1):
                for i, text in enumerate(batch.column(k).to_pylist()):
                    # ordinary characters only: nothing to search
                    if not text or (clean.issuperset(text) and not _ESCAPED.search(text)) or text in MISSING:
                        continue
                    finding = searcher.search(text)
                    if finding.garbled:
                        ids = ids or batch.column(0).to_pylist()
                        for column, x in zip(out, (ids[i], name, text, finding.restored)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _OUT.types)], schema=_OUT)

    return run


def find_garbled(df: DataFrame, id_col: str = "rec_id", columns: tuple[str, ...] = ("title_cn", "abstract_cn", "institution")) -> DataFrame:
    """Rows ``(id_col, field_name, garbled, restored)`` of garbled values; ``restored`` is NULL where characters were lost.

    The character model counts all text of the columns. Missing values (NULL, '', ``nan``) are not garbled. Very
    long texts are searched whole. Repeated rows are found each for
    themselves; other columns are not read; an empty table gives an empty result.
    """
    names = list(columns)
    model = charmodel.costs(charmodel.character_counts(df, names))
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), *(F.col(c).cast("string").alias(f"_c{i}") for i, c in enumerate(names)))
    out = spread(rows).mapInArrow(_finder(names, model), "_id bigint, field_name string, garbled string, restored string")
    return out.withColumnRenamed("_id", id_col)
