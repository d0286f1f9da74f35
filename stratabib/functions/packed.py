"""Segmentation of one field that packs several values.

A field is cut at delimiters. Which of them separate values is decided by dynamic programming over
the stretches between them: a stretch that an automaton finds to be a known whole value is cheap, so
delimiters inside it stay; an unknown stretch costs more, and swallowing a delimiter costs by its
strength. Quoted stretches, bracketed name lists and list literals are taken as written.
"""

from __future__ import annotations

import ast
import re

import ahocorasick

#: Cost of a stretch that is a known whole value; of one that isn't; of a delimiter left inside a stretch.
KNOWN, UNKNOWN = 0.1, 1.0
STRONG = re.compile(r"[;；|\n\r\t、｜]")
_SPACED = re.compile(r"\s+(?:and|&|/|·)\s+")
_BRACKET = re.compile(r"^\s*(?:\[[^\]]*\]\s*)+")
MISSING = {"", "nan"}

#: Weak delimiters by field kind; the strong ones hold for all.
WEAK = {"keyword": re.compile(r",\s*|，\s*"), "affiliation": None, "person": re.compile(r",\s*|，\s*|\s+and\s+|\s*&\s*")}
SWALLOW_STRONG, SWALLOW_WEAK = 8.0, 1.2


def automaton(values) -> ahocorasick.Automaton | None:
    """An automaton over known whole values; None if there are none."""
    auto = ahocorasick.Automaton()
    n = 0
    for v in values:
        auto.add_word(v, v)
        n += 1
    if not n:
        return None
    auto.make_automaton()
    return auto


def _unquote(piece: str) -> str:
    piece = piece.strip()
    if len(piece) > 1 and piece[0] == piece[-1] == '"':
        inner = piece[1:-1]
        if '"' not in inner.replace('""', ""):
            return inner.replace('""', '"').strip()
    return piece


def _closing(text: str, start: int, weak) -> int:
    """End of the quoted stretch that opens at ``start``, if a delimiter or the end follows it; else -1."""
    i = start + 1
    while True:
        i = text.find('"', i)
        if i < 0:
            return -1
        if text[i + 1 : i + 2] == '"':
            i += 2
            continue
        rest = text[i + 1 :].lstrip(" ")
        return i + 1 if not rest or STRONG.match(rest) or rest[0] in ",，" or (weak is not None and weak.match(rest)) else -1


def _shielded(text: str, weak) -> list[tuple[int, int]]:
    """Stretches no delimiter counts in: quoted values and bracketed name lists."""
    spans: list[tuple[int, int]] = []
    i, fresh = 0, True
    while i < len(text):
        c = text[i]
        if fresh and c == '"' and (end := _closing(text, i, weak)) > 0:
            spans.append((i, end))
            i, fresh = end, False
            continue
        if c == "[" and (end := text.find("]", i)) > 0:
            spans.append((i, end + 1))
            i, fresh = end + 1, False
            continue
        if STRONG.match(c) or c in ",，":
            fresh = True
        elif c != " ":
            fresh = False
        i += 1
    return spans


def _person(text: str) -> float:
    """Cost of a stretch as one person: 'First Last', or 'Last, First' with its comma inside."""
    parts = [p.split() for p in re.split(r"[,，]", text)]
    if re.search(r"\s(?:and|&)\s|&", text):
        return 6.0
    if len(parts) == 1:
        return 0.2 if len(parts[0]) > 1 or not parts[0] or not parts[0][0].isascii() else 2.0
    if not text.isascii() and re.search("[\u4e00-\u9fff]", text):  # no comma inside a Chinese name
        return 3.0 * len(parts)
    if len(parts) == 2 and len(parts[0]) == 1 and 1 <= len(parts[1]) <= 3:
        return 0.3
    if len(parts) == 2 and len(parts[0]) <= 2 and len(parts[1]) == 1 and len(parts[1][0].rstrip(".")) <= 2:
        return 0.5
    return 3.0 * len(parts)


def split_packed(text: str | None, kind: str, known: ahocorasick.Automaton | None = None) -> list[str]:
    """Values of a field in order, empty ones left out; a missing field has none.

    ``kind`` is keyword, affiliation or person. ``known`` holds whole values that may contain
    delimiters. Very long fields are cut by the same rules; the work grows with the number of
    delimiters times the most that a known value holds.
    """
    if text is None or text.strip() in MISSING:
        return []
    stripped = text.strip()
    if stripped[0] == "[" and stripped[-1] == "]" and stripped[1:2] in ("'", '"'):
        try:
            listed = ast.literal_eval(stripped)
            if isinstance(listed, list):
                return [v for v in (_clean(str(x), kind) for x in listed) if v]
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
    weak = WEAK[kind]
    shield = _shielded(text, weak) if '"' in text or "[" in text else []
    quoted = any(text[a] == '"' for a, _ in shield)
    cuts: list[tuple[int, int, bool]] = []  # start, end, strong
    for m in STRONG.finditer(text):
        cuts.append((m.start(), m.end(), True))
    found = weak if weak is not None else re.compile(r",\s*") if quoted else None
    if found is not None:
        cuts += [(m.start(), m.end(), quoted and any(b == m.start() or text[b : m.start()].isspace() for a, b in shield)) for m in found.finditer(text)]
    if shield:
        cuts = [c for c in cuts if not any(a <= c[0] < b for a, b in shield)]
        if weak is None:  # outside quotes a comma belongs to the address
            cuts = [c for c in cuts if c[2]]
    if not cuts:
        value = _clean(text, kind)
        return [value] if value else []
    cuts.sort()
    if all(c[2] for c in cuts) and (known is None or next(known.iter(text), None) is None):
        bounds = [0, *(x for c in cuts for x in c[:2]), len(text)]
        return [v for v in (_clean(text[a:b], kind) for a, b in zip(bounds[::2], bounds[1::2])) if v]
    return _cover(text, kind, cuts, known)


def whole_values(text: str, kind: str) -> list[str]:
    """Values of a field that are whole beyond doubt: listed and quoted ones, and those between strong delimiters."""
    values = split_packed(text, kind)
    if text.lstrip()[:1] == "[" and text.lstrip()[1:2] in ("'", '"'):
        return values
    if '"' in text:
        shield = _shielded(text, WEAK[kind])
        quoted = {_clean(text[a:b], kind) for a, b in shield if text[a] == '"'}
        return [v for v in values if v in quoted]
    if "[" in text:
        return []
    return [v for v in (_clean(p, kind) for p in STRONG.split(text)) if v] if STRONG.search(text) else []


def parts_of(value: str, kind: str) -> list[str]:
    """What a value falls into at its delimiters; nothing if it holds none."""
    pattern = STRONG if WEAK[kind] is None else re.compile(f"{STRONG.pattern}|{WEAK[kind].pattern}")
    parts = [p.strip() for p in pattern.split(value)]
    return [p for p in parts if p] if len(parts) > 1 else []


def _cover(text: str, kind: str, cuts: list[tuple[int, int, bool]], known) -> list[str]:
    starts, ends = [0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(text)]
    whole: set[tuple[int, int]] = set()
    if known is not None:
        at_start = {s + len(text[s:]) - len(text[s:].lstrip(' "')): i for i, s in reversed(list(enumerate(starts)))}
        at_end = {len(text[:e].rstrip(' "')): i for i, e in reversed(list(enumerate(ends)))}
        for last, value in known.iter(text):
            i, j = at_start.get(last + 1 - len(value)), at_end.get(last + 1)
            if i is not None and j is not None and i <= j:
                whole.add((i, j))
    reach = max([2, *(j - i + 1 for i, j in whole)]) if kind != "person" else 3
    n = len(starts)
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for j in range(n):
        for i in range(max(0, j - reach + 1), j + 1):
            inner = cuts[i:j]
            if any(c[2] for c in inner) and (i, j) not in whole:
                continue
            piece = text[starts[i] : ends[j]].strip()
            if not piece:
                cost = 0.0
            elif (i, j) in whole:
                cost = KNOWN
            elif kind == "person":
                cost = _person(piece)
            else:
                cost = UNKNOWN + SWALLOW_WEAK * len(inner)
            if best[i] + cost < best[j + 1]:
                best[j + 1], back[j + 1] = best[i] + cost, i
    out: list[str] = []
    j = n
    while j > 0:
        i = back[j]
        value = _clean(text[starts[i] : ends[j - 1]], kind)
        if value:
            out.append(value)
        j = i
    return out[::-1]


def _clean(piece: str, kind: str) -> str:
    piece = _unquote(piece)
    if kind == "affiliation" and "[" in piece:
        piece = _BRACKET.sub("", piece)
    piece = piece.strip()
    return "" if piece in MISSING else piece
