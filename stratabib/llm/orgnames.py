"""Spellings of organisation names: normal forms, and profiles that grow as matched spellings are merged.

An organisation is a place and a kind ("Ostbury" + "University of Petroleum"); both are learned from the rules.
A profile holds every spelling known of a place or a kind, with their initials. A name matches if its parts
match a place and a kind exactly, by one typing error, by abbreviation or by initials, but not both parts by such
likeness alone: one known part vouches for the other's new spelling. What matched is merged into the profile, and the
richer profile meets the names left over in the next round, so a name with two odd parts is linked once each of them
was met beside a known one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict

#: Traditional characters of organisation names and their simplified forms (fixed values).
TRADITIONAL = "師範學團質鑽煉氣業華東國實驗發開經濟儲層點係機車電術農醫資廠總處設計礦長門環學質關區灣島嶼龍濱陽陰廣黃齊魯漢遼寧綠鐵鋼運輸聯邦聖維爾蘭萊諾圖紐斯頓"
SIMPLIFIED = "师范学团质钻炼气业华东国实验发开经济储层点系机车电术农医资厂总处设计矿长门环学质关区湾岛屿龙滨阳阴广黄齐鲁汉辽宁绿铁钢运输联邦圣维尔兰莱诺图纽斯顿"
_SIMPLE = str.maketrans(TRADITIONAL, SIMPLIFIED)
STOP = {"the", "of", "and", "for", "at", "in", "de", "la"}

_CJK = re.compile("[一-鿿]")
_BRACKETS = re.compile(r"[(（\[【][^)）\]】]*[)）\]】]?")
_MARKS = re.compile(r"[^\w·]+|_")


def normal_form(name: str) -> str:
    """A name as compared: lower case, simplified characters, no brackets or marks; parts around '·' in Chinese order."""
    text = unicodedata.normalize("NFKC", name).replace("‧", "·").replace("・", "·").replace("•", "·")
    text = _BRACKETS.sub(" ", text).strip()
    if _CJK.search(text):
        text = text.translate(_SIMPLE)
        if "·" in text:
            a, _, b = text.partition("·")
            text = b + a
        return "".join(_MARKS.sub("", text).replace("·", "").lower().split())
    return " ".join(_MARKS.sub(" ", text.lower().replace("·", " ")).split())


def name_and_hints(affiliation: str) -> tuple[str, list[str]]:
    """The organisation's name in an affiliation, and the other parts of its address."""
    parts = [p.strip() for p in re.split(r"[,，]", affiliation)]
    hints = []
    for p in parts[1:]:
        hint = normal_form(re.sub(r"\d+", " ", p))
        if hint and " " not in hint:
            hints.append(hint)
    return normal_form(parts[0]), hints


def one_edit(a: str, b: str) -> bool:
    """Whether one letter inserted, left out, replaced or swapped with its neighbour makes a of b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    if len(a) > len(b):
        return a[i + 1 :] == b[i:]
    return a[i:] == b[i + 1 :]


def _deletes(word: str) -> set[str]:
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def _subsequence(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


class Profiles:
    """Places and kinds with all their known spellings."""

    def __init__(self):
        self.standard: dict[tuple[str, str], str] = {}
        self.place_zh: dict[str, str] = {}
        self.place_en: dict[str, str] = {}
        self.kind_zh: dict[str, str] = {}
        self.kind_en: dict[tuple[str, ...], str] = {}
        self.exact: dict[str, str] = {}
        self.foreign: dict[str, int] = {}
        self._ready = False

    # -- learning from the rules ------------------------------------------------------------------

    @classmethod
    def learn(cls, rules: list[tuple[str | None, str | None, str | None, str | None]]) -> Profiles:
        """From (raw name, translation, standard name, remark) rows."""
        self = cls()
        forms: dict[str, set[str]] = defaultdict(set)
        remarks: dict[str, list[str]] = defaultdict(list)
        for raw, trans, standard, remark in rules:
            if not standard or not standard.strip() or standard.strip() == "nan":
                continue
            standard = standard.strip()
            for f in (raw, trans, standard):
                if f and f.strip() and f.strip() != "nan" and (n := normal_form(f)):
                    forms[standard].add(n)
            remarks[standard] += re.findall(r"[A-Za-z][A-Za-z .&'-]+", (remark or "").split("说明")[0])
        names = {s: normal_form(s) for s in forms}
        split = _split_kinds(list(names.values()))
        for s, n in names.items():
            place, kind = split[n]
            self.standard[place, kind] = s
            self.place_zh[place] = place
            self.kind_zh[kind] = kind
            for f in forms[s]:
                # a spelling that two organisations share tells nothing
                self.exact[f] = s if self.exact.get(f, s) == s else ""
        for f in [f for f, s in self.exact.items() if not s]:
            del self.exact[f]
        # the token that goes with a place wherever it occurs, and with no other, is its name
        at, everywhere = defaultdict(Counter), Counter()
        for s, n in names.items():
            place = split[n][0]
            for f in forms[s]:
                if not _CJK.search(f):
                    for t in set(f.split()):
                        at[place][t] += 1
                        everywhere[t] += 1
            for r in remarks[s]:
                tokens = normal_form(r).split()
                for t in set(tokens):
                    weight = 3 if len(tokens) == 1 else 1
                    at[place][t] += weight
                    everywhere[t] += weight
        for place, tokens in at.items():
            t = max(tokens, key=lambda t: (tokens[t] ** 2 / everywhere[t], t))
            if t not in STOP and len(t) > 2 and tokens[t] >= 0.6 * everywhere[t]:
                self.place_en[t] = place
        of = defaultdict(set)
        for t, place in self.place_en.items():
            of[place].add(t)
        for s, n in names.items():
            place, kind = split[n]
            for f in sorted(forms[s] | {normal_form(r) for r in remarks[s] if " " in r.strip()}):
                if _CJK.search(f):
                    rest = f.removeprefix(place)
                    if rest != f and 2 <= len(rest) <= len(kind) + 1:
                        self.kind_zh.setdefault(rest, kind)
                    continue
                tokens = f.split()
                rest = tuple(t for t in tokens if t not in STOP and not any(t == x or (len(x) > 3 and one_edit(t, x)) for x in of[place]))
                if rest and len(rest) < len([t for t in tokens if t not in STOP]):
                    self.kind_en.setdefault(rest, kind)
        return self

    def merge(self, new_kinds: list[tuple[str, str]], new_places: list[tuple[str, str]]) -> int:
        """Unite spellings matched in a round with their profiles; the number of spellings that were new."""
        n = 0
        for spelling, kind in new_kinds:
            if _CJK.search(spelling):
                if spelling not in self.kind_zh:
                    self.kind_zh[spelling], n = kind, n + 1
            elif tuple(spelling.split()) not in self.kind_en:
                self.kind_en[tuple(spelling.split())], n = kind, n + 1
        for spelling, place in new_places:
            if spelling not in self.place_en and spelling not in self.foreign:
                self.place_en[spelling], n = place, n + 1
        self._ready = False
        return n

    # -- matching ---------------------------------------------------------------------------------

    def _prepare(self) -> None:
        if self._ready:
            return
        self.kind_words = {t for a in self.kind_en for t in a}
        self.near: dict[str, list[str]] = defaultdict(list)
        for t in [*self.place_en, *self.foreign]:
            if len(t) > 3:
                for d in _deletes(t):
                    self.near[d].append(t)
        self.blocks: dict[str, list[tuple[str, ...]]] = defaultdict(list)
        for a in self.kind_en:
            for key in _block_keys(a):
                self.blocks[key].append(a)
        self.kinds_zh = sorted(self.kind_zh, key=lambda k: (-len(k), k))
        self.full_zh = sorted(set(self.kind_zh.values()), key=lambda k: (-len(k), k))
        self.place_sizes = sorted({len(p) for p in self.place_zh}, reverse=True)
        self._kind_memo: dict[tuple[str, ...], str | None] = {}
        self._ready = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("standard", "place_zh", "place_en", "kind_zh", "kind_en", "exact", "foreign")} | {"_ready": False}

    def resolve(self, form: str, hints: list[str]) -> tuple[str | None, str, str, str, str]:
        """(standard name or None, place, kind, spelling of the kind if new, spelling of the place if new)."""
        self._prepare()
        if form in self.exact:
            return self.exact[form], "", "", "", ""
        found = self._resolve_zh(form, hints) if _CJK.search(form) else self._resolve_en(form, hints)
        if found is None:
            return None, "", "", "", ""
        place, kind, new_kind, new_place = found
        if new_kind and new_place:
            return None, "", "", "", ""
        return self.standard.get((place, kind)), place, kind, new_kind, new_place

    def _resolve_zh(self, form: str, hints: list[str]):
        for size in self.place_sizes:
            place = form[:size]
            if place in self.place_zh and len(form) > size:
                kind, spelling = self._kind_of_zh(form[size:])
                if kind:
                    return self.place_zh[place], kind, spelling, ""
        return None

    def _kind_of_zh(self, rest: str) -> tuple[str | None, str]:
        for k in self.kinds_zh:
            if rest.startswith(k):
                return self.kind_zh[k], ""
        best = sorted((sum(a != b for a, b in zip(rest, k)), k) for k in self.full_zh if len(rest) >= len(k))
        best = [(d, k) for d, k in best if d <= max(1, len(k) // 3) or (d == 2 and len(k) >= 5)]
        if best and (len(best) == 1 or best[0][0] < best[1][0]):
            return best[0][1], rest[: len(best[0][1])]
        if 2 <= len(rest) <= 6:
            fit = [k for k in self.full_zh if _subsequence(rest, k)]
            if len(fit) == 1:
                return fit[0], rest
        return None, ""

    def _resolve_en(self, form: str, hints: list[str]):
        tokens = [t for t in form.split() if t not in STOP]
        stated = [h for h in hints if h in self.place_en or h in self.foreign]
        at, place, new_place = None, None, ""
        for i, t in enumerate(tokens):
            if t in self.place_en or t in self.foreign:
                at, place = i, t
                break
        if at is None:
            # the address names the place cleanly where the name has a typing error
            for i, t in enumerate(tokens):
                if t in self.kind_words:
                    continue
                near = [h for h in stated if one_edit(t, h) or (len(h) > 5 and _two_edits(t, h))]
                if near:
                    at, place, new_place = i, near[0], t
                    break
        if at is None:
            for i, t in enumerate(tokens):
                if t in self.kind_words or len(t) < 4:
                    continue
                near = sorted({x for d in _deletes(t) for x in self.near.get(d, ()) if one_edit(t, x)})
                if len(near) == 1 and not any(one_edit(t, w) for w in self.kind_words if len(w) > 3 and len(t) > 3 and w[0] == t[0]):
                    at, place, new_place = i, near[0], t
                    break
        if at is None:
            return None
        rest = tuple(tokens[:at] + tokens[at + 1 :])
        kind, spelling = self._kind_of_en(rest)
        if kind is None or place not in self.place_en:
            return None
        return self.place_en[place], kind, spelling, new_place

    def _kind_of_en(self, rest: tuple[str, ...]) -> tuple[str | None, str]:
        if rest in self.kind_en:
            return self.kind_en[rest], ""
        if rest not in self._kind_memo:
            best: dict[str, float] = {}
            for a in {a for key in _block_keys(rest) for a in self.blocks.get(key, ())}:
                kind = self.kind_en[a]
                best[kind] = max(best.get(kind, 0.0), _alike(rest, a))
            scores = sorted(((v, kind) for kind, v in best.items()), reverse=True)
            good = scores and scores[0][0] >= 0.55 and (len(scores) < 2 or scores[0][0] - scores[1][0] >= 0.12)
            self._kind_memo[rest] = scores[0][1] if good else None
        return self._kind_memo[rest], " ".join(rest)


def _block_keys(tokens: tuple[str, ...]) -> set[str]:
    """First and second letters of the words: words that are alike at all share one, whatever one edit did to them."""
    return {c for t in tokens for c in t[:2]}


def _two_edits(a: str, b: str) -> bool:
    return abs(len(a) - len(b)) <= 2 and any(one_edit(x, y) for x in _deletes(a) for y in _deletes(b))


def _token_alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    short, long = (a, b) if len(a) < len(b) else (b, a)
    if len(short) >= 3 and long.startswith(short):
        return 0.92
    if len(short) >= 3 and len(long) >= 3 and one_edit(a, b):
        return 0.88
    if len(short) >= 3 and any(one_edit(short, long[:n]) for n in (len(short) - 1, len(short), len(short) + 1) if 3 <= n < len(long)):
        return 0.7
    if len(short) <= 2 and long[0] == short[0]:
        return 0.6
    return 0.0


def _alike(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """How well two spellings cover each other, token by token."""
    if not a or not b:
        return 0.0
    there = sum(max(_token_alike(x, y) for y in b) for x in a) / len(a)
    back = sum(max(_token_alike(x, y) for x in a) for y in b) / len(b)
    return (there + back) / 2


def _split_kinds(names: list[str]) -> dict[str, tuple[str, str]]:
    """Each standard name as place and kind: the kind is the ending that the most different characters precede."""
    before: dict[str, set[str]] = defaultdict(set)
    for n in set(names):
        for i in range(1, len(n)):
            before[n[i:]].add(n[i - 1])
    out = {}
    for n in names:
        cuts = range(2, len(n) - 1) if len(n) > 3 else range(1, max(2, len(n)))
        i = max(cuts, key=lambda i: (len(before[n[i:]]), -i), default=len(n))
        out[n] = (n[:i], n[i:])
    return out
