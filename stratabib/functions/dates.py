"""All valid readings of one written date.

``readings`` turns a written value into a list of ``(format, normal form, day, cost)``. The cost
states how far a reading departs from the declared conventions of its source; choosing among
readings is left to ``operators.timestamps``.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

Reading = tuple[str, str, float, float]

#: Departing from the declared order of slashed dates: less than two format switches, so that neighbours on both sides
#: that can only be read in another order outvote the declaration.
OTHER_ORDER = 0.7
#: Departing from the usual reading of a bare number.
UNUSUAL = 3.0
#: A year other than the one stated in the record.
OTHER_YEAR = 2.0
#: The second of the two instants that one local time names when clocks go back.
LATER_FOLD = 0.5

MONTHS = {m: i for i, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
SEASON = r"(?:spr(?:ing)?|sum(?:mer)?|aut(?:umn)?|fal(?:l)?|win(?:ter)?|春季?|夏季?|秋季?|冬季?|q[1-4])"
#: Hours east of Greenwich of zone abbreviations.
ABBREVIATED = {
    "utc": 0, "gmt": 0, "z": 0, "wet": 0, "bst": 1, "west": 1, "cet": 1, "cest": 2, "eet": 2, "eest": 3, "msk": 3,
    "est": -5, "edt": -4, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7, "jst": 9, "kst": 9, "hkt": 8,
}
CLOCK = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,]\d+)?)?"
ZONE = r"(?P<zone>z|(?:utc|gmt)?\s*[+-]\d{1,2}(?::?\d{2})?|" + "|".join(sorted((k for k in ABBREVIATED if k != "z"), key=len, reverse=True)) + r")"
TIME = rf"(?P<half>上午|下午|中午|晚上|凌晨)?\s*{CLOCK}\s*(?P<ampm>[ap]\.?m\.?)?\s*{ZONE}?"
WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_AT = rf"(?:[\st,]\s*{TIME})?"

_PATTERNS = [
    ("ymd", rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}}){_AT}"),
    ("ym", r"(?P<y>\d{4})[-/.](?P<m>\d{1,2})"),
    ("zh", rf"(?P<y>\d{{4}})\s*年\s*(?:(?P<m>\d{{1,2}})\s*月\s*(?:(?P<d>\d{{1,2}})\s*[日号]?)?)?(?:\s*{TIME})?"),
    ("slash", rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<c>\d{{4}}|\d{{2}}){_AT}"),
    ("mdy", rf"{WEEKDAY}(?P<mon>{MONTH})\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_AT}"),
    ("dmy", rf"{WEEKDAY}(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+(?P<mon>{MONTH})[\s,-]+(?P<y>\d{{4}}){_AT}"),
    ("ymon", rf"(?P<y>\d{{4}})[\s-]+(?P<mon>{MONTH})(?:[\s-]+(?P<d>\d{{1,2}}))?"),
    ("my", rf"(?P<mon>{MONTH})[\s,-]+(?P<y>\d{{4}})"),
    ("span", rf"{MONTH}\s*[-/–]\s*{MONTH}[\s,]+(?P<y>\d{{4}})"),
    ("span", rf"(?P<y>\d{{4}})[\s,-]*{MONTH}\s*[-/–]\s*{MONTH}"),
    ("season", rf"{SEASON}[\s,-]+(?P<y>\d{{4}})|(?P<y2>\d{{4}})\s*年?[\s,-]*{SEASON}"),
    ("md", rf"(?P<mon>{MONTH})\s+(?P<d>\d{{1,2}})"),
    ("dm", rf"(?P<d>\d{{1,2}})\s+(?P<mon>{MONTH})"),
    ("m", rf"(?P<mon>{MONTH})"),
    ("zhm", r"(?P<m>\d{1,2})\s*月(?:\s*(?P<d>\d{1,2})\s*[日号])?"),
    ("number", r"(?P<n>\d{4,19})"),
    ("fraction", r"(?P<n>\d{5})\.(?P<f>\d+)"),
]
PATTERNS = [(name, re.compile(pattern, re.I)) for name, pattern in _PATTERNS]
_YEAR = re.compile(r"(?<!\d)((?:19|20)\d{2})(?!\d)")
_FLOATED = re.compile(r"(?<=\d)\.0+$")
_DIGIT = re.compile(r"\d")
_NORMAL = re.compile(r"\d{4}(?:-\d{2}(?:-\d{2}(?:T\d{2}:\d{2}:\d{2}Z)?)?)?")


def stated_year(value: str | None) -> int | None:
    """The four-digit year stated in a year field in any writing, else None."""
    if not value:
        return None
    found = _YEAR.search(unicodedata.normalize("NFKC", value))
    return int(found[1]) if found else None


def _names(shape: str) -> tuple[int, ...]:
    """Patterns that match a value with all digits replaced by 1: digits never decide which match."""
    return tuple(i for i, (_, pattern) in enumerate(PATTERNS) if pattern.fullmatch(shape))


_names_of_short = lru_cache(maxsize=4096)(_names)


@lru_cache(maxsize=64)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except Exception:
        return None


def _instants(local: datetime, zone_text: str | None, zone_name: str | None) -> list[tuple[str, datetime, float]]:
    """(format suffix, UTC instant, cost) of a local time."""
    if zone_text:
        text = re.sub(r"\s", "", zone_text.lower())
        signed = re.fullmatch(r"(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?", text)
        if signed:
            offset = timedelta(hours=int(signed[2]), minutes=int(signed[3] or 0)) * (1 if signed[1] == "+" else -1)
        elif text in ABBREVIATED:
            offset = timedelta(hours=ABBREVIATED[text])
        else:
            return []
        return [("+zone", local - offset, 0.0)]
    zone = _zone(zone_name) if zone_name else None
    if zone is None:
        return [("+utc", local, 0.0)]
    first = local.replace(tzinfo=zone, fold=0).astimezone(timezone.utc).replace(tzinfo=None)
    later = local.replace(tzinfo=zone, fold=1).astimezone(timezone.utc).replace(tzinfo=None)
    if later > first:  # clocks go back: one writing, two instants
        return [("+local", first, 0.0), ("+local", later, LATER_FOLD)]
    return [("+local", first, 0.0)]


def _day_number(y: int, m: int = 1, d: int = 1) -> float:
    return float(date(y, m, d).toordinal())


def _dated(name: str, y: int, m: int, d: int, group: dict, zone_name: str | None, cost: float) -> list[Reading]:
    """Readings of a day, with a clock time if the groups hold one."""
    try:
        day = date(y, m, d)
    except ValueError:
        return []
    if group.get("H") is None:
        return [(name, day.isoformat(), float(day.toordinal()), cost)]
    hour, minute, second = int(group["H"]), int(group["M"]), int(group["S"] or 0)
    ampm, half = (group.get("ampm") or "").lower()[:1], group.get("half") or ""
    if ampm == "p" or half in ("下午", "晚上", "中午"):
        hour = hour + 12 if hour < 12 and not (half == "中午" and hour > 9) else hour
    elif (ampm == "a" or half in ("上午", "凌晨")) and hour == 12:
        hour = 0
    if second == 60:
        second = 59
    if hour == 24 and minute == second == 0:
        hour, day = 0, day + timedelta(days=1)
    try:
        local = datetime(day.year, day.month, day.day, hour, minute, second)
    except ValueError:
        return []
    out = []
    for suffix, at, more in _instants(local, group.get("zone"), zone_name):
        out.append((name + suffix, at.strftime("%Y-%m-%dT%H:%M:%SZ") if at.year > 999 else "", at.timestamp() / 86400 + _EPOCH, cost + more))
    return out


_EPOCH = float(date(1970, 1, 1).toordinal())


def _plausible(y: int) -> bool:
    return 1900 <= y <= 2100


def _monthly(name: str, y: int, m: int, cost: float) -> list[Reading]:
    if 1 <= m <= 12:
        return [(name, f"{y:04d}-{m:02d}", _day_number(y, m), cost)]
    return _yearly(name, y, cost)


def _yearly(name: str, y: int, cost: float) -> list[Reading]:
    return [(name, f"{y:04d}", _day_number(y), cost)] if y > 0 else []


def _epoch(name: str, seconds: float, cost: float) -> list[Reading]:
    at = datetime(1970, 1, 1) + timedelta(seconds=seconds)
    return [(name, at.strftime("%Y-%m-%dT%H:%M:%SZ"), seconds / 86400 + _EPOCH, cost)] if _plausible(at.year) else []


def _number(n: str, zone_name: str | None) -> list[Reading]:
    size, value = len(n), int(n)
    out: list[Reading] = []
    if size == 4:
        return _yearly("year", value, 0.0) if value >= 1000 else []
    if size == 5:
        for name, start, cost in (("serial", date(1899, 12, 30), 0.0), ("serial1904", date(1904, 1, 1), UNUSUAL)):
            day = start + timedelta(days=value)
            if _plausible(day.year):
                out.append((name, day.isoformat(), float(day.toordinal()), cost))
    if size == 6 and _plausible(int(n[:4])) and 1 <= int(n[4:]) <= 12:
        out += _monthly("yyyymm", int(n[:4]), int(n[4:]), 0.0)
    if size == 6:
        out += _dated("yymmdd", 2000 + int(n[:2]), int(n[2:4]), int(n[4:]), {}, zone_name, UNUSUAL if out else 0.0)
    if size in (8, 12, 14, 17) and _plausible(int(n[:4])):
        clock = {"H": n[8:10], "M": n[10:12], "S": n[12:14]} if size > 8 else {}
        out += _dated(f"digits{size}", int(n[:4]), int(n[4:6]), int(n[6:8]), clock, zone_name, 0.0)
        if not out and size == 8 and n[6:] == "00":
            out += _monthly("digits8", int(n[:4]), int(n[4:6]), 0.0)
    if size == 8 and _plausible(int(n[4:])):
        for name, d, m in (("ddmmyyyy", n[:2], n[2:4]), ("mmddyyyy", n[2:4], n[:2])):
            out += _dated(name, int(n[4:]), int(m), int(d), {}, zone_name, UNUSUAL)
    if size in (9, 10):
        out += _epoch("seconds", value, 0.0)
    if size == 10 and _plausible(int(n[:4])):
        out += _dated("digits10", int(n[:4]), int(n[4:6]), int(n[6:8]), {"H": n[8:], "M": "00", "S": "00"}, zone_name, UNUSUAL)
    for digits, name, unit in ((13, "millis", 1e3), (16, "micros", 1e6), (19, "nanos", 1e9)):
        if size == digits:
            out += _epoch(name, value // int(unit), 0.0)
    return out


_ORDERS = {"YMD": "ymd", "MDY": "mdy", "DMY": "dmy"}


def _slashed(g: dict, order: str | None, zone_name: str | None) -> list[Reading]:
    """Every order that gives a day; the declared one without cost."""
    out: list[Reading] = []
    declared = _ORDERS.get((order or "").strip().upper())
    for kind in ("ymd", "mdy", "dmy"):
        part = dict(zip(kind, (g["a"], g["b"], g["c"])))
        if kind == "ymd" and len(g["c"]) == 4:
            continue
        y = int(part["y"]) + (2000 if len(part["y"]) <= 2 else 0)
        out += _dated(f"slash-{kind}", y, int(part["m"]), int(part["d"]), g, zone_name, 0.0 if kind == declared or declared is None else OTHER_ORDER)
    if len(g["c"]) == 4 and declared == "ymd" and out:  # a four-digit year last can't follow it: the order stays open
        out = [(f, n, t, c - OTHER_ORDER) for f, n, t, c in out]
    return out


def readings(value: str | None, year: str | None = None, zone_name: str | None = None, order: str | None = None) -> list[Reading]:
    """All valid readings of ``value``; empty for missing values, placeholders and what states no year.

    ``year`` is the record's year field: it completes a month or a day without year, and any reading
    of another year costs ``OTHER_YEAR`` more. Readings are distinct in their normal form, the cheapest
    format kept.
    """
    if value is None:
        return []
    text = unicodedata.normalize("NFKC", value).strip()
    if not text:
        return []
    text = _FLOATED.sub("", text)
    stated = stated_year(year)
    out: list[Reading] = []
    shape = _DIGIT.sub("1", text)
    for i in _names_of_short(shape) if len(shape) <= 64 else _names(shape):
        name, pattern = PATTERNS[i]
        g = pattern.fullmatch(text)
        if g is None:
            continue
        g = g.groupdict()
        if name == "number":
            out += _number(g["n"], zone_name)
            continue
        if name == "fraction":
            at = datetime(1899, 12, 30) + timedelta(days=float(f"{g['n']}.{g['f']}"))
            if _plausible(at.year):
                out += _dated("serial", at.year, at.month, at.day, {"H": at.hour, "M": at.minute, "S": at.second}, zone_name, 0.0)
            continue
        if name == "slash":
            out += _slashed(g, order, zone_name)
            continue
        if name in ("span", "season"):
            out += _yearly(name, int(g.get("y") or g.get("y2")), 0.0)
            continue
        y = int(g["y"]) if g.get("y") else None
        m = MONTHS[g["mon"][:3].lower()] if g.get("mon") else int(g["m"]) if g.get("m") else None
        d = int(g["d"]) if g.get("d") else None
        if y is None:
            y = stated
            if y is None:
                continue
        if y < 1000:
            continue
        if m is None or not 1 <= m <= 12:
            out += _yearly(name, y, 0.0)
        elif d is None:
            out += _monthly(name, y, m, 0.0)
        elif d == 0:
            out += _monthly(name, y, m, 0.0)
        else:
            days = _dated(name, y, m, d, g, zone_name, 0.0)
            if not days and name in ("md",) and d > 31:
                days = _monthly("my", 2000 + d, m, 0.0)
            out += days or (_monthly(name, y, m, 1.0) if g.get("H") is None else [])
    best: dict[str, Reading] = {}
    for fmt, norm, day, cost in out:
        if stated is not None and norm[:4] != str(stated):
            # an instant in UTC may fall into the neighbouring year
            cost += 0.0 if len(norm) > 10 and abs(int(norm[:4]) - stated) == 1 and norm[5:10] in ("01-01", "12-31") else OTHER_YEAR
        if norm and (norm not in best or cost < best[norm][3]):
            best[norm] = (fmt, norm, day, cost)
    return sorted(best.values(), key=lambda r: (r[3], r[1]))


def is_normal(value: str) -> bool:
    return _NORMAL.fullmatch(value) is not None
