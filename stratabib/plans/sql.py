"""SQL fragments shared by the queries' SQL, in the dialect the driver runs."""

from __future__ import annotations

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def text(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR lower({trim(c)}) = 'nan' THEN '' ELSE {trim(c)} END)"


def first(*cols: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({text(c)}, '')" for c in cols) + ", '')"


def year_text(c: str) -> str:
    return f"regexp_extract({text(c)}, '(19|20)[0-9]{{2}}', 0)"


def year_int(c: str) -> str:
    return f"CAST(nullif({year_text(c)}, '') AS INTEGER)"


def number(c: str) -> str:
    return f"coalesce(TRY_CAST({text(c)} AS DOUBLE), 0.0)"


def doi(c: str, pattern: str = r"10\.[0-9]{4,9}/\S+") -> str:
    stripped = rf"regexp_replace({text(c)}, '^(doi:\s*|https?://(dx\.)?doi\.org/)', '', 'i')"
    return f"lower(trim(regexp_extract({stripped}, '{pattern}', 0), '()[]{{}}<>.,;'))"


def ascii_key(c: str) -> str:
    return f"regexp_replace(lower({text(c)}), '[^a-z0-9]+', '', 'g')"


def author_key(c: str) -> str:
    head = f"list_extract(regexp_split_to_array(lower({text(c)}), '[;；,，]'), 1)"
    return f"array_to_string(list_sort(regexp_extract_all({head}, '[a-z0-9]+')), '|')"


def ratio(a: str, b: str, digits: int = 4) -> str:
    return f"coalesce(round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {digits}), 0.0)"


def publish_month(c: str) -> str:
    t = text(c)
    tokens = rf"regexp_split_to_array(regexp_replace({t}, '\.', ' ', 'g'), '\s+')"
    cases = " ".join(f"WHEN '{m}' THEN '{i:02d}'" for i, m in enumerate(MONTHS, 1))
    names = ", ".join(f"'{m}'" for m in MONTHS)
    year = f"coalesce(list_extract(list_filter({tokens}, lambda x: regexp_full_match(x, '[0-9]{{4}}')), -1), '')"
    month = f"coalesce((CASE list_extract(list_filter(list_transform({tokens}, lambda x: lower(x)), lambda x: x IN ({names})), -1) {cases} END), '00')"
    return rf"""(CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}') THEN substring({t}, 1, 7)
      WHEN regexp_matches({t}, '^[0-9]{{4}}(\.0+)?$') THEN substring({t}, 1, 4) || '-00'
      WHEN {year} <> '' THEN {year} || '-' || {month} ELSE {t} END)"""
