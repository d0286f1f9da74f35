"""Scalar Column functions over bibliographic text. A missing value is NULL, '' or the text ``nan``."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
CJK = "[\\u4e00-\\u9fff]"
DOI_EDGES = "()[]{}<>.,;"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    """Trimmed text; '' for NULL and for ``nan`` in any case."""
    t = F.regexp_replace(col(c).cast("string"), r"^\s+|\s+$", "")
    return F.when(t.isNull() | (F.lower(t) == "nan"), "").otherwise(t)


def first_nonempty(*columns: Column | str) -> Column:
    return F.coalesce(*(F.nullif(text_or_empty(c), F.lit("")) for c in columns), F.lit(""))


def compact(c: Column | str) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"(?U)\s+", " "), "^ | $", "")


def nfkc(c: Column | str) -> Column:
    """Compatibility composition; Spark has no built-in for it."""

    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.pandas_udf(compose, "string")(col(c))


def strip_accents(c: Column | str) -> Column:
    def strip(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "".join(k for k in unicodedata.normalize("NFKD", x) if not unicodedata.combining(k)), na_action="ignore")

    return F.pandas_udf(strip, "string")(col(c))


def to_int(c: Column | str) -> Column:
    """Lenient integer: '' and junk are 0, '12.7' is 12."""
    number = text_or_empty(c).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number.try_cast("bigint")), F.lit(0))


def to_float(c: Column | str) -> Column:
    number = text_or_empty(c).try_cast("double")
    return F.coalesce(F.when(~F.isnan(number), number), F.lit(0.0))


def safe_ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded; 0 where b is 0."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))


def year_text(c: Column | str) -> Column:
    return F.regexp_extract(text_or_empty(c), "(?:19|20)[0-9]{2}", 0)


def year_int(c: Column | str) -> Column:
    return F.nullif(year_text(c), F.lit("")).cast("int")


def publish_month(c: Column | str) -> Column:
    """``YYYY-MM``, ``YYYY-00`` without a month, or the text itself if it states no year; of several years and months the last."""
    t = text_or_empty(c)
    tokens = F.split(F.regexp_replace(t, r"\.", " "), r"\s+")
    year = F.element_at(F.concat(F.array(F.lit("")), F.filter(tokens, lambda x: x.rlike("^[0-9]{4}$"))), -1)
    number = F.create_map(*(x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))))
    month = F.element_at(F.concat(F.array(F.lit("00")), F.transform(F.filter(tokens, lambda x: F.lower(x).isin(*MONTHS)), lambda x: F.try_element_at(number, F.lower(x)))), -1)
    return (
        F.when(t.rlike("^[0-9]{4}-[0-9]{2}"), F.substring(t, 1, 7))
        .when(t.rlike(r"^[0-9]{4}(\.0+)?$"), F.concat(F.substring(t, 1, 4), F.lit("-00")))
        .when(year != "", F.concat(year, F.lit("-"), month))
        .otherwise(t)
    )


def _doi(c: Column | str, pattern: str) -> Column:
    t = F.regexp_replace(text_or_empty(c), r"(?i)^(doi:\s*|https?://(dx\.)?doi\.org/)", "")
    return F.lower(F.trim(F.regexp_extract(t, pattern, 0), F.lit(DOI_EDGES)))


def doi_strict(c: Column | str) -> Column:
    """The standard DOI in a value: 10., four to nine digits, a suffix; else ''."""
    return _doi(c, r"10\.[0-9]{4,9}/\S+")


def doi_loose(c: Column | str) -> Column:
    return _doi(c, r"10\.\S+")


def candidate_doi(doi: Column | str, registered: Column | str) -> Column:
    return F.coalesce(F.nullif(doi_strict(doi), F.lit("")), doi_strict(registered))


def source_id_key(source: Column | str, raw: Column | str, standard: Column) -> Column:
    """An identifier that holds within its source only, where there is no standard DOI."""
    t = text_or_empty(raw)
    return F.when((standard == "") & (t != ""), F.concat(col(source), F.lit(":"), F.lower(t))).otherwise("")


def key_text(c: Column | str) -> Column:
    """Letters and digits of any script, lower case."""
    return F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)[\W_]+", "")


def ascii_key(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "")


def first_author_key(c: Column | str) -> Column:
    """Name parts of the first author in sorted order, joined by '|'; other scripts as key text."""
    first = F.element_at(F.split(F.lower(text_or_empty(c)), "[;；,，]"), 1)
    parts = F.array_sort(F.regexp_extract_all(first, F.lit("[a-z0-9]+"), 0))
    return F.when(first.rlike("[a-z]"), F.array_join(parts, "|")).otherwise(key_text(first))


#: Shortest title of a metadata key with a journal and without (fixed values).
TITLE_WITH_JOURNAL, TITLE_ALONE = 8, 20


def meta_key(title: Column, year: Column, author_key: Column, journal: Column | None = None) -> Column:
    """title|year|author, with |journal if one is given; '' where a part is missing or the title is too short to tell works apart."""
    t = key_text(title)
    parts = [t, year, author_key] if journal is None else [t, year, author_key, key_text(journal)]
    whole = F.length(t) >= (TITLE_ALONE if journal is None else TITLE_WITH_JOURNAL)
    for p in parts[1:]:
        whole = whole & (p != "")
    return F.when(whole, F.concat_ws("|", *parts)).otherwise("")


def title_for_key(title_en: Column | str, title_cn_en: Column | str, title_cn: Column | str) -> Column:
    """The English title; else the longest part with Latin letters of the joint title, else its longest part; else the Chinese title."""
    parts = F.filter(F.transform(F.split(text_or_empty(title_cn_en), r"\|"), F.trim), lambda x: x != "")
    latin = F.filter(parts, lambda x: x.rlike("[a-zA-Z]"))
    longest = lambda a: F.aggregate(a, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return first_nonempty(title_en, F.when(F.size(latin) > 0, longest(latin)).otherwise(longest(parts)), title_cn)


def join_parts(*columns: Column | str, sep: str = " | ") -> Column:
    """Distinct non-empty parts in order."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*(F.nullif(text_or_empty(c), F.lit("")) for c in columns)))), sep)


def split_list(c: Column | str, pattern: str) -> Column:
    """Trimmed, non-empty parts."""
    return F.filter(F.transform(F.split(text_or_empty(c), pattern), F.trim), lambda x: x != "")


def decode_mask(mask: Column, names: dict[int, str], none: str = "single") -> Column:
    found = F.array_compact(F.array(*(F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in names.items())))
    return F.when(F.size(found) == 0, none).otherwise(F.array_join(found, "|"))


def quality(columns: list[str]) -> tuple[Column, Column]:
    """(number of non-empty fields, their total length)."""
    values = F.array(*(text_or_empty(c) for c in columns))
    return F.size(F.filter(values, lambda x: x != "")), F.aggregate(values, F.lit(0), lambda a, x: a + F.length(x))


def has_cjk(c: Column | str) -> Column:
    return col(c).rlike(CJK)


def strip_private(c: Column | str) -> Column:
    """Without private-use characters, which broken fonts and encodings leave."""
    return F.regexp_replace(col(c), "[\\x{E000}-\\x{F8FF}]", "")


def safe_filename(c: Column | str) -> Column:
    return F.translate(col(c), '<>:"/\\|?*', "_________")


def word_match(c: Column, words: list[str]) -> Column:
    """Whether one of the words occurs, not inside a longer Latin word."""
    return F.lower(c).rlike("(?<![a-z0-9])(?:" + "|".join(words) + ")(?![a-z0-9])")


def any_of(c: Column, parts: list[str]) -> Column:
    return c.rlike("|".join(parts))


def publish_period(year: Column, periods: list[tuple[str, int, int]]) -> Column:
    out = F.lit("")
    for label, a, b in reversed(periods):
        out = F.when(year.between(a, b), label).otherwise(out)
    return out
