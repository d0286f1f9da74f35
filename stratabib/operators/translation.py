"""Names to Chinese standard names: rule precedence, word-level translation, review of the result."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratabib.functions import text as T
from stratabib.operators.institutions import alias_key

#: A small dictionary of organisation words (fixed values); larger ones are parameters.
WORDS = {
    "university": "大学", "institute": "研究所", "college": "学院", "academy": "科学院", "company": "公司", "group": "集团", "bureau": "局", "research": "研究", "geology": "地质", "geological": "地质",
    "petroleum": "石油", "ocean": "海洋", "normal": "师范", "technology": "理工", "energy": "能源", "drilling": "钻井", "oilfield": "油田", "refining": "炼化", "chemical": "化工", "geophysical": "地球物理", "survey": "勘探", "science": "科学", "national": "国家",
}
#: Sounds of letter groups, longest first (fixed values).
SOUNDS = {"shu": "舒", "lin": "林", "bur": "伯", "ost": "奥", "ka": "卡", "wi": "威", "lu": "鲁", "na": "纳", "do": "多", "va": "瓦", "a": "阿", "b": "布", "c": "克", "d": "德", "e": "埃", "f": "弗", "g": "格", "h": "赫", "i": "伊", "k": "克", "l": "尔", "m": "姆", "n": "恩", "o": "奥", "p": "普", "r": "尔", "s": "斯", "t": "特", "u": "乌", "v": "夫", "w": "沃", "y": "伊", "z": "兹", "j": "杰", "q": "奇", "x": "克斯"}
#: Numerals (fixed values).
DIGITS = "零一二三四五六七八九十"
#: Kinds of organisation that name none by themselves (fixed values).
GENERIC = ["大学", "学院", "研究院", "研究所", "公司", "集团", "中心", "实验室"]
#: Mentions from which a doubtful result is worth a reviewer's time (fixed values).
LOW, MEDIUM, HIGH = 20, 50, 100
#: Words of enterprises (fixed values).
ENTERPRISE = ["petrochina", "sinopec", "cnpc", "cnooc", "oilfield", "company", "corp"]
#: Reasons for review in their order, the signals that all must hold, and the mentions from which they count. A reason may
#: have several rows. The reasons' names are fixed values.
REVIEW = [
    ("empty_trans_or_norm", ("missing",), 0),
    ("norm_not_cjk", ("foreign",), HIGH),
    ("norm_not_cjk", ("foreign", "enterprise"), MEDIUM),
    ("high_freq_auto_result", ("bare",), HIGH),
    ("top_freq_needs_review", ("foreign", "derived"), HIGH),
    ("top_freq_needs_review", ("bare", "derived"), HIGH),
    ("generic_enterprise_alias", ("enterprise", "foreign"), MEDIUM),
    ("same_name_country_disambiguation", ("scattered", "acronym"), LOW),
    ("pending_disambiguation_label", ("pending",), 0),
]


def assemble_rules(tables: list[DataFrame], key: str = "name", value: str = "value") -> DataFrame:
    """One rule per key: that of the last table that has it, within a table the greatest value."""
    out = None
    for i, t in enumerate(tables):
        t = t.filter((F.trim(key) != "") & (F.trim(value) != "")).select(F.trim(key).alias(key), F.trim(value).alias(value), F.lit(i).alias("_p"))
        out = t if out is None else out.unionByName(t)
    best = out.groupBy(key).agg(F.max(F.struct("_p", value)).alias("_b"))
    return best.select(key, F.col("_b")[value].alias(value), F.col("_b._p").alias("priority"))


def translate_words(name: Column, words: dict[str, str] = WORDS) -> Column:
    """Known words of a name's key translated in their order, unknown ones kept."""
    m = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    parts = F.transform(F.split(alias_key(name), " "), lambda w: F.coalesce(F.try_element_at(m, w), w))
    return F.array_join(parts, "")


def transliterate(c: Column, sounds: dict[str, str] = SOUNDS) -> Column:
    """Latin letters by sound, the longest group first; other characters stay."""
    longest = max(map(len, sounds))

    def spell(s: pd.Series) -> pd.Series:
        def one(x: str) -> str:
            out, i, low = [], 0, x.lower()
            while i < len(x):
                for n in range(longest, 0, -1):
                    if low[i : i + n] in sounds and len(low[i : i + n]) == n:
                        out.append(sounds[low[i : i + n]])
                        i += n
                        break
                else:
                    out.append(x[i])
                    i += 1
            return "".join(out)

        return s.map(one, na_action="ignore")

    return F.pandas_udf(spell, "string")(c)


def chinese_number(n: Column) -> Column:
    """1 to 99 in words."""
    digit = lambda k: F.substring(F.lit(DIGITS), k + 1, F.lit(1))
    tens, ones = F.floor(n / 10).cast("int"), (n % 10).cast("int")
    tail = F.when(ones > 0, digit(ones)).otherwise("")
    return F.when(n <= 10, digit(n.cast("int"))).when(n < 20, F.concat(F.lit("十"), digit(ones))).otherwise(F.concat(digit(tens), F.lit("十"), tail))


def numbered_plant(name: Column) -> Column:
    """``No. 3 Oil Production Plant`` as 第三采油厂; NULL for other names."""
    pattern = r"(?i)^No\.?\s*([0-9]{1,2})\s+(Oil|Gas)\s+Production\s+Plant"
    n = F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int")
    kind = F.when(F.lower(F.regexp_extract(name, pattern, 2)) == "oil", "采油厂").otherwise("采气厂")
    return F.when(n.isNotNull(), F.concat(F.lit("第"), chinese_number(n), kind))


def defects(name: Column, result: Column) -> Column:
    """What is wrong with a Chinese rendering of a name, as an array of: missing, bare, latin, doubled, headless, stub.

    ``bare`` is a kind of organisation and nothing else, ``doubled`` holds a kind twice running, ``headless`` begins with a
    kind, ``stub`` is hardly longer than the kind it holds though the name isn't Chinese.
    """
    kinds = "|".join(GENERIC)
    foreign = ~T.has_cjk(name)
    found = {
        "missing": F.length(result) == 0,
        "bare": result.rlike(f"^(?:{kinds})$"),
        "latin": result.rlike("[A-Za-z]"),
        "doubled": result.rlike(f"({kinds})\\1"),
        "headless": foreign & result.rlike(f"^(?:{kinds})..."),
        "stub": foreign & result.rlike(f"^(?=.*(?:{kinds})).{{1,4}}$"),
    }
    return F.array_compact(F.array(*(F.when(holds, F.lit(label)) for label, holds in found.items())))


#: Defects that a word-level result can't be kept with.
FATAL = ["missing", "bare", "latin", "stub"]


def signals(name: Column, norm: Column, method: Column, n_countries: Column, main_share: Column) -> dict[str, Column]:
    """What is known of a result, by the names that REVIEW uses."""
    chinese = T.has_cjk(norm)
    return {
        "missing": norm == "",
        "foreign": (norm != "") & ~chinese,
        "bare": norm.isin(*GENERIC),
        "derived": (method != "exact") & ~((name == norm) & chinese),
        "enterprise": T.any_of(F.lower(name), ENTERPRISE),
        "scattered": (n_countries > 1) & (main_share < 0.9),
        "acronym": F.lower(name).rlike("^[a-z0-9]{1,6}$"),
        "pending": F.contains(norm, F.lit("待区分")),
    }


def review_reasons(known: dict[str, Column], count: Column, rules: list[tuple[str, tuple[str, ...], int]] | None = None) -> Column:
    """Reasons of ``rules`` (REVIEW) that hold, in their order, each once, joined; '' for none."""
    hits = []
    for reason, wanted, least in rules or REVIEW:
        holds = count >= least
        for w in wanted:
            holds = holds & known[w]
        hits.append(F.when(holds, F.lit(reason)))
    return F.array_join(F.array_distinct(F.array_compact(F.array(*hits))), " | ")


def translate_table(names: DataFrame, exact: DataFrame, keyed: DataFrame, shares: DataFrame) -> DataFrame:
    """``name, count`` with translation, norm, method and review: exact rule, else unique key, else Chinese as it is, else words, else raw."""
    rows = names.withColumn("_k", alias_key(F.col("name"))).join(exact.select("name", F.col("value").alias("_e")), "name", "left").join(keyed.select(F.col("key").alias("_k"), F.col("value").alias("_kv")), "_k", "left").join(shares.select("name", "n_countries", "main_share"), "name", "left")
    rows = rows.withColumn("_w", translate_words(F.col("name")))
    usable = ~F.arrays_overlap(defects(F.col("name"), F.col("_w")), F.array(*map(F.lit, FATAL)))
    by_rank = [("exact", F.col("_e"), F.col("_e").isNotNull()), ("canonical", F.col("_kv"), F.col("_kv").isNotNull()), ("raw_cjk", F.col("name"), T.has_cjk("name")), ("auto_word_level", F.col("_w"), usable)]
    method, norm = F.lit("raw_fallback"), F.col("name")
    for label, value, holds in reversed(by_rank):
        method, norm = F.when(holds, label).otherwise(method), F.when(holds, value).otherwise(norm)
    rows = rows.withColumns({"method": method, "norm": norm})
    known = signals(F.col("name"), F.col("norm"), F.col("method"), F.coalesce("n_countries", F.lit(0)), F.coalesce("main_share", F.lit(1.0)))
    rows = rows.withColumn("review_reason", review_reasons(known, F.col("count")))
    return rows.select("name", "count", F.col("_w").alias("words"), "norm", "method", (F.col("review_reason") != "").cast("int").alias("review_flag"), "review_reason")
