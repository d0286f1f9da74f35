"""Institution names: splitting, cleaning, frequencies, lookups and types."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratabib.functions import text as T

EDGES = " ,;、。."
#: Country names as sources write them (fixed values); the part after the last comma is used as written if unknown.
COUNTRIES = {"PEOPLES R CHINA": "China", "CHINA": "China", "USA": "United States", "UNITED STATES": "United States", "UK": "United Kingdom", "ENGLAND": "United Kingdom", "SCOTLAND": "United Kingdom"}
SUBUNITS = ["department", "dept", "school", "college", "laboratory", "lab", "faculty", "division"]
ORGANISATIONS = ["univ", "university", "institute", "academy", "company", "corporation", "oilfield", "research center"]


def clean_name(c: Column) -> Column:
    """Without what follows '!', edge marks, or a role standing alone."""
    t = F.trim(F.element_at(F.split(T.compact(c), "!"), 1), F.lit(EDGES))
    t = F.regexp_replace(t, r"(?i)\s*(教授|博士|硕士|研究员|professor|ph\.?d\.?)$", "")
    return F.trim(t, F.lit(EDGES))


def _split(c: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(T.text_or_empty(c), pattern), clean_name), lambda x: x != "")


def split_cnki(c: Column) -> Column:
    return _split(c, r"[|;；\n]")


def split_merged(c: Column) -> Column:
    return _split(c, r"\|")


def wos_blocks(c: Column) -> Column:
    """Address blocks without the bracketed authors before them."""
    return F.filter(F.transform(F.split(F.regexp_replace(T.text_or_empty(c), r"\[[^\]]*\]", ""), r"[;|\n]"), F.trim), lambda x: x != "")


def split_wos(c: Column) -> Column:
    return F.filter(F.transform(wos_blocks(c), lambda b: clean_name(F.element_at(F.split(b, ","), 1))), lambda x: x != "")


def split_cscd(c: Column) -> Column:
    """``Author, Organisation, City.; ...``: the second part of a block, or the third if the second is a sub-unit of it."""
    blocks = F.filter(F.transform(F.split(T.compact(T.text_or_empty(c)), r"\.\s*;\s*|\.\s*$"), F.trim), lambda x: x != "")

    def name(b: Column) -> Column:
        parts = F.filter(F.transform(F.split(b, ","), F.trim), lambda x: x != "")
        second, third = F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.coalesce(F.get(parts, F.lit(2)), F.lit(""))
        second = F.trim(F.element_at(F.split(second, ";"), -1))
        parent = T.any_of(F.lower(second), SUBUNITS) & T.any_of(F.lower(third), ORGANISATIONS)
        return clean_name(F.when(parent, third).otherwise(second))

    return F.filter(F.transform(blocks, name), lambda x: x != "")


def names_by_source(source: Column, institution: Column, extracted: Column) -> Column:
    """Names in a record, split as its source writes them."""
    return (
        F.when(source == "MERGED", split_merged(T.first_nonempty(extracted, institution)))
        .when(source == "CNKI", split_cnki(T.first_nonempty(extracted, institution)))
        .when(source == "WOS", split_wos(institution))
        .when(source == "CSCD", split_cscd(institution))
        .otherwise(F.array().cast("array<string>"))
    )


def country_of(block: Column) -> Column:
    """Country at the end of an address block."""
    tail = F.trim(F.regexp_replace(F.element_at(F.split(block, ","), -1), r"[.;]+$", ""))
    table = F.create_map(*(F.lit(x) for kv in COUNTRIES.items() for x in kv))
    return F.when(F.contains(block, F.lit(",")), F.coalesce(F.try_element_at(table, F.upper(tail)), tail)).otherwise("")


def country_pairs(source: Column, institution: Column, extracted: Column) -> Column:
    """``array<struct<name, country>>``; sources other than WOS are Chinese."""
    wos = F.transform(wos_blocks(institution), lambda b: F.struct(clean_name(F.element_at(F.split(b, ","), 1)).alias("name"), country_of(b).alias("country")))
    rest = F.transform(F.array_sort(F.array_distinct(names_by_source(source, institution, extracted))), lambda n: F.struct(n.alias("name"), F.lit("China").alias("country")))
    return F.array_distinct(F.filter(F.when(source == "WOS", wos).otherwise(rest), lambda p: p["name"] != ""))


def serialize_pairs(pairs: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(pairs, lambda p: F.concat(p["name"], F.lit("@@"), p["country"]))), " || ")


def parse_pairs(c: Column) -> Column:
    items = F.filter(F.transform(F.split(T.text_or_empty(c), r"\|\|"), F.trim), lambda x: x != "")
    return F.array_distinct(F.transform(items, lambda x: F.struct(F.trim(F.element_at(F.split(x, "@@", 2), 1)).alias("name"), F.trim(F.coalesce(F.get(F.split(x, "@@", 2), F.lit(1)), F.lit(""))).alias("country"))))


def name_frequency(rows: DataFrame, names: Column, source: str, sources: list[str]) -> DataFrame:
    """Records that have each name, in all and by source; a name counts once a record."""
    long = rows.select(source, F.explode(F.array_distinct(names)).alias("name"))
    return long.groupBy("name").agg(F.count(F.lit(1)).alias("count"), *(F.count_if(F.col(source) == s).alias(f"{s.lower()}_count") for s in sources))


def norm_frequency(frequency: DataFrame, mapping: DataFrame, counts: list[str]) -> DataFrame:
    """Frequencies of raw names summed over their normalised names; generic and pending names left out."""
    joined = frequency.join(mapping, "name").filter(~skip_norm(F.col("norm")))
    return joined.groupBy("norm").agg(*(F.sum(c).alias(c) for c in counts))


def skip_norm(norm: Column) -> Column:
    """Names too general to count: blank, to be told apart, or one of the bare kinds."""
    return (F.trim(norm) == "") | F.contains(norm, F.lit("待区分")) | norm.isin("大学", "学院", "公司", "研究院", "研究所", "university", "institute", "company")


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def dominant_alias(rows: DataFrame, key: str, value: str, weight: str) -> DataFrame:
    """The value a key's votes settle on: alone, twice the second's weight, 20 ahead, or of weight 100."""
    votes = rows.groupBy(key, value).agg(F.sum(weight).alias("w"))
    two = F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("w", value)))), 1, 2)
    g = votes.groupBy(key).agg(two.alias("t"))
    first, second = F.col("t")[0], F.get("t", F.lit(1))
    settled = second.isNull() | (first["w"] >= second["w"] * 2) | (first["w"] - second["w"] >= 20) | (first["w"] >= 100)
    return g.filter(settled).select(key, first[value].alias(value), first["w"].alias("weight"))


def fallback_lookup(names: DataFrame, tiers: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """The first tier that knows a name: ``(label, key column, table(key, value))`` in order; ``value`` and ``tier`` per name."""
    out = names
    value, tier = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (label, key, lookup) in enumerate(tiers):
        out = out.join(lookup.select(F.col(key).alias(f"_k{i}"), F.col("value").alias(f"_v{i}")), F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        value, tier = F.coalesce(value, F.col(f"_v{i}")), F.coalesce(tier, F.when(F.col(f"_v{i}").isNotNull(), label))
    return out.withColumns({"value": value, "tier": F.coalesce(tier, F.lit("none"))}).drop(*(f"_v{i}" for i in range(len(tiers))))


#: Spelling out of abbreviations, and words without weight in a key (fixed values).
ABBREVIATIONS = {"univ": "university", "inst": "institute", "coll": "college", "acad": "academy", "sci": "science", "technol": "technology", "res": "research", "petr": "petroleum", "geol": "geology", "grp": "group", "co": "company", "bur": "bureau", "geophys": "geophysical", "chem": "chemical"}
STOPWORDS = ["of", "the", "and", "for", "at", "in"]
GENERIC = ["university", "institute", "college", "academy", "company", "group", "research", "bureau", "science", "technology", "petroleum"]


def alias_key(c: Column) -> Column:
    """Lower case, abbreviations spelled out, marks and stop-words dropped."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "), " "), lambda x: (x != "") & ~x.isin(*STOPWORDS))
    table = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    return F.array_join(F.transform(words, lambda x: F.coalesce(F.try_element_at(table, x), x)), " ")


def significant(key: Column) -> Column:
    words = F.split(key, " ")
    telling = F.filter(words, lambda x: ~x.isin(*GENERIC))
    return F.when(F.size(telling) > 0, telling).otherwise(words)


def blocked_candidates(names: DataFrame, master: DataFrame, rarest: int) -> DataFrame:
    """Pairs ``(key, candidate)`` that share one of the key's rarest telling words: a join on words, never on all pairs."""
    words = master.select("candidate", F.explode(F.array_distinct(significant(F.col("candidate")))).alias("w"))
    freq = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    own = names.select("key", F.explode(F.array_distinct(significant(F.col("key")))).alias("w")).join(freq, "w")
    few = own.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "w"))), 1, rarest).alias("r")).select("key", F.explode("r").alias("r")).select("key", "r.w")
    return few.join(words, "w").select("key", "candidate").distinct()


def match_containment(names: DataFrame, master: DataFrame) -> DataFrame:
    """The longest master key of three words or more inside each name's key."""
    pairs = blocked_candidates(names, master, 3).filter((F.size(F.split("candidate", " ")) >= 3) & F.contains("key", F.col("candidate")))
    size = F.struct(F.size(F.split("candidate", " ")), F.length("candidate"), "candidate")
    return pairs.groupBy("key").agg(F.max_by("candidate", size).alias("candidate"))


def match_fuzzy(names: DataFrame, master: DataFrame, floor: float = 0.88, sure: float = 0.97, likely: float = 0.93, margin: float = 0.015) -> DataFrame:
    """The master key most alike by matching blocks, if alike enough and clear of the second."""

    def ratio(batches):
        for pdf in batches:
            score = [SequenceMatcher(None, a, b).ratio() for a, b in zip(pdf["key"], pdf["candidate"])]
            out = pd.DataFrame({"key": pdf["key"], "candidate": pdf["candidate"], "score": score})
            yield out[out["score"] >= floor]

    # keys whose lengths alone keep the ratio under the floor need no comparison
    a, b = F.length("key"), F.length("candidate")
    pairs = blocked_candidates(names, master, 4).filter(2 * F.least(a, b) / (a + b) >= floor)
    scored = pairs.mapInPandas(ratio, "key string, candidate string, score double")
    two = scored.groupBy("key").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("score", "candidate")))), 1, 2).alias("t"))
    best, second = F.col("t")[0], F.coalesce(F.get("t", F.lit(1))["score"], F.lit(0.0))
    return two.filter((best["score"] >= sure) | ((best["score"] >= likely) & (best["score"] - second >= margin))).select("key", best["candidate"].alias("candidate"), best["score"].alias("score"))


ACADEMIC, ENTERPRISE, INTERNATIONAL, GOVERNMENT, OTHER = "高校/科研院所", "企业研发中心", "国际组织", "政府机构", "其他"
#: Words that tell a kind of institution (fixed values), in the order they are tried.
TYPE_RULES: list[tuple[str, str, list[str], bool]] = [
    (GOVERNMENT, "政府机构", ["自然资源部", "能源局", "人民政府", "地质调查局"], False),
    (GOVERNMENT, "政府机构", ["ministry", "geological survey", "department of energy"], True),
    (ACADEMIC, "高校强特征", ["大学", "学院"], False),
    (ACADEMIC, "高校强特征", ["university", "college", "school", "univ", "coll"], True),
    (ENTERPRISE, "企业标记", ["petrochina", "sinopec", "cnooc", "cnpc", "shell", "exxon", "chevron", "aramco", "totalenergies"], True),
    (ENTERPRISE, "企业关键词", ["公司", "集团", "油田", "石化", "石油局", "勘探局"], False),
    (ENTERPRISE, "企业英文关键词", ["company", "corporation", "corp", "co ltd", "co", "limited", "inc", "plc", "oilfield", "petrochemical"], True),
    (INTERNATIONAL, "国际组织短语", ["石油输出国组织", "国际能源署"], False),
    (INTERNATIONAL, "国际组织短语", ["international energy agency", "organization of the petroleum exporting countries", "united nations", "world bank"], True),
    (ACADEMIC, "高校科研关键词", ["科学院", "研究院", "研究所", "实验室", "研究中心"], False),
    (ACADEMIC, "高校科研关键词", ["academy", "institute", "laboratory", "research center", "research centre", "acad", "inst"], True),
]


def classify_type(name: Column) -> Column:
    """``struct<type, basis>`` by the first rule that a name meets; Latin words count only as whole words."""
    out = F.struct(F.lit(OTHER).alias("type"), F.lit("未命中规则").alias("basis"))
    for kind, basis, words, latin in reversed(TYPE_RULES):
        for w in reversed(words):
            hit = T.word_match(name, [w]) if latin else F.contains(name, F.lit(w))
            out = F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(f"{basis}:{w}").alias("basis"))).otherwise(out)
    return F.when(F.trim(name) == "", F.struct(F.lit(OTHER).alias("type"), F.lit("空值").alias("basis"))).otherwise(out)


def is_noise(name: Column) -> Column:
    """Addresses, numbered sub-units, offices and half-translated names."""
    address = name.rlike(r"^\d+\s*[A-Za-z]") | name.rlike(r"^\d{6}$")
    office = T.any_of(name, ["编辑部", "编委会", "办公室", "项目部"]) | T.word_match(name, ["editorial office", "editorial board", "working group"])
    mixed = name.rlike("[\\u4e00-\\u9fff](?:and|of)[\\u4e00-\\u9fff]") | name.rlike("[a-z]{3,}[\\u4e00-\\u9fff]")
    return address | office | mixed
