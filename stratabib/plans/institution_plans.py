"""Queries over institution names, indicators and ranking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratabib.functions import text as T
from stratabib.operators import indicators as I
from stratabib.operators import institutions as N
from stratabib.operators import mcdm as M
from stratabib.operators import translation as X
from stratabib.plans import sql as S
from stratabib.runtime import spread, stage, table

MERGED, RULES = "merge_three_db", "institution_wikidata_lookup_rules__20260424_132702"
SOURCES = ["CNKI", "WOS", "CSCD"]
START, END = 2011, 2025
BUCKETS = [("2011_2015", 2011, 2015), ("2016_2020", 2016, 2020), ("2021_2025", 2021, 2025)]
TIERS = [("头部", 1, 20), ("中部", 21, 50), ("尾部", 51, 100)]


def _merged(spark, d):
    return table(spark, d, MERGED)


def _blocks(spark, d):
    """Address blocks as ``rec_id, source_db, name, country``: the name is the part before the first comma."""
    df = spread(_merged(spark, d).select("rec_id", "source_db", "institution"))
    blocks = N.wos_blocks(F.regexp_replace(T.text_or_empty("institution"), "；", ";"))
    long = df.select("rec_id", "source_db", F.explode(blocks).alias("b"))
    tail = F.trim(F.element_at(F.split("b", ","), -1))
    return long.select("rec_id", "source_db", F.trim(F.element_at(F.split("b", ","), 1)).alias("name"), F.when(F.col("source_db") != "WOS", "China").when(~F.contains("b", F.lit(",")), "").when(tail == "Peoples R China", "China").otherwise(tail).alias("country")).filter("name <> ''")


_BLOCKS = rf"""
blocks AS (SELECT rec_id, source_db, trim(unnest(regexp_split_to_array(regexp_replace(replace({S.text("institution")}, '；', ';'), '\[[^\]]*\]', '', 'g'), '[;|\n]'))) AS b FROM {MERGED}),
names AS (SELECT rec_id, source_db, trim(string_split(b, ',')[1]) AS name,
  CASE WHEN source_db <> 'WOS' THEN 'China' WHEN NOT contains(b, ',') THEN '' WHEN trim(string_split(b, ',')[-1]) = 'Peoples R China' THEN 'China' ELSE trim(string_split(b, ',')[-1]) END AS country FROM blocks WHERE b <> '' AND trim(string_split(b, ',')[1]) <> '')"""


def institution_names(spark, d):
    """Names in each record as its source writes them, cleaned, one per row."""
    names = N.names_by_source(F.col("source_db"), F.col("institution"), F.col("institution_extracted"))
    return _merged(spark, d).select("rec_id", "source_db", F.posexplode(names).alias("pos", "name"))


def institution_countries(spark, d):
    """(name, country) pairs of each record, written out and read back."""
    pairs = N.country_pairs(F.col("source_db"), F.col("institution"), F.col("institution_extracted"))
    return _merged(spark, d).withColumn("s", N.serialize_pairs(pairs)).select("rec_id", F.explode(N.parse_pairs(F.col("s"))).alias("p")).select("rec_id", "p.name", "p.country")


def name_frequency_by_source(spark, d):
    names = _blocks(spark, d).groupBy("rec_id", "source_db").agg(F.collect_set("name").alias("names"))
    return N.name_frequency(names, F.col("names"), "source_db", SOURCES)


SQL_FREQUENCY = f"""WITH {_BLOCKS}, u AS (SELECT DISTINCT rec_id, source_db, name FROM names)
SELECT name, count(*) AS count, count(*) FILTER (source_db = 'CNKI') AS cnki_count, count(*) FILTER (source_db = 'WOS') AS wos_count, count(*) FILTER (source_db = 'CSCD') AS cscd_count FROM u GROUP BY name"""


def _mapping(spark, d):
    """Raw name to standard name from the rules, the last rule wins."""
    r = table(spark, d, RULES).select(F.trim("机构原始名称").alias("name"), F.trim("机构标准名").alias("norm"), "rule_id").filter("name <> '' and norm <> ''")
    both = r.unionByName(r.select(F.col("norm").alias("name"), "norm", "rule_id"))
    return N.last_wins(both, "name", "norm", "rule_id")


_MAP = f"""
m0 AS (SELECT trim("机构原始名称") AS name, trim("机构标准名") AS norm, rule_id FROM {RULES} WHERE trim("机构原始名称") <> '' AND trim("机构标准名") <> ''),
map AS (SELECT name, arg_max(norm, rule_id) AS norm FROM (SELECT * FROM m0 UNION ALL SELECT norm, norm, rule_id FROM m0) GROUP BY name)"""


def norm_frequency(spark, d):
    return N.norm_frequency(name_frequency_by_source(spark, d), _mapping(spark, d), ["count", "cnki_count", "wos_count", "cscd_count"])


SQL_NORM = f"""WITH {_BLOCKS}, {_MAP}, u AS (SELECT DISTINCT rec_id, source_db, name FROM names)
SELECT norm, count(*) AS count, count(*) FILTER (source_db = 'CNKI') AS cnki_count, count(*) FILTER (source_db = 'WOS') AS wos_count, count(*) FILTER (source_db = 'CSCD') AS cscd_count
FROM u JOIN map USING (name) WHERE norm NOT IN ('大学', '学院', '公司', '研究院', '研究所', 'university', 'institute', 'company') AND NOT contains(norm, '待区分') GROUP BY norm"""


def _top(spark, d, n=100):
    """The most frequent norm names with rank and level; a top-n report."""
    top = norm_frequency(spark, d).orderBy(F.desc("count"), "norm").limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("count"), "norm")))


def top100_institutions(spark, d):
    return _top(spark, d).select("rank", "norm", "count", I.level(F.col("rank"), TIERS).alias("level"))


_TOP = """n AS (SELECT norm, count(*) AS count FROM u JOIN map USING (name) WHERE norm NOT IN ('大学', '学院', '公司', '研究院', '研究所', 'university', 'institute', 'company') AND NOT contains(norm, '待区分') GROUP BY norm),
top AS (SELECT *, row_number() OVER (ORDER BY count DESC, norm) AS rank FROM n ORDER BY count DESC, norm LIMIT 100)"""
_TOP_CTE = f"WITH {_BLOCKS}, {_MAP}, u AS (SELECT DISTINCT rec_id, source_db, name FROM names), {_TOP}"
SQL_TOP = f"{_TOP_CTE} SELECT rank, norm, count, CASE WHEN rank <= 20 THEN '头部' WHEN rank <= 50 THEN '中部' ELSE '尾部' END AS level FROM top"


def tiered_lookup(spark, d):
    """Names found by exact rule, else by a key that one standard name has alone."""
    names = name_frequency_by_source(spark, d).select("name", "count").withColumn("key", N.alias_key(F.col("name")))
    exact = _mapping(spark, d).select("name", F.col("norm").alias("value"))
    keyed = exact.withColumn("key", N.alias_key(F.col("name"))).filter("key <> ''").groupBy("key").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).filter("n = 1").select("key", "value")
    return N.fallback_lookup(names, [("exact", "name", exact), ("key", "key", keyed)]).select("name", "count", "key", "value", "tier")


def _alias(c):
    words = f"list_filter(string_split(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '' AND x NOT IN ({', '.join(repr(w) for w in N.STOPWORDS)}))"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in N.ABBREVIATIONS.items())
    return f"array_to_string(list_transform({words}, lambda x: CASE x {cases} ELSE x END), ' ')"


SQL_TIERED = f"""WITH {_BLOCKS}, {_MAP}, u AS (SELECT DISTINCT rec_id, source_db, name FROM names), f AS (SELECT name, count(*) AS count, {_alias("name")} AS key FROM u GROUP BY name),
k AS (SELECT key, min(norm) AS norm FROM (SELECT {_alias("name")} AS key, norm FROM map) WHERE key <> '' GROUP BY key HAVING count(DISTINCT norm) = 1)
SELECT f.name, f.count, f.key, coalesce(map.norm, k.norm) AS value, CASE WHEN map.norm IS NOT NULL THEN 'exact' WHEN k.norm IS NOT NULL THEN 'key' ELSE 'none' END AS tier FROM f LEFT JOIN map ON f.name = map.name LEFT JOIN k ON f.key = k.key"""


def _keys(spark, d):
    names = name_frequency_by_source(spark, d).select(N.alias_key(F.col("name")).alias("key")).filter("key <> ''").distinct()
    master = _mapping(spark, d).select(N.alias_key(F.col("name")).alias("candidate")).filter("candidate <> ''").distinct()
    return names, master


def containment_match(spark, d):
    """Names whose key holds a rule's key of three words or more."""
    return N.match_containment(*_keys(spark, d))


SQL_CONTAINMENT = f"""WITH {_BLOCKS}, {_MAP}, f AS (SELECT DISTINCT {_alias("name")} AS key FROM names), c AS (SELECT DISTINCT {_alias("name")} AS candidate FROM map),
telling AS (SELECT candidate, string_split(candidate, ' ') AS ws FROM c WHERE candidate <> ''),
cw AS (SELECT candidate, unnest(list_distinct(CASE WHEN len(list_filter(ws, lambda x: x NOT IN ({", ".join(repr(w) for w in N.GENERIC)}))) > 0 THEN list_filter(ws, lambda x: x NOT IN ({", ".join(repr(w) for w in N.GENERIC)})) ELSE ws END)) AS w FROM telling),
freq AS (SELECT w, count(*) AS n FROM cw GROUP BY w),
ft AS (SELECT key, string_split(key, ' ') AS ws FROM f WHERE key <> ''),
kw AS (SELECT key, unnest(list_distinct(CASE WHEN len(list_filter(ws, lambda x: x NOT IN ({", ".join(repr(w) for w in N.GENERIC)}))) > 0 THEN list_filter(ws, lambda x: x NOT IN ({", ".join(repr(w) for w in N.GENERIC)})) ELSE ws END)) AS w FROM ft),
rare AS (SELECT key, w FROM kw JOIN freq USING (w) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n, w) <= 3),
p AS (SELECT DISTINCT key, candidate FROM rare JOIN cw USING (w) WHERE len(string_split(candidate, ' ')) >= 3 AND contains(key, candidate))
SELECT key, candidate FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY len(string_split(candidate, ' ')) DESC, length(candidate) DESC, candidate DESC) = 1"""


def fuzzy_match(spark, d):
    """Names whose key is nearly a rule's key, by matching blocks."""
    return N.match_fuzzy(*_keys(spark, d))


def dominant_aliases(spark, d):
    """The spelling each key settles on by weighted vote."""
    rows = name_frequency_by_source(spark, d).select(N.alias_key(F.col("name")).alias("key"), "name", "count").filter("key <> ''")
    return N.dominant_alias(rows, "key", "name", "count")


SQL_DOMINANT = f"""WITH {_BLOCKS}, u AS (SELECT DISTINCT rec_id, name FROM names), v AS (SELECT {_alias("name")} AS key, name, count(*) AS w FROM u GROUP BY ALL),
r AS (SELECT key, name, w, row_number() OVER o AS n, lead(w) OVER o AS second FROM v WHERE key <> '' WINDOW o AS (PARTITION BY key ORDER BY w DESC, name DESC))
SELECT key, name, w AS weight FROM r WHERE n = 1 AND (second IS NULL OR w >= second * 2 OR w - second >= 20 OR w >= 100)"""


def type_cascade(spark, d):
    """Type and basis of every name, and whether it is noise."""
    t = N.classify_type(F.col("name"))
    return name_frequency_by_source(spark, d).select("name", t["type"].alias("type"), t["basis"].alias("basis"))


def _word(c, w):
    return f"regexp_matches(lower({c}), '(^|[^a-z0-9]){w}($|[^a-z0-9])')"


SQL_TYPES = (
    f"WITH {_BLOCKS}, f AS (SELECT DISTINCT name FROM names) SELECT name, "
    + ", ".join(
        "CASE " + " ".join(f"WHEN {_word('name', w) if latin else f'''contains(name, '{w}')'''} THEN '{kind if out == 'type' else f'{basis}:{w}'}'" for kind, basis, words, latin in N.TYPE_RULES for w in words) + f" ELSE '{N.OTHER if out == 'type' else '未命中规则'}' END AS {out}"
        for out in ("type", "basis")
    )
    + " FROM f"
)


def country_shares(spark, d):
    return I.country_shares(_blocks(spark, d), "name", "country")


SQL_SHARES = f"""WITH {_BLOCKS}, c AS (SELECT name, country, count(*) AS n FROM names WHERE country <> '' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, country) AS k, sum(n) OVER (PARTITION BY name) AS total, count(*) OVER (PARTITION BY name) AS nc FROM c)
SELECT name, max(country) FILTER (k = 1) AS main_country, round(max(n) FILTER (k = 1) / max(total), 4) AS main_share, CAST(max(nc) AS INTEGER) AS n_countries, string_agg(country, ' / ' ORDER BY k) FILTER (k <= 3) AS summary FROM r GROUP BY name"""


def rule_precedence(spark, d):
    """Rules of all origins, the later table first: lists, then automatic, then manual ones."""
    r = table(spark, d, RULES).select(F.col("机构原始名称").alias("name"), F.col("机构标准名").alias("value"), F.col("规则来源").alias("origin"))
    return X.assemble_rules([r.filter(F.col("origin") == o).select("name", "value") for o in ("外部词表", "自动核名", "人工核名")])


SQL_PRECEDENCE = f"""WITH r AS (SELECT trim("机构原始名称") AS name, trim("机构标准名") AS value, CASE "规则来源" WHEN '外部词表' THEN 0 WHEN '自动核名' THEN 1 WHEN '人工核名' THEN 2 END AS priority FROM {RULES})
SELECT name, value, priority FROM r WHERE name <> '' AND value <> '' AND priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY priority DESC, value DESC) = 1"""


def translated_names(spark, d):
    """Every name with its translation, method and reasons for review."""
    names = name_frequency_by_source(spark, d).select("name", "count")
    exact = _mapping(spark, d).select("name", F.col("norm").alias("value"))
    keyed = exact.withColumn("key", N.alias_key(F.col("name"))).filter("key <> ''").groupBy("key").agg(F.count_distinct("value").alias("n"), F.min("value").alias("value")).filter("n = 1").select("key", "value")
    return X.translate_table(names, exact, keyed, country_shares(spark, d))


_GEN = ", ".join(f"'{g}'" for g in X.GENERIC)
_WORDCASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.WORDS.items())
SQL_TRANSLATED = f"""WITH {_BLOCKS}, {_MAP}, u AS (SELECT DISTINCT rec_id, source_db, name FROM names), f AS (SELECT name, count(*) AS count, {_alias("name")} AS key FROM u GROUP BY name),
k AS (SELECT key, min(norm) AS norm FROM (SELECT {_alias("name")} AS key, norm FROM map) WHERE key <> '' GROUP BY key HAVING count(DISTINCT norm) = 1),
cs AS (SELECT name, country, count(*) AS n FROM names WHERE country <> '' GROUP BY ALL), sh AS (SELECT name, count(*) AS nc, max(n) / sum(n) AS ms FROM cs GROUP BY name),
w AS (SELECT f.*, map.norm AS e, k.norm AS kv, array_to_string(list_transform(string_split(f.key, ' '), lambda x: CASE x {_WORDCASE} ELSE x END), '') AS words, coalesce(nc, 0) AS nc, round(coalesce(ms, 1.0), 4) AS ms,
  regexp_matches(f.name, '[一-鿿]') AS zh FROM f LEFT JOIN map ON f.name = map.name LEFT JOIN k ON f.key = k.key LEFT JOIN sh ON f.name = sh.name),
m AS (SELECT *, CASE WHEN e IS NOT NULL THEN 'exact' WHEN kv IS NOT NULL THEN 'canonical' WHEN zh THEN 'raw_cjk'
  WHEN NOT (words = '' OR words IN ({_GEN}) OR regexp_matches(words, '[A-Za-z]') OR (NOT zh AND length(words) <= 4 AND regexp_matches(words, '{"|".join(X.GENERIC)}'))) THEN 'auto_word_level' ELSE 'raw_fallback' END AS method FROM w),
o AS (SELECT *, coalesce(e, kv, CASE WHEN method = 'auto_word_level' THEN words ELSE name END) AS norm FROM m),
q AS (SELECT *, norm <> '' AND NOT regexp_matches(norm, '[一-鿿]') AS latin, regexp_matches(lower(name), 'petrochina|sinopec|cnpc|cnooc|oilfield|company|corp') AS ent FROM o),
r AS (SELECT *, array_to_string(list_filter([CASE WHEN norm = '' THEN 'empty_trans_or_norm' END, CASE WHEN latin AND (count >= {X.HIGH} OR (ent AND count >= {X.MEDIUM})) THEN 'norm_not_cjk' END,
  CASE WHEN norm IN ({_GEN}) AND count >= {X.HIGH} THEN 'high_freq_auto_result' END, CASE WHEN method <> 'exact' AND count >= {X.HIGH} AND NOT (name = norm AND regexp_matches(norm, '[一-鿿]')) AND (latin OR norm IN ({_GEN})) THEN 'top_freq_needs_review' END,
  CASE WHEN ent AND latin AND count >= {X.MEDIUM} THEN 'generic_enterprise_alias' END, CASE WHEN nc > 1 AND ms < 0.9 AND regexp_matches(lower(name), '^[a-z0-9]{{1,6}}$') AND count >= {X.LOW} THEN 'same_name_country_disambiguation' END,
  CASE WHEN contains(norm, '待区分') THEN 'pending_disambiguation_label' END], lambda x: x IS NOT NULL), ' | ') AS review_reason FROM q)
SELECT name, count, words, norm, method, CAST(review_reason <> '' AS INTEGER) AS review_flag, review_reason FROM r"""


def noise_names(spark, d):
    """Names that are addresses, offices or half translated."""
    return name_frequency_by_source(spark, d).filter(N.is_noise(F.col("name"))).select("name", "count")


SQL_NOISE = rf"""WITH {_BLOCKS}, u AS (SELECT DISTINCT rec_id, name FROM names), f AS (SELECT name, count(*) AS count FROM u GROUP BY name)
SELECT * FROM f WHERE regexp_matches(name, '^\d+\s*[A-Za-z]') OR regexp_matches(name, '^\d{{6}}$') OR regexp_matches(name, '编辑部|编委会|办公室|项目部') OR {_word("name", "editorial office")} OR {_word("name", "editorial board")} OR {_word("name", "working group")}
  OR regexp_matches(name, '[一-鿿](and|of)[一-鿿]') OR regexp_matches(name, '[a-z]{{3,}}[一-鿿]')"""


def _bridge(spark, d):
    """Papers, their norm names, and those names' countries."""
    pairs = stage(_blocks(spark, d).join(_mapping(spark, d), "name").select(F.col("rec_id").alias("paper"), F.col("norm").alias("inst"), "country", F.col("rec_id").alias("seq")), "paper-institutions").df
    papers = _merged(spark, d).select(F.col("rec_id").alias("paper"), F.col("source_db").alias("source"), T.year_int("year").alias("year"), T.to_float("cited_count").alias("cited"))
    return papers, pairs.select("paper", "inst").distinct(), pairs


_BRIDGE = f"""{_TOP_CTE}, pairs AS (SELECT rec_id AS paper, norm AS inst, country FROM names JOIN map USING (name)), bridge AS (SELECT DISTINCT paper, inst FROM pairs),
papers AS (SELECT rec_id AS paper, source_db AS source, {S.year_int("year")} AS year, {S.number("cited_count")} AS cited FROM {MERGED}),
own AS (SELECT b.paper, b.inst, p.source, p.year, p.cited FROM bridge b JOIN top ON b.inst = top.norm JOIN papers p USING (paper))"""


def institution_h_index(spark, d):
    papers, bridge, _ = _bridge(spark, d)
    return I.h_index(bridge.join(papers, "paper"), "inst", "cited")


SQL_H = f"""{_BRIDGE}, a AS (SELECT b.inst, p.cited FROM bridge b JOIN papers p USING (paper)), r AS (SELECT inst, cited, row_number() OVER (PARTITION BY inst ORDER BY cited DESC) AS k FROM a)
SELECT inst, coalesce(max(k) FILTER (cited >= k), 0) AS h_index FROM r GROUP BY inst"""


def citation_p90(spark, d):
    papers, _, _ = _bridge(spark, d)
    return I.nearest_rank(papers, "cited", 0.9)


SQL_P90 = f"SELECT quantile_disc({S.number('cited_count')}, 0.9) AS threshold FROM {MERGED}"


def year_bucket_counts(spark, d):
    papers, bridge, _ = _bridge(spark, d)
    year = F.col("year")
    return bridge.join(papers, "paper").groupBy("inst").agg(*I.bucket_counts(year, BUCKETS), F.count_distinct(F.when(year.between(START, END), year)).alias("active_years"))


SQL_BUCKETS = f"{_BRIDGE} SELECT b.inst, " + ", ".join(f"count(*) FILTER (year BETWEEN {a} AND {b}) AS paper_count_{l}" for l, a, b in BUCKETS) + f", count(DISTINCT year) FILTER (year BETWEEN {START} AND {END}) AS active_years FROM bridge b JOIN papers p USING (paper) GROUP BY b.inst"


def collaboration_metrics(spark, d):
    _, bridge, _ = _bridge(spark, d)
    return I.collaboration(bridge, "paper", "inst")


SQL_COLLABORATION = f"""{_BRIDGE}, s AS (SELECT *, count(*) OVER (PARTITION BY paper) AS n FROM bridge), p AS (SELECT a.inst, count(DISTINCT b.inst) AS k FROM bridge a JOIN bridge b USING (paper) WHERE a.inst <> b.inst GROUP BY a.inst)
SELECT s.inst, count(*) FILTER (n > 1) AS collaboration_paper_count, CAST(sum(n - 1) AS BIGINT) AS partner_total, coalesce(max(k), 0) AS partner_institution_count FROM s LEFT JOIN p USING (inst) GROUP BY s.inst"""


def home_countries(spark, d):
    _, _, pairs = _bridge(spark, d)
    return I.home_country(pairs, "inst", "country")


SQL_HOME = f"""{_BRIDGE}, t AS (SELECT rec_id, norm AS inst, country FROM names JOIN map USING (name)), c AS (SELECT inst, country, count(*) AS n, min(rec_id) AS f FROM t WHERE country <> '' GROUP BY ALL),
b AS (SELECT inst, country FROM c QUALIFY row_number() OVER (PARTITION BY inst ORDER BY n DESC, f, country DESC) = 1)
SELECT i.inst, coalesce(b.country, 'China') AS home_country FROM (SELECT DISTINCT inst FROM t) i LEFT JOIN b USING (inst)"""


def _impact(spark, d):
    papers, bridge, pairs = _bridge(spark, d)
    top = stage(_top(spark, d).select(F.col("norm").alias("inst")), "top-institutions").df
    return I.impact(papers, bridge, pairs, top, START, END, BUCKETS)


IMPACT = ["inst", "paper_count", "paper_count_cnki", "paper_count_wos", "paper_count_cscd", "first_year", "last_year", "active_years", "paper_count_2011_2015", "paper_count_2016_2020", "paper_count_2021_2025", "total_citations", "max_citations", "median_citations", "cited_papers", "high_cited_papers", "h_index", "home_country", "collaboration_paper_count", "partner_total", "partner_institution_count", "international_papers", "international_partners", "partner_countries", "annual_papers", "recent_ratio", "citations_per_paper", "cited_ratio", "high_cited_ratio", "collaboration_ratio", "partners_per_collaboration", "international_ratio"]


def impact_indicators(spark, d):
    """All indicators of the hundred most frequent institutions."""
    return _impact(spark, d).select(*IMPACT)


_IMPACT = f"""{_BRIDGE}, thr AS (SELECT quantile_disc(cited, 0.9) AS t FROM papers),
base AS (SELECT inst, count(*) AS paper_count, count(*) FILTER (source = 'CNKI') AS paper_count_cnki, count(*) FILTER (source = 'WOS') AS paper_count_wos, count(*) FILTER (source = 'CSCD') AS paper_count_cscd,
  coalesce(min(year) FILTER (year BETWEEN {START} AND {END}), 0) AS first_year, coalesce(max(year) FILTER (year BETWEEN {START} AND {END}), 0) AS last_year, count(DISTINCT year) FILTER (year BETWEEN {START} AND {END}) AS active_years,
  {", ".join(f"count(*) FILTER (year BETWEEN {a} AND {b}) AS paper_count_{l}" for l, a, b in BUCKETS)},
  sum(cited) AS total_citations, max(cited) AS max_citations, median(cited) AS median_citations, count(*) FILTER (cited > 0) AS cited_papers, count(*) FILTER (cited >= (SELECT t FROM thr)) AS high_cited_papers FROM own GROUP BY inst),
hr AS (SELECT inst, cited, row_number() OVER (PARTITION BY inst ORDER BY cited DESC) AS k FROM own), h AS (SELECT inst, coalesce(max(k) FILTER (cited >= k), 0) AS h_index FROM hr GROUP BY inst),
tp AS (SELECT rec_id, norm AS inst, country FROM names JOIN map USING (name)), cc AS (SELECT inst, country, count(*) AS n, min(rec_id) AS f FROM tp WHERE country <> '' GROUP BY ALL),
home AS (SELECT i.norm AS inst, coalesce(b.country, 'China') AS home_country FROM top i LEFT JOIN (SELECT inst, country FROM cc QUALIFY row_number() OVER (PARTITION BY inst ORDER BY n DESC, f, country DESC) = 1) b ON i.norm = b.inst),
s AS (SELECT *, count(*) OVER (PARTITION BY paper) AS n FROM bridge), co AS (SELECT inst, count(*) FILTER (n > 1) AS collaboration_paper_count, CAST(sum(n - 1) AS BIGINT) AS partner_total FROM s GROUP BY inst),
pa AS (SELECT a.inst, count(DISTINCT b.inst) AS partner_institution_count FROM own a JOIN bridge b USING (paper) WHERE a.inst <> b.inst GROUP BY a.inst),
stated AS (SELECT DISTINCT paper, inst, country FROM pairs WHERE country <> ''),
ats AS (SELECT * FROM stated UNION ALL SELECT b.paper, b.inst, home.home_country FROM bridge b JOIN home USING (inst) WHERE NOT EXISTS (SELECT 1 FROM stated x WHERE x.paper = b.paper AND x.inst = b.inst)),
ab AS (SELECT o.inst, count(DISTINCT o.paper) AS international_papers, count(DISTINCT x.inst) AS international_partners, count(DISTINCT x.country) AS partner_countries FROM own o JOIN home USING (inst) JOIN ats x ON o.paper = x.paper AND x.inst <> o.inst AND x.country <> home.home_country GROUP BY o.inst),
w AS (SELECT base.*, h_index, home_country, coalesce(collaboration_paper_count, 0) AS collaboration_paper_count, coalesce(partner_total, 0) AS partner_total, coalesce(partner_institution_count, 0) AS partner_institution_count,
  coalesce(international_papers, 0) AS international_papers, coalesce(international_partners, 0) AS international_partners, coalesce(partner_countries, 0) AS partner_countries
  FROM base JOIN h USING (inst) LEFT JOIN home USING (inst) LEFT JOIN co USING (inst) LEFT JOIN pa USING (inst) LEFT JOIN ab USING (inst)),
impact AS (SELECT *, round(paper_count / {END - START + 1}, 4) AS annual_papers, {S.ratio("paper_count_2021_2025", "paper_count")} AS recent_ratio, {S.ratio("total_citations", "paper_count")} AS citations_per_paper, {S.ratio("cited_papers", "paper_count")} AS cited_ratio,
  {S.ratio("high_cited_papers", "paper_count")} AS high_cited_ratio, {S.ratio("collaboration_paper_count", "paper_count")} AS collaboration_ratio, {S.ratio("partner_total", "collaboration_paper_count")} AS partners_per_collaboration, {S.ratio("international_papers", "paper_count")} AS international_ratio FROM w)"""
SQL_IMPACT = f"{_IMPACT} SELECT {', '.join(IMPACT)} FROM impact"

#: Indicators of the ranking and their dimensions.
DIMENSIONS = {"paper_count": "research_output", "recent_ratio": "research_output", "h_index": "academic_impact", "high_cited_ratio": "academic_impact", "collaboration_ratio": "collaboration", "international_ratio": "collaboration", "partner_countries": "collaboration"}
FIELDS = list(DIMENSIONS)
ZH = {"research_output": "科研产出", "academic_impact": "学术影响", "collaboration": "合作网络"}


def _raw(spark, d):
    """The decision matrix, written once: weights and scores read it several times."""
    return stage(M.to_long(_impact(spark, d), "inst", FIELDS).coalesce(1), "decision-matrix").df


def _dims(spark):
    return spark.createDataFrame(list(DIMENSIONS.items()), "field string, dimension string")


_LONG = f"{_IMPACT}, raw AS (UNPIVOT (SELECT inst AS item, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FIELDS)} FROM impact) ON {', '.join(FIELDS)} INTO NAME field VALUE value)"
_SCALED = f"""{_LONG}, ends AS (SELECT field, min(value) AS lo, max(value) AS hi, sqrt(sum(value * value)) AS len FROM raw GROUP BY field),
scaled AS (SELECT item, field, CASE WHEN abs(hi - lo) <= 1e-12 THEN 1.0 ELSE (value - lo) / (hi - lo) END AS value FROM raw JOIN ends USING (field))"""


def minmax_matrix(spark, d):
    return M.minmax(_raw(spark, d)).withColumn("value", F.round("value", 6))


SQL_MINMAX = f"{_SCALED} SELECT item, field, round(value, 6) AS value FROM scaled"


def unit_matrix(spark, d):
    return M.unit_length(_raw(spark, d)).withColumn("value", F.round("value", 6))


SQL_UNIT = f"{_SCALED} SELECT item, field, round(CASE WHEN len <= 1e-12 THEN 0.0 ELSE value / len END, 6) AS value FROM raw JOIN ends USING (field)"


def correlation_matrix(spark, d):
    return M.correlations(M.minmax(_raw(spark, d))).withColumn("r", F.round("r", 6) + F.lit(0.0))


_CORR = f"""{_SCALED}, corr AS (SELECT a.field AS x, b.field AS y, CASE WHEN stddev_pop(a.value) <= 1e-12 OR stddev_pop(b.value) <= 1e-12 THEN 0.0 ELSE covar_pop(a.value, b.value) / (stddev_pop(a.value) * stddev_pop(b.value)) END AS r
  FROM scaled a JOIN scaled b ON a.item = b.item GROUP BY ALL)"""
SQL_CORR = f"{_CORR} SELECT x, y, round(r, 6) + 0.0 AS r FROM corr"


def prior_weights(spark, d):
    return M.prior_weights(_dims(spark)).withColumn("weight", F.round("weight", 6))


_PRIOR = "prior AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{dim}', {1 / 3 / list(DIMENSIONS.values()).count(dim)!r})" for f, dim in DIMENSIONS.items()) + ") t(field, dimension, weight))"
SQL_PRIOR = f"WITH {_PRIOR} SELECT field, round(weight, 6) AS weight FROM prior"


def entropy_weights(spark, d):
    return M.entropy_weights(M.minmax(_raw(spark, d))).withColumn("weight", F.round("weight", 6))


_WEIGHTS = f"""{_CORR}, {_PRIOR}, sh AS (SELECT field, (value + 1e-12) / sum(value + 1e-12) OVER (PARTITION BY field) AS p, count(*) OVER (PARTITION BY field) AS n FROM scaled),
e0 AS (SELECT field, 1.0 + sum(p * ln(p)) / ln(max(n)) AS w FROM sh GROUP BY field), entropy AS (SELECT field, w / sum(w) OVER () AS weight FROM e0),
c0 AS (SELECT s.field, stddev_pop(s.value) * (SELECT sum(1.0 - r) FROM corr WHERE x = s.field AND y <> s.field) AS w FROM scaled s GROUP BY s.field), critic AS (SELECT field, w / sum(w) OVER () AS weight FROM c0),
mw AS (SELECT field, avg(weight) AS w FROM (SELECT field, weight FROM prior UNION ALL SELECT * FROM entropy UNION ALL SELECT * FROM critic) GROUP BY field), combined AS (SELECT field, w / sum(w) OVER () AS weight FROM mw)"""
SQL_ENTROPY = f"{_WEIGHTS} SELECT field, round(weight, 6) AS weight FROM entropy"


def critic_weights(spark, d):
    return M.critic_weights(M.minmax(_raw(spark, d))).withColumn("weight", F.round("weight", 6))


SQL_CRITIC = f"{_WEIGHTS} SELECT field, round(weight, 6) AS weight FROM critic"


def _combined(spark, scaled):
    return M.combine_weights(M.prior_weights(_dims(spark)), M.entropy_weights(scaled), M.critic_weights(scaled))


def combined_weights(spark, d):
    return _combined(spark, M.minmax(_raw(spark, d))).withColumn("weight", F.round("weight", 6))


SQL_COMBINED = f"{_WEIGHTS} SELECT field, round(weight, 6) AS weight FROM combined"


def topsis_scores(spark, d):
    """Closeness to the ideal and its competition rank."""
    raw = _raw(spark, d)
    scores = M.topsis(raw, _combined(spark, M.minmax(raw)))
    return scores.select("item", "score", M.competition_rank("score").alias("topsis_rank"))


_TOPSIS = f"""{_WEIGHTS}, wm AS (SELECT item, field, CASE WHEN len <= 1e-12 THEN 0.0 ELSE value / len END * weight AS v FROM raw JOIN ends USING (field) JOIN combined USING (field)),
we AS (SELECT field, min(v) AS lo, max(v) AS hi FROM wm GROUP BY field), dist AS (SELECT item, sqrt(sum((v - hi) * (v - hi))) AS up, sqrt(sum((v - lo) * (v - lo))) AS down FROM wm JOIN we USING (field) GROUP BY item),
sc AS (SELECT item, round(CASE WHEN up + down <= 1e-12 THEN 0.0 ELSE down / (up + down) END, 6) AS score FROM dist)"""
SQL_TOPSIS = f"{_TOPSIS} SELECT item, score, rank() OVER (ORDER BY score DESC) AS topsis_rank FROM sc"


def dimension_scores(spark, d):
    """Scores per dimension, the dominant one, and its place against the overall rank."""
    scaled = M.minmax(_raw(spark, d))
    long = M.subscores(scaled, _combined(spark, scaled), _dims(spark))
    wide = long.groupBy("item").pivot("dimension", list(ZH)).agg(F.max("score"))
    return wide.withColumn("dominant", M.dominant(ZH))


SQL_DIMENSIONS = f"""{_WEIGHTS}, wd AS (SELECT c.field, p.dimension, c.weight / sum(c.weight) OVER (PARTITION BY p.dimension) AS weight FROM combined c JOIN prior p USING (field)),
sub AS (SELECT item, dimension, round(sum(value * weight), 6) AS score FROM scaled JOIN wd USING (field) GROUP BY ALL),
pv AS (SELECT item, {", ".join(f"max(score) FILTER (dimension = '{k}') AS {k}" for k in ZH)} FROM sub GROUP BY item)
SELECT *, CASE {" ".join(f"WHEN {k} = greatest({', '.join(ZH)}) THEN '{v}'" for k, v in ZH.items())} END AS dominant FROM pv"""


def dimension_top10(spark, d):
    """The ten best institutions of each dimension; a top-n report."""
    scaled = M.minmax(_raw(spark, d))
    long = M.subscores(scaled, _combined(spark, scaled), _dims(spark))
    return long.withColumn("place", F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("score"), "item"))).filter("place <= 10")


SQL_TOP10 = f"""{_WEIGHTS}, wd AS (SELECT c.field, p.dimension, c.weight / sum(c.weight) OVER (PARTITION BY p.dimension) AS weight FROM combined c JOIN prior p USING (field)),
sub AS (SELECT item, dimension, round(sum(value * weight), 6) AS score FROM scaled JOIN wd USING (field) GROUP BY ALL)
SELECT item, dimension, score, row_number() OVER (PARTITION BY dimension ORDER BY score DESC, item) AS place FROM sub QUALIFY place <= 10"""


def dimension_remarks(spark, d):
    """The ten best of each dimension with their overall rank and a remark on the gap."""
    overall = stage(topsis_scores(spark, d).select("item", "topsis_rank"), "overall-ranks").df
    return dimension_top10(spark, d).join(overall, "item").select("item", "dimension", "place", "topsis_rank", M.rank_gap_remark(F.col("place"), F.col("topsis_rank")).alias("remark"))


SQL_REMARKS = f"""WITH top10 AS ({SQL_TOP10}), overall AS ({SQL_TOPSIS})
SELECT item, dimension, place, topsis_rank, CASE WHEN topsis_rank - place >= 20 THEN '{M.AHEAD}' WHEN place <= 5 AND topsis_rank <= 20 THEN '{M.STRONG}' ELSE '' END AS remark FROM top10 JOIN overall USING (item)"""

_ALL = {
    "dimension_remarks": (dimension_remarks, SQL_REMARKS), "institution_names": (institution_names, ""), "institution_countries": (institution_countries, ""), "name_frequency_by_source": (name_frequency_by_source, SQL_FREQUENCY), "norm_frequency": (norm_frequency, SQL_NORM),
    "top100_institutions": (top100_institutions, SQL_TOP), "tiered_lookup": (tiered_lookup, SQL_TIERED), "containment_match": (containment_match, SQL_CONTAINMENT), "fuzzy_match": (fuzzy_match, ""), "dominant_aliases": (dominant_aliases, SQL_DOMINANT),
    "type_cascade": (type_cascade, SQL_TYPES), "country_shares": (country_shares, SQL_SHARES), "rule_precedence": (rule_precedence, SQL_PRECEDENCE), "translated_names": (translated_names, SQL_TRANSLATED), "noise_names": (noise_names, SQL_NOISE), "institution_h_index": (institution_h_index, SQL_H), "citation_p90": (citation_p90, SQL_P90), "year_bucket_counts": (year_bucket_counts, SQL_BUCKETS),
    "collaboration_metrics": (collaboration_metrics, SQL_COLLABORATION), "home_countries": (home_countries, SQL_HOME), "impact_indicators": (impact_indicators, SQL_IMPACT), "minmax_matrix": (minmax_matrix, SQL_MINMAX), "unit_matrix": (unit_matrix, SQL_UNIT),
    "correlation_matrix": (correlation_matrix, SQL_CORR), "prior_weights": (prior_weights, SQL_PRIOR), "entropy_weights": (entropy_weights, SQL_ENTROPY), "critic_weights": (critic_weights, SQL_CRITIC), "combined_weights": (combined_weights, SQL_COMBINED),
    "topsis_scores": (topsis_scores, SQL_TOPSIS), "dimension_scores": (dimension_scores, SQL_DIMENSIONS), "dimension_top10": (dimension_top10, SQL_TOP10),
}


def queries():
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql():
    return {k: v[1] for k, v in _ALL.items() if v[1]}
