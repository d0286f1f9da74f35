"""Queries over topics and sentiment."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratabib.functions import text as T
from stratabib.operators import sentiment as E
from stratabib.operators import topics as K
from stratabib.plans import sql as S
from stratabib.runtime import spread, stage, table

MERGED = "merge_three_db"
PERIODS = [("2011-2015", 2011, 2015), ("2016-2020", 2016, 2020), ("2021-2025", 2021, 2025)]


def _docs(spark, d):
    return table(spark, d, "documents")


def _tokens(spark, d):
    """Abstracts with period, language and English tokens."""
    df = spread(table(spark, d, MERGED).select("rec_id", "source_db", "year", "journal_en", "abstract_en", "abstract_cn"))
    chosen = K.choose_abstract(F.col("abstract_en"), F.col("abstract_cn"))
    rows = df.select("rec_id", "source_db", T.publish_period(T.year_int("year"), PERIODS).alias("period"), chosen.alias("c"), T.text_or_empty("journal_en").alias("journal"))
    return rows.select("rec_id", "source_db", "period", "journal", "c.text", "c.lang", K.english_tokens(F.col("c.text")).alias("tokens"))


def _canon(x):
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.CANONICAL.items())
    t = f"trim(replace(replace(lower({x}), '-', '_'), '/', '_'), '_')"
    look = lambda e: f"(CASE {e} {cases} END)"
    return f"coalesce({look(t)}, CASE WHEN {t} LIKE '%ies' THEN {look(f'''substring({t}, 1, length({t}) - 3) || 'y' ''')} END, CASE WHEN {t} LIKE '%s' THEN {look(f'substring({t}, 1, length({t}) - 1)')} END, {t})"


def _phrases(c):
    out = rf"' ' || lower(trim(regexp_replace({c}, '\s+', ' ', 'g'))) || ' '"
    for p in sorted(K.PHRASES, key=lambda p: (-len(p), p)):
        out = f"replace({out}, ' {p} ', ' {K.PHRASES[p]} ')"
    return f"regexp_replace({out}, '[-/]', ' ', 'g')"


_STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)
_TOK = rf"""
y AS (SELECT *, {S.year_int("year")} AS yi, trim(regexp_replace({S.text("abstract_en")}, '\s+', ' ', 'g')) AS ae, trim(regexp_replace({S.text("abstract_cn")}, '\s+', ' ', 'g')) AS ac FROM {MERGED}),
c AS (SELECT rec_id, source_db, {S.text("journal_en")} AS journal, CASE {" ".join(f"WHEN yi BETWEEN {a} AND {b} THEN '{l}'" for l, a, b in PERIODS)} ELSE '' END AS period,
  CASE WHEN length(ae) >= 30 THEN ae WHEN ac <> '' THEN ac ELSE ae END AS text, CASE WHEN length(ae) >= 30 THEN 'en' WHEN ac <> '' THEN 'zh' WHEN ae <> '' THEN 'en' ELSE '' END AS lang FROM y),
t AS (SELECT *, list_filter(list_transform(regexp_extract_all({_phrases("text")}, '[a-z][a-z0-9_]+'), lambda x: {_canon("x")}), lambda x: length(x) >= 2 AND x NOT IN ({_STOP})) AS tokens FROM c)"""


def term_tf_df(spark, d):
    return K.term_frequency(_tokens(spark, d).filter("lang = 'en'"), "tokens")


SQL_TFDF = f"WITH {_TOK}, e AS (SELECT rec_id, unnest(tokens) AS term FROM t WHERE lang = 'en') SELECT term, count(*) AS tf, count(DISTINCT rec_id) AS df FROM e GROUP BY term"


def ranked_terms(spark, d):
    """Sixty most frequent terms of each period with cloud weights."""
    tf = K.term_frequency(_tokens(spark, d).filter("lang = 'en' and period <> ''"), "tokens", "period")
    return K.ranked_terms(tf, "period", 60)


SQL_RANKED = f"""WITH {_TOK}, e AS (SELECT period, rec_id, unnest(tokens) AS term FROM t WHERE lang = 'en' AND period <> ''), g AS (SELECT period, term, count(*) AS tf, count(DISTINCT rec_id) AS df FROM e GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY period ORDER BY tf DESC, term) AS place, round(tf / max(tf) OVER (PARTITION BY period), 6) AS cloud_weight FROM g QUALIFY place <= 60"""


def preprocess_funnel(spark, d):
    """Documents at each step of preparation, by period."""
    rows = _tokens(spark, d)
    relevant = F.arrays_overlap("tokens", F.array(*map(F.lit, K.ANCHORS)))
    kept = relevant & (F.size("tokens") >= K.MIN_TOKENS)
    return rows.groupBy("period").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("text") != "").alias("with_abstract"), F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("lang") == "zh").alias("n_zh"), F.count_if(relevant).alias("relevant"), F.count_if(kept).alias("modelled"), F.round(F.avg(F.when(kept, F.size("tokens"))), 4).alias("avg_tokens"))


_ANCH = ", ".join(f"'{a}'" for a in K.ANCHORS)
SQL_FUNNEL = f"""WITH {_TOK}, r AS (SELECT *, list_has_any(tokens, [{_ANCH}]) AS relevant FROM t)
SELECT period, count(*) AS n_docs, count(*) FILTER (text <> '') AS with_abstract, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'zh') AS n_zh, count(*) FILTER (relevant) AS relevant,
  count(*) FILTER (relevant AND len(tokens) >= {K.MIN_TOKENS}) AS modelled, round(avg(len(tokens)) FILTER (relevant AND len(tokens) >= {K.MIN_TOKENS}), 4) AS avg_tokens FROM r GROUP BY period"""


def term_pair_npmi(spark, d):
    """Coherence of the pairs of the thirty terms in most documents."""
    docs = stage(_tokens(spark, d).filter("lang = 'en'").select("rec_id", "tokens"), "npmi-docs").df
    top = K.term_frequency(docs, "tokens").orderBy(F.desc("df"), "term").limit(30)
    return K.npmi(docs, "rec_id", "tokens", top)


SQL_NPMI = f"""WITH {_TOK}, d AS (SELECT rec_id, list_distinct(tokens) AS tokens FROM t WHERE lang = 'en'), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d), e AS (SELECT rec_id, unnest(tokens) AS term FROM d),
f AS (SELECT term, count(*) AS df FROM e GROUP BY term ORDER BY df DESC, term LIMIT 30), o AS (SELECT e.* FROM e JOIN f USING (term)),
j AS (SELECT a.term AS x, b.term AS y, count(*) AS joint FROM o a JOIN o b ON a.rec_id = b.rec_id AND a.term < b.term GROUP BY ALL)
SELECT fx.term AS x, fy.term AS y, coalesce(joint, 0) AS joint, round(CASE WHEN joint IS NULL THEN -1.0 ELSE ln((joint / n + 1e-12) / (fx.df / n * fy.df / n + 1e-12)) / -ln(joint / n + 1e-12) END, 6) AS npmi
FROM f fx JOIN f fy ON fx.term < fy.term CROSS JOIN n LEFT JOIN j ON j.x = fx.term AND j.y = fy.term"""


def _vectors(spark, d, period):
    """Term distributions by source within a period: sources stand for topics."""
    tf = K.term_frequency(_tokens(spark, d).filter((F.col("lang") == "en") & (F.col("period") == period)), "tokens", "source_db").select(F.col("source_db").alias("topic"), "term", F.col("tf").cast("double").alias("weight"))
    return K.distribution(tf, ["topic"])


def period_cosine_links(spark, d):
    """Similarity of term distributions between the first two periods."""
    return K.cosine(_vectors(spark, d, PERIODS[0][0]), _vectors(spark, d, PERIODS[1][0]))


SQL_COSINE = f"""WITH {_TOK}, e AS (SELECT period, source_db AS topic, unnest(tokens) AS term FROM t WHERE lang = 'en'), g AS (SELECT period, topic, term, CAST(count(*) AS DOUBLE) AS w FROM e GROUP BY ALL),
p AS (SELECT period, topic, term, w / sum(w) OVER (PARTITION BY period, topic) AS p FROM g), l AS (SELECT * FROM p WHERE period = '{PERIODS[0][0]}'), r AS (SELECT * FROM p WHERE period = '{PERIODS[1][0]}'),
nl AS (SELECT topic, sqrt(sum(p * p)) AS n FROM l GROUP BY topic), nr AS (SELECT topic, sqrt(sum(p * p)) AS n FROM r GROUP BY topic), dt AS (SELECT l.topic AS lt, r.topic AS rt, sum(l.p * r.p) AS dot FROM l JOIN r USING (term) GROUP BY ALL)
SELECT nl.topic AS left_topic, nr.topic AS right_topic, round(coalesce(dot, 0.0) / (nl.n * nr.n), 6) AS similarity FROM nl CROSS JOIN nr LEFT JOIN dt ON lt = nl.topic AND rt = nr.topic"""


def topic_matches(spark, d):
    """One-to-one match of the two periods' topics."""
    return K.match_topics(period_cosine_links(spark, d))


def evolution_paths(spark, d):
    """Paths over three periods, linked where a journal's articles fall under the same leading letter."""
    rows = _tokens(spark, d).filter("journal <> '' and period <> ''").select("period", F.substring("journal", 1, 1).alias("topic")).distinct()
    of = lambda i: rows.filter(F.col("period") == PERIODS[i][0]).select("topic")
    link = lambda a, b, letters: a.join(b, "topic").filter(F.col("topic").isin(*letters)).select(F.col("topic").alias("left_topic"), F.col("topic").alias("right_topic"))
    a, b, c = of(0), of(1), of(2)
    return K.evolution_paths(a, b, c, link(a, b, list("ABKLS")), link(b, c, list("AKQT")))


SQL_PATHS = f"""WITH {_TOK}, r AS (SELECT DISTINCT period, substring(journal, 1, 1) AS topic FROM t WHERE journal <> '' AND period <> ''),
a AS (SELECT topic FROM r WHERE period = '{PERIODS[0][0]}'), b AS (SELECT topic FROM r WHERE period = '{PERIODS[1][0]}'), pc AS (SELECT topic FROM r WHERE period = '{PERIODS[2][0]}'),
l1 AS (SELECT a.topic FROM a JOIN b USING (topic) WHERE a.topic IN ('A', 'B', 'K', 'L', 'S')), l2 AS (SELECT b.topic FROM b JOIN pc USING (topic) WHERE b.topic IN ('A', 'K', 'Q', 'T')),
p AS (SELECT 1 AS s, a.topic AS t1, l1.topic AS t2, l2.topic AS t3 FROM a LEFT JOIN l1 USING (topic) LEFT JOIN l2 ON l1.topic = l2.topic
  UNION ALL SELECT 2, NULL, b.topic, l2.topic FROM b LEFT JOIN l2 USING (topic) WHERE b.topic NOT IN (SELECT topic FROM l1) UNION ALL SELECT 3, NULL, NULL, pc.topic FROM pc WHERE pc.topic NOT IN (SELECT topic FROM l2))
SELECT printf('P%02d', row_number() OVER (ORDER BY s, coalesce(t1, t2, t3))) AS path_id, t1, t2, t3 FROM p"""


def type_topic_share(spark, d):
    """Share of each topic among the documents of a source, by language."""
    rows = _docs(spark, d).select(F.col("doc_id").alias("doc"), "source", "topic", F.lower(F.coalesce("lang", F.lit("und"))).alias("lang"))
    return K.shares(rows, "source", "topic", "lang")


SQL_SHARE = "WITH n AS (SELECT lower(coalesce(lang, 'und')) AS lang, source, topic, count(DISTINCT doc_id) AS n FROM documents GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY lang, source), 6) AS share FROM n"


def topic_intensity(spark, d):
    """Documents and share of each topic, ranked, with a label."""
    n = _docs(spark, d).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("topic", "n", F.round(F.col("n") / F.col("total"), 6).alias("intensity"), F.row_number().over(W.orderBy(F.desc("n"), "topic")).alias("place"))


SQL_INTENSITY = "SELECT topic, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS intensity, row_number() OVER (ORDER BY count(*) DESC, topic) AS place FROM documents GROUP BY topic"


def presentation_terms(spark, d):
    """Terms fit for display, their frequencies summed after unification."""
    tf = K.term_frequency(_tokens(spark, d).filter("lang = 'en'"), "tokens")
    return tf.withColumn("shown", K.presentation_term(F.col("term"))).filter("shown <> ''").groupBy("shown").agg(F.sum("tf").alias("tf"), F.max("df").alias("df"))


SQL_SHOWN = f"""WITH {_TOK}, e AS (SELECT rec_id, unnest(tokens) AS term FROM t WHERE lang = 'en'), g AS (SELECT term, count(*) AS tf, count(DISTINCT rec_id) AS df FROM e GROUP BY term)
SELECT {_canon("term")} AS shown, CAST(sum(tf) AS BIGINT) AS tf, max(df) AS df FROM g WHERE {_canon("term")} NOT IN ({_STOP}, {", ".join(f"'{w}'" for w in K.PRESENTATION_STOPWORDS)}) GROUP BY ALL"""


def _modelled(spark, d):
    docs = _tokens(spark, d).filter("lang = 'en'").filter(F.size("tokens") >= K.MIN_TOKENS).select("rec_id", "tokens")
    return stage(docs, "lda-docs").df


def lda_assignment(spark, d):
    """Dominant topic of every modelled document."""
    docs = _modelled(spark, d)
    _, model, rows = K.fit_lda(docs, "tokens", 6, max_iter=4)
    return K.assign_topics(model, rows, "rec_id")


def lda_selection(spark, d):
    """Topic counts by perplexity and coherence, and the one selected."""
    docs = _modelled(spark, d)
    out = []
    for k in (4, 6, 8):
        vectoriser, model, rows = K.fit_lda(docs, "tokens", k, max_iter=3)
        top = model.describeTopics(10).select(F.explode("termIndices").alias("i")).distinct().collect()
        terms = spark.createDataFrame([(vectoriser.vocabulary[r["i"]],) for r in top], "term string")
        coherence = K.npmi(docs, "rec_id", "tokens", terms).agg(F.avg("npmi")).first()[0] or 0.0
        out.append((k, float(model.logPerplexity(rows)), float(coherence)))
    return K.select_k(spark.createDataFrame(out, "k int, perplexity double, coherence double"))


def _news(spark, d):
    """News and notes scored by the market lexicon, their title weighing more."""
    rows = spread(_docs(spark, d).select("doc_id", "source", "topic", "title", "text")).select("doc_id", "source", "topic", E.tokens_of(F.col("text")).alias("body"), E.tokens_of(F.col("title")).alias("head"))
    return E.score_documents(rows, F.col("body"), F.col("head"), E.lexicon_map(E.POSITIVE, E.NEGATIVE))


def sentiment_scores(spark, d):
    r = _news(spark, d)
    return r.select("doc_id", F.round("raw_score", 6).alias("raw_score"), F.round("positive_mass", 6).alias("positive_mass"), F.round("negative_mass", 6).alias("negative_mass"), "positive_hits", "negative_hits", F.round("sentiment", 6).alias("sentiment"), "label")


_LEX = {w: 1.0 for w in E.POSITIVE} | {w: -1.0 for w in E.NEGATIVE}
_LEXSQL = "MAP {" + ", ".join(f"'{w}': {v}" for w, v in _LEX.items()) + "}"
_SCALESQL = "MAP {" + ", ".join(f"'{w}': {v}" for w, v in E.SCALES.items()) + "}"
_NEG = ", ".join(f"'{w}'" for w in E.NEGATIONS)


def _hits(tok):
    before = f"list_slice({tok}, greatest(i - 3, 1), i - 1)"
    factor = f"coalesce(list_product(list_transform({before}, lambda w: coalesce({_SCALESQL}[w], 1.0))), 1.0)"
    return f"list_filter(list_transform(range(1, len({tok}) + 1), lambda i: {{'token': {tok}[i], 'score': {_LEXSQL}[{tok}[i]] * CASE WHEN list_has_any({before}, [{_NEG}]) THEN -1.0 ELSE 1.0 END * {factor}}}), lambda h: h.score IS NOT NULL)"


def _sum(h, cond="TRUE", sign=""):
    return f"coalesce(list_sum(list_transform(list_filter({h}, lambda h: {cond}), lambda h: {sign}h.score)), 0.0)"


_NEWS = f"""
k AS (SELECT doc_id, source, topic, regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)?') AS body, regexp_extract_all(lower(coalesce(title, '')), '[a-z]+(?:-[a-z]+)?') AS head FROM documents),
hh AS (SELECT doc_id, source, topic, {_hits("body")} AS b, {_hits("head")} AS t FROM k),
ms AS (SELECT *, {_sum("b")} + 1.5 * {_sum("t")} AS raw_score, {_sum("b", "h.score >= 0")} + 1.5 * {_sum("t", "h.score >= 0")} AS positive_mass, {_sum("b", "h.score < 0", "-")} + 1.5 * {_sum("t", "h.score < 0", "-")} AS negative_mass,
  len(list_filter(list_concat(b, t), lambda h: h.score >= 0)) AS positive_hits, len(list_filter(list_concat(b, t), lambda h: h.score < 0)) AS negative_hits FROM hh),
sc AS (SELECT *, raw_score / (positive_mass + negative_mass + 3.0) AS sentiment FROM ms), lb AS (SELECT *, CASE WHEN sentiment >= 0.1 THEN 'bullish' WHEN sentiment <= -0.1 THEN 'bearish' ELSE 'neutral' END AS label FROM sc)"""
SQL_SCORES = f"WITH {_NEWS} SELECT doc_id, round(raw_score, 6) AS raw_score, round(positive_mass, 6) AS positive_mass, round(negative_mass, 6) AS negative_mass, CAST(positive_hits AS INTEGER) AS positive_hits, CAST(negative_hits AS INTEGER) AS negative_hits, round(sentiment, 6) AS sentiment, label FROM lb"


def sentiment_labels(spark, d):
    return _news(spark, d).groupBy("source", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("sentiment"), 6).alias("mean_sentiment"))


SQL_LABELS = f"WITH {_NEWS} SELECT source, label, count(*) AS n, round(avg(sentiment), 6) AS mean_sentiment FROM lb GROUP BY ALL"


def sentiment_pivot(spark, d):
    """Documents of each topic by label, columns in fixed order."""
    return _news(spark, d).groupBy("topic").pivot("label", ["bullish", "neutral", "bearish"]).count().na.fill(0)


SQL_PIVOT = f"WITH {_NEWS} SELECT topic, count(*) FILTER (label = 'bullish') AS bullish, count(*) FILTER (label = 'neutral') AS neutral, count(*) FILTER (label = 'bearish') AS bearish FROM lb GROUP BY topic"


def matched_terms_top20(spark, d):
    return E.matched_terms(_news(spark, d), 20)


SQL_MATCHED = f"WITH {_NEWS}, e AS (SELECT unnest(list_concat(b, t)) AS h FROM lb), g AS (SELECT CASE WHEN h.score >= 0 THEN 'bullish' ELSE 'bearish' END AS direction, h.token AS token, count(*) AS n FROM e GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY direction ORDER BY n DESC, token) AS place FROM g QUALIFY place <= 20"

BASE_POSITIVE, BASE_NEGATIVE = ["rally", "surge", "premium", "decline"], ["glut", "slump", "storms", "weak", "outage"]


def _words(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


def _expansion(spark, d):
    freq = K.term_frequency(spread(_docs(spark, d).select("text")).select(E.tokens_of(F.col("text")).alias("tokens")), "tokens").withColumnRenamed("term", "word")
    terms = _words(spark, E.POSITIVE).withColumn("polarity", F.lit("positive")).unionByName(_words(spark, E.NEGATIVE).withColumn("polarity", F.lit("negative")))
    return E.expansion(terms, freq, _words(spark, BASE_POSITIVE), _words(spark, BASE_NEGATIVE), 10)


def lexicon_expansion(spark, d):
    """What the domain terms do to the base lists, by frequency in the corpus."""
    return _expansion(spark, d)


_VAL = lambda ws: ", ".join(f"('{w}')" for w in ws)
_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)
_EXP = f"""
e AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+(?:-[a-z]+)?')) AS word FROM documents), f AS (SELECT word, count(*) AS tf, count(DISTINCT doc_id) AS df FROM e GROUP BY word),
x AS (SELECT word, 'positive' AS polarity FROM (VALUES {_VAL(E.POSITIVE)}) p(word) UNION ALL SELECT word, 'negative' FROM (VALUES {_VAL(E.NEGATIVE)}) n(word)),
r AS (SELECT x.word, polarity, tf, df, CASE WHEN polarity = 'positive' AND x.word IN ({_IN(BASE_POSITIVE)}) THEN 'already_positive' WHEN polarity = 'negative' AND x.word IN ({_IN(BASE_NEGATIVE)}) THEN 'already_negative'
  WHEN x.word IN ({_IN(BASE_POSITIVE)}) THEN 'reclassified_from_positive' WHEN x.word IN ({_IN(BASE_NEGATIVE)}) THEN 'reclassified_from_negative' ELSE 'added' END AS action FROM x JOIN f USING (word) WHERE tf >= 10)"""
SQL_EXPANSION = f"WITH {_EXP} SELECT * FROM r"


def lexicon_merge(spark, d):
    return E.merge_lexicons(_words(spark, BASE_POSITIVE), _words(spark, BASE_NEGATIVE), _expansion(spark, d))


SQL_MERGE = f"""WITH {_EXP}, b AS (SELECT word, 'positive' AS polarity FROM (VALUES {_VAL(BASE_POSITIVE)}) p(word) UNION SELECT word, 'negative' FROM (VALUES {_VAL(BASE_NEGATIVE)}) n(word))
SELECT word, polarity FROM b WHERE word NOT IN (SELECT word FROM r) UNION SELECT word, polarity FROM r"""

_ALL = {
    "term_tf_df": (term_tf_df, SQL_TFDF), "ranked_terms": (ranked_terms, SQL_RANKED), "preprocess_funnel": (preprocess_funnel, SQL_FUNNEL), "term_pair_npmi": (term_pair_npmi, SQL_NPMI), "period_cosine_links": (period_cosine_links, SQL_COSINE),
    "topic_matches": (topic_matches, ""), "evolution_paths": (evolution_paths, SQL_PATHS), "type_topic_share": (type_topic_share, SQL_SHARE), "topic_intensity": (topic_intensity, SQL_INTENSITY), "presentation_terms": (presentation_terms, SQL_SHOWN),
    "lda_assignment": (lda_assignment, ""), "lda_selection": (lda_selection, ""), "sentiment_scores": (sentiment_scores, SQL_SCORES), "sentiment_labels": (sentiment_labels, SQL_LABELS), "sentiment_pivot": (sentiment_pivot, SQL_PIVOT),
    "matched_terms_top20": (matched_terms_top20, SQL_MATCHED), "lexicon_expansion": (lexicon_expansion, SQL_EXPANSION), "lexicon_merge": (lexicon_merge, SQL_MERGE),
}


def queries():
    return {k: v[0] for k, v in _ALL.items()}


def oracle_sql():
    return {k: v[1] for k, v in _ALL.items() if v[1]}
