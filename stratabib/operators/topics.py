"""Topic analysis: tokens, frequencies, models per period, links between periods, profiles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratabib.functions import text as T

#: Phrases kept together as one term, and a small canonical table (fixed values); larger tables are parameters.
PHRASES = {"hydraulic fracturing": "hydraulic_fracturing", "core flooding": "core_flooding", "pore structure": "pore_structure", "shale gas": "shale_gas", "machine learning": "machine_learning", "gas content": "gas_content", "oil saturation": "oil_saturation"}
CANONICAL = {
    "reservoir": "储层", "hydraulic_fracturing": "水力压裂", "压裂": "水力压裂", "shale_gas": "页岩气", "porosity": "孔隙度", "wellbore": "井筒", "asphaltene": "沥青质", "carbonate": "碳酸盐岩",
    "sag": "凹陷", "co2": "二氧化碳", "permeability": "渗透率", "shale": "页岩", "sandstone": "砂岩",
}
STOPWORDS = ["the", "of", "and", "in", "on", "to", "for", "with", "was", "were", "is", "are", "by", "from", "at", "that", "which", "this", "an", "as", "be", "near", "after", "its", "their"]
PRESENTATION_STOPWORDS = ["ratio", "studied", "production", "one", "two", "all", "but"]
ANCHORS = ["oil", "gas", "reservoir", "储层", "shale", "页岩", "drilling", "well", "pipeline", "refinery", "permeability", "渗透率", "水力压裂", "core_flooding", "flooding", "sandstone", "砂岩"]
MIN_TOKENS = 8
LINK = 0.20


def replace_phrases(text: Column, phrases: dict[str, str]) -> Column:
    """Phrases by their terms, the longest first, between blanks."""
    out = F.concat(F.lit(" "), F.lower(T.compact(text)), F.lit(" "))
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        out = F.replace(out, F.lit(f" {p} "), F.lit(f" {phrases[p]} "))
    return out


def canonical(token: Column, table: dict[str, str]) -> Column:
    """A term by the table, trying the singular of plural forms."""
    t = F.trim(F.translate(F.lower(token), "-/", "__"), F.lit("_"))
    m = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(
        F.try_element_at(m, t), F.when(t.endswith("ies"), F.try_element_at(m, F.concat(F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))), F.when(t.endswith("s"), F.try_element_at(m, F.substring(t, F.lit(1), F.length(t) - 1))), t
    )


def inflected(table: dict[str, str]) -> dict[str, str]:
    """The table with plural forms spelled out, for one lookup a word."""
    plurals = {f"{k}s": v for k, v in table.items()} | {f"{k[:-1]}ies": v for k, v in table.items() if k.endswith("y")}
    return plurals | table


def english_tokens(text: Column, phrases: dict[str, str] = PHRASES, table: dict[str, str] = CANONICAL, stop: list[str] = STOPWORDS) -> Column:
    words = F.regexp_extract_all(F.regexp_replace(replace_phrases(text, phrases), "[-/]", " "), F.lit("[a-z][a-z0-9_]+"), 0)
    forms = inflected(table)
    m = F.create_map(*(F.lit(x) for kv in forms.items() for x in kv))
    # few words are in the table: a set look-up decides before the map is searched
    return F.transform(F.filter(F.transform(words, lambda w: F.rtrim(w, F.lit("_"))), lambda w: (F.length(w) >= 2) & ~w.isin(*stop)), lambda w: F.when(w.isin(*forms), F.try_element_at(m, w)).otherwise(w))


def chinese_tokens(text: Column, words: list[str]) -> Column:
    """Forward longest match against a word list by one alternation, longest first; other characters are skipped."""
    pattern = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})"), 1)


def presentation_term(token: Column, table: dict[str, str] = CANONICAL) -> Column:
    """A term fit for display, '' for generic ones."""
    c = canonical(token, table)
    return F.when(c.isin(*STOPWORDS, *PRESENTATION_STOPWORDS), "").otherwise(c)


def topic_label(terms: Column, stop: list[str] = STOPWORDS) -> Column:
    """Up to four terms, those without Latin letters if there are any."""
    kept = F.filter(terms, lambda t: ~t.isin(*stop))
    plain = F.filter(kept, lambda t: ~t.rlike("[A-Za-z]"))
    chosen = F.when(F.size(plain) > 0, plain).when(F.size(kept) > 0, kept).otherwise(terms)
    return F.array_join(F.slice(chosen, 1, 4), " / ")


def choose_abstract(en: Column, zh: Column) -> Column:
    """``struct<text, lang>``: English of 30 characters or more, else Chinese, else any English."""
    e, z = T.compact(T.text_or_empty(en)), T.compact(T.text_or_empty(zh))
    pick = lambda t, lang: F.struct(t.alias("text"), F.lit(lang).alias("lang"))
    return F.when(F.length(e) >= 30, pick(e, "en")).when(z != "", pick(z, "zh")).when(e != "", pick(e, "en")).otherwise(pick(F.lit(""), ""))


def term_frequency(docs: DataFrame, tokens: str, *by: str) -> DataFrame:
    """Occurrences and documents of each term, in all or by columns: counted per document first, so no distinct is needed."""
    numbered = docs.select(*by, tokens).withColumn("_d", F.monotonically_increasing_id())
    own = numbered.select(*by, "_d", F.explode(tokens).alias("term")).groupBy(*by, "_d", "term").agg(F.count(F.lit(1)).alias("n"))
    return own.groupBy(*by, "term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def ranked_terms(tf: DataFrame, by: str, top: int) -> DataFrame:
    """The most frequent terms per group with cloud weight; a top-n report."""
    w = W.partitionBy(by)
    return tf.withColumns({"place": F.row_number().over(w.orderBy(F.desc("tf"), "term")), "cloud_weight": F.round(F.col("tf") / F.max("tf").over(w), 6)}).filter(F.col("place") <= top)


def npmi(docs: DataFrame, doc: str, tokens: str, terms: DataFrame) -> DataFrame:
    """NPMI of pairs of chosen terms over documents; -1 for pairs that never meet.

    Only the chosen terms are kept before documents are joined with themselves, so a document gives at most their pairs.
    """
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("n"))
    own = docs.select(doc, F.explode(F.array_distinct(tokens)).alias("term")).join(F.broadcast(terms.select("term")), "term")
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    a, b = own.alias("a"), own.alias("b")
    met = a.join(b, F.col(f"a.{doc}") == F.col(f"b.{doc}")).filter("a.term < b.term").groupBy(F.col("a.term").alias("x"), F.col("b.term").alias("y")).agg(F.count(F.lit(1)).alias("joint"))
    pairs = df.select(F.col("term").alias("x"), F.col("df").alias("dx")).crossJoin(F.broadcast(df.select(F.col("term").alias("y"), F.col("df").alias("dy")))).filter("x < y")
    rows = pairs.join(met, ["x", "y"], "left").crossJoin(F.broadcast(n))
    eps = 1e-12
    p = F.col("joint") / F.col("n")
    value = F.ln((p + eps) / (F.col("dx") / F.col("n") * F.col("dy") / F.col("n") + eps)) / -F.ln(p + eps)
    return rows.select("x", "y", F.coalesce("joint", F.lit(0)).alias("joint"), F.round(F.when(F.col("joint").isNull(), -1.0).otherwise(value), 6).alias("npmi"))


def distribution(weights: DataFrame, topic: list[str]) -> DataFrame:
    """Positive weights of each topic's terms, summing to 1."""
    kept = weights.filter("weight > 0")
    return kept.withColumn("p", F.col("weight") / F.sum("weight").over(W.partitionBy(*topic)))


def cosine(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left_topic, right_topic, similarity)`` of all topics of two periods over ``(topic, term, p)``; topics are few."""
    norm = lambda d: d.groupBy("topic").agg(F.sqrt(F.sum(F.col("p") ** 2)).alias("norm"))
    grid = norm(left).select(F.col("topic").alias("left_topic"), F.col("norm").alias("ln")).crossJoin(F.broadcast(norm(right).select(F.col("topic").alias("right_topic"), F.col("norm").alias("rn"))))
    dot = left.select(F.col("topic").alias("left_topic"), "term", F.col("p").alias("lp")).join(right.select(F.col("topic").alias("right_topic"), "term", F.col("p").alias("rp")), "term").groupBy("left_topic", "right_topic").agg(F.sum(F.col("lp") * F.col("rp")).alias("dot"))
    return grid.join(dot, ["left_topic", "right_topic"], "left").select("left_topic", "right_topic", F.round(F.coalesce("dot", F.lit(0.0)) / (F.col("ln") * F.col("rn")), 6).alias("similarity"))


def assignment(cost: list[list[float]]) -> list[int]:
    """Column of each row in a one-to-one assignment of least total cost (-1 for rows without one); shortest augmenting paths."""
    if not cost or not cost[0]:
        return [-1] * len(cost)
    n, m = len(cost), len(cost[0])
    if n > m:
        back = assignment([list(c) for c in zip(*cost)])
        out = [-1] * n
        for j, i in enumerate(back):
            if i >= 0:
                out[i] = j
        return out
    inf = float("inf")
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0] = i
        least, used, way, j0 = [inf] * (m + 1), [False] * (m + 1), [0] * (m + 1), 0
        while True:
            used[j0] = True
            i0, delta, j1 = owner[j0], inf, 0
            for j in range(1, m + 1):
                if not used[j]:
                    c = cost[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if used[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if not owner[j0]:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


#: Topics of a period; a period's topics are model components, chosen by the user.
MAX_TOPICS = 2_000


def match_topics(links: DataFrame) -> DataFrame:
    """The one-to-one match of two periods' topics with most total similarity; linked if at least LINK."""
    rows = links.orderBy("left_topic", "right_topic").limit(MAX_TOPICS**2 + 1).collect()
    if len(rows) > MAX_TOPICS**2:
        raise ValueError("too many topics to match on the driver")
    left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    sim = {(r[0], r[1]): r[2] for r in rows}
    found = assignment([[1.0 - sim[a, b] for b in right] for a in left])
    out = [(a, right[j], float(sim[a, right[j]]), int(sim[a, right[j]] >= LINK)) for a, j in zip(left, found) if j >= 0]
    kind = dict(links.dtypes)["left_topic"]
    return links.sparkSession.createDataFrame(out, f"left_topic {kind}, right_topic {kind}, similarity double, linked int")


def evolution_paths(first: DataFrame, second: DataFrame, third: DataFrame, link_12: DataFrame, link_23: DataFrame) -> DataFrame:
    """``(path_id, t1, t2, t3)``: topics of the first period followed on, then those that begin in the second, then in the third.

    Each period gives a column ``topic``; links give ``left_topic, right_topic`` one to one.
    """
    a, b = link_12.select(F.col("left_topic").alias("t1"), F.col("right_topic").alias("t2")), link_23.select(F.col("left_topic").alias("t2"), F.col("right_topic").alias("t3"))
    from_1 = first.select(F.col("topic").alias("t1")).join(a, "t1", "left").join(b, "t2", "left").select(F.lit(1).alias("start"), "t1", "t2", "t3")
    from_2 = second.select(F.col("topic").alias("t2")).join(a.select("t2"), "t2", "left_anti").join(b, "t2", "left").select(F.lit(2).alias("start"), F.lit(None).cast(dict(from_1.dtypes)["t1"]).alias("t1"), "t2", "t3")
    from_3 = third.select(F.col("topic").alias("t3")).join(b.select("t3"), "t3", "left_anti").select(F.lit(3).alias("start"), F.lit(None).cast(dict(from_1.dtypes)["t1"]).alias("t1"), F.lit(None).cast(dict(from_1.dtypes)["t2"]).alias("t2"), "t3")
    every = from_1.unionByName(from_2).unionByName(from_3)
    return every.withColumn("path_id", F.format_string("P%02d", F.row_number().over(W.orderBy("start", F.coalesce("t1", "t2", "t3"))))).select("path_id", "t1", "t2", "t3")


def shares(rows: DataFrame, category: str, topic: str, *by: str) -> DataFrame:
    """Documents of each category and topic and their share of the category; a document counts once a category."""
    n = rows.groupBy(*by, category, topic).agg(F.count_distinct("doc").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*by, category)), 6))


def seeded_sample(docs: DataFrame, id_col: str, size: int, seed: int = 42) -> DataFrame:
    """``size`` documents in an order that only the seed and the ids set."""
    return docs.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(size)


def fit_lda(docs: DataFrame, tokens: str, k: int, min_df: float = 20, max_df: float = 0.45, features: int = 5000, max_iter: int = 12, seed: int = 42):
    """(vectoriser, model, documents with ``features``): online LDA over a bag of words."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    vectoriser = CountVectorizer(inputCol=tokens, outputCol="features", minDF=min_df, maxDF=max_df, vocabSize=features).fit(docs)
    rows = vectoriser.transform(docs)
    model = LDA(k=k, maxIter=max_iter, optimizer="online", learningOffset=50.0, seed=seed, featuresCol="features").fit(rows)
    return vectoriser, model, rows


def assign_topics(model, rows: DataFrame, id_col: str) -> DataFrame:
    """Dominant topic and its probability."""
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("topicDistribution")
    return model.transform(rows).select(id_col, p.alias("p")).select(id_col, (F.array_position("p", F.array_max("p")) - 1).cast("int").alias("topic"), F.round(F.array_max("p"), 6).alias("probability"))


def select_k(rows: DataFrame) -> DataFrame:
    """The topic count with the best sum of ranks (perplexity up, coherence down); ties by coherence rank, then perplexity."""
    ranked = rows.withColumns({"perplexity_rank": F.rank().over(W.orderBy("perplexity")), "coherence_rank": F.rank().over(W.orderBy(F.desc("coherence")))})
    order = W.orderBy(F.col("perplexity_rank") + F.col("coherence_rank"), "coherence_rank", "perplexity", "k")
    return ranked.withColumn("selected", (F.row_number().over(order) == 1).cast("int"))
