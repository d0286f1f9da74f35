"""Lexicon sentiment of market news: windowed scoring, labels, summaries and lexicon upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that turn a term's sign, and words that scale it (fixed values).
NEGATIONS = ["no", "not", "never", "none", "neither", "nor", "without", "hardly", "rarely", "seldom"]
SCALES = {
    "very": 1.3, "strongly": 1.4, "sharply": 1.5, "steeply": 1.5, "significantly": 1.4, "substantially": 1.4, "deeply": 1.4, "severely": 1.5, "materially": 1.3, "further": 1.2,
    "slightly": 0.7, "modestly": 0.75, "marginally": 0.8, "partly": 0.85,
}
WINDOW, TITLE_WEIGHT, ALPHA, THRESHOLD = 3, 1.5, 3.0, 0.10
#: A market lexicon (fixed values); any table of word and polarity takes its place.
POSITIVE = ["attack", "blockade", "bullish", "curb", "cut", "deficit", "disruption", "draw", "embargo", "firmed", "jump", "outage", "premium", "rallied", "rally", "rebound", "rose", "sanctions", "shortage", "shut", "storms", "surge", "tight", "tightened"]
NEGATIVE = ["bearish", "build", "contraction", "crash", "decline", "discount", "downturn", "drop", "easing", "fell", "glut", "lower", "oversupply", "plunge", "recession", "slipped", "slowdown", "slump", "softened", "surplus", "weak", "weaker"]


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+(?:-[a-z]+)?"), 0)


def lexicon_map(positive: list[str], negative: list[str]) -> Column:
    """Word to sign; a word in both lists is negative."""
    signs = {w: 1.0 for w in positive} | {w: -1.0 for w in negative}
    return F.create_map(*(F.lit(x) for kv in signs.items() for x in kv))


def hits(tokens: Column, lexicon: Column) -> Column:
    """``array<struct<token, score>>`` of lexicon words in order.

    Any negation among the three words before turns the sign, once; every scaling word among them multiplies.
    """
    scales = F.create_map(*(F.lit(x) for kv in SCALES.items() for x in kv))

    def score(t: Column, i: Column) -> Column:
        before = F.slice(tokens, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW)))
        sign = F.when(F.arrays_overlap(before, F.array(*map(F.lit, NEGATIONS))), -1.0).otherwise(1.0)
        factor = F.aggregate(before, F.lit(1.0), lambda a, w: a * F.coalesce(F.try_element_at(scales, w), F.lit(1.0)))
        return F.struct(t.alias("token"), (F.try_element_at(lexicon, t) * sign * factor).alias("score"))

    return F.filter(F.transform(tokens, score), lambda h: h["score"].isNotNull())


def breakdown(found: Column) -> Column:
    """``struct<raw, pos, neg, n_pos, n_neg>`` of hits."""
    total = lambda cond, value: F.aggregate(F.filter(found, cond), F.lit(0.0), lambda a, h: a + value(h))
    up, down = lambda h: h["score"] >= 0, lambda h: h["score"] < 0
    return F.struct(
        F.aggregate(found, F.lit(0.0), lambda a, h: a + h["score"]).alias("raw"), total(up, lambda h: h["score"]).alias("pos"), total(down, lambda h: -h["score"]).alias("neg"),
        F.size(F.filter(found, up)).alias("n_pos"), F.size(F.filter(found, down)).alias("n_neg"),
    )


def label(score: Column) -> Column:
    return F.when(score >= THRESHOLD, "bullish").when(score <= -THRESHOLD, "bearish").otherwise("neutral")


def score_documents(df: DataFrame, body: Column, title: Column, lexicon: Column) -> DataFrame:
    """Adds masses, hits, the normalised score and its label; the title's masses weigh 1.5."""
    rows = df.withColumns({"_b": hits(body, lexicon), "_t": hits(title, lexicon)})
    rows = rows.withColumns({"_bb": breakdown(F.col("_b")), "_tb": breakdown(F.col("_t"))})
    both = lambda f: F.col(f"_bb.{f}") + F.col(f"_tb.{f}") * TITLE_WEIGHT
    rows = rows.withColumns({"raw_score": both("raw"), "positive_mass": both("pos"), "negative_mass": both("neg"), "positive_hits": F.col("_bb.n_pos") + F.col("_tb.n_pos"), "negative_hits": F.col("_bb.n_neg") + F.col("_tb.n_neg")})
    rows = rows.withColumn("sentiment", F.col("raw_score") / (F.col("positive_mass") + F.col("negative_mass") + ALPHA))
    return rows.withColumn("label", label(F.col("sentiment"))).drop("_bb", "_tb")


def matched_terms(scored: DataFrame, top: int) -> DataFrame:
    """The most frequent matched words by direction; a top-n report."""
    from pyspark.sql import Window as W

    long = scored.select(F.explode(F.concat("_b", "_t")).alias("h")).select("h.token", F.when(F.col("h.score") >= 0, "bullish").otherwise("bearish").alias("direction"))
    n = long.groupBy("direction", "token").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy("direction").orderBy(F.desc("n"), "token"))).filter(F.col("place") <= top)


def expansion(terms: DataFrame, frequency: DataFrame, positive: DataFrame, negative: DataFrame, min_frequency: int) -> DataFrame:
    """What each domain term does to the base lists, for terms frequent enough in the corpus."""
    rows = terms.join(frequency, "word").filter(F.col("tf") >= min_frequency)
    rows = rows.join(positive.select("word", F.lit(True).alias("_p")), "word", "left").join(negative.select("word", F.lit(True).alias("_n")), "word", "left")
    up = F.col("polarity") == "positive"
    inside = lambda c: F.coalesce(c, F.lit(False))
    action = (
        F.when(inside(F.col("_p")) & up, "already_positive").when(inside(F.col("_n")) & ~up, "already_negative")
        .when(inside(F.col("_p")) & ~up, "reclassified_from_positive").when(inside(F.col("_n")) & up, "reclassified_from_negative").otherwise("added")
    )
    return rows.select("word", "polarity", "tf", "df", action.alias("action"))


def merge_lexicons(positive: DataFrame, negative: DataFrame, changes: DataFrame) -> DataFrame:
    """Base lists with the changes applied; a changed word leaves the other list."""
    base = positive.select("word", F.lit("positive").alias("polarity")).unionByName(negative.select("word", F.lit("negative").alias("polarity"))).distinct()
    return base.join(changes.select("word"), "word", "left_anti").unionByName(changes.select("word", "polarity")).distinct()
