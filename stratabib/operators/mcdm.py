"""Multi-criteria ranking over any matrix: normalisation, weights, TOPSIS.

The matrix is long: ``(item, field, value)``. Everything is per field, so fields spread over the cluster and no
field is gathered; a field's constants come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-12


def to_long(df: DataFrame, item: str, fields: list[str]) -> DataFrame:
    return df.select(F.col(item).alias("item"), *(F.col(f).cast("double").alias(f) for f in fields)).unpivot("item", fields, "field", "value")


def minmax(m: DataFrame) -> DataFrame:
    """Values as benefit between 0 and 1; 1 where all of a field are equal."""
    ends = m.groupBy("field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return m.join(F.broadcast(ends), "field").select("item", "field", F.when(F.abs(span) <= TINY, 1.0).otherwise((F.col("value") - F.col("lo")) / span).alias("value"))


def unit_length(m: DataFrame) -> DataFrame:
    """Values over the field's Euclidean length; 0 if that is 0."""
    length = m.groupBy("field").agg(F.sqrt(F.sum(F.col("value") ** 2)).alias("len"))
    return m.join(F.broadcast(length), "field").select("item", "field", F.when(F.col("len") <= TINY, 0.0).otherwise(F.col("value") / F.col("len")).alias("value"))


def correlations(m: DataFrame) -> DataFrame:
    """Pearson correlation of each pair of fields; 0 if either doesn't vary."""
    a, b = m.alias("a"), m.alias("b")
    pairs = a.join(b, F.col("a.item") == F.col("b.item")).select(F.col("a.field").alias("x"), F.col("b.field").alias("y"), F.col("a.value").alias("u"), F.col("b.value").alias("v"))
    g = pairs.groupBy("x", "y").agg(F.covar_pop("u", "v").alias("c"), F.stddev_pop("u").alias("su"), F.stddev_pop("v").alias("sv"))
    flat = (F.col("su") <= TINY) | (F.col("sv") <= TINY)
    return g.select("x", "y", F.when(flat, 0.0).otherwise(F.col("c") / F.when(flat, 1.0).otherwise(F.col("su") * F.col("sv"))).alias("r"))


def normalise_weights(w: DataFrame, over: list[str] | None = None) -> DataFrame:
    """Weights summing to 1, in all or within ``over``; equal if their sum is 0. Fields are few."""
    part = W.partitionBy(*over) if over else W.partitionBy(F.lit(0))
    total = F.sum("weight").over(part)
    return w.withColumn("weight", F.when(F.abs(total) <= TINY, 1.0 / F.count(F.lit(1)).over(part)).otherwise(F.col("weight") / F.when(F.abs(total) <= TINY, 1.0).otherwise(total)))


def prior_weights(dimensions: DataFrame) -> DataFrame:
    """Equal per dimension, equal within: from ``(field, dimension)``."""
    n = dimensions.agg(F.count_distinct("dimension").alias("n"))
    within = dimensions.groupBy("dimension").agg(F.count(F.lit(1)).alias("k"))
    return normalise_weights(dimensions.join(within, "dimension").crossJoin(F.broadcast(n)).select("field", (1.0 / F.col("n") / F.col("k")).alias("weight")))


def entropy_weights(scaled: DataFrame) -> DataFrame:
    """1 minus each field's entropy, normalised; needs at least two items."""
    totals = scaled.groupBy("field").agg(F.sum(F.col("value") + TINY).alias("total"), F.count(F.lit(1)).alias("n"))
    p = (F.col("value") + TINY) / F.col("total")
    g = scaled.join(F.broadcast(totals), "field").groupBy("field").agg(F.sum(p * F.ln(p)).alias("s"), F.first("n").alias("n"))
    return normalise_weights(g.select("field", (1.0 + F.col("s") / F.ln(F.col("n"))).alias("weight")))


def critic_weights(scaled: DataFrame) -> DataFrame:
    """Spread times conflict with the other fields, normalised."""
    spread = scaled.groupBy("field").agg(F.stddev_pop("value").alias("sd"))
    conflict = correlations(scaled).filter("x <> y").groupBy(F.col("x").alias("field")).agg(F.sum(1.0 - F.col("r")).alias("conflict"))
    return normalise_weights(spread.join(conflict, "field", "left").select("field", (F.col("sd") * F.coalesce("conflict", F.lit(0.0))).alias("weight")))


def combine_weights(*weights: DataFrame) -> DataFrame:
    """Mean of several weightings, normalised."""
    out = weights[0]
    for w in weights[1:]:
        out = out.unionByName(w)
    return normalise_weights(out.groupBy("field").agg(F.avg("weight").alias("weight")))


def topsis(raw: DataFrame, weights: DataFrame) -> DataFrame:
    """``(item, score)``: closeness to the ideal over unit-length weighted values, 6 decimals."""
    weighted = unit_length(raw).join(F.broadcast(weights), "field").select("item", "field", (F.col("value") * F.col("weight")).alias("value"))
    ends = weighted.groupBy("field").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    d = weighted.join(F.broadcast(ends), "field").groupBy("item").agg(F.sqrt(F.sum((F.col("value") - F.col("hi")) ** 2)).alias("up"), F.sqrt(F.sum((F.col("value") - F.col("lo")) ** 2)).alias("down"))
    total = F.col("up") + F.col("down")
    return d.select("item", F.round(F.when(total <= TINY, 0.0).otherwise(F.col("down") / F.when(total <= TINY, 1.0).otherwise(total)), 6).alias("score"))


def subscores(scaled: DataFrame, weights: DataFrame, dimensions: DataFrame) -> DataFrame:
    """``(item, dimension, score)``: scaled values under weights made to sum to 1 within each dimension."""
    within = normalise_weights(weights.join(dimensions, "field"), ["dimension"])
    return scaled.join(F.broadcast(within), "field").groupBy("item", "dimension").agg(F.round(F.sum(F.col("value") * F.col("weight")), 6).alias("score"))


def competition_rank(score: str, *ties: Column | str) -> Column:
    """1, 1, 3 ... by descending score."""
    return F.rank().over(W.orderBy(F.desc(score)))


#: Remarks on an institution's place in a dimension beside its overall rank (fixed values).
AHEAD, STRONG = "该机构在该维度表现明显优于其综合排名", "该机构在该维度与综合排名上均表现突出"


def rank_gap_remark(place: Column, overall: Column) -> Column:
    """Whether a dimension lifts an institution far above its overall rank, or both are high; '' for neither."""
    return F.when(overall - place >= 20, AHEAD).when((place <= 5) & (overall <= 20), STRONG).otherwise("")


def dominant(columns: dict[str, str]) -> Column:
    """Label of the greatest column; the first one on ties."""
    best = F.greatest(*(F.col(c) for c in columns))
    out = F.lit("")
    for c, label in reversed(list(columns.items())):
        out = F.when(F.col(c) == best, label).otherwise(out)
    return out
