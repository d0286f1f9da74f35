"""Impact indicators of institutions over a paper-institution bridge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratabib.functions import text as T


def h_index(rows: DataFrame, group: str, citations: str) -> DataFrame:
    """``(group, h_index)``: the largest h with h papers cited at least h times.

    Papers are counted by citation first, so a group with many papers shuffles one row per distinct count.
    """
    counts = rows.groupBy(group, F.floor(F.col(citations)).alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(group).orderBy(F.desc("_c")).rowsBetween(W.unboundedPreceding, 0)
    # among papers cited exactly c times, h can reach min(c, papers cited at least c times)
    return counts.withColumn("_at_least", F.sum("_n").over(w)).groupBy(group).agg(F.max(F.greatest(F.lit(0), F.least("_c", "_at_least"))).cast("bigint").alias("h_index"))


def nearest_rank(rows: DataFrame, value: str, p: float) -> DataFrame:
    """One row with the nearest-rank percentile over all rows; 0 for an empty table.

    Exact without gathering values: they are counted by value, and the running count over distinct values is
    compared with the rank.
    """
    counts = rows.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    # the running count goes over distinct values, of which citations have few
    running = counts.withColumn("upto", F.sum("n").over(W.orderBy("v").rowsBetween(W.unboundedPreceding, 0)))
    reached = running.crossJoin(F.broadcast(total)).filter(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("total"))))
    return reached.agg(F.coalesce(F.min("v"), F.lit(0.0)).alias("threshold"))


def bucket_counts(year: Column, buckets: list[tuple[str, int, int]]) -> list[Column]:
    return [F.count_if(year.between(a, b)).alias(f"paper_count_{label}") for label, a, b in buckets]


def home_country(pairs: DataFrame, institution: str, country: str) -> DataFrame:
    """The most frequent country of each institution; ties go to the one seen first, then by name. None: China for a Chinese name, else Unknown."""
    tally = pairs.filter(F.col(country) != "").groupBy(institution, country).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    best = tally.groupBy(institution).agg(F.max_by(country, F.struct("n", (-F.col("first")).alias("f"), country)).alias("home"))
    every = pairs.select(institution).distinct()
    return every.join(best, institution, "left").select(institution, F.coalesce("home", F.when(T.has_cjk(institution), "China").otherwise("Unknown")).alias("home_country"))


def country_shares(pairs: DataFrame, name: str, country: str, top: int = 3) -> DataFrame:
    """Per name: its main country, that country's share, the number of countries and the first few listed."""
    n = pairs.filter(F.col(country) != "").groupBy(name, country).agg(F.count(F.lit(1)).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("neg"), F.col(country).alias("c"))))
    g = n.groupBy(name).agg(listed.alias("l"), F.sum("n").alias("total"))
    return g.select(name, F.col("l")[0]["c"].alias("main_country"), F.round(-F.col("l")[0]["neg"] / F.col("total"), 4).alias("main_share"), F.size("l").alias("n_countries"), F.array_join(F.transform(F.slice("l", 1, top), lambda x: x["c"]), " / ").alias("summary"))


def collaboration(bridge: DataFrame, paper: str, institution: str, targets: DataFrame | None = None) -> DataFrame:
    """Per institution: papers with partners, distinct partners, partners summed over papers.

    Papers by many institutions would square in a self-join; partners per paper are counted by a window over the
    paper instead, and only distinct partners need the join, between distinct pairs.
    """
    rows = bridge.select(paper, institution).distinct()
    sized = rows.withColumn("n", F.count(F.lit(1)).over(W.partitionBy(paper)))
    counted = sized.groupBy(institution).agg(F.count_if(F.col("n") > 1).alias("collaboration_paper_count"), F.sum(F.col("n") - 1).alias("partner_total"))
    left = sized.filter("n > 1").select(paper, institution)
    if targets is not None:
        left = left.join(targets.select(institution), institution, "left_semi")
        counted = counted.join(targets.select(institution), institution, "left_semi")
    partners = left.join(sized.filter("n > 1").select(paper, F.col(institution).alias("_p")), paper).filter(F.col(institution) != F.col("_p"))
    distinct = partners.groupBy(institution).agg(F.count_distinct("_p").alias("partner_institution_count"))
    return counted.join(distinct, institution, "left").select(institution, "collaboration_paper_count", "partner_total", F.coalesce("partner_institution_count", F.lit(0)).alias("partner_institution_count"))


def impact(papers: DataFrame, bridge: DataFrame, countries: DataFrame, top: DataFrame, start: int, end: int, buckets: list[tuple[str, int, int]]) -> DataFrame:
    """All indicators of the institutions in ``top``.

    ``papers`` has ``paper, source, year, cited``; ``bridge`` ``paper, inst``; ``countries`` ``paper, inst, country, seq``;
    ``top`` ``inst``. The high-cited threshold is taken over all papers. A partner is foreign if a country of it on
    the paper differs from the institution's home; partners without one take their home if they are in ``top``.
    """
    bridge = bridge.select("paper", "inst").distinct()
    own = bridge.join(top.select("inst"), "inst", "left_semi")
    rows = own.join(papers, "paper")
    threshold = nearest_rank(papers, "cited", 0.9)
    rows = rows.crossJoin(F.broadcast(threshold))
    inside = F.col("year").between(start, end)
    base = rows.groupBy("inst").agg(
        F.count(F.lit(1)).alias("paper_count"), *(F.count_if(F.col("source") == s).alias(f"paper_count_{s.lower()}") for s in ("CNKI", "WOS", "CSCD")),
        F.min(F.when(inside, F.col("year"))).alias("first_year"), F.max(F.when(inside, F.col("year"))).alias("last_year"), F.count_distinct(F.when(inside, F.col("year"))).alias("active_years"),
        *bucket_counts(F.col("year"), buckets),
        F.sum("cited").alias("total_citations"), F.max("cited").alias("max_citations"), F.percentile("cited", F.lit(0.5)).alias("median_citations"),
        F.count_if(F.col("cited") > 0).alias("cited_papers"), F.count_if(F.col("cited") >= F.col("threshold")).alias("high_cited_papers"),
    )
    home = home_country(countries.join(top.select("inst"), "inst", "left_semi"), "inst", "country")
    collab = collaboration(bridge, "paper", "inst", top)
    stated = countries.filter("country <> ''").select("paper", "inst", "country").distinct()
    backed = bridge.join(stated.select("paper", "inst").distinct(), ["paper", "inst"], "left_anti").join(home, "inst").filter("home_country <> 'Unknown'").select("paper", "inst", F.col("home_country").alias("country"))
    at = stated.unionByName(backed)
    met = own.join(home, "inst").join(at.select("paper", F.col("inst").alias("partner"), "country"), "paper").filter((F.col("inst") != F.col("partner")) & (F.col("country") != F.col("home_country")))
    abroad = met.groupBy("inst").agg(F.count_distinct("paper").alias("international_papers"), F.count_distinct("partner").alias("international_partners"), F.count_distinct("country").alias("partner_countries"))
    wide = base.join(h_index(rows, "inst", "cited"), "inst").join(home, "inst", "left").join(collab, "inst", "left").join(abroad, "inst", "left").na.fill(0)
    n = F.col("paper_count")
    years = end - start + 1
    return wide.withColumns({
        "annual_papers": F.round(n / years, 4), "recent_ratio": T.safe_ratio(F.col(f"paper_count_{buckets[-1][0]}"), n), "citations_per_paper": T.safe_ratio(F.col("total_citations"), n),
        "cited_ratio": T.safe_ratio(F.col("cited_papers"), n), "high_cited_ratio": T.safe_ratio(F.col("high_cited_papers"), n), "collaboration_ratio": T.safe_ratio(F.col("collaboration_paper_count"), n),
        "partners_per_collaboration": T.safe_ratio(F.col("partner_total"), F.col("collaboration_paper_count")), "international_ratio": T.safe_ratio(F.col("international_papers"), n),
    })


def level(rank: Column, tiers: list[tuple[str, int, int]]) -> Column:
    out = F.lit("")
    for label, a, b in reversed(tiers):
        out = F.when(rank.between(a, b), label).otherwise(out)
    return out
