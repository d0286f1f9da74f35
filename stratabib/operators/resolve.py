"""Entity resolution on shared keys: components, the sequential merge rules, and field fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabib.functions import text as T
from stratabib.runtime import stage

SOURCE_ORDER = ("CNKI", "WOS", "CSCD")
ENGLISH, CHINESE = ("WOS", "CNKI", "CSCD"), ("CNKI", "CSCD", "WOS")
#: Which source a field is taken from first (fixed values); fields not named follow SOURCE_ORDER.
FIELD_PRIORITIES = {
    "title_en": ENGLISH, "journal_en": ENGLISH, "abstract_en": ENGLISH, "keywords_en": ENGLISH, "publish_date": ENGLISH,
    "title_cn": CHINESE, "title_cn_en": CHINESE, "author_cn": CHINESE, "journal_cn": CHINESE, "abstract_cn": CHINESE, "keywords_cn": CHINESE,
    "author": ("WOS", "CSCD", "CNKI"), "cited_count": ("WOS", "CSCD", "CNKI"), "registered_doi": ("CNKI", "WOS", "CSCD"),
}
#: Taken from the primary source even when empty there.
PRIMARY_FIELDS = {"year", "institution", "institution_norm"}


def components(rows: DataFrame, id_col: str, keys: list[str], max_rounds: int = 50) -> DataFrame:
    """``(id_col, component)`` of every row: the smallest id reachable over equal keys.

    Rows hold a parent, at first themselves. A round offers each row the least grandparent met under its keys, hooks the
    row and its parent to it, and points the row to its grandparent; trees merge and flatten at once, so rounds grow with
    the logarithm of the longest chain. Keys are aggregated before the shuffle, so a key that many rows share costs
    one row a task. Rounds are written to the shared folder.
    """
    long = rows.select(F.col(id_col).alias("id"), F.explode(F.array(*(F.struct(F.lit(i).alias("c"), T.text_or_empty(k).alias("k")) for i, k in enumerate(keys)))).alias("e")).select("id", "e.c", "e.k").filter("k <> ''")
    shared = long.groupBy("c", "k").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("c", "k")
    links = stage(long.join(shared, ["c", "k"]).select("id", F.xxhash64("c", "k").alias("k")), "links").df
    now = stage(links.select("id").distinct().withColumn("f", F.col("id")), "parents")
    for _ in range(max_rounds):
        up = now.df.select(F.col("id").alias("f"), F.col("f").alias("g"))
        held = now.df.join(up, "f").select("id", "f", "g")
        least = links.join(held.select("id", "g"), "id").groupBy("k").agg(F.min("g").alias("m"))
        offers = links.join(least, "k").groupBy("id").agg(F.min("m").alias("m"))
        met = held.join(offers, "id")
        moves = met.select(F.explode(F.array(F.struct("id", F.least("m", "g").alias("to")), F.struct(F.col("f").alias("id"), F.col("m").alias("to")))).alias("x")).select("x.id", "x.to").groupBy("id").agg(F.min("to").alias("to"))
        after = stage(now.df.join(moves, "id", "left").select("id", F.least("f", F.coalesce("to", "f")).alias("f"), (F.coalesce("to", "f") < F.col("f")).alias("changed")), "parents")
        now.drop()
        now = after
        if not now.df.filter("changed").limit(1).count():
            break
    else:
        raise RuntimeError(f"parents still change after {max_rounds} rounds")
    grouped = now.df.select(F.col("id").alias("_i"), F.col("f").alias("_c"))
    ids = rows.select(F.col(id_col).alias(id_col)).distinct()
    return ids.join(grouped, F.col(id_col) == F.col("_i"), "left").select(id_col, F.coalesce("_c", F.col(id_col)).alias("component"))


def replay(rows: list[tuple[int, str, str, str]]) -> list[tuple[int, int, int]]:
    """The sequential rule inside one component: rows ``(seq, doi, source id, meta)`` in order to ``(seq, group, mask)``.

    A row joins the group of its DOI, that of its source's own id if no other DOI is held there, and all groups of its meta
    key with a compatible DOI; a row without DOI and id joins by meta key only if exactly one compatible group has it, else it
    opens a group. The larger group takes in the smaller. ``mask`` has 2 for a match on DOI, 8 on the source's id, 4 on
    the meta key; a group is named by its first row.
    """
    parent: dict[int, int] = {}
    size: dict[int, int] = {}
    held: dict[int, str] = {}
    mask: dict[int, int] = {}
    by_doi: dict[str, int] = {}
    by_id: dict[str, int] = {}
    by_meta: dict[str, list[int]] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    joined: list[tuple[int, int]] = []
    for seq, doi, own, meta in rows:
        reasons = 0
        found = []
        if doi and doi in by_doi:
            found, reasons = [root(by_doi[doi])], 2
        if own and own in by_id and (not doi or held[root(by_id[own])] in ("", doi)):
            found, reasons = found + [root(by_id[own])], reasons | 8
        if meta:
            near = sorted({g for g in map(root, by_meta.get(meta, ())) if not held[g] or not doi or held[g] == doi})
            if near and (doi or len(near) == 1):
                found, reasons = found + near, reasons | 4
        groups = sorted(set(found))
        if groups:
            into = groups[0]
            for other in groups[1:]:
                into, other = root(into), root(other)
                if into == other:
                    continue
                if size[other] > size[into]:
                    into, other = other, into
                parent[other] = into
                size[into] += size[other]
                mask[into] |= mask[other]
                held[into] = held[into] or held[other]
            size[into] += 1
            mask[into] |= reasons
            held[into] = held[into] or doi
        else:
            into = seq
            parent[seq], size[seq], held[seq], mask[seq] = seq, 1, doi, 1
        joined.append((seq, into))
        if doi:
            by_doi[doi] = into
        if own:
            by_id[own] = into
        if meta:
            by_meta.setdefault(meta, []).append(into)
    first: dict[int, int] = {}
    out = []
    for seq, group in joined:
        g = root(group)
        first.setdefault(g, seq)
        out.append((seq, first[g], mask[g]))
    return out


#: Rows of one component beyond which the sequential rule isn't run in one task.
MAX_COMPONENT = 1_000_000


def merge_in_order(rows: DataFrame, id_col: str, doi: str, meta: str, order: list[str], own: str | None = None, unstable: DataFrame | None = None) -> DataFrame:
    """``(id_col, group_id, match_mask)`` under the sequential rule.

    ``own`` names a key made of the source and its own identifier. DOIs in the column ``doi`` of ``unstable``, which several
    works share, are no keys. No rule reaches beyond a component of shared keys, so the order inside components is all that
    counts and components run apart. A component over MAX_COMPONENT rows is refused, never cut.
    """
    base = rows.select(F.col(id_col).alias("id"), T.text_or_empty(doi).alias("doi"), (T.text_or_empty(own) if own else F.lit("")).alias("own"), T.text_or_empty(meta).alias("meta"), *order)
    if unstable is not None:
        shared_dois = unstable.select(T.text_or_empty("doi").alias("doi"), F.lit(True).alias("_unstable")).distinct()
        base = base.join(shared_dois, "doi", "left").withColumn("doi", F.when(F.col("_unstable"), "").otherwise(F.col("doi"))).drop("_unstable")
    parts = components(base, "id", ["doi", "own", "meta"])
    placed = base.join(parts, "id")
    most = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if most > MAX_COMPONENT:
        raise ValueError(f"a component of {most} rows is too large for the sequential rule")

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values([*order, "id"], kind="stable")
        seqs = {i: k for i, k in enumerate(pdf["id"])}
        out = replay([(i, *keys) for i, keys in enumerate(zip(pdf["doi"], pdf["own"], pdf["meta"]))])
        return pd.DataFrame({"id": [seqs[s] for s, _, _ in out], "group_id": [seqs[g] for _, g, _ in out], "match_mask": [m for _, _, m in out]})

    shared = placed.withColumn("_many", F.lit(1))
    return shared.groupBy("component").applyInPandas(run, "id bigint, group_id bigint, match_mask int").withColumnRenamed("id", id_col)


def fuse(rows: DataFrame, group: str, fields: list[str], source: str = "source_db", id_col: str = "row_id") -> DataFrame:
    """One record per group: the best row of each source, then each field from the first source that has it.

    A source's best row has most filled fields, then most text, then the greatest DOI, then the smallest id. The
    primary source is the first present; it gives ``year`` and ``institution`` even if empty there.
    """
    filled, weight = T.quality(fields)
    best = F.max_by(F.struct(*(T.text_or_empty(f).alias(f) for f in fields)), F.struct(filled, weight, T.text_or_empty("doi"), -F.col(id_col)))
    per_source = rows.groupBy(group, source).agg(best.alias("_best"), F.count(F.lit(1)).alias("_n"))
    whole = per_source.groupBy(group).agg(
        F.sum("_n").alias("group_size"),
        *(F.max(F.when(F.col(source) == s, F.col("_best"))).alias(f"_{s}") for s in SOURCE_ORDER),
    )
    present = [F.col(f"_{s}").isNotNull() for s in SOURCE_ORDER]
    primary = F.coalesce(*(F.when(p, s) for p, s in zip(present, SOURCE_ORDER)))

    def pick(field: str):
        of = lambda s: F.col(f"_{s}")[field]
        if field in PRIMARY_FIELDS:
            return F.coalesce(*(F.when(p, of(s)) for p, s in zip(present, SOURCE_ORDER)))
        order = [*FIELD_PRIORITIES.get(field, SOURCE_ORDER)]
        return F.coalesce(*(F.nullif(of(s), F.lit("")) for s in order), F.lit(""))

    return whole.select(group, "group_size", primary.alias("source_db_primary"), F.array_join(F.array_compact(F.array(*(F.when(p, s) for p, s in zip(present, SOURCE_ORDER)))), "|").alias("source_db_group"), *(pick(f).alias(f) for f in fields))


def fuse_reviewed(rows: DataFrame, group: str, fields: list[str], lists: list[str], id_col: str, sep: str = " | ") -> DataFrame:
    """Groups approved for merging to one row each: fields of the richest row, gaps filled from the next rich ones, lists united."""
    filled, weight = T.quality(fields)
    rich = F.struct((-filled).alias("f"), (-weight).alias("w"), F.col(id_col).alias("i"))
    out = [F.count(F.lit(1)).alias("n_merged"), F.min(id_col).alias(id_col)]
    for f in fields:
        value = F.nullif(T.text_or_empty(f), F.lit(""))
        if f in lists:
            tokens = F.array_sort(F.array_distinct(F.flatten(F.collect_set(T.split_list(f, r"[|;]")))))
            out.append(F.array_join(tokens, sep).alias(f))
        else:
            out.append(F.coalesce(F.min_by(value, F.when(value.isNotNull(), rich)), F.lit("")).alias(f))
    return rows.groupBy(group).agg(*out)
