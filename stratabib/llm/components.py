"""Pairwise matches to groups: alternating large-star and small-star edge rewrites.

Every node ends up linked to the smallest id of its component. A large-star step links each node's
larger neighbours to the smallest of its neighbourhood, a small-star step links its smaller ones and
itself; both are one aggregation (combined before the shuffle) and one join. Edges live in tables in
the shared folder, so a lost executor costs the tasks it ran, not the rounds before.

A node that many edges share (the hub of a large component) would make one join key hold a large part of
all edges. Nodes with over 1/HEAVY_SHARE of the edges are at most 2 * HEAVY_SHARE in number by that very
condition, so they are broadcast; the edges of all other nodes are spread by the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabib.runtime import Staged, stage

HEAVY_SHARE = 1000
MISSING = ("", "nan")


def _minimum(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Smallest neighbour of each node, split into light nodes and the few heavy ones."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
    heavy_from = max(n // HEAVY_SHARE, 10_000)
    return least.filter(F.col("d") <= heavy_from).select("u", "m"), least.filter(F.col("d") > heavy_from).select("u", F.col("m").alias("hm"))


def _with_minimum(edges: DataFrame, n: int) -> DataFrame:
    light, heavy = _minimum(edges, n)
    if n <= 10_000:  # no node can be heavy
        return edges.join(light, "u")
    marked = edges.join(F.broadcast(heavy), "u", "left")
    # a heavy node's edges carry their minimum already and take a key of their own each, so none gathers in one task
    keyed = marked.withColumn("k", F.when(F.col("hm").isNull(), F.col("u")))
    joined = keyed.filter("k is not null").join(light, "u").select("u", "v", "m")
    return joined.unionByName(keyed.filter("k is null").select("u", "v", F.col("hm").alias("m")))


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """From edges stored once: link each node's larger neighbours to the smallest of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    rows = _with_minimum(both, 2 * n)
    return rows.filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """From edges (larger, smaller): link each node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    rows = _with_minimum(down, n)
    return rows.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a task; the root of each tree is its smallest node."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    yield pa.RecordBatch.from_pydict({"node": list(root), "component": [find(x) for x in root]}, schema=pa.schema([("node", pa.int64()), ("component", pa.int64())]))


def connected_components(edges: DataFrame, max_rounds: int = 60, in_task: int = 0) -> DataFrame:
    """``(node, component)`` of every node that has an edge; the component is its smallest node.

    Up to ``in_task`` edges, counted first, are united in one task instead of by rounds, with the same result.

    ``edges`` has bigint columns ``u, v``; NULL ends and loops are left out, repeated and reversed edges count
    once. An empty table gives an empty result.
    """
    start = edges.filter("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stage(start, "star-edges")
    seen = _signature(now.df)
    if 0 < seen[0] <= in_task:
        return now.df.repartition(1).mapInArrow(_united, "node bigint, component bigint")
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        after = stage(small_star(large_star(now.df, seen[0]), seen[0]), "star-edges")
        now.drop()
        now, before, seen = after, seen, _signature(after.df)
        if seen == before:
            break
    else:
        raise RuntimeError(f"edges still change after {max_rounds} rounds")
    stars = now.df
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def key_edges(rows: DataFrame, id_col: str, key_cols: list[str]) -> DataFrame:
    """Each row linked to the smallest row that has the same value in the same key column.

    A value shared by k rows gives k - 1 edges, never all pairs. Missing values (NULL, '', ``nan``) link nothing.
    """
    long = rows.select(F.col(id_col).cast("bigint").alias("id"), F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.trim(F.col(c).cast("string")).alias("k")) for i, c in enumerate(key_cols)))).alias("e")).select("id", "e.c", "e.k")
    long = long.filter(F.col("k").isNotNull() & ~F.col("k").isin(*MISSING))
    least = long.groupBy("c", "k").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("c", "k", "least")
    return long.join(least, ["c", "k"]).filter("id <> least").select(F.col("id").alias("u"), F.col("least").alias("v"))


def group_rows(rows: DataFrame, id_col: str = "row_id", key_cols: tuple[str, ...] = ("standard_doi_key", "meta_dedup_key")) -> DataFrame:
    """``(id_col, group_id)`` of rows that share a key with another row, directly or through others.

    Rows without a partner have no row in the result. Equal ids are one node. Other columns, even ones named
    ``u``, ``v`` or ``group_id``, are not read.
    """
    groups = connected_components(key_edges(rows, id_col, list(key_cols)))
    return groups.select(F.col("node").alias(id_col), F.col("component").alias("group_id"))
