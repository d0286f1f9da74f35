"""A training mix to target shares as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity flows
from patterns to source quotas; using a pattern's documents for the r-th time costs r, so repetition is
convex and spreads before it deepens. The flow is solved over patterns, never over documents; documents are
then laid end to end in seeded order and each source takes the stretch of that line which its flow covers.
"""

from __future__ import annotations

import base64
import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratabib.runtime import spread, stage

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern that belongs to the tokenizer's ranks (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Target rows of one window partition when documents are laid end to end.
LINE = 10_000


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str):
    schema = pa.schema([("_id", pa.int64()), ("_members", pa.list_(pa.string())), ("_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            tokens = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(schema.field(1).type), pa.array(tokens, pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, members, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(_id, _members, _tokens)``: tokens of whole texts; a missing text has none. ``members`` is an array of sources."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), members.cast("array<string>").alias("_members"), F.col(text_col).cast("string").alias("_text"))
    return spread(rows).mapInArrow(_counter(tokenizer), "_id bigint, _members array<string>, _tokens bigint")


def min_cost_flow(supply: dict, quota: dict[str, int], repeats: dict[str, int]) -> dict[tuple, int]:
    """Tokens routed from each pattern to each source: as much as the quotas take, at least total cost.

    ``supply`` maps a pattern (tuple of sources) to its tokens. A pattern's tokens may be used once per tier;
    tier r costs r. A source draws at most its ``repeats`` times a pattern's tokens, and no pattern is used
    more often than the largest ``repeats`` among its sources.
    """
    patterns = [p for p in supply if supply[p] > 0 and any(quota.get(s, 0) > 0 and repeats.get(s, 0) > 0 for s in p)]
    nodes = {"in": 0, "out": 1}
    for p in patterns:
        nodes["p", p] = len(nodes)
    for s in quota:
        nodes["s", s] = len(nodes)
    graph: list[list[list]] = [[] for _ in nodes]

    def edge(a, b, cap: int, cost: int) -> list:
        e = [nodes[b], cap, cost, None]
        r = [nodes[a], 0, -cost, e]
        e[3] = r
        graph[nodes[a]].append(e)
        graph[nodes[b]].append(r)
        return e

    routed = {}
    for p in patterns:
        for tier in range(1, max(repeats.get(s, 0) for s in p if s in quota) + 1):
            edge("in", ("p", p), supply[p], tier)
        for s in p:
            if s in quota and repeats.get(s, 0) > 0:
                routed[p, s] = edge(("p", p), ("s", s), supply[p] * repeats[s], 0)
    for s, q in quota.items():
        edge(("s", s), "out", q, 0)

    n = len(nodes)
    potential = [0] * n
    while True:  # successive shortest paths under potentials
        dist, prev = [math.inf] * n, [None] * n
        dist[0] = 0
        heap = [(0, 0)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                if e[1] > 0 and d + e[2] + potential[u] - potential[e[0]] < dist[e[0]]:
                    dist[e[0]] = d + e[2] + potential[u] - potential[e[0]]
                    prev[e[0]] = e
                    heapq.heappush(heap, (dist[e[0]], e[0]))
        if prev[1] is None:
            break
        potential = [potential[i] + (dist[i] if dist[i] < math.inf else 0) for i in range(n)]
        push, v = math.inf, 1
        while v:
            push, v = min(push, prev[v][1]), prev[v][3][0]
        v = 1
        while v:
            prev[v][1] -= push
            prev[v][3][1] += push
            v = prev[v][3][0]
    return {key: e[3][1] for key, e in routed.items() if e[3][1] > 0}


def _local(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """A few rows as a table, without a task to make them."""
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())}))


class Mix:
    """A solved mix: ``shares`` reports, ``documents`` gives each document's copies."""

    def __init__(self, counts: DataFrame, targets: DataFrame, seed: int = 7, mix_tokens: int | None = None):
        self.spark, self.seed = counts.sparkSession, seed
        canonical = F.array_sort(F.array_distinct(F.filter("_members", lambda m: m.isNotNull())))
        self.counts = stage(counts.withColumn("_members", F.coalesce(canonical, F.array().cast("array<string>"))), "mix-counts").df
        # targets are a stated plan, one row a source; of repeated rows the larger share counts
        plan = targets.filter("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()
        self.plan = {r["source"]: (float(r["share"] or 0.0), int(r["repeats"] or 0)) for r in plan}
        wanted = F.filter("_members", lambda m: m.isin(list(self.plan))) if self.plan else F.array().cast("array<string>")
        # at most 2 to the number of sources patterns, in practice a handful
        patterns = self.counts.groupBy(wanted.alias("p")).agg(F.sum("_tokens").alias("tokens")).collect()
        self.supply = {tuple(r["p"]): int(r["tokens"] or 0) for r in patterns}
        self.total = sum(self.supply.values()) if mix_tokens is None else mix_tokens
        self.exact = {s: share * self.total for s, (share, _) in self.plan.items()}
        quota = {s: math.ceil(q - 1e-9 * max(1.0, q)) for s, q in self.exact.items()}
        self.quota = quota
        self.flow = min_cost_flow(self.supply, quota, {s: r for s, (_, r) in self.plan.items()})

    def shares(self) -> DataFrame:
        """``(source, target_share, own_tokens, max_repeats, quota_tokens, mix_tokens, reached_share, falls_short)``."""
        routed = {s: sum(t for (_, x), t in self.flow.items() if x == s) for s in self.plan}
        whole = sum(routed.values())
        rows = []
        for s, (share, repeats) in sorted(self.plan.items()):
            own = sum(t for p, t in self.supply.items() if s in p)
            rows.append((s, share, own, repeats, self.quota[s], routed[s], routed[s] / whole if whole else 0.0, routed[s] < self.quota[s]))
        return _local(self.spark, rows, {"source": pa.string(), "target_share": pa.float64(), "own_tokens": pa.int64(), "max_repeats": pa.int32(), "quota_tokens": pa.int64(), "mix_tokens": pa.int64(), "reached_share": pa.float64(), "falls_short": pa.bool_()})

    def documents(self, id_col: str = "doc_id") -> DataFrame:
        """``(id_col, source, copies, tokens)`` of every document in the mix, once per source it serves."""
        spark, sources = self.spark, list(self.plan)
        wanted = F.filter("_members", lambda m: m.isin(sources)) if sources else F.array().cast("array<string>")
        rows = self.counts.withColumns({"_p": F.concat_ws("\u0001", wanted), "_h": F.xxhash64("_id", F.lit(self.seed))}).filter("_tokens > 0")
        bins = max(1, self.counts.count() // LINE)
        rows = rows.withColumn("_bin", F.floor((F.shiftrightunsigned("_h", 1) / F.lit(2.0**63)) * bins).cast("bigint"))
        # positions: sums per bin are few, the running sum inside a bin covers about LINE documents
        sums = rows.groupBy("_p", "_bin").agg(F.sum("_tokens").alias("_t"))
        before = sums.withColumn("_before", F.coalesce(F.sum("_t").over(W.partitionBy("_p").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        inside = W.partitionBy("_p", "_bin").orderBy("_h", "_id").rowsBetween(W.unboundedPreceding, -1)
        placed = rows.withColumn("_in", F.coalesce(F.sum("_tokens").over(inside), F.lit(0))).join(before.select("_p", "_bin", "_before"), ["_p", "_bin"]).withColumn("_at", F.col("_before") + F.col("_in"))
        routes, start = [], {}
        for (p, s), tokens in sorted(self.flow.items()):
            routes.append(("\u0001".join(p), s, start.get(p, 0), start.get(p, 0) + tokens, self.supply[p]))
            start[p] = start.get(p, 0) + tokens
        route = _local(spark, routes, {"_p": pa.string(), "source": pa.string(), "_from": pa.int64(), "_to": pa.int64(), "_line": pa.int64()})
        # copies: how many times the repeated line passes the document's place inside the source's stretch
        copies = F.greatest(F.lit(0), F.ceil((F.col("_to") - F.col("_at")) / F.col("_line"))) - F.greatest(F.lit(0), F.ceil((F.col("_from") - F.col("_at")) / F.col("_line")))
        out = placed.join(F.broadcast(route), "_p").withColumn("copies", copies.cast("int")).filter("copies > 0")
        return out.select(F.col("_id").alias(id_col), "source", "copies", F.col("_tokens").alias("tokens"))


def texts_with_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(id_col, text_col, members)``: each distinct text once, under its smallest id, with all sources it stands in.

    Combined inside each task before the shuffle, so a text with many copies is no burden. A missing text is kept apart by id.
    """
    keyed = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(source_col).cast("string").alias("_source"))
    key = F.coalesce(F.sha2("_text", 256), F.col("_id").cast("string"))
    groups = keyed.groupBy(key.alias("_k")).agg(F.min("_id").alias("_id"), F.array_sort(F.collect_set("_source")).alias("members"))
    return groups.select("_id", "members").join(keyed.select("_id", "_text").dropDuplicates(["_id"]), "_id").select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), "members")


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", members=None, seed: int = 7, tokenizer: str = TOKENIZER, mix_tokens: int | None = None) -> Mix:
    """Solve a mix as large as all documents in tokens (or ``mix_tokens``).

    A document belongs to its source, or to the array ``members`` where sources overlap. Documents without a
    target source count for the size of the mix and serve no quota. A source without documents falls short of
    any positive quota. Missing texts have no tokens. Empty tables give a mix of nothing. Copies of a text
    under several ids are documents of their own.
    """
    members = F.array(F.col(source_col).cast("string")) if members is None else members
    return Mix(token_counts(docs, members, id_col, text_col, tokenizer), targets, seed, mix_tokens)
