"""Mixed timestamp formats and time zones to one unambiguous form.

Every value becomes an array of all its valid readings. Which reading holds is decided by Viterbi
over each source's record order: a path pays the readings' own costs, and for each step a penalty if
the format switches and one if time jumps back.

The chain of a source is never gathered as a whole. Records are ranged by (source, id) into blocks of about
equal size. A first pass gives, for every block, the least cost from each reading of its first record to each
reading of its last; these small matrices are chained per source, which settles the first and last reading of
every block; a second pass fills in the blocks. The result is that of one long pass, however ids are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabib.functions.dates import readings
from stratabib.runtime import spread, stage

SWITCH, BACKWARD = 0.4, 0.2
#: Records of a block at least, and blocks at most: each gives one row of a few numbers to the driver.
BLOCK, BLOCKS = 50_000, 20_000

_CANDIDATES = pa.schema(
    [("_id", pa.int64()), ("_source", pa.string()), ("_raw", pa.string()), ("_fmt", pa.list_(pa.string())), ("_norm", pa.list_(pa.string())), ("_day", pa.list_(pa.float64())), ("_cost", pa.list_(pa.float64()))]
)
_CANDIDATES_DDL = "_id bigint, _source string, _raw string, _fmt array<string>, _norm array<string>, _day array<double>, _cost array<double>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prune = 2 * (SWITCH + BACKWARD)
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        out: tuple[list, ...] = ([], [], [], [], [], [], [])
        for rec, source, value, year, zone, order in zip(*columns):
            found = readings(value, year, zone, order)
            if not found:
                continue
            least = found[0][3]
            found = [r for r in found if r[3] <= least + prune]
            for column, x in zip(out, (rec, source, value, *map(list, zip(*found)))):
                column.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _CANDIDATES.types)], schema=_CANDIDATES)


def _step(so_far: list[float], fmts, days, next_fmts, next_days, next_costs) -> tuple[list[int], list[float]]:
    """Where the cheapest way to each next reading comes from, and its cost; ties go to the earlier reading."""
    back, total = [], []
    for f, d, c in zip(next_fmts, next_days, next_costs):
        ways = [so_far[j] + SWITCH * (fmts[j] != f) + BACKWARD * (days[j] > d) for j in range(len(so_far))]
        j = min(range(len(ways)), key=ways.__getitem__)
        back.append(j)
        total.append(ways[j] + c)
    return back, total


def best_path(fmts: list[list[str]], days: list[list[float]], costs: list[list[float]]) -> list[int]:
    """Indices of the cheapest path through a chain of readings; ties go to the earlier reading."""
    if not costs:
        return []
    back: list[list[int]] = []
    so_far = list(costs[0])
    for i in range(1, len(costs)):
        step, so_far = _step(so_far, fmts[i - 1], days[i - 1], fmts[i], days[i], costs[i])
        back.append(step)
    path = [min(range(len(so_far)), key=so_far.__getitem__)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


_BORDERS_DDL = "_source string, _block int, first_fmt array<string>, first_day array<double>, last_fmt array<string>, last_day array<double>, cost array<double>"


def _lists(pdf):
    pdf = pdf.sort_values(["_id", "_raw"], kind="stable")
    return pdf, [list(x) for x in pdf["_fmt"]], [list(x) for x in pdf["_day"]], [list(x) for x in pdf["_cost"]]


def _borders(pdf):
    """Least cost of a block from each reading of its first record to each of its last, first by first."""
    import pandas as pd

    pdf, fmts, days, costs = _lists(pdf)
    cost: list[float] = []
    for k, c in enumerate(costs[0]):
        so_far = [c if j == k else float("inf") for j in range(len(costs[0]))]
        for i in range(1, len(costs)):
            so_far = _step(so_far, fmts[i - 1], days[i - 1], fmts[i], days[i], costs[i])[1]
        cost += so_far
    row = (pdf["_source"].iloc[0], int(pdf["_block"].iloc[0]), fmts[0], days[0], fmts[-1], days[-1], cost)
    return pd.DataFrame([row], columns=["_source", "_block", "first_fmt", "first_day", "last_fmt", "last_day", "cost"])


def chained(blocks: list) -> list[tuple[int, int]]:
    """First and last reading of each block of a source, given in order, on the cheapest path through them all."""
    back, so_far = [], [0.0]
    fmts, days = [""], [float("-inf")]
    for n, b in enumerate(blocks):
        size = len(b["last_fmt"])
        if n:
            step, total = _step(so_far, fmts, days, b["first_fmt"], b["first_day"], [0.0] * len(b["first_fmt"]))
        else:
            step, total = [0] * len(b["first_fmt"]), [0.0] * len(b["first_fmt"])
        froms, ends = [], []
        for last in range(size):
            ways = [total[f] + b["cost"][f * size + last] for f in range(len(total))]
            f = min(range(len(ways)), key=ways.__getitem__)
            froms.append((f, step[f]))
            ends.append(ways[f])
        back.append(froms)
        so_far, fmts, days = ends, b["last_fmt"], b["last_day"]
    out: list[tuple[int, int]] = []
    last = min(range(len(so_far)), key=so_far.__getitem__) if blocks else 0
    for froms in reversed(back):
        first, before = froms[last]
        out.append((first, last))
        last = before
    return out[::-1]


def _fill(pdf):
    """Readings of a block's records, its first and last reading given."""
    pdf, fmts, days, costs = _lists(pdf)
    for i, k in ((0, int(pdf["_first"].iloc[0])), (len(costs) - 1, int(pdf["_last"].iloc[0]))):
        costs[i] = [c if j == k else float("inf") for j, c in enumerate(costs[i])]
    choice = best_path(fmts, days, costs)
    pdf["_chosen"] = [n[k] for n, k in zip(pdf["_norm"], choice)]
    pdf["_format"] = [n[k] for n, k in zip(pdf["_fmt"], choice)]
    return pdf[["_id", "_source", "_raw", "_chosen", "_format"]]


def normalise_timestamps(
    df: DataFrame, feed: DataFrame, id_col: str = "rec_id", value_col: str = "publish_date", year_col: str = "year", source_col: str = "source_db"
) -> DataFrame:
    """One row ``(id_col, source, raw, publish_norm, format)`` per record whose value states at least a year.

    ``feed`` holds ``source_db, zone_name, slash_order``; the first row by ``slash_order`` counts if a
    source has several. Missing values (NULL, '', ``nan``), placeholders, words and long texts
    have no reading and no row. Sources without a feed row are read as UTC with any slash order.
    Equal ids are kept as separate rows; ties between readings go to the cheaper, then the earlier one.
    Empty tables give an empty result. Other columns, whatever their names, are not read.
    """
    feed = feed.groupBy(F.col("source_db").alias("_s")).agg(F.min_by(F.struct("zone_name", "slash_order"), F.struct("slash_order", "zone_name")).alias("_f"))
    rows = df.select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(value_col).cast("string").alias("_raw"), F.col(year_col).cast("string").alias("_year")
    ).filter("_raw is not null and trim(_raw) not in ('', 'nan')")
    rows = spread(rows).join(feed, rows["_source"] == feed["_s"], "left").select("_id", "_source", "_raw", "_year", "_f.zone_name", "_f.slash_order")
    read = stage(rows.mapInArrow(_read, _CANDIDATES_DDL), "date-readings").df

    total = read.count()
    n = max(1, min(BLOCKS, -(-total // BLOCK)))
    ranged = read.withColumn("_source", F.coalesce("_source", F.lit(""))).repartitionByRange(n, "_source", "_id", "_raw")
    placed = stage(ranged.withColumn("_block", F.spark_partition_id()), "date-order").df
    # a block without an open record needs no second pass, but its borders take part in the chain
    borders = placed.groupBy("_source", "_block").applyInPandas(_borders, _BORDERS_DDL).collect()
    of: dict[str, list] = {}
    for b in sorted(borders, key=lambda b: (b["_source"], b["_block"])):
        of.setdefault(b["_source"], []).append(b)
    fixed = [(source, b["_block"], first, last) for source, blocks in of.items() for b, (first, last) in zip(blocks, chained(blocks))]
    kinds = (("_source", pa.string()), ("_block", pa.int32()), ("_first", pa.int32()), ("_last", pa.int32()))
    ends = df.sparkSession.createDataFrame(pa.table({name: pa.array([f[i] for f in fixed], kind) for i, (name, kind) in enumerate(kinds)}))
    solved = placed.join(F.broadcast(ends), ["_source", "_block"]).groupBy("_source", "_block").applyInPandas(_fill, "_id bigint, _source string, _raw string, _chosen string, _format string")
    return solved.select(F.col("_id").alias(id_col), F.when(F.col("_source") != "", F.col("_source")).alias(source_col), F.col("_raw").alias("raw"), F.col("_chosen").alias("publish_norm"), F.col("_format").alias("format"))
