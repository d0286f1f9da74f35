"""Best representative of each duplicate group, field by field, by skyline selection.

Every record of a group is a point in completeness (which fields it holds whole), trust and recency. A record is
dominated if another holds at least the same fields, is trusted at least as much and is as recent, and is better in
one of them. From the first layer, the undominated records, a lexicographic policy (most trusted, then most recent)
picks the record that gives its fields. What it leaves empty is filled from the next layer: the records undominated in
the fields still empty; and so on until nothing can be filled. Values cut short fill what no whole value does.

A group is never gathered. Of the records that hold the same fields and are trusted alike only the latest is kept, as it
dominates the others, combined before the shuffle; so a group comes down to at most 4 ** fields points per trust rank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratabib.llm import charmodel
from stratabib.llm.mojibake import Searcher
from stratabib.llm.truncation import ending
from stratabib.runtime import small, spread, stage

#: Written in place of a value (fixed values), compared in lower case.
PLACEHOLDERS = {
    "", "nan", "null", "none", "n/a", "na", "-", "--", "—", "...", "…", "?", "??", "???", "##", "unknown", "untitled", "tbd",
    "无", "缺", "暂无", "未知", "未统计", "（题名缺失）", "(题名缺失)", "（摘要缺失）", "no abstract available.", "no abstract available",
    "abstract not supplied", "abstract pending", "see full text", "not available",
}
COUNT = re.compile(r"\+?(?:\d{1,3}(?:[,，]\d{3})+|\d+)(?:\.\d+)?")

WHOLE, CUT, UNUSABLE = 2, 1, 0
FIELDS = {"abstract_en": "prose", "cited_count": "count", "title_cn": "title"}


_TAIL = re.compile(r"[\s.…]+$")
_GRADED_DDL = "_g bigint, _id bigint, _trust int, _at timestamp, _grades array<int>, _stems array<string>"


def _grader(kinds: list[str], costs: dict[str, float]):
    """Grade of each value, apart from what only its neighbours show, and the stems of readable texts."""
    schema = pa.schema([("_g", pa.int64()), ("_id", pa.int64()), ("_trust", pa.int32()), ("_at", pa.timestamp("us", tz="UTC")), ("_grades", pa.list_(pa.int32())), ("_stems", pa.list_(pa.string()))])

    def grade(kind: str, value: str | None, searcher: Searcher) -> int:
        text = (value or "").strip()
        if text.lower() in PLACEHOLDERS:
            return UNUSABLE
        if kind == "count":
            return WHOLE if COUNT.fullmatch(text) else UNUSABLE
        if not searcher.clean.issuperset(text) and searcher.search(text).garbled:
            return UNUSABLE
        if text.endswith(("...", "…")):
            return CUT
        if kind == "prose" and ending(text)[1] != "closed":
            return CUT
        return WHOLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(costs)
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[4:]]
            grades = [[grade(k, v, searcher) for k, v in zip(kinds, row)] for row in zip(*columns)]
            stems = [[_TAIL.sub("", v) if g > UNUSABLE and k != "count" else None for k, v, g in zip(kinds, row, of)] for row, of in zip(zip(*columns), grades)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(schema.field(i).type) for i in range(4)), pa.array(grades, schema.field(4).type), pa.array(stems, schema.field(5).type)], schema=schema)

    return run


_NEXT_DDL = "what int, _part int, _g bigint, _f int, _stem string"
_BEGUN, _FIRST, _LAST = 0, 1, 2


def _begins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted stems those that begin their successor, and the first and last of the partition."""
    schema = pa.schema([("what", pa.int32()), ("_part", pa.int32()), ("_g", pa.int64()), ("_f", pa.int32()), ("_stem", pa.string())])
    before = None
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if before is None:
                out.append((_FIRST, *row))
            elif before[1:3] == row[1:3] and row[3].startswith(before[3]) and row[3] != before[3]:
                out.append((_BEGUN, *before))
            before = row
        columns = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((_LAST, *before), schema.types)], schema=schema)


def _beginnings(graded: DataFrame) -> DataFrame:
    """``(_g, _f, _h)`` of stems that begin a longer one of the same group and field.

    Among sorted stems one that begins another begins its successor, so each is held against one neighbour; a group may
    lie over many partitions, whose borders (two rows each) are compared apart.
    """
    stems = graded.select("_g", F.posexplode("_stems").alias("_f", "_stem")).filter("_stem is not null").distinct()
    ranged = stems.repartitionByRange("_g", "_f", "_stem").sortWithinPartitions("_g", "_f", "_stem").select(F.spark_partition_id().alias("_part"), "_g", "_f", "_stem")
    found = stage(ranged.mapInArrow(_begins, _NEXT_DDL), "stem-order").df
    borders = found.filter(F.col("what") > _BEGUN).select("what", "_part", "_g", "_f", "_stem", F.lead(F.struct("_g", "_f", "_stem")).over(W.orderBy("_part", "what")).alias("_next"))
    over = borders.filter((F.col("what") == _LAST) & (F.col("_next._g") == F.col("_g")) & (F.col("_next._f") == F.col("_f")) & F.col("_next._stem").startswith(F.col("_stem")) & (F.col("_next._stem") != F.col("_stem")))
    begun = found.filter(F.col("what") == _BEGUN).select("_g", "_f", "_stem").unionByName(over.select("_g", "_f", "_stem"))
    return stage(begun.select("_g", "_f", F.xxhash64("_stem").alias("_h")), "stems-begun").df


def choose(points: list[tuple[int, int, int, float, int]], n: int) -> dict[int, tuple[int, int, int]]:
    """Per field (row, grade, layer) from points (whole, readable, trust rank, time, row); the masks have a bit per field."""
    out: dict[int, tuple[int, int, int]] = {}
    layer = 0
    for at, grade in ((0, WHOLE), (1, CUT)):
        empty = sum(1 << f for f in range(n) if f not in out)
        while able := [p for p in points if p[at] & empty]:
            layer += 1
            front = [p for p in able if not any(_dominates(q, p, at, empty) for q in able)]
            pick = min(front, key=lambda p: (p[2], -p[3], p[4]))  # policy: trusted, then recent, then the smaller id
            for f in range(n):
                if pick[at] & empty & (1 << f):
                    out[f] = (pick[4], grade, layer)
            empty &= ~pick[at]
    return out


def _dominates(q, p, at: int, empty: int) -> bool:
    a, b = q[at] & empty, p[at] & empty
    return a & b == b and q[2] <= p[2] and q[3] >= p[3] and (a != b or q[2] < p[2] or q[3] > p[3])


def _chooser(names: list[str]):
    schema = pa.schema([("group_id", pa.int64()), ("field_name", pa.string()), ("_row", pa.int64()), ("grade", pa.int32()), ("layer", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group, points in zip(*(c.to_pylist() for c in batch.columns)):
                for f, chosen in choose([(p["w"], p["r"], p["t"], p["at"], p["id"]) for p in points], len(names)).items():
                    out.append((group, names[f], *chosen))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def survivors(rows: DataFrame, groups: DataFrame, feed: DataFrame, fields: dict[str, str] | None = None, id_col: str = "row_id") -> DataFrame:
    """``(group_id, field_name, row_id, grade, layer)``: the row whose value survives for each field of each group.

    ``groups`` gives ``(id_col, group_id)``; ``feed`` gives ``source_db, trust_rank``; ``fields`` maps columns to prose,
    title or count. Grade 2 is whole and readable, 1 cut short; a field none of whose values is readable has no
    row. ``layer`` counts the layers drawn on. A source without a rank is trusted least. Equal dates go to the smaller id.
    NULL dates count as oldest. Empty tables give an empty result; other columns are not read.
    """
    fields = fields or FIELDS
    names, kinds = list(fields), list(fields.values())
    texts = [f for f in names if fields[f] != "count"]
    model = charmodel.costs(charmodel.character_counts(rows, texts)) if texts else {}
    trust = feed.groupBy(F.col("source_db").alias("_s")).agg(F.min("trust_rank").cast("int").alias("_trust"))
    base = rows.select(F.col(id_col).cast("bigint").alias("_id"), F.col("source_db").alias("_s"), F.col("harvested_at").cast("timestamp").alias("_at"), *(F.col(f).cast("string").alias(f"_v{i}") for i, f in enumerate(names)))
    members = groups.select(F.col(id_col).alias("_id"), F.col("group_id").alias("_g"))
    long = spread(base).join(small(members), "_id").join(small(trust), "_s", "left").select("_g", "_id", F.coalesce("_trust", F.lit(2**31 - 1)).alias("_trust"), "_at", *(f"_v{i}" for i in range(len(names))))
    graded = stage(long.mapInArrow(_grader(kinds, model), _GRADED_DDL), "graded-rows").df
    begun = small(_beginnings(graded)) if texts else None
    whole, readable = F.lit(0), F.lit(0)
    for i, name in enumerate(names):
        good = F.col("_grades")[i]
        if name in texts:
            flags = begun.filter(F.col("_f") == i).select("_g", F.col("_h").alias(f"_h{i}"), F.lit(True).alias(f"_b{i}"))
            graded = graded.withColumn(f"_h{i}", F.xxhash64(F.col("_stems")[i])).join(flags, ["_g", f"_h{i}"], "left")
            good = F.when(F.col(f"_b{i}") | (F.length(F.col("_stems")[i]) < 2), F.least(good, F.lit(CUT))).otherwise(good)
        whole = whole + F.when(good == WHOLE, 1 << i).otherwise(0)
        readable = readable + F.when(good > UNUSABLE, 1 << i).otherwise(0)
    points = graded.select("_g", "_trust", whole.alias("w"), readable.alias("r"), F.coalesce(F.unix_micros("_at"), F.lit(-(2**62))).alias("at"), "_id").filter("r > 0")
    cells = points.groupBy("_g", "_trust", "w", "r").agg(F.max(F.struct("at", (-F.col("_id")).alias("neg"))).alias("top"))
    gathered = cells.groupBy("_g").agg(F.collect_list(F.struct("w", "r", F.col("_trust").alias("t"), F.col("top.at").alias("at"), (-F.col("top.neg")).alias("id"))).alias("_points"))
    return gathered.mapInArrow(_chooser(names), "group_id bigint, field_name string, _row bigint, grade int, layer int").withColumnRenamed("_row", id_col)


def surviving_records(rows: DataFrame, picked: DataFrame, fields: dict[str, str] | None = None, id_col: str = "row_id") -> DataFrame:
    """One record per group from what ``survivors`` picked: each field's value, and the layer it came from."""
    names = list(fields or FIELDS)
    values = rows.select(F.col(id_col).cast("bigint").alias("_id"), F.explode(F.array(*(F.struct(F.lit(f).alias("_name"), F.col(f).cast("string").alias("_value")) for f in names))).alias("_e")).select("_id", "_e._name", "_e._value")
    found = picked.join(values, (picked[id_col] == values["_id"]) & (picked["field_name"] == values["_name"]))
    of = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    return found.groupBy("group_id").agg(*(of(f, "_value").alias(f) for f in names), *(of(f, "layer").alias(f"{f}_layer") for f in names))
