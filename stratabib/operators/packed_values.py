"""Several values packed in one field, to one row per value with its position."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabib.functions.packed import STRONG, automaton, parts_of, split_packed, whole_values
from stratabib.runtime import BROADCAST_BOUND, spread, stage

KINDS = {"keywords_en": "keyword", "institution": "affiliation", "author": "person"}
#: A value that holds a delimiter is known if at least MIN_COUNT fields give it whole and, of its parts, none is met by
#: itself over 1 / SHARE times as often on the least count: a chance neighbourhood of two common values isn't one value.
MIN_COUNT, SHARE = 3, 0.1

_OUT = pa.schema([("_id", pa.int64()), ("field_name", pa.string()), ("pos", pa.int32()), ("item", pa.string()), ("_n", pa.int32())])


def _undoubted(kind: str):
    """Values that a field shows to be whole: quoted or listed ones, and what stands between strong delimiters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, counts = pa.schema([("value", pa.string()), ("n", pa.int64())]), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text and (STRONG.search(text) or '"' in text or text[0] == "["):
                    counts.update(set(whole_values(text, kind)))
            if len(counts) > 300_000:
                yield pa.RecordBatch.from_pydict({"value": list(counts), "n": list(counts.values())}, schema=schema)
                counts.clear()
        yield pa.RecordBatch.from_pydict({"value": list(counts), "n": list(counts.values())}, schema=schema)

    return run


def _cut(kind: str):
    """Values that hold a delimiter, a row per part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(v, n, p) for v, n in zip(*(c.to_pylist() for c in batch.columns)) for p in parts_of(v, kind)]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string()))], names=["value", "n", "part"])

    return run


def known_values(df: DataFrame, column: str, kind: str, share: float = SHARE, min_count: int = MIN_COUNT) -> list[str]:
    """Whole values of a column that contain delimiters, learned from all fields that leave no doubt about a value.

    Counts are combined inside each task before they are shuffled. The rule compares counts with each other, so it is
    alike at every size. The list is broadcast as an automaton: beyond BROADCAST_BOUND characters it is refused.
    """
    counts = stage(spread(df.select(F.col(column).cast("string"))).mapInArrow(_undoubted(kind), "value string, n bigint").groupBy("value").agg(F.sum("n").alias("n")), "values-met")
    met = counts.df
    cut = met.filter(F.col("n") >= min_count).mapInArrow(_cut(kind), "value string, n bigint, part string")
    alone = cut.join(met.select(F.col("value").alias("part"), F.col("n").alias("m")), "part", "left").groupBy("value").agg(F.first("n").alias("n"), F.min(F.coalesce("m", F.lit(0))).alias("m"))
    found = stage(alone.filter(F.col("n") >= share * F.col("m")).select("value"), "values-known")
    size = found.df.agg(F.coalesce(F.sum(F.length("value")), F.lit(0))).first()[0]
    if size > BROADCAST_BOUND:
        raise ValueError(f"{column}: known values of {size} characters")
    known = sorted(r["value"] for r in found.df.collect())
    counts.drop()
    found.drop()
    return known


def _splitter(fields: dict[str, str], known: dict[str, list[str]], keep_single: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        autos = {name: automaton(known.get(name, ())) for name in fields}
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out_id, out_field, out_pos, out_item, out_n = [], [], [], [], []
            for k, (name, kind) in enumerate(fields.items(), 1):
                auto = autos[name]
                for rec, text in zip(ids, batch.column(k).to_pylist()):
                    if not text:
                        continue
                    items = split_packed(text, kind, auto)
                    n = len(items)
                    if n > 1 or (keep_single and n):
                        out_id += [rec] * n
                        out_field += [name] * n
                        out_pos += range(1, n + 1)
                        out_item += items
                        out_n += [n] * n
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((out_id, out_field, out_pos, out_item, out_n), _OUT.types)], schema=_OUT)

    return run


def split_fields(df: DataFrame, id_col: str = "rec_id", fields: dict[str, str] | None = None, keep_single: bool = False) -> DataFrame:
    """Rows ``(id_col, field_name, pos, item)`` of every value of fields that hold two or more.

    ``fields`` maps column names to keyword, affiliation or person. Missing fields (NULL, '', ``nan``) have no
    values; a field of one value gives no row unless ``keep_single``. Positions count non-empty values from 1.
    Repeated rows and equal ids are split each for themselves. Very long fields are split whole. Columns other
    than the named ones, whatever they are called, are not read. An empty table gives an empty result.
    """
    fields = fields or KINDS
    known = {name: known_values(df, name, kind) for name, kind in fields.items()}
    rows = df.select(F.col(id_col).cast("bigint").alias("_id"), *(F.col(name).cast("string").alias(f"_f{i}") for i, name in enumerate(fields)))
    out = spread(rows).mapInArrow(_splitter(fields, known, keep_single), "_id bigint, field_name string, pos int, item string, _n int")
    return out.select(F.col("_id").alias(id_col), "field_name", "pos", "item")
