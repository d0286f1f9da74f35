"""Delimited text in and out: all-text schemas, encodings, directories, partitioned and versioned sinks."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from stratabib.operators.ranges import in_own_order, row_numbers

#: Spark's name for an encoding.
_SPARK = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "gb18030": "GB18030"}


def encodings(spark: SparkSession, path: str, glob: str | None = None) -> dict[str, str]:
    """Encoding of each file: utf-8 if every line of it decodes so, else gb18030. Whole files are read, as lines."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    lines = reader.text(path).select(F.input_file_name().alias("file"), (~F.is_valid_utf8("value")).alias("odd"))
    return {r["file"]: "gb18030" if r["odd"] else "utf-8" for r in lines.groupBy("file").agg(F.max("odd").alias("odd")).collect()}


def guess_encoding(spark: SparkSession, path: str) -> str:
    """The one encoding of all files; an error if they differ."""
    found = set(encodings(spark, path).values()) or {"utf-8"}
    if len(found) > 1:
        raise ValueError(f"{path}: files in several encodings")
    return found.pop()


def header(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names alone; a byte-order mark is no part of the first."""
    names = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).csv(path).limit(0).columns
    return [n.lstrip("﻿") for n in names]


def read_table(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, glob: str | None = None, columns: list[str] | None = None, line_breaks: bool = False) -> DataFrame:
    """A delimited table with a header, every column text, missing cells ''.

    Without ``encoding`` each file is read in its own. Cells may be as long as they like and hold doubled quotes; only with
    ``line_breaks`` may they hold line breaks, as a file is then read by one task. Bytes that don't decode become U+FFFD.
    ``columns`` declares the schema, which spares a look at the files.
    """
    if encoding is None:
        groups: dict[str, list[str]] = {}
        for file, name in sorted(encodings(spark, path, glob).items()):
            groups.setdefault(name, []).append(file)
        if len(groups) > 1:
            tables = [read_table(spark, files, sep, name, None, columns, line_breaks) for name, files in groups.items()]
            out = tables[0]
            for t in tables[1:]:
                out = out.unionByName(t, allowMissingColumns=True)
            return out.na.fill("")
        encoding = next(iter(groups), "utf-8")
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", _SPARK.get(encoding, encoding)).option("multiLine", line_breaks).option("quote", '"').option("escape", '"').option("maxCharsPerColumn", -1)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if columns:
        reader = reader.schema(Ty.StructType([Ty.StructField(c, Ty.StringType()) for c in columns]))
    df = reader.csv(path)
    return df.toDF(*(c.lstrip("\ufeff") for c in df.columns)).na.fill("")


def head_of_each_file(df: DataFrame, rows: int) -> DataFrame:
    """At most so many rows of each file read, for a trial run; the limit is the feature."""
    placed = df.withColumns({"_f": F.input_file_name(), "_at": F.monotonically_increasing_id()})
    return placed.withColumn("_n", F.row_number().over(W.partitionBy("_f").orderBy("_at"))).filter(F.col("_n") <= rows).drop("_f", "_at", "_n")


def with_file_order(df: DataFrame) -> DataFrame:
    """Adds ``file_name``, by which directories are put in order."""
    return df.withColumn("file_name", F.input_file_name())


def numbered(df: DataFrame, name: str = "row_seq") -> DataFrame:
    """Rows numbered from 1 in the table's own order: by partition, then within, without gathering rows anywhere."""
    return in_own_order(df, name)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word``: lines in lower case without blank ones and ``;`` comments."""
    w = F.lower(F.trim("value"))
    return spark.read.text(path).select(w.alias("word")).filter("word <> '' and not startswith(word, ';')")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """``word, score`` from word and polarity; other polarities are left out, the last of repeated words counts."""
    rows = numbered(read_table(spark, path, encoding="utf-8"))
    word, polarity = F.lower(F.trim("word")), F.lower(F.trim("polarity"))
    kept = rows.select(word.alias("word"), F.when(polarity == "positive", 1.0).when(polarity == "negative", -1.0).alias("score"), "row_seq").filter("word <> '' and score is not null")
    return kept.groupBy("word").agg(F.max_by("score", "row_seq").alias("score"))


def read_rules(df: DataFrame, spellings: dict[str, list[str]]) -> DataFrame:
    """A rule table whose columns may go by several headers: the first filled one of each."""
    def one(names: list[str]) -> Column:
        present = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
        return F.coalesce(*present, F.lit("")) if present else F.lit("")

    return df.select(*(one(names).alias(c) for c, names in spellings.items()))


def lexicon_path(exists, expanded: tuple[str, str], base: tuple[str, str], market: str | None = None) -> tuple[str, tuple[str, ...]]:
    """Which lexicon to use: the market table if there, else the expanded lists if both are there, else the base lists."""
    if market and exists(market):
        return "market", (market,)
    return ("expanded", expanded) if all(map(exists, expanded)) else ("base", base)


def write_table(df: DataFrame, path: str, fields: list[str] | None = None, encoding: str = "UTF-8", files: int | None = None, mark: bool = False) -> None:
    """With header and in the given column order; GB18030 needs the session's javaCharsets setting.

    ``mark`` sets a byte-order mark before the first column's name, as the mark stands before everything else of a file.
    """
    out = df.select(*fields) if fields else df
    out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0]) if mark else out
    out = out.coalesce(files) if files else out
    out.write.mode("overwrite").option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').csv(path)


def write_by_year(df: DataFrame, path: str, year: str = "year", unknown: bool = False) -> None:
    """A directory per year; rows without one under ``unknown``, or left out."""
    rows = df.withColumn("_y", F.when(F.trim(F.coalesce(F.col(year), F.lit(""))) == "", F.lit("unknown" if unknown else None)).otherwise(F.trim(year))).filter("_y is not null")
    rows.drop(year).withColumnRenamed("_y", year).write.mode("overwrite").partitionBy(year).option("header", True).csv(path)


def write_in_parts(df: DataFrame, path: str, rows_per_file: int) -> None:
    """Files of at most so many rows, each with the header."""
    df.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", rows_per_file).csv(path)


def part_ids(df: DataFrame, order: list[str], rows_per_part: int, block: int = 100_000) -> DataFrame:
    """Adds ``part``: rows in order, so many a part, the last one short; no task holds more than a block."""
    return row_numbers(df, order, "_r", block).withColumn("part", (F.floor((F.col("_r") - 1) / rows_per_part) + 1).cast("bigint")).drop("_r")


def rewrite(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> None:
    """Replace the table at ``path``, which ``df`` may be read from: written beside it, then swapped by two renames.

    Whatever fails before the swap leaves the old table as it was.
    """
    spark = df.sparkSession
    write(df, f"{path}.new")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, now, old = (hadoop.Path(path + end) for end in (".new", "", ".old"))
    if fs.exists(now) and not fs.rename(now, old):
        raise OSError(f"{path} can't be set aside")
    if not fs.rename(new, now):
        fs.rename(old, now)
        raise OSError(f"{path}.new can't take the place of {path}")
    fs.delete(old, True)


def versioned(path: str, at: datetime) -> str:
    """A path that no earlier version has."""
    return f"{path.rstrip('/')}/v={at:%Y%m%d%H%M%S}"


def output_path(base: str, tag: str, name: str) -> str:
    return "/".join((base.rstrip("/"), *([tag] if tag else []), name))
