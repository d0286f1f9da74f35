"""Variant spellings of organisation names, linked to their standard names by merge-and-rematch.

Distinct spellings are counted first, so each is compared once however many records use it. Rounds match them
against the profiles of the rules; spellings and initials that matched are merged into the profiles, which meet
the remaining names again until a round merges nothing. Then every mention is linked through the final profiles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabib.functions.packed import split_packed
from stratabib.llm import charmodel
from stratabib.llm.mojibake import Searcher
from stratabib.llm.orgnames import Profiles, name_and_hints
from stratabib.runtime import spread, stage

#: A new spelling is merged if this many mentions agree on its profile, and this share of those that have it. Merged
#: spellings lie within a few edits of those of the rules, which bounds their number. A place that isn't listed is known
#: apart if this share of all mentions names it.
MIN_COUNT, AGREEMENT, SUPPORT = 2, 0.8, 1e-5
#: Rules are a stated dictionary, held in memory whole.
MAX_RULES = 1_000_000


def _mentions(text: str, searcher: Searcher) -> list[tuple[str, list[str]]]:
    if not searcher.clean.issuperset(text):
        finding = searcher.search(text)
        text = finding.restored or (finding.best if finding.garbled else text)
    return [name_and_hints(v) for v in split_packed(text, "affiliation")]


def _counter(costs: dict[str, float]):
    schema = pa.schema([("kind", pa.string()), ("text", pa.string()), ("hint", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher, forms, hints = Searcher(costs), Counter(), Counter()

        def give() -> pa.RecordBatch:
            rows = [("form", f, h, n) for (f, h), n in forms.items()] + [("hint", h, "", n) for h, n in hints.items()]
            columns = list(zip(*rows)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for form, address in _mentions(text, searcher):
                    if form:
                        forms[form, address[0] if address else ""] += 1
                        hints.update(address)
            if len(forms) > 300_000:
                yield give()
                forms.clear()
                hints.clear()
        yield give()

    return run


def _matcher(profiles: Profiles):
    schema = pa.schema([("text", pa.string()), ("hint", pa.string()), ("n", pa.int64()), ("place", pa.string()), ("kind", pa.string()), ("new_kind", pa.string()), ("new_place", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, hint, n in zip(*(c.to_pylist() for c in batch.columns)):
                _, place, kind, new_kind, new_place = profiles.resolve(text, [hint] if hint else [])
                if new_kind or new_place:
                    rows.append((text, hint, n, place, kind, new_kind, new_place))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)

    return run


def _agreed(found: DataFrame, spelling: str, target: str, least: float) -> list[tuple[str, str]]:
    """Spellings whose mentions agree on one profile."""
    votes = found.filter(F.col(spelling) != "").groupBy(spelling, target).agg(F.sum("n").alias("n"))
    best = votes.groupBy(spelling).agg(F.max_by(target, F.struct("n", target)).alias("best"), F.max("n").alias("top"), F.sum("n").alias("all"))
    rows = best.filter((F.col("top") >= least) & (F.col("top") >= AGREEMENT * F.col("all"))).select(spelling, "best").collect()
    return sorted((r[0], r[1]) for r in rows)


def learn_profiles(records: DataFrame, rules: DataFrame, column: str = "institution", rounds: int = -1) -> tuple[Profiles, dict[str, float]]:
    """Profiles after all rounds (``rounds`` of them if positive, none if 0), and the character model used to restore garbled names."""
    texts = records.select(F.col(column).cast("string").alias("text")).filter("text is not null and trim(text) not in ('', 'nan')")
    costs = charmodel.costs(charmodel.character_counts(texts, ["text"]))
    rows = rules.select(*(F.col(c).cast("string") for c in ("机构原始名称", "机构译名", "机构标准名", "备注"))).distinct().limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    profiles = Profiles.learn(sorted((tuple(r) for r in rows), key=lambda r: tuple(x or "" for x in r)))
    counted = stage(spread(texts).mapInArrow(_counter(costs), "kind string, text string, hint string, n bigint").groupBy("kind", "text", "hint").agg(F.sum("n").alias("n")), "org-spellings").df
    total = counted.filter("kind = 'form'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least = max(MIN_COUNT, SUPPORT * total)
    # places that addresses name: known ones apart, they keep names of places not listed from being taken for typing errors
    words = counted.filter("kind = 'form'").select(F.explode(F.split("text", " ")).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("m"))
    places = counted.filter("kind = 'hint' and length(text) > 2").groupBy("text").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).join(words, F.col("text") == F.col("w")).filter(F.col("m") >= least)
    profiles.foreign = {r["text"]: r["n"] for r in places.select("text", "n").collect() if r["text"] not in profiles.place_en}
    forms = counted.filter("kind = 'form'").select("text", "hint", "n")
    while rounds:  # each round adds spellings of the table or is the last
        found = stage(forms.mapInArrow(_matcher(profiles), "text string, hint string, n bigint, place string, kind string, new_kind string, new_place string"), "org-round").df
        n = profiles.merge(_agreed(found, "new_kind", "kind", MIN_COUNT), _agreed(found, "new_place", "place", MIN_COUNT))
        rounds -= 1
        if not n or not rounds:
            break
    return profiles, costs


def _linker(profiles: Profiles, costs: dict[str, float]):
    schema = pa.schema([("_id", pa.int64()), ("standard_name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(costs)
        memo: dict[tuple[str, str], str | None] = {}
        for batch in batches:
            ids, names = [], []
            for rec, text in zip(*(c.to_pylist() for c in batch.columns)):
                linked = set()
                for form, hints in _mentions(text, searcher):
                    if not form:
                        continue
                    key = (form, hints[0] if hints else "")
                    if key not in memo:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[key] = profiles.resolve(form, hints)[0]
                    if memo[key]:
                        linked.add(memo[key])
                for name in sorted(linked):
                    ids.append(rec)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string())], schema=schema)

    return run


def link_organisations(records: DataFrame, rules: DataFrame, id_col: str = "rec_id", column: str = "institution", rounds: int = -1) -> DataFrame:
    """``(id_col, standard_name)``: organisations of the rules that a record names, once each.

    Missing fields (NULL, '', ``nan``) and organisations that aren't listed have no row. A spelling that two listed
    organisations share links neither by itself. Long fields are split whole. Other columns are not read; empty
    tables give an empty result.
    """
    profiles, costs = learn_profiles(records, rules, column, rounds)
    rows = records.select(F.col(id_col).cast("bigint").alias("_id"), F.col(column).cast("string").alias("_text")).filter("_text is not null and trim(_text) not in ('', 'nan')")
    return spread(rows).mapInArrow(_linker(profiles, costs), "_id bigint, standard_name string").withColumnRenamed("_id", id_col)
