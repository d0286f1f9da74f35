"""How plausible characters are: a static prior by script, sharpened by counts over a corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabib.runtime import spread

#: A CJK character outside the commonest level counts as ordinary if met so often in texts that are so ordinary otherwise.
LEAST, COMPANY = 12, 0.55
#: Share of all texts with other than ASCII characters that such a character is in at least, so that a larger corpus needs more of it.
SHARE = 2.25e-4
_CJK_SIGNS = set("，。、；：？！（）《》“”‘’—…·～【】〔〕「」％－＋／　〇①②③④⑤℃‰×÷±≤≥≈∶–−′″•")


@lru_cache(maxsize=200_000)
def prior(c: str) -> float:
    """Cost of a character without its context: about 1 for what ordinary text is made of, up to 8."""
    o = ord(c)
    if o < 0x20:
        return 1.0 if c in "\n\t\r" else 8.0
    if o < 0x7F:
        return 1.0
    if o <= 0x9F or 0xE000 <= o <= 0xF8FF or o == 0xFFFD or o >= 0xF0000:
        return 9.0
    if c in _CJK_SIGNS:
        return 1.0
    if 0x4E00 <= o <= 0x9FFF:
        try:
            first = c.encode("gb2312")[0]
            return 1.0 if first <= 0xD7 else 2.6
        except UnicodeEncodeError:
            pass
        try:
            return 3.4 if c.encode("big5")[0] <= 0xC6 else 4.2
        except UnicodeEncodeError:
            return 5.0
    if 0xFF01 <= o <= 0xFF5E:
        return 1.2
    if 0xC0 <= o <= 0x24F and o not in (0xD7, 0xF7):
        return 3.0
    if 0x391 <= o <= 0x3C9:
        return 2.5
    if 0x410 <= o <= 0x44F or o in (0x401, 0x451):
        return 3.0
    return 5.0


#: Characters that ordinary Chinese text is made of, by the prior alone.
ORDINARY = frozenset(c for c in map(chr, range(0x4E00, 0xA000)) if prior(c) <= 1.0)
#: Left by replacement characters that were decoded once more; never ordinary, however often they occur.
NEVER = {"锟"}


#: Row of a tally that counts all texts.
_TOTAL = -1


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per character its count and, for CJK characters that aren't ordinary, the texts it is in and how ordinary those are."""
    counts: Counter = Counter()
    texts: Counter = Counter()
    company: Counter = Counter()
    total = 0
    for batch in batches:
        for column in batch.columns:
            values = [x for x in column.to_pylist() if x]
            counts.update("".join(values))
            for text in values:
                if text.isascii():
                    continue
                total += 1
                rare = [c for c in set(text).difference(ORDINARY) if "一" <= c <= "鿿"]
                if rare:
                    plain = sum(c in ORDINARY for c in text)
                    share = plain / (plain + sum("一" <= c <= "鿿" and c not in ORDINARY for c in text))
                    for c in rare:
                        texts[c] += 1
                        company[c] += share
    schema = pa.schema([("c", pa.int32()), ("n", pa.int64()), ("texts", pa.int64()), ("company", pa.float64())])
    yield pa.RecordBatch.from_pydict({"c": [_TOTAL, *map(ord, counts)], "n": [0, *counts.values()], "texts": [total, *(texts[c] for c in counts)], "company": [0.0, *(float(company[c]) for c in counts)]}, schema=schema)


def character_counts(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, float, float]]:
    """Each character's count in whole columns, the share of ordinary characters in the texts that have it, and the share of texts that do.

    Tallied within tasks first. At most the 1.1 million code points.
    """
    tallied = spread(df.select(*(F.col(c).cast("string") for c in columns))).mapInArrow(_tally, "c int, n bigint, texts bigint, company double")
    rows = tallied.groupBy("c").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.sum("company").alias("company")).collect()
    total = max(1, sum(r["texts"] for r in rows if r["c"] == _TOTAL))
    return {chr(r["c"]): (r["n"], r["company"] / r["texts"] if r["texts"] else 1.0, r["texts"] / total) for r in rows if r["c"] != _TOTAL and not 0xD800 <= r["c"] <= 0xDFFF}


def costs(counts: dict[str, tuple[int, float, float] | int]) -> dict[str, float]:
    """Cost of each character met in the corpus: its prior, but 1 for CJK characters that keep ordinary company.

    Characters of names are rare in the language and yet stand in ordinary text; those that wrong decoding makes
    stand among their like, however frequent they are.
    """
    out = {}
    for c, known in counts.items():
        n, company, share = known if isinstance(known, tuple) else (known, 1.0, 1.0)
        cost = prior(c)
        if 1.0 < cost < 5.5 and "一" <= c <= "鿿" and n >= LEAST and share >= SHARE and company >= COMPANY and c not in NEVER:
            cost = 1.0
        out[c] = cost
    return out
