"""Packed values and timestamps against hand-worked cases and brute force."""

import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratabib.functions.dates import readings
from stratabib.functions.packed import automaton, split_packed
from stratabib.operators.packed_values import known_values, split_fields
from stratabib.operators import timestamps
from stratabib.operators.timestamps import BACKWARD, SWITCH, best_path, normalise_timestamps

KNOWN = automaton(["n-alkanes, C15+", "1,2-dichloroethane"])


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("a; b ;; c;", "keyword", ["a", "b", "c"]),
        ("a, n-alkanes, C15+, b", "keyword", ["a", "n-alkanes, C15+", "b"]),
        ("1,2-dichloroethane; x", "keyword", ["1,2-dichloroethane", "x"]),
        ('"a","""sweet spot"" mapping","n-alkanes, C15+"', "keyword", ["a", '"sweet spot" mapping', "n-alkanes, C15+"]),
        ('a b, c d, """sweet spot"" mapping", e', "keyword", ["a b", "c d", '"sweet spot" mapping', "e"]),
        ("['a', \"b's\"]", "keyword", ["a", "b's"]),
        ("[X, A; Y, B] Univ One, City, USA; [Z, C] Inst Two, Town", "affiliation", ["Univ One, City, USA", "Inst Two, Town"]),
        ('"A, x","B, y"', "affiliation", ["A, x", "B, y"]),
        ("Li, Wei", "person", ["Li, Wei"]),
        ("Li Wei, Wu Bo & Xu An", "person", ["Li Wei", "Wu Bo", "Xu An"]),
        ("Li, Wei; Wu, B", "person", ["Li, Wei", "Wu, B"]),
        ("荣静, 窦旭, 裴静", "person", ["荣静", "窦旭", "裴静"]),
        ("A Bc and D Ef", "person", ["A Bc", "D Ef"]),
        (None, "keyword", []), ("", "keyword", []), ("nan", "keyword", []), (" ;; ", "keyword", []), ("['broken", "keyword", ["['broken"]),
    ],
)
def test_split_packed(text, kind, want):
    assert split_packed(text, kind, KNOWN) == want


@given(st.lists(st.text(st.characters(categories=["Ll"]), min_size=1, max_size=8), min_size=1, max_size=8), st.sampled_from(["; ", ";", "；", " | ", "\n", "、"]))
@settings(max_examples=60, deadline=None)
def test_joined_values_come_back(values, sep):
    values = [v for v in values if v != "nan"]
    assert split_packed(sep.join(values), "keyword") == values


def test_very_long_field():
    assert len(split_packed("ab; " * 100_000, "keyword")) == 100_000


def test_split_fields_edges(spark):
    rows = [(1, "a; b", None, "nan", 7, 9), (1, "a; b", None, "nan", 7, 9), (2, None, "[A] X, y; Z", "Li, W", 7, 9), (3, "one", "", None, 7, 9)]
    df = spark.createDataFrame(rows, "rec_id bigint, keywords_en string, institution string, author string, pos int, item int")
    got = sorted(map(tuple, split_fields(df).collect()))
    assert got == [(1, "keywords_en", 1, "a"), (1, "keywords_en", 1, "a"), (1, "keywords_en", 2, "b"), (1, "keywords_en", 2, "b"), (2, "institution", 1, "X, y"), (2, "institution", 2, "Z")]
    assert split_fields(df.limit(0)).count() == 0


def test_known_values_are_learned(spark):
    df = spark.createDataFrame([("a; b, c; d",)] * 5 + [("e; f",)] * 5 + [("x, y",)], "k string")
    assert known_values(df, "k", "keyword") == ["b, c"]


def test_a_chance_neighbourhood_is_no_value(spark):
    """The rule weighs counts against each other: ten times the rows give the same values."""
    rows = [("a; b, c; d",)] * 4 + [("b; e",)] * 90 + [("c; f; x-1,2",)] * 90
    for times in (1, 10):
        df = spark.createDataFrame(rows * times, "k string")
        assert known_values(df, "k", "keyword") == ["x-1,2"]


def test_known_values_protect_strong_delimiters(spark):
    """A value quoted elsewhere keeps its delimiter where nobody quoted it; without the dictionary it would be cut."""
    rows = [(i, None, '"Dept A; Unit 2, Riga"; Inst B, Oslo', None) for i in range(3)] + [(9, "m; n", "Inst B, Oslo; Dept A; Unit 2, Riga", "Li, Wei, Chu, Yi")]
    rows += [(20 + i, None, None, "Li, Wei; Chu, Yi") for i in range(3)]
    df = spark.createDataFrame(rows, "rec_id bigint, keywords_en string, institution string, author string")
    got = sorted((r["field_name"], r["pos"], r["item"]) for r in split_fields(df).filter("rec_id = 9").collect())
    assert got == [("author", 1, "Li, Wei"), ("author", 2, "Chu, Yi"), ("institution", 1, "Inst B, Oslo"), ("institution", 2, "Dept A; Unit 2, Riga"), ("keywords_en", 1, "m"), ("keywords_en", 2, "n")]
    assert split_packed("Inst B, Oslo; Dept A; Unit 2, Riga", "affiliation") == ["Inst B, Oslo", "Dept A", "Unit 2, Riga"]


FEED = ("Europe/Berlin", "DMY")


@pytest.mark.parametrize(
    ("value", "year", "want"),
    [
        ("2024-05-06", None, "2024-05-06"), ("2014.0", None, "2014"), ("DEC 12 2025.0", None, "2025-12-12"), ("MAY 25", "2018", "2018-05-25"), ("JUL", "（2020）", "2020-07"), ("JUL", None, None),
        ("JUN-JUL 2025", None, "2025"), ("SUM 2021", None, "2021"), ("spring", "2024", None), ("in press", "2024", None), ("0000-00-00", "2017", None), ("03/04/2020", None, "2020-04-03"), ("25/01/19", None, "2019-01-25"),
        ("44234", None, "2021-02-07"), ("1378555768", None, "2013-09-07T12:09:28Z"), ("1332673454633", None, "2012-03-25T11:04:14Z"), ("20231212035654", None, "2023-12-12T02:56:54Z"),
        ("2022-03-06 15:30:21 UTC+8", None, "2022-03-06T07:30:21Z"), ("2011-06-06 20:40:34 EDT", None, "2011-06-07T00:40:34Z"), ("2016-07-01 12:00", None, "2016-07-01T10:00:00Z"),
        ("2021年8月17日 上午12:30", None, "2021-08-16T22:30:00Z"), ("2021年8月17日 下午12:30", None, "2021-08-17T10:30:00Z"), ("Sun, 06 Jul 2014 01:33:50 +0800", None, "2014-07-05T17:33:50Z"),
        ("2025-08-24T05:24:40.957Z", None, "2025-08-24T05:24:40Z"), ("2016年10月", None, "2016-10"), (None, None, None), ("", "2020", None), ("nan", "2020", None), ("x" * 100_000, "2020", None),
    ],
)
def test_readings(value, year, want):
    found = readings(value, year, *FEED)
    assert (found[0][1] if found else None) == want


def test_clock_changes():
    back = readings("2021-10-31 02:30:00", None, *FEED)
    assert [r[1] for r in back] == ["2021-10-31T00:30:00Z", "2021-10-31T01:30:00Z"]
    assert readings("2021-03-28 02:30:00", None, *FEED)[0][1] == "2021-03-28T01:30:00Z"


@given(st.datetimes(datetime(2001, 1, 1), datetime(2037, 1, 1)))
@settings(max_examples=60, deadline=None)
def test_instants_round_trip(at):
    at = at.replace(microsecond=0)
    want = at.strftime("%Y-%m-%dT%H:%M:%SZ")
    shifted = at + timedelta(hours=5, minutes=30)
    assert readings(shifted.strftime("%a, %d %b %Y %H:%M:%S +0530"))[0][1] == want
    assert readings(str(int(at.replace(tzinfo=timezone.utc).timestamp())))[0][1] == want or at.year < 2002


def test_best_path_against_all_paths():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randint(1, 5)
        fmts = [[rng.choice("ab") for _ in range(rng.randint(1, 3))] for _ in range(n)]
        days = [[rng.randint(0, 3) for _ in f] for f in fmts]
        costs = [[rng.choice([0.0, 0.3, 0.5, 1.0]) for _ in f] for f in fmts]

        def total(p):
            return sum(c[k] for c, k in zip(costs, p)) + sum(SWITCH * (fmts[i][p[i]] != fmts[i - 1][p[i - 1]]) + BACKWARD * (days[i - 1][p[i - 1]] > days[i][p[i]]) for i in range(1, n))

        best = min(map(total, itertools.product(*(range(len(f)) for f in fmts))))
        assert abs(total(best_path(fmts, days, costs)) - best) < 1e-9


def test_timestamps_edges(spark):
    feed = spark.createDataFrame([("S", "Europe/Berlin", "DMY", 1), ("S", "Europe/Berlin", "DMY", 1)], "source_db string, zone_name string, slash_order string, trust_rank int")
    rows = [(1, "03/04/2020", None, "S", "x"), (2, None, None, "S", "x"), (3, "2021-10-31 02:30:00", None, "S", "x"), (4, "2019", "2019", None, "x"), (5000, "31/12/2020", None, "S", "x"), (5000, "31/12/2020", None, "S", "x")]
    df = spark.createDataFrame(rows, "rec_id bigint, publish_date string, year string, source_db string, raw string")
    got = sorted((r["rec_id"], r["publish_norm"]) for r in normalise_timestamps(df, feed).collect())
    assert got == [(1, "2020-04-03"), (3, "2021-10-31T00:30:00Z"), (4, "2019"), (5000, "2020-12-31"), (5000, "2020-12-31")]
    assert normalise_timestamps(df.limit(0), feed).count() == 0


@pytest.mark.parametrize("spread", [1, 7_919])
def test_blocks_give_one_long_pass(spark, monkeypatch, spread):
    """Blocks of a few records, however far apart ids lie, give the choice of one pass over the whole order."""
    monkeypatch.setattr(timestamps, "BLOCK", 3)
    feed = spark.createDataFrame([("S", "Europe/Berlin", None)], "source_db string, zone_name string, slash_order string")
    rng = random.Random(5)
    ids, written = [spread * i for i in range(40)], ("{0:02d}/{1:02d}/2021", "2021-10-31 02:{0:02d}:00", "2021-{0:02d}-{1:02d}", "{1:02d}/25/2021", "25/{0:02d}/2021")
    values = [rng.choice(written).format(rng.randint(1, 12), rng.randint(1, 12)) for _ in ids]
    df = spark.createDataFrame([(i, v, None, "S") for i, v in zip(ids, values)], "rec_id bigint, publish_date string, year string, source_db string")
    got = {r["rec_id"]: r["publish_norm"] for r in normalise_timestamps(df, feed).collect()}
    found = [readings(v, None, "Europe/Berlin", None) for v in values]
    choice = best_path([[r[0] for r in f] for f in found], [[r[2] for r in f] for f in found], [[r[3] for r in f] for f in found])
    assert got == {i: f[k][1] for i, f, k in zip(ids, found, choice)} and any(len(f) > 1 for f in found)


def test_neighbours_outvote_a_wrong_declaration(spark):
    """Day first is declared, the records around can only be read month first: with the penalties off the answer differs."""
    feed = spark.createDataFrame([("S", None, "DMY")], "source_db string, zone_name string, slash_order string")
    df = spark.createDataFrame([(1, "03/25/2020", None, "S"), (2, "04/05/2020", None, "S"), (3, "04/28/2020", None, "S")], "rec_id bigint, publish_date string, year string, source_db string")
    run = lambda: {r["rec_id"]: r["publish_norm"] for r in normalise_timestamps(df, feed).collect()}
    assert run()[2] == "2020-04-05"
    found = [readings(v, None, None, "DMY") for v in ("03/25/2020", "04/05/2020", "04/28/2020")]
    assert found[1][0][1] == "2020-05-04"  # the cheapest reading by itself
