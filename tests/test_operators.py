"""Hand-worked cases of the analytic operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratabib.functions import text as T
from stratabib.operators import audit, corpus, indicators, institutions, mcdm, resolve, sentiment, topics


def one(spark, column, *values, names="abcdef"):
    df = spark.createDataFrame([values], ", ".join(f"{n} string" for n in names[: len(values)]))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("DEC 12 2025.0", "2025-12"), ("2024", "2024-00"), ("2024.0", "2024-00"), ("2024-05-06", "2024-05"), ("MAY 2007", "2007-05"), ("spring", "spring"), ("nan", ""), (None, "")])
def test_publish_month(spark, raw, want):
    assert one(spark, T.publish_month("a"), raw) == want


@pytest.mark.parametrize(("raw", "want"), [("https://doi.org/10.1234/AbC.", "10.1234/abc"), ("CNKI:SUN:X", ""), ("10.12", ""), ("(10.5555/x;)", "10.5555/x"), (None, "")])
def test_doi_strict(spark, raw, want):
    assert one(spark, T.doi_strict("a"), raw) == want


def test_scalars(spark):
    assert one(spark, T.first_author_key("a"), "Smith, John A.; Wu, B") == "smith"
    assert one(spark, T.first_author_key("a"), "Smith John; Wu") == "john|smith"
    assert one(spark, T.first_author_key("a"), "李 伟；王") == "李伟"
    assert one(spark, T.to_int("a"), "12.7") == 12 and one(spark, T.to_int("a"), "junk") == 0
    assert one(spark, T.key_text("a"), "CO2_驱 油!") == "co2驱油"
    assert one(spark, T.nfkc("a"), "ＡＢ１") == "AB1" and one(spark, T.strip_accents("a"), "é") == "e"
    assert one(spark, T.join_parts("a", "b", "c"), "x", "", "x") == "x"
    assert one(spark, T.title_for_key("a", "b", "c"), "", "中文标题 | Long English | En", "z") == "Long English"


def test_merge_order_and_doi_guard(spark):
    """D sees two compatible groups and opens its own; E's DOI fits only D's."""
    rows = [(1, "", "m"), (2, "d1", "m"), (3, "d2", "m"), (4, "", "m"), (5, "d3", "m"), (6, "d9", "n"), (7, "d8", "n")]
    df = spark.createDataFrame(rows, "row_id bigint, doi string, meta string")
    got = {r["row_id"]: r["group_id"] for r in resolve.merge_in_order(df, "row_id", "doi", "meta", []).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_three_keys_and_unstable_dois(spark):
    """A source's own id joins what has no DOI; a DOI that several works share is no key."""
    rows = [(1, "", "C:7", "m"), (2, "", "C:7", ""), (3, "d1", "", "x"), (4, "d1", "", "y"), (5, "d2", "", "q"), (6, "d2", "", "")]
    df = spark.createDataFrame(rows, "row_id bigint, doi string, own string, meta string")
    unstable = spark.createDataFrame([("d1",)], "doi string")
    got = {r["row_id"]: (r["group_id"], r["match_mask"]) for r in resolve.merge_in_order(df, "row_id", "doi", "meta", [], own="own", unstable=unstable).collect()}
    assert got == {1: (1, 9), 2: (1, 9), 3: (3, 1), 4: (4, 1), 5: (5, 3), 6: (5, 3)}
    assert {r["group_id"] for r in resolve.merge_in_order(df, "row_id", "doi", "meta", []).collect()} == {1, 2, 3, 5}


def test_metadata_keys(spark):
    title, short = F.lit("A title of more than twenty letters"), F.lit("Short title")
    key = lambda t, j=None: spark.range(1).select(T.meta_key(t, F.lit("2020"), F.lit("li|wei"), j)).first()[0]
    assert key(title).endswith("|2020|li|wei") and key(short) == "" and key(short, F.lit("J One")).endswith("|2020|li|wei|jone") and key(short, F.lit("")) == ""


def test_replay_per_component_equals_one_pass():
    rng = random.Random(1)
    for _ in range(300):
        rows = [(i, rng.choice(["", "a", "b", "c"]), rng.choice(["", "", "W:1", "C:2"]), rng.choice(["", "m", "n", "o"])) for i in range(rng.randint(1, 9))]
        whole = {s: g for s, g, _ in resolve.replay(rows)}
        parent = list(range(len(rows)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for (i, d, s, m), (j, e, t, n) in itertools.combinations(rows, 2):
            if (d and d == e) or (s and s == t) or (m and m == n):
                parent[max(find(i), find(j))] = min(find(i), find(j))
        apart = {}
        for c in {find(i) for i in range(len(rows))}:
            apart |= {s: g for s, g, _ in resolve.replay([r for r in rows if find(r[0]) == c])}
        assert apart == whole


def test_components(spark):
    df = spark.createDataFrame([(5, "a", ""), (3, "a", "k"), (9, "", "k"), (7, None, "nan"), (2, "z", "")], "id bigint, k1 string, k2 string")
    assert {r[0]: r[1] for r in resolve.components(df, "id", ["k1", "k2"]).collect()} == {5: 3, 3: 3, 9: 3, 7: 7, 2: 2}


def test_fusion(spark):
    fields = ["title_en", "title_cn", "doi", "cited_count", "year"]
    df = spark.createDataFrame([(1, "CNKI", "k", "", "题", "", "3", ""), (2, "WOS", "k", "T", None, "10.1/x", "7", "2020")], "row_id bigint, source_db string, k string, title_en string, title_cn string, doi string, cited_count string, year string")
    r = resolve.fuse(df, "k", fields).first()
    assert (r["source_db_primary"], r["title_en"], r["title_cn"], r["cited_count"], r["year"], r["group_size"]) == ("CNKI", "T", "题", "7", "", 2)


def test_h_index_and_percentile(spark):
    df = spark.createDataFrame([("a", 5.0), ("a", 4.0), ("a", 1.0), ("b", 0.0), ("c", 9.0), ("c", 9.0), ("c", 9.0), ("c", 9.0)], "g string, c double")
    assert {r["g"]: r["h_index"] for r in indicators.h_index(df, "g", "c").collect()} == {"a": 2, "b": 0, "c": 4}
    one_to_eleven = spark.range(1, 12).select(F.col("id").cast("double").alias("v"))
    assert indicators.nearest_rank(one_to_eleven, "v", 0.9).first()[0] == 10
    assert indicators.nearest_rank(one_to_eleven.limit(0), "v", 0.9).first()[0] == 0


def test_mcdm(spark):
    m = spark.createDataFrame([("x", "f", 2.0), ("y", "f", 2.0), ("x", "g", 1.0), ("y", "g", 3.0)], "item string, field string, value double")
    scaled = {(r["item"], r["field"]): r["value"] for r in mcdm.minmax(m).collect()}
    assert scaled == {("x", "f"): 1.0, ("y", "f"): 1.0, ("x", "g"): 0.0, ("y", "g"): 1.0}
    assert all(r["r"] == 0 for r in mcdm.correlations(m).filter("x <> y").collect())
    w = spark.createDataFrame([("f", 0.5), ("g", 0.5)], "field string, weight double")
    assert {r["item"]: r["score"] for r in mcdm.topsis(m, w).collect()} == {"x": 0.0, "y": 1.0}
    dims = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"), ("e", "3"), ("f", "3"), ("g", "3")], "field string, dimension string")
    assert sorted(round(r["weight"], 6) for r in mcdm.prior_weights(dims).collect()) == [0.111111] * 3 + [0.166667] * 4
    total = mcdm.entropy_weights(mcdm.minmax(m)).agg(F.sum("weight")).first()[0]
    assert abs(total - 1) < 1e-9


@pytest.mark.parametrize(
    ("body", "title", "want"),
    [(["not", "very", "rally"], [], -0.302326), (["no", "never", "rally"], [], -0.25), (["not", "a", "b", "c", "rally"], [], 0.25), ([], ["rally"], 0.333333), ([], [], 0.0)],
)
def test_sentiment(spark, body, title, want):
    df = spark.createDataFrame([(body, title)], "b array<string>, t array<string>")
    r = sentiment.score_documents(df, F.col("b"), F.col("t"), sentiment.lexicon_map(["rally"], ["glut"])).first()
    assert round(r["sentiment"], 6) == want
    assert r["label"] == ("bearish" if want <= -0.1 else "bullish" if want >= 0.1 else "neutral")


def test_topic_terms(spark):
    for raw, want in [("reservoir", "储层"), ("储层", "储层"), ("hydraulic_fracturing", "水力压裂"), ("压裂", "水力压裂"), ("porosity", "孔隙度"), ("wellbore", "井筒"), ("asphaltene", "沥青质"), ("carbonates", "碳酸盐岩"), ("porosities", "孔隙度")]:
        assert one(spark, topics.canonical(F.col("a"), topics.CANONICAL), raw) == want
    for raw, want in [("ratio", ""), ("studied", ""), ("production", ""), ("sag", "凹陷"), ("co2", "二氧化碳"), ("页岩气", "页岩气")]:
        assert one(spark, topics.presentation_term(F.col("a")), raw) == want
    df = spark.createDataFrame([(["水力压裂", "储层", "porosity", "页岩气", "wellbore"],)], "t array<string>")
    assert df.select(topics.topic_label(F.col("t"))).first()[0] == "水力压裂 / 储层 / 页岩气"
    assert one(spark, topics.english_tokens(F.col("a")), "The hydraulic fracturing of shale-gas reservoirs") == ["水力压裂", "页岩", "gas", "储层"]


def test_assignment_against_all(spark):
    rng = random.Random(5)
    for _ in range(100):
        n, m = rng.randint(1, 4), rng.randint(1, 5)
        cost = [[rng.random() for _ in range(m)] for _ in range(n)]
        found = topics.assignment(cost)
        got = sum(cost[i][j] for i, j in enumerate(found) if j >= 0)
        if n <= m:
            want = min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        else:
            want = min(sum(cost[p[j]][j] for j in range(m)) for p in itertools.permutations(range(n), m))
        assert abs(got - want) < 1e-9


def test_paths(spark):
    t = lambda *x: spark.createDataFrame([(i,) for i in x], "topic int")
    link = lambda *x: spark.createDataFrame(list(x), "left_topic int, right_topic int")
    got = [tuple(r) for r in topics.evolution_paths(t(0, 1), t(0, 1), t(0, 1), link((0, 1)), link((1, 0))).orderBy("path_id").collect()]
    assert got == [("P01", 0, 1, 0), ("P02", 1, None, None), ("P03", None, 0, None), ("P04", None, None, 1)]


@pytest.mark.parametrize(
    ("name", "want"),
    [("China Sinopec Co.", "企业研发中心"), ("Organization of the Petroleum Exporting Countries", "国际组织"), ("International Energy Agency", "国际组织"), ("Key Laboratory of Jiangsu Province, Yancheng Institute of Technology", "高校/科研院所"), ("", "其他")],
)
def test_types(spark, name, want):
    assert one(spark, institutions.classify_type(F.col("a")), name)["type"] == want


def test_institution_splits(spark):
    text = "[Li, Asia; Wu, B] China Univ Petr, Beijing, Peoples R China; [Doe, J] Texas A&M Univ, College Stn, TX, USA"
    pairs = one(spark, institutions.country_pairs(F.lit("WOS"), F.col("a"), F.lit("")), text)
    assert [(p["name"], p["country"]) for p in pairs] == [("China Univ Petr", "China"), ("Texas A&M Univ", "United States")]
    assert one(spark, institutions.split_cscd(F.col("a")), "Li, Dept Geol, Univ One, X City.; Wu, Inst Two, Y.") == ["Univ One", "Inst Two"]
    assert one(spark, institutions.split_cnki(F.col("a")), "甲大学；乙所 | 丙; ") == ["甲大学", "乙所", "丙"]


def test_audit_rules(spark):
    o = spark.createDataFrame([("R1", 2, 1, 1, "t"), ("R2", 1, 1, 1, "t"), ("R3", 1, 1, 3, "t"), ("R4", 1, 2, 1, "t"), ("R5", 2, 2, 1, "t")], "group_id string, n_sources int, n_journals int, n_institutions int, title string")
    got = {r["group_id"]: r["action"] for r in audit.residual_action(o).collect()}
    assert got == {"R1": audit.MERGE, "R2": audit.MERGE, "R3": audit.MANUAL, "R4": audit.KEEP, "R5": audit.MANUAL}
    c = spark.createDataFrame([("C1", 2, "x"), ("C2", 1, "Erratum to x"), ("C3", 1, "plain")], "group_id string, n_journals int, title string")
    assert {r["group_id"]: (r["action"], r["markers"]) for r in audit.conflict_action(c).collect()} == {"C1": (audit.KEEP, ""), "C2": (audit.KEEP, "erratum"), "C3": (audit.MANUAL, "")}


def test_first_wins_keeps_ties_apart(spark):
    df = spark.createDataFrame([(2, "a", "x"), (1, "a", "y"), (3, None, "z")], "i int, k string, v string")
    assert sorted((r["k"] or "", r["v"]) for r in corpus.first_wins(df, ["k"], [F.col("i")]).collect()) == [("", "z"), ("a", "y")]


def test_delimited_tables(spark, tmp_path):
    from stratabib.sources import delimited as D

    path = tmp_path / "t.csv"
    path.write_bytes('﻿名称,note\r\n石油大学,"two\nlines, ""quoted"""\r\n'.encode())
    df = D.read_table(spark, str(path), line_breaks=True)
    assert [tuple(r) for r in df.collect()] == [("石油大学", 'two\nlines, "quoted"')] and df.columns == ["名称", "note"]
    gb = tmp_path / "g.csv"
    gb.write_bytes("名称\n石油大学\n".encode("gb18030"))
    assert D.guess_encoding(spark, str(gb)) == "gb18030" and D.read_table(spark, str(gb)).first()[0] == "石油大学"
    (tmp_path / "w.txt").write_text("Alpha\n;note\n\n beta \n")
    assert sorted(r[0] for r in D.read_words(spark, str(tmp_path / "w.txt")).collect()) == ["alpha", "beta"]
    D.write_table(df, str(tmp_path / "out"), encoding="GB18030")
    assert D.read_table(spark, str(tmp_path / "out"), encoding="gb18030", line_breaks=True).first()[0] == "石油大学"
    parts = D.part_ids(spark.range(10).withColumnRenamed("id", "k"), ["k"], 4, block=3)
    assert sorted((r["k"], r["part"]) for r in parts.collect()) == [(k, k // 4 + 1) for k in range(10)]
    assert D.lexicon_path({"e1"}.__contains__, ("e1", "e2"), ("b1", "b2"))[0] == "base"


def test_files_in_several_encodings(spark, tmp_path):
    """Each file is read in its own encoding, judged by all its lines; a mark at the head is no part of a name."""
    from stratabib.sources import delimited as D

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_bytes("k,v\n1,石油大学\n".encode("gb18030"))
    (tmp_path / "in/b.csv").write_bytes(("\ufeffk,v\n" + "2,plain\n" * 50_000 + "3,海洋学院\n").encode())
    got = {r["k"]: r["v"] for r in D.read_table(spark, str(tmp_path / "in")).collect()}
    assert got == {"1": "石油大学", "2": "plain", "3": "海洋学院"}
    D.write_table(spark.createDataFrame([("1", "x")], "k string, v string"), str(tmp_path / "marked"), mark=True)
    assert next((tmp_path / "marked").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbfk,v")


def test_rewrite_in_place(spark, tmp_path):
    from stratabib.sources import delimited as D

    path = str(tmp_path / "t")
    D.write_table(spark.createDataFrame([("1", "x"), ("2", "y")], "k string, v string"), path)
    D.rewrite(D.read_table(spark, path).filter("k = '2'"), path, D.write_table)
    assert [tuple(r) for r in D.read_table(spark, path).collect()] == [("2", "y")] and not (tmp_path / "t.old").exists()


def test_head_of_each_file(spark, tmp_path):
    from stratabib.sources import delimited as D

    for name in "ab":
        (tmp_path / f"{name}.csv").write_text("k\n" + "".join(f"{name}{i}\n" for i in range(9)))
    got = sorted(r["k"] for r in D.head_of_each_file(D.read_table(spark, str(tmp_path), encoding="utf-8", columns=["k"]), 2).collect())
    assert got == ["a0", "a1", "b0", "b1"]


def test_row_numbers_over_blocks(spark):
    from stratabib.operators.ranges import in_own_order, row_numbers

    df = spark.range(200).withColumn("k", (F.col("id") * 37) % 200).repartition(7)
    got = {r["k"]: r["n"] for r in row_numbers(df, ["k"], "n", block=30).collect()}
    assert got == {k: k + 1 for k in range(200)}
    own = in_own_order(spark.range(100, numPartitions=6), "n").collect()
    assert sorted(r["n"] for r in own) == list(range(1, 101)) and all(r["n"] == r["id"] + 1 for r in own)


def test_late_events_are_dropped(spark, tmp_path):
    """An event behind the watermark is not counted; windows that the watermark passed are written."""
    from stratabib.streaming import windows as V

    rows = lambda *ts: spark.createDataFrame([(t, "a", 1.0) for t in ts], "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    source = str(tmp_path / "in")
    schema = rows("2024-01-01 00:00:00").schema
    rows("2024-01-01 00:10:00", "2024-01-01 05:00:00").coalesce(1).write.parquet(source)
    run = lambda: V.run_to_table(V.windowed(V.stream_of(spark, source, schema), "1 hour", late="1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    run()
    rows("2024-01-01 00:20:00", "2024-01-01 09:00:00").coalesce(1).write.mode("append").parquet(source)
    run()
    rows("2024-01-02 00:00:00").coalesce(1).write.mode("append").parquet(source)
    run()
    got = sorted((str(r["window_start"]), r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [("2024-01-01 00:00:00", 1), ("2024-01-01 05:00:00", 1)] and len(got) >= 3


def test_translation_rules(spark):
    from stratabib.operators import translation as X

    assert one(spark, X.numbered_plant(F.col("a")), "No. 3 Oil Production Plant of X") == "第三采油厂"
    assert one(spark, X.numbered_plant(F.col("a")), "No.12 Gas Production Plant") == "第十二采气厂" and one(spark, X.numbered_plant(F.col("a")), "Plant 3") is None
    assert one(spark, X.translate_words(F.col("a")), "Univ Petr") == "大学石油"
    assert one(spark, X.transliterate(F.col("a")), "Ost-lu") == "奥-鲁"
    t = spark.createDataFrame([("a", "1"), ("b", "2"), ("", "x")], "name string, value string")
    u = spark.createDataFrame([("a", "3"), ("a", "2"), (None, "4")], "name string, value string")
    assert sorted((r["name"], r["value"], r["priority"]) for r in X.assemble_rules([t, u]).collect()) == [("a", "3", 1), ("b", "2", 0)]
    reason = X.review_reasons(X.signals(F.col("a"), F.col("b"), F.col("c"), F.lit(2), F.lit(0.5)), F.lit(120))
    assert one(spark, reason, "Delta Company", "Delta Company", "raw_fallback") == "norm_not_cjk | top_freq_needs_review | generic_enterprise_alias"
    assert one(spark, reason, "甲公司", "甲公司", "raw_cjk") == ""
    wrong = X.defects(F.col("a"), F.col("b"))
    assert [one(spark, wrong, "X Univ", r) for r in ("", "大学", "X大学", "石油大学大学", "大学石油系", "油大学", "奥斯伯里石油大学")] == [["missing"], ["bare", "stub"], ["latin", "stub"], ["doubled"], ["headless"], ["stub"], []]
