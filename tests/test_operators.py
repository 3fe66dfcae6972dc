"""Operators on small tables: precedence rules, ties, nulls, empty tables, conservation laws."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscale.operators import allocation, checks, matching, screening, search, sequences, tags
from folioscale.operators.graph import connected_components
from folioscale.runtime import attach_group, broadcast_if_small, numbered


def test_connected_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "id long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 15)] + [(20, 22), (22, 21), (29, 29), (40, 41)], "a long, b long")
    found = {row.id: row.component for row in connected_components(nodes, edges).collect()}
    assert len(found) == 30 and {found[i] for i in range(16)} == {0} and {found[i] for i in (20, 21, 22)} == {20} and found[29] == 29
    assert connected_components(nodes, edges.limit(0)).count() == 30


def test_attach_group_with_a_hot_key(spark):
    rows = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    out = attach_group(rows, groups, ["k"], "n")
    assert out.count() == 5000 and out.where("k = 0").select("first").distinct().collect()[0][0] == 0
    assert attach_group(rows.limit(0), groups.limit(0), ["k"], "n").count() == 0


def test_numbered_is_a_numbering(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    out = numbered(rows, ["k"], "id", "n", buckets=8).toPandas()
    for _, group in out.groupby("k"):
        assert sorted(group["n"]) == list(range(len(group)))


def test_broadcast_only_when_small(spark):
    small, large = spark.range(10), spark.range(1000)
    assert "ResolvedHint" in broadcast_if_small(small, 100)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in broadcast_if_small(large, 100)._jdf.queryExecution().analyzed().toString()


PAPERS = "paper_id long, direction int, title string, first_author string, year int, journal string, tier string, source_type string"


def papers(spark, rows):
    return spark.createDataFrame(rows, PAPERS)


def test_best_tier_keeps_the_first_place(spark):
    rows = papers(spark, [(1, 1, "A b", "X, Y", 2000, None, "backup", "wos"), (2, 1, "C", "Z", None, None, None, None), (3, 1, "a  B!", "x", 2000, None, "core", "wos"), (4, 1, "A b", "X", 2000, None, "core", "wos"), (5, None, "A b", "X", 2000, None, "core", "wos"), (6, 2, None, None, None, None, None, None)])
    out = {row.key: (row.ord, row["rank"], row.first_ord) for row in screening.dedup_within(screening.screened(rows)).collect()}
    assert out == {"x|2000|a b": (3, 0, 1), "z||c": (2, 2, 2), "||": (6, 2, 6)}


@pytest.mark.parametrize("quota", [1, 2, 10, 40, 180, 360])
def test_truncation_caps(spark, quota):
    rows = papers(spark, [(i, 1, f"t{i}", "a", 2000, None, ("core", "important", "backup")[i % 3], "wos") for i in range(600)])
    quotas = spark.createDataFrame([(1, quota)], "direction long, quota long")
    kept = screening.merge(screening.screened(rows), quotas).groupBy("rank").count().orderBy("rank").collect()
    caps = [max(1, int(quota * 0.25)), max(1, int(quota * 0.40)), max(1, int(quota * 0.35))]
    expected, left = [], quota
    for cap in caps:
        expected.append(min(cap, 200, left))
        left -= expected[-1]
    assert [row["count"] for row in kept] == [n for n in expected if n]


def test_flatten_and_empty(spark):
    rows = screening.screened(papers(spark, [(1, 2, "A", "x", 1, None, "core", None), (2, 1, "a", "x", 1, None, "core", None), (3, 3, "A", "x", 1, None, "backup", None)]))
    row = screening.flatten_unique(rows).first()
    assert (row.primary_direction, row.directions, row.ord) == (1, [1, 2, 3], 2)
    assert screening.flatten_unique(rows.limit(0)).count() == 0 and screening.summary(screening.dedup_within(rows.limit(0))).count() in (0, 1)
    assert screening.cross_duplicates(rows).first().duplicates == 2


def directions(spark, rows):
    return spark.createDataFrame(rows, "id int, name string, tags array<string>, priority string")


@pytest.mark.parametrize("n, budget", [(3, 360), (10, 360), (40, 900), (30, 100), (1, 7)])
def test_quotas_sum_to_the_budget(spark, n, budget):
    rng = random.Random(n)
    rows = [(i, None, rng.sample(list(tags.VOCABULARY), rng.randint(1, 4)), None) for i in range(1, n + 1)] + [(n + 1, None, None, None)]
    quotas = allocation.apportion(directions(spark, rows), budget)
    split = allocation.tier_split(quotas.select("id", "quota"))
    assert quotas.agg(F.sum("quota")).first()[0] == budget and quotas.count() == n + 1
    assert checks.quotas(split, directions(spark, rows), budget).where("code in ('SUM_MISMATCH', 'TIER_MISMATCH')").count() == 0


def test_quotas_without_demand(spark):
    assert allocation.apportion(directions(spark, [(1, None, None, None), (2, None, ["COMP"], None)]), 100).count() == 0


def test_split_and_first_fit_conserve(spark):
    items = spark.createDataFrame([(1, 1, 134, 30), (2, 1, 0, 30), (3, 1, None, 30), (4, 1, 30, 30), (5, 1, 7, 30), (6, 1, 8, 30), (7, 1, 15, 30), (8, 1, 15, 30)], "item_id int, plan_id int, item_count int, batch_limit int")
    parts = allocation.split_work(items, "item_count", "batch_limit")
    assert checks.dispatch(items, parts, "item_id", "item_count", "batch_limit").count() == 0
    assert parts.where("item_id = 1").count() == 5 and parts.where("item_id = 1").agg(F.max("part_count")).first()[0] == 27
    bins = allocation.first_fit(items.where("item_id > 3"), "plan_id", "item_id", "item_count", "batch_limit").toPandas()
    assert bins.groupby("bin")["item_count"].sum().max() <= 30 and len(bins) == 5 and bins["bin"].nunique() == 3


def test_blocked_match_rules(spark):
    pool = spark.createDataFrame([(1, "Smith, A.", 2000, "anything at all"), (2, "Lee", 2001, "Deep learning for maps"), (3, "Lee", 2001, "No such"), (4, "Kim", 1999, "x"), (5, None, None, None)], "ord int, author string, year int, title string")
    entries = spark.createDataFrame([(10, "smith", 2000, "Other title"), (20, "Lee", 2001, "Deep learning"), (21, "Lee", 2001, "Deep learning for maps and more"), (22, "Lee", 2001, "deep LEARNING for maps!")], "ord int, author string, year int, title string")
    out = {row.ord: row.entry_ord for row in matching.blocked_match(pool, entries).collect()}
    assert out == {1: 10, 2: 21, 3: None, 4: None, 5: None}


def test_section_match_cascade(spark):
    nodes = spark.createDataFrame([(1, 1, "Introduction"), (1, 2, "The Data & Method"), (1, 3, "Data and Methods of Study"), (2, 0, "nothing like it")], "doc_id int, node_id int, title string")
    queries = spark.createDataFrame([(1, 1, " introduction "), (1, 2, "data and method"), (1, 3, "methods of study"), (1, 4, "xy"), (1, 5, "nothing like it"), (1, 6, None)], "doc_id int, query_id int, query string")
    assert {row.query_id: (row.node_id, row.strategy) for row in matching.match_sections(queries, nodes).collect()} == {1: (1, 1), 2: (2, 2), 3: (3, 3)}


def test_multiset_difference_counts_duplicates(spark):
    make = lambda words: spark.createDataFrame([(w,) for w in words], "token string")
    out = {(row.token, row.change): row.n for row in matching.multiset_difference(make("aabc"), make("abcd")).collect()}
    assert out == {("a", "lost"): 1, ("d", "gained"): 1}


def test_tree(spark):
    nodes = spark.createDataFrame([(1, n + 1, level) for n, level in enumerate([1, 2, 3, 2, 1, 3])], "doc int, node long, level int")
    out = {row.node: (row.parent, row.preceding, row.following) for row in sequences.link_tree(nodes, "doc", "node", "level").collect()}
    assert out == {1: (None, None, 5), 2: (1, None, 4), 3: (2, None, None), 4: (1, 2, None), 5: (None, 1, None), 6: (5, None, None)}


def test_runs_misses_and_gaps(spark):
    rows = spark.createDataFrame([(1, n, hit) for n, hit in enumerate([True, False, True, False, False, False, True])], "k int, n int, hit boolean")
    assert [row.n for row in sequences.until_misses(rows, "hit", "k", "n").orderBy("n").collect()] == [0, 2]
    numbers = spark.createDataFrame([(1, n) for n in (1, 2, 2, 5, None)], "k int, n int")
    assert [(row.after, row.before) for row in sequences.gaps(numbers, "n", "k").collect()] == [(2, 5)]


@pytest.mark.parametrize(
    "query, found",
    [('TS=("urban heat" AND model*)', {1}), ("TI=heat OR TI=rail", {1, 2, 3}), ('TS=(heat NOT "urban heat")', {3}), ("TS=mod", set()), ("TS=(Heat AND (rail OR modelling))", {1})],
)
def test_web_search(spark, query, found):
    rows = spark.createDataFrame([(1, "Urban heat and modelling"), (2, "Rail freight"), (3, "Heat of maps"), (4, None)], "id int, t string")
    assert {row.id for row in rows.where(search.web_search(query, F.col("t"), F.col("t"))).collect()} == found


def test_cnki_search_and_errors(spark):
    rows = spark.createDataFrame([(1, "绿色创新与面板数据", 2019), (2, "绿色创新", 2010), (3, "面板数据", None)], "id int, t string, y int")
    find = lambda q: {row.id for row in rows.where(search.cnki_search(q, {"TI": [F.col("t")], "SU": [F.col("t")]}, F.col("y"))).collect()}
    assert find("TI='绿色创新'") == {2} and find("TI%='绿色创新*面板数据'") == {1} and find("SU%='绿色创新-面板数据' OR TI='面板数据'") == {2, 3} and find("TI%'创新' AND YE BETWEEN ('2015','2024')") == {1}
    for bad in ("", "TI=(", "TI=", "XX='a'"):
        with pytest.raises(search.SearchError):
            search.cnki_search(bad, {"TI": [F.col("t")]}, F.col("y"))


def test_tag_search_and_ambiguity(spark):
    rows = spark.createDataFrame([(1, ["Alpha", "Beta"]), (2, ["alphabet"]), (3, []), (4, None)], "id int, tags array<string>")
    assert {row.id: row.hits for row in tags.search(rows, "tags", ["alpha", "bet"]).collect()} == {1: 2, 2: 2}
    assert {row.id for row in tags.search(rows, "tags", ["alpha", "beta"], every=True).collect()} == {1}
    text = spark.createDataFrame([("building* AND green building",)], "q string")
    assert text.select(search.ambiguous_terms(F.col("q"), {"building*": ("green building",), "construction": ()}).alias("x")).first().x == ["building*"]


def test_braces(spark):
    rows = spark.createDataFrame([("{a{b}}",), ("}{",), ("{",), ("",)], "t string")
    assert [row[0] for row in rows.select(checks.braces(F.col("t"))).collect()] == [True, False, False, True]


def test_map_groups_sees_whole_groups(spark):
    from folioscale.runtime import map_groups

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(200).select((F.col("id") % 9).alias("k"), "id")
        out = map_groups(rows, "k", lambda g: g.groupby("k", as_index=False).agg(n=("id", "count")), "k long, n long").collect()
        assert sorted(map(tuple, out)) == [(k, len(range(k, 200, 9))) for k in range(9)]
        assert map_groups(rows.limit(0), "k", lambda g: g, "k long, id long").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
