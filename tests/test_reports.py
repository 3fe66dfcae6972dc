"""Gates, orders and checks on small tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioscale.operators import audits, judge, letters, reports


def one(spark, column, schema, *values):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first().x


def test_gates(spark):
    assert one(spark, reports.title_gates(F.col("t"), F.col("d")), "t string, d string", "十一个字的标题在这里呀", "short") == ["api title"]
    assert [one(spark, reports.size_gate(F.col("n"), F.col("p")), "n int, p int", *v) for v in ((50, 1), (500, 101), (500, 61), (500, 9), (None, 1))] == ["stop", "reject", "warn", "ok", "stop"]
    assert [one(spark, reports.all_capitals(F.col("t")), "t string", v) for v in ("JOURNAL OF X", "Journal", "", None)] == [True, False, False, False]
    day = datetime(2024, 1, 31)
    assert one(spark, reports.fresh(F.col("a"), F.col("b"), 30), "a timestamp, b timestamp", datetime(2024, 1, 1), day) and not one(spark, reports.fresh(F.col("a"), F.col("b"), 30), "a timestamp, b timestamp", None, day)
    assert one(spark, reports.fresh_cache(F.col("a"), F.col("b"), F.lit(100), F.lit(119)), "a timestamp, b timestamp", datetime(2024, 1, 30, 12), day)
    assert [one(spark, reports.entry_validity([F.col("a"), F.col("b"), F.col("c")]), "a string, b string, c int", *v) for v in (("x", "y", 1), (" ", "y", 1), (None, "", None))] == ["ok", "warn", "drop"]
    assert one(spark, audits.within_budget(F.lit(109), F.lit(100), 0.1), "a int", 1) and not one(spark, audits.within_budget(F.lit(111), F.lit(100), 0.1), "a int", 1)


def test_work_order(spark):
    clusters = spark.createDataFrame([(1, False), (2, True), (3, False), (4, False)], "cluster int, is_global boolean")
    edges = spark.createDataFrame([(3, 1), (3, 2), (4, 3), (4, 99)], "cluster int, needs int")
    assert [(row.cluster, row.stage) for row in reports.work_order(clusters, edges).orderBy("place").collect()] == [(2, 1), (1, 1), (3, 2), (4, 3)]
    with pytest.raises(ValueError):
        reports.work_order(clusters, edges.union(spark.createDataFrame([(1, 4)], edges.schema)))


def test_severity_queue_and_stage(spark):
    issues = spark.createDataFrame([(1, "green"), (2, "red"), (3, "structural"), (4, "red")], "n int, severity string")
    assert [row.n for row in reports.severity_queue(issues, "severity", "n").orderBy("place").collect()] == [2, 4, 1, 3]
    files = spark.createDataFrame([("p", "structure/3_x/a_dev.md", "x" * 600), ("p", "structure/3_x/a.md", "x" * 10), ("q", "manuscript.tex", "% TODO\n" + "y" * 600), ("r", "other.md", None)], "project string, path string, text string")
    assert {row.project: row.stage for row in reports.project_stage(files, "project", "path", "text").collect()} == {"p": "A", "q": "C", "r": "none"}


def test_notes_and_points(spark):
    notes = spark.createDataFrame([(1, "P", "a", "text\n---"), (1, "P", "b", ""), (1, "P", "c", "x" * 1001)], "doc_id int, part string, section string, text string")
    assert {(row.section, row.problem) for row in reports.note_lint(notes).collect()} == {("b", "empty"), ("b", "no rule at the end"), ("c", "too long"), ("c", "no rule at the end")}
    points = spark.createDataFrame([(1, "aa"), (1, "aaa"), (2, "a"), (3, "ab"), (3, "ba")], "k int, t string")
    assert {row.k: row.balanced for row in reports.balanced_points(points, "k", "t").collect()} == {1: True, 3: False}


def test_quotas_of_agents_and_fallbacks(spark):
    agents = spark.createDataFrame([(1, "cnki"), (1, "wos"), (2, "wos")], "direction int, source_type string")
    out = reports.own_quotas(agents, spark.createDataFrame([(1, 9)], "direction int, quota int"), spark.createDataFrame([(1, "cnki", 4)], "direction int, source_type string, quota int"))
    assert {(row.direction, row.source_type): row.quota for row in out.collect()} == {(1, "cnki"): 4, (1, "wos"): 9, (2, "wos"): None}
    summary = spark.createDataFrame([(0,)], "n int")
    assert reports.raw_total(summary, "n", spark.range(3)).first().total == 3
    assert {row.term for row in reports.expand_keywords(spark.createDataFrame([("韧性",), ("x",)], "k string"), "k").collect()} == {"resilience", "disruption", "robustness", "x"}


def test_bibliography_checks(spark):
    rows = spark.createDataFrame([("a", {"author": ["A"], "title": ["T"], "year": ["2020"], "doi": ["10/x"]}, "@a{a, t={x}}"), ("b", {"year": ["n.d."]}, "@a{b, t={x}"), ("b", {"author": [" "]}, "{}")], "key string, fields map<string,array<string>>, raw string")
    found = {(row.key, row.code) for row in reports.bib_checks(rows).collect()}
    assert ("b", "DUPLICATE_KEY") in found and ("b", "BAD_YEAR") in found and ("b", "BRACES") in found and not any(key == "a" for key, _ in found)
    fields = reports.bib_fields(F.lit("{Van Dyke}, A. and B"), F.lit("c2019x"), F.lit("The {Big}"), F.lit(None).cast("string"), F.lit("Proc"))
    row = spark.range(1).select(*[column.alias(name) for name, column in fields.items()]).first()
    assert (row.surname, row.year, row.title, row.journal) == ("Van Dyke", 2019, "The Big", "Proc")


def test_judgements_keep_what_fails(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, t string")

    def ask(row):
        if row["t"] == "bad":
            raise OSError("no answer")
        return f"1. {row['t']}"

    out = {row.id: (row.answer, row.failed) for row in judge.judge(rows, ask, ["t"], wait=0.0, parallel=2).collect()}
    assert out == {1: ("1. good", False), 2: (None, True), 3: ("1. None", False)}
    done = judge.batched(rows, lambda part: [{"id": row["id"], "n": len(part)} for row in part], "id int, n int", size=2, parallel=1)
    assert sorted(row.id for row in done.collect()) == [1, 2, 3] and max(row.n for row in done.collect()) == 2


def test_letters(spark):
    text = "From: x\nDear Authors\nMajor revision.\nAssociate Editor\nfine\nReviewer #1\nMajor comments\n1. First point here\nmore\n2) Second point here\nMinor issues\n1. Tiny point\n3. no\nReviewer (3)\nJust some prose about it."
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    out = [(row.number, row.comment_id, row.type, row.text) for row in letters.comments(docs, "doc_id", "text").orderBy("number", "comment_id").collect()]
    assert out == [(1, "R1-1", "major", "First point here\nmore"), (1, "R1-2", "major", "Second point here"), (1, "R1-m1", "minor", "Tiny point"), (3, "R3-1", "major", "Just some prose about it.")]
    assert {row.role for row in letters.letter_lines(docs, "doc_id", "text").where("line <> ''").collect()} == {"editor", "ae", "reviewer"}
    tags = spark.createDataFrame([("Results", "crisis"), ("Conclusion", None), (None, None), ("研究方法", ""), ("Discussion", "")], "a string, b string")
    assert [row.x for row in tags.select(letters.section_tags(F.col("a"), F.col("b"), 2).alias("x")).collect()] == [["DISC-RQ2"], ["LR"], ["LR"], ["METHOD-基础"], ["DISC-RQ1", "DISC-RQ2"]]


def test_pool_entries(spark):
    text = "### p1\n- citation_key: a2020x\n- 分级：核心\n- **作者**: {{author}}\n## p2\n- 场景: no key\n### p3\nprose only\n### p4\nKey: b2021y\nkey: c2022z"
    entries, failed = letters.pool_entries(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text")
    assert [(row.title, row.fields) for row in entries.orderBy("block").collect()] == [("p1", {"citation_key": "a2020x", "分级": "核心"}), ("p4", {"citation_key": "c2022z"})]
    assert [row.title for row in failed.collect()] == ["p2"]
