"""Files read and written: formats, reports, edits and guarded writes."""

from __future__ import annotations

import json
from functools import partial

import pytest
from pyspark.sql import functions as F

from folioscale.sinks import writers
from folioscale.sources import records, tables

RIS = "﻿TY  - JOUR\nTI  - First title\nAU  - Smith, A.\nAU  - Lee, B.\nSN  - 1234-5678\nSN  - 8765-4321\nPY  - 2020/01\nER  - \n\nTY  - CONF\nT1  - Second\nPY  - n.d.\nER  -\nTY  - BOOK\nTI  - Last without end\n"
ENW = "%0 Journal Article\n%A 张三\n%A 李四\n%T 标题\n续行\n%K 甲;乙；丙\n%P 1-15\n%U http://x/doi/10.2.20260402.1.2\n\n%0 Newspaper Article\n%T 报纸\n%8 2021-05-01\n\n\n%0 Odd Type\n%T x\n%D 1999\n"
BIB = '@article{a1,\n title = {The {Big {Nested}} One},\n year = 2020,\n author = "A and B",\n}\n@book{b2, title={X}}\n@article{a1, title={Later}}\n@misc{open, title={never closed'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "ris").mkdir()
    (tmp_path / "ris" / "3_topic_cnki.ris").write_text(RIS, encoding="utf-8")
    (tmp_path / "ris" / "12-other.ris").write_text(RIS.replace("\n", "\r\n"), encoding="utf-8")
    (tmp_path / "x.enw").write_text(ENW, encoding="utf-8")
    (tmp_path / "x.bib").write_text(BIB, encoding="utf-8")
    return tmp_path


def test_ris_both_ways(spark, folder):
    records.register(spark)
    by_format = spark.read.format("ris").load(str(folder / "ris"))
    by_lines = records.read_ris(spark, str(folder / "ris"))
    for rows in (by_format, by_lines):
        found = rows.orderBy("file", "ordinal").select(records.direction_of_file().alias("d"), records.value("TI").alias("ti"), records.values("AU").alias("au"), records.values("SN").alias("sn"), records.value("TY").alias("ty")).collect()
        assert [row.ty for row in found] == ["JOUR", "CONF", "BOOK"] * 2
        assert {row.d for row in found} == {3, 12} and found[0].au == ["Smith, A.", "Lee, B."] and found[0].sn == ["1234-5678", "8765-4321"] and found[2].ti == "Last without end"
    fields = {row.title: (row.surname, row.year) for row in records.screening_fields(by_lines).collect()}
    assert fields == {"First title": ("smith", 2020), "Second": ("", None), "Last without end": ("", None)}
    assert {(row.direction, row.is_cnki): row.n for row in records.count_by_direction(by_lines).collect()} == {(3, True): 3, (12, False): 3}


def test_ris_round_trip(spark, folder, tmp_path):
    rows = records.read_ris(spark, str(folder / "ris" / "3_topic_cnki.ris"))
    text = "".join(row.t for row in rows.orderBy("ordinal").select(writers.ris_text(F.col("fields")).alias("t")).collect())
    again = list(records.ris_records(text))
    assert [fields for fields, _ in again] == [fields for fields, _ in records.ris_records(RIS)]


def test_enw_to_ris(spark, folder):
    rows = records.read_enw(spark, str(folder / "x.enw"))
    converted = writers.enw_to_ris(rows, skip_newspapers=True)
    out = converted.orderBy("ordinal").collect()
    assert len(out) == 2 and out[0].ris.split("\n") == ["TY  - JOUR", "AU  - 张三", "AU  - 李四", "TI  - 标题 续行", "PY  - 2026", "KW  - 甲", "KW  - 乙", "KW  - 丙", "SP  - 1", "EP  - 15", "UR  - http://x/doi/10.2.20260402.1.2", "N1  - LA:zh", "ER  - "]
    assert out[1].ris.startswith("TY  - GEN") and "PY  - 1999" in out[1].ris
    assert writers.conversion_counts(converted, rows).first().asDict() == {"records": 3, "converted": 2, "skipped": 1, "no_year": 0, "found_year": 1}


def test_bibtex(spark, folder):
    rows = records.read_bibtex(spark, str(folder / "x.bib")).collect()
    found = {row.fields["key"][0]: row.fields for row in rows}
    assert found["a1"]["title"] == ["Later"] and found["b2"]["type"] == ["book"] and "open" in found
    first = next(records.bibtex_entries(BIB))[0]
    whole = {key: value for row in rows for key, value in [(row.fields["key"][0], row.raw)]}
    assert whole["b2"] == "@book{b2, title={X}}"
    assert first["title"] == ["The {Big {Nested}} One"] and first["year"] == ["2020"] and first["author"] == ["A and B"]


def test_files_are_split_at_record_ends(spark, tmp_path):
    """Files of many splits give the records that one pass over the text gives, in order."""
    entries = "".join(f"@article{{k{i},\n title = {{Title {i} of {{nested}} braces}},\n year = {2000 + i % 20}\n}}\n" for i in range(400))
    exports = "".join(f"%0 Journal Article\n%A 张{i}\n%T Title {i}\n on two lines\n%D {2000 + i % 20}\n\n" for i in range(400))
    records_ = "".join(f"TY  - JOUR\nTI  - Title {i}\nAU  - A{i}\nER  - \n\n" for i in range(400))
    for name, text in (("x.bib", entries), ("x.enw", exports), ("x.ris", records_)):
        (tmp_path / name).write_text(text, encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for reader, name, parser in ((partial(records.read_bibtex, last_wins=False), "x.bib", records.bibtex_entries), (records.read_enw, "x.enw", records.enw_records), (records.read_ris, "x.ris", records.ris_records)):
            frame = reader(spark, str(tmp_path / name))
            assert frame.rdd.getNumPartitions() > 2
            found = [row.fields for row in frame.orderBy("ordinal").collect()]
            assert found == [fields for fields, _ in parser((tmp_path / name).read_text(encoding="utf-8"))], name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    docs = spark.createDataFrame([(1, records_[:200]), (2, None), (3, "no records")], "doc_id long, text string")
    assert [(row.doc_id, row.n) for row in records.records_of(docs, "doc_id", "text", "ris").orderBy("n").collect()] == [(1, n) for n in range(len(list(records.ris_records(records_[:200]))))]


def test_bibtex_out(spark):
    row = spark.createDataFrame([({"TY": ["CONF"], "AU": ["A & B", "C"], "TI": ["T_1"], "T2": ["Proc"], "PY": ["2020/1"], "SP": ["1"], "EP": ["9"], "N1": ["LA:zh"]},)], "fields map<string,array<string>>")
    text = row.select(writers.ris_to_bibtex(F.lit("k1"), F.col("fields"), F.lit("x"), F.lit("y"), F.lit(""), F.lit(1999)).alias("t")).first().t
    assert text.split("\n") == ["@inproceedings{k1,", r"  author = {A \& B and C},", r"  title = {{T\_1}},", "  booktitle = {Proc},", "  year = {2020},", "  pages = {1--9},", "  language = {chinese},", "}"]
    stub = row.select(writers.stub_bibtex(F.lit("k"), F.lit("A"), F.lit("T"), F.lit(""), F.lit(1)).alias("t")).first().t
    assert "note = {TODO" in stub and "journal" not in stub
    keyed = row.select(writers.rekeyed(F.lit("@article{old, title={x, y}}"), F.lit("old"), F.lit("new")).alias("t")).first().t
    assert keyed == "@article{new, title={x, y}}"


REPORT = "# D3\n> direction: 3\n> total_items: 9\n## 一 核心文献\n| # | 作者 | 标题 | 年份 | 期刊 | 标签 | 理由 |\n|---|---|---|---|---|---|---|\n| 1 | A | T\\|x | 2020 | J | `BG`+LR\\|COMP | r |\n| 2 | B | U | 20x0 | J | — | r |\n| 3 | C | V | 2021 | J | r |\n## 小结\n| 4 | D | W | 2020 | J | LR | r |\n| D5 | n | t | P | 49 篇 |\n| 6 | n | t | P | 7篇 |\n"


def test_report_tables(spark, tmp_path):
    (tmp_path / "d3_batch1.md").write_text(REPORT, encoding="utf-8")
    lines = tables.report_lines(spark, str(tmp_path))
    found = tables.paper_tables(lines).orderBy("n").collect()
    assert [(row.n, row.tier, row.title, row.tags, row.reason) for row in found] == [(1, "core", "T|x", ["BG", "LR", "COMP"], "r"), (3, "core", "V", [], "r")]
    assert {(row.direction, row.quota) for row in tables.quotas(lines).collect()} == {(5, 49), (6, 7)}
    meta = tables.batch_metadata(lines).first()
    assert (meta.direction, meta.total) == (3, 9)
    assert {row.tier: row.n for row in tables.row_counts(lines).collect()} == {"core": 3, None: 2}
    assert tables.pool_table(lines).count() == 3
    tag_rows = spark.createDataFrame([(lines.first().file, "core", 1, ["BG"])], "file string, tier string, n int, tags array<string>")
    edited = writers.insert_column(tables.with_tier(lines), "标签", tag_rows).orderBy("line_no").collect()
    assert edited[6].line == "| 1 | A | T\\|x | 2020 | J | `BG`+LR\\|COMP | BG | r |" and edited[7].missing and edited[4].line.endswith("| 标签 | 理由 |")


def test_tag_list(spark, tmp_path):
    (tmp_path / "t.md").write_text("## Core\n1 → BG (2024-2026)+LR — note\n2: nonsense\n## Backup\n1：GAP-RQ1、COMP\n", encoding="utf-8")
    out = {(row.tier, row.n): row.tags for row in tables.tag_list(tables.report_lines(spark, str(tmp_path))).collect()}
    assert out == {("core", 1): ["BG", "LR"], ("core", 2): ["LR"], ("backup", 1): ["GAP-RQ1", "COMP"]}


def test_json_repair(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"direction": 1, "selected": [\n{\n"title": "He said "yes" here",\n"tier": "core"\n}\n]}', encoding="utf-8")
    (tmp_path / "b.json").write_text("{broken", encoding="utf-8")
    out = {row.file[-6:]: row for row in tables.json_batches(spark, str(tmp_path)).collect()}
    assert out["a.json"].batch.selected[0].title == 'He said "yes" here' and not out["b.json"].readable
    assert json.loads(tables.repair_json('{"a": 1}')) == {"a": 1}


def test_other_readers(spark):
    files = spark.createDataFrame([("a.py", 'c="#576FA0"; d="#000000"; plt.savefig("x.png", dpi=300)'), ("b.tex", ""), ("c.R", None)], "file string, text string")
    out = {row.file: row for row in tables.figure_styles(files).collect()}
    assert out["a.py"].palette == "PARTIAL" and out["a.py"].dpi == ["300"] and out["a.py"].issues == ["other colours", "missing font", "png output"] and out["b.tex"].palette == "N/A"
    assert {(row.file, row.colours, row.font, row.format) for row in tables.figure_inventory(tables.figure_styles(files)).collect()} == {("a.py", 2, "MISS", "png"), ("b.tex", 0, "MISS", "PDF"), ("c.R", 0, "MISS", "?")}
    pages = spark.createDataFrame([(1, 2, "Table 1. x\nFig. 2 y"), (1, 1, "see Table 1\nFigure 2. y")], "doc_id int, page int, text string")
    assert {(row.kind, row.number): row.page for row in tables.captions(pages).collect()} == {("table", 1): 2, ("figure", 2): 1}
    html = spark.createDataFrame([(1, '<a href="/pii/S1">short</a><a class="x" href="/pii/S1?a">A title that is long <b>enough</b></a><a href="/pii/S1">Another title of the same one</a>')], "page_id int, html string")
    assert [row.title for row in tables.article_links(html).collect()] == ["A title that is long enough"]
    speech = spark.createDataFrame([(1, "en", "e"), (1, "zh", "z"), (2, "fr", "f")], "id int, language string, text string")
    assert [(row.id, row.text) for row in tables.best_language(speech, "id", "language").collect()] == [(1, "z")]
    names = spark.createDataFrame([("a.json",), ("a.md",), ("b.json",), ("c_raw.md",)], "file string")
    assert {row.file for row in tables.prefer(names, "file", ["md", "json"]).collect()} == {"a.md", "b.json"}


def test_blocks_are_idempotent(spark):
    text = "# t\n\n## 引用池\nold\n\n## Next\nx\n"
    once, changed = writers.replace_block(text, "## 引用池", "## 引用池\nnew\n")
    assert changed and once == "# t\n\n## 引用池\nnew\n\n## Next\nx\n" and writers.replace_block(once, "## 引用池", "## 引用池\nnew\n") == (once, False)
    files = spark.createDataFrame([("a", "# only"), ("b", None)], "file string, text string")
    blocks = spark.createDataFrame([("a", "## 引用池\nz")], "file string, block string")
    out = {row.file: (row.text, row.changed) for row in writers.upsert_blocks(files, "## 引用池", blocks).collect()}
    assert out == {"a": ("# only\n\n## 引用池\nz\n", True), "b": (None, False)}


def test_guarded_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.guarded_overwrite(spark.range(3), path) == 3
    with pytest.raises(writers.NothingToWrite):
        writers.guarded_overwrite(spark.range(0), path)
    assert writers.guarded_overwrite(spark.read.parquet(path).where("id > 0"), path) == 2 and spark.read.parquet(path).count() == 2
    writers.write_csv_with_bom(spark.createDataFrame([("b",), ("a",)], "x string"), ["x"], str(tmp_path / "r" / "o.csv"))
    assert (tmp_path / "r" / "o.csv").read_bytes().decode("utf-8-sig").split() == ["序号,x", "1,a", "2,b"]
    report = writers.report_table(spark.createDataFrame([(1, "a|b"), (1, "c")], "d int, t string"), "d", ["t"], ["t"]).first().markdown
    assert report.split("\n") == ["| # | t |", "|---|---|", "| 1 | a/b |", "| 2 | c |"]
    items = spark.createDataFrame([(1, n) for n in range(1, 6)], "item_id int, n int")
    parts = spark.createDataFrame([(1, 1, 1, 3), (1, 2, 4, 5)], "item_id int, part int, range_start int, range_end int")
    writers.write_chunks(items, parts, "item_id", str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "c")).groupBy("part").count().orderBy("part").collect()[0]["count"] == 3
    master = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, v int")
    assert [row.key for row in writers.new_entries(master.where("key <> 'c'"), master.where("key = 'a'"), master).collect()] == ["b"]
