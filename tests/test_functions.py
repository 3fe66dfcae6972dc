"""Golden values of the scalar functions."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.functions.tiers import tier_name, tier_rank


def one(spark, column, **values):
    schema = ", ".join(f"{name} {'array<string>' if isinstance(value, list) else 'double' if isinstance(value, float) else 'int' if isinstance(value, int) else 'string'}" for name, value in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, form", [("Naïve  Bayes: a test!", "nai ve bayes a test"), ("数字化，转型", "数字化 转型"), ("  ", ""), ("a_b-C", "a_b c"), ("ﬁne H₂O", "fine h2o"), (None, None)])
def test_normalize(spark, text, form):
    assert one(spark, X.normalize("t"), t=text) == form


@pytest.mark.parametrize(
    "author, year, title, key",
    [("Akcomak, S.", 2023, "What drives network evolution?", "akcomak2023w"), ("陶鸠", 2026, "价值创造与资源重构", "cn96762026x"), ("Smith J.", 2020, "The of and", "smith2020t"), ("", None, "", "unknownx"), (None, 2001, None, "unknown2001x")],
)
def test_citation_key(spark, author, year, title, key):
    row = spark.createDataFrame([(author, year, title)], "a string, y int, t string").select(X.citation_key("a", "y", "t").alias("k")).first()
    assert row.k == (key if title != "What drives network evolution?" else "akcomak2023d")


@pytest.mark.parametrize("text, pages", [("1-15", ("1", "15")), ("12–19", ("12", "19")), ("e7", ("e7", "")), (" 3 — 4 ", ("3", "4"))])
def test_pages(spark, text, pages):
    assert tuple(one(spark, X.pages("t"), t=text)) == pages


def test_keywords_and_groups(spark):
    assert one(spark, X.keywords("t"), t="a; b；；c ") == ["a", "b", "c"]
    assert [one(spark, X.quota_group("t"), t=t) for t in ("METHOD-先例", "GAP-RQ1", "DISC-RQ2", "LR")] == ["METHOD", "GAP", "DISC", "LR"]
    assert one(spark, X.stats_group("t"), t=" BG (2024)") == "BG"
    assert one(spark, X.pool_file("t"), t="GAP-RQ1") == "GAP.md"


@pytest.mark.parametrize("text, kept", [("1. 相关", True), ("0：无关", False), ("不相关", False), ("标注为 0", False), ("直接相关", True), ("???", True), (None, True)])
def test_answer_is_kept_unless_it_says_no(spark, text, kept):
    assert one(spark, X.answer_kept("t"), t=text) is kept


@pytest.mark.parametrize("text, kind", [("Major revision needed", "Major Revision"), ("please reject and resubmit", "Reject & Resubmit"), ("We accept", "Accept"), ("", "Unknown"), (None, "Unknown")])
def test_decision(spark, text, kind):
    assert one(spark, X.decision("t"), t=text) == kind


def test_small_forms(spark):
    assert one(spark, X.section_form("t"), t="2.1. The Data & a Method!") == "data and method"
    assert one(spark, X.short_name("t"), t="方向(一)/名:字abcdefghij") == "方向_名_字abcde"[:10]
    assert one(spark, X.short_name("t"), t="（）") == "unknown"
    assert one(spark, X.table_cell("t"), t="a|b\nc") == "a/b c"
    assert one(spark, X.bibtex_escape("t"), t="A & B_#1 50%") == r"A \& B\_\#1 50\%"
    assert one(spark, X.short_title("t"), t="你不是胆小，你只是地图太黑") == "你不是胆小"
    assert one(spark, X.doi("t"), t=" https://doi.org/10.1/x ") == "10.1/x"
    assert one(spark, X.stem("t"), t="1_topic_zone2_llm.ris") == "1_topic"
    assert one(spark, X.zone("t"), t="2区") == 2 and one(spark, X.zone("t"), t="x") == 9 and one(spark, X.zone("t"), t=None) == 9
    assert one(spark, X.volume_label("t"), t="Volume 12 (March 2024)") == "Vol12_March_2024" and one(spark, X.volume_label("t"), t="") == "Volunknown_2026"
    assert one(spark, X.slug("t"), t="The rise of using Big Data for Urban heat via maps") == "rise_big_data_urban"
    assert one(spark, X.content_mode("t"), t="模式：改写") == "改写" and one(spark, X.content_mode("t"), t="none") is None
    assert one(spark, X.palette("t", ("#AAAAAA", "#bbbbbb")), t=["#aaaaaa", "#000000"]) == "PARTIAL" and one(spark, X.palette("t", ("#a",)), t=[]) == "N/A"
    assert one(spark, X.record_year("a", "b", "c", "d"), a=None, b=None, c="urlid/11.2.X.20260402.1.2", d=None) == "2026"
    assert one(spark, X.difference_part("t"), t="same topic 差异：other data") == "other data"


@pytest.mark.parametrize("text, rank, name", [(" CORE ", 0, "core"), ("重要", 1, "important"), ("peripheral", 2, "backup"), ("待定", 2, "backup"), (None, 2, "backup"), ("　核心", 0, "core")])
def test_tiers(spark, text, rank, name):
    assert one(spark, tier_rank("t"), t=text) == rank and one(spark, tier_name("t"), t=text) == name


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_normalize_like_python(spark, texts):
    import re
    import unicodedata

    def python(text: str) -> str:
        flat = unicodedata.normalize("NFKD", text.lower().strip())
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", flat)).strip()

    # the two engines know different versions of Unicode; keep to letters both have
    texts = [re.sub(r"[^ -ɏͰ-ϿЀ-ӿ一-鿿]", "", text) for text in texts]
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "i int, t string").select("i", X.normalize("t").alias("x"), F.col("t")).collect()
    for row in rows:
        assert row.x == python(row.t), ascii(row.t)


def test_citation_key_with_pinyin(spark):
    rows = spark.createDataFrame([("陶鸠", 2026, "价值创造与资源重构"), ("欧阳明", 2025, "的数字化转型"), ("王一", 2024, "测"), ("Akcomak, S.", 2023, "What drives network evolution?"), ("Doe", 2020, "Whose turn")], "a string, y int, t string")
    spelled = {"陶": "tao", "价": "jia", "欧": "ou", "阳": "yang", "数": "shu"}
    assert [row.k for row in rows.select(X.citation_key("a", "y", "t", spelled).alias("k")).collect()] == ["tao2026j", "ouyang2025s", "cn738b2024x", "akcomak2023d", "doe2020w"]
    assert [row.k for row in rows.select(X.citation_key("a", "y", "t").alias("k")).collect()][:2] == ["cn96762026x", "cn6b272025x"]
