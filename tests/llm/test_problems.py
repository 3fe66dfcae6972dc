"""The operators on small tables, against brute force, with nulls, blanks, long texts, ties, repeats and empty tables."""

from __future__ import annotations

import itertools
import math
import random
import unicodedata
from collections import Counter
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscale.llm import leaks, lookalikes, mixing, names, packing, page_spam, residue, survivors, text_dedup
from folioscale.llm.catalog import oracle, queries
from folioscale.llm.top_n import top_n
from tests.oracle import assert_same, connect

QUERIES, ORACLE = queries(), oracle()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, data):
    assert_same(QUERIES[name](spark, data).toPandas(), connect(data).execute(ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() >= 0


# 1 packing

ITEMS = "item_id long, plan_id long, tags array<string>, item_count int, batch_limit int, bin int"


def check_batches(items, batches):
    due = {item: (count, limit) for item, plan, _, count, limit, _ in items if plan is not None and (count or 0) > 0 and (limit or 0) > 0}
    given_, parts = Counter(), Counter()
    for row in batches:
        assert row.filled == sum(x.item_count for x in row["items"]) <= row.capacity <= row.batch_limit and row.n_items == len(row["items"])
        for x in row["items"]:
            given_[x.item_id] += x.item_count
            parts[x.item_id] += 1
    assert given_ == Counter({item: count for item, (count, _) in due.items()})
    assert all(due[item][0] > due[item][1] for item, n in parts.items() if n > 1)


def test_batches_hold_every_item_once(spark):
    rng = random.Random(5)
    items = [(i, rng.choice([1, 1, 1, 2, 3]), rng.choice([None, [], ["a"], ["b", "a", "a"]]), rng.choice([0, None, 5, 15, 15, 16, 29, 30, 31, 134]), 30, 7) for i in range(400)]
    items += [(900, None, None, 5, 30, 0), (901, 4, None, 5, None, 0), (902, 4, None, 5, 0, 0), (903, 5, ["z"], 1, 1, 0), (904, 4, ["q"], 9, 30, 0)]
    table = spark.createDataFrame([*items, items[-1], items[0]], ITEMS)
    batches = packing.batches(table).collect()
    check_batches(items, batches)
    numbers = Counter((row.plan_id, row.batch_limit, row.batch_no) for row in batches)
    assert set(numbers.values()) == {1} and all(sorted(n for p, l, n in numbers if (p, l) == key) == list(range(sum(1 for p, l, _ in numbers if (p, l) == key))) for key in {(p, l) for p, l, _ in numbers})
    assert {row.item_id: row.state for row in packing.unpacked(table).collect() if row.item_id >= 900} == {900: "no plan", 901: "no limit", 902: "no limit"}
    assert [row.tags for row in batches if row.plan_id == 4] == [["q"]]
    assert packing.batches(table.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), min_size=1, max_size=15))
def test_stacks_hold_the_counts(sizes):
    stacks = packing.pack_best(sizes, 50)
    held = Counter()
    for capacity, bins, contents in stacks:
        assert bins > 0 and sum(s * n for s, n in contents.items()) <= capacity <= 50
        for size, n in contents.items():
            held[size] += n * bins
    assert held == Counter(sizes)
    total, bins = sum(s * n for s, n in sizes.items()), sum(b for _, b, _ in stacks)
    # never more than any first-fit packing may need
    assert math.ceil(total / 50) <= bins <= max(1, math.floor(1.7 * max(total / 50, sum(n for s, n in sizes.items() if s > 25)) + 1))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=8))
def test_fullest_filling_is_the_best_sum(room, sizes):
    sums = {0}
    for size, n in sizes.items():
        sums = {s + k * size for s in sums for k in range(n + 1) if s + k * size <= room}
    found = packing.fullest(room, sorted(sizes.items(), reverse=True))
    assert sum(s * n for s, n in found.items()) == max(sums) and all(n <= sizes[s] for s, n in found.items())


def test_item_of_many_pieces_and_hot_pool(spark):
    items = [(1, 1, ["a"], 70_000, 2, 0), (2, 1, ["b"], 3, 2, 0)] + [(i, 1, None, 1, 2, 0) for i in range(3, 9000)]
    rows = packing.batches(spark.createDataFrame(items, ITEMS)).collect()
    check_batches(items, rows)
    assert len(rows) == 35_000 + 1 + math.ceil((1 + 8997) / 2)


# 2 names


def clusters_of(spark, authors):
    table = spark.createDataFrame([(i, author, "x") for i, author in enumerate(authors)], "source_id long, author_full string, name string")
    found = names.clusters(table, "source_id", "author_full").collect()
    out: dict[str, set[int]] = {}
    for row in found:
        out.setdefault(row.cluster, set()).add(row.id)
    return sorted(map(sorted, out.values()))


def test_spellings_of_a_person_and_of_a_body(spark):
    fillers = [f"Filler{chr(97 + i)}{chr(97 + j)}xyz, {given}" for i in range(6) for j in range(6) for given in ("Michael", "Nadia", "Edward", "Esther")]
    same = ["Stovesevon, Michael and Other, A.", "Mike Stovesevon", "STOVESEVON, M.", "Stovesevon, M J", "Dr. Michael J. Stovesevon", "stovesevon, micheal", "Stovesveon, Michael", "M. Stovesevon and others"]
    other = ["Stovesevon, Nadia", "N. Stovesevon"]
    bodies = ["{Limakubon Institute for Materials and Energy} and B, C.", "Inst. Mat. & Energy (Limakubon)", "Limakubon The Institute for Materials/Energy", "Limakubno Materials + Energy Institute"]
    neighbour = ["{Limakubon Centre for Materials and Energy}"]
    chinese = ["郑, 光丰", "鄭光豐", "郑 光 丰 and 王, 一"]
    texts = ["{Other%s Institute for Materials and Energy}" % chr(97 + i) for i in range(8)] + ["{Other%s Centre for Materials}" % chr(97 + i) for i in range(8)]
    authors = [*same, *other, *bodies, *neighbour, *chinese, None, "", "  ", *fillers, *texts]
    groups = clusters_of(spark, authors)
    n = len(same)
    assert list(range(n)) in groups and [n, n + 1] in groups
    assert [n + 2, n + 3, n + 4, n + 5] in groups and [n + 6] in groups and [n + 7, n + 8, n + 9] in groups
    assert not any(i in group for group in groups for i in (n + 10, n + 11, n + 12))


def test_names_edge_cases(spark):
    long = "Verylong " * 3000
    groups = clusters_of(spark, ["A", "A", ",", "{}", "{unclosed and B", long, long + "x", "X, Y, Z", "。"])
    assert any(group[:2] == [0, 1] for group in groups)
    assert clusters_of(spark, [None]) == []


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
def test_close_is_one_edit(a, b):
    def edits(word):
        yield word
        for i in range(len(word)):
            yield word[:i] + word[i + 1 :]
            for c in "ab":
                yield word[:i] + c + word[i + 1 :]
            if i + 1 < len(word):
                yield word[:i] + word[i + 1] + word[i] + word[i + 2 :]
        for i in range(len(word) + 1):
            for c in "ab":
                yield word[:i] + c + word[i:]

    assert names.close(a, b) == (b in set(edits(a)))


def test_near_heads_hold_every_slip(spark):
    rng = random.Random(22)
    words = ["clark", "clrak", "lopez", "lobez", "martin", "matrin", "ligrevaland", "ligervalnd", "long", "lung"]
    for _ in range(60):
        word = "".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(5, 11)))
        words.append(word)
        for _ in range(rng.randint(1, 2)):
            at = rng.randrange(len(word) - 1)
            word = rng.choice([word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word[:at] + "x" + word[at + 1 :], word[:at] + word[at + 1] + word[at] + word[at + 2 :]])
        words.append(word)
    words = sorted(set(words))
    heads = spark.createDataFrame([("person", word) for word in words], "kind string, head string")
    found = {(row.a, row.b) for row in names.near_heads(heads).collect()}
    slips = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if names._slip(a, b, 9, 1)}
    assert len(slips) > 40 and slips <= found and ("long", "lung") not in found


def test_near_heads_of_any_length(spark):
    """Two edits anywhere in heads around and beyond the length from which stretches are compared, and very long ones."""
    rng = random.Random(23)
    words, slips = [], set()
    for size in (*range(28, 40), 60, 61, 5000):
        for _ in range(6 if size < 100 else 1):
            word = old = "".join(rng.choice("abcdeimnorst") for _ in range(size))
            for _ in range(2):
                at = rng.randrange(len(word) - 1)
                word = rng.choice([word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word[:at] + "x" + word[at + 1 :], word[:at] + word[at + 1] + word[at] + word[at + 2 :]])
            words += [old, word]
            if names._slip(old, word, 9, 1):
                slips.add(tuple(sorted((old, word))))
    heads = spark.createDataFrame([("person", word) for word in sorted(set(words))], "kind string, head string")
    found = {(row.a, row.b) for row in names.near_heads(heads).collect()}
    assert len(slips) > 60 and slips <= found
    one = "stovesevon" * 3000
    assert clusters_of(spark, [f"{one}, Michael", f"{one[:9000]}x{one[9000:]}, Michael", "Other, M."]) == [[0, 1], [2]]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
def test_edits_against_the_whole_table(a, b, most):
    table = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            table[i, j] = max(i, j) if not i or not j else min(table[i - 1, j] + 1, table[i, j - 1] + 1, table[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                table[i, j] = min(table[i, j], table[i - 2, j - 2] + 1)
    assert names.edits(a, b, most) == min(table[len(a), len(b)], most + 1)


def test_slips_of_short_family_names(spark):
    full = ["Clark, Xenia", "Clrak, Xenia", "Lopez, Maria", "Lobez, Maria", "Ligrevaland, Xenia M.", "Ligrevaland, Xenia M.", "Ligrevaland, Xenia M.", "Ligervalnd, Xenia M."]
    table = spark.createDataFrame(list(enumerate(full)), "source_id long, author_full string")
    cluster = {row.id: row.cluster for row in names.clusters(table, "source_id", "author_full").collect()}
    assert cluster[0] == cluster[1] and cluster[2] == cluster[3] and cluster[4] == cluster[7] and len(set(cluster.values())) == 3


def test_similar_heads_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice(("ba", "bo", "di", "du", "fe")) for _ in range(4)) + rng.choice(("", "n", "st")) for _ in range(150)})
    heads = spark.createDataFrame([("person", word) for word in words], "kind string, head string")
    found = {(row.a, row.b) for row in names.similar_heads(heads, least=0.3).collect()}
    grams = {word: Counter(("^" + word + "$")[i : i + 4] for i in range(len(word) - 1)) for word in words}
    df = Counter(g for counter in grams.values() for g in counter)
    vector = {word: {g: tf * (math.log(len(words) / df[g]) + 1) for g, tf in counter.items()} for word, counter in grams.items()}
    norm = {word: math.sqrt(sum(x * x for x in v.values())) for word, v in vector.items()}
    for a, b in itertools.combinations(words, 2):
        cosine = sum(x * vector[b].get(g, 0) for g, x in vector[a].items()) / norm[a] / norm[b]
        if cosine >= 0.3001 and names.close(a, b):
            assert (a, b) in found, (a, b, cosine)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.randoms(use_true_random=False))
def test_average_linkage_against_a_full_matrix(n, rng):
    weights = [rng.randint(1, 5) for _ in range(n)]
    similarity = {pair: rng.choice([0.3, 0.5, 0.6, 0.61, 0.9, 1.0]) for pair in itertools.combinations(range(n), 2) if rng.random() < 0.6}
    groups = [[i] for i in range(n)]
    while True:
        mean = lambda a, b: round(sum(similarity.get((min(i, j), max(i, j)), 0.0) for i in a for j in b) / len(a) / len(b), 9)
        best = max(((mean(a, b), sum(weights[i] for i in (*a, *b)), -a[0], -b[0]) for a, b in itertools.combinations(groups, 2)), default=(0,))
        if best[0] < 0.42:
            break
        a, b = next(g for g in groups if g[0] == -best[2]), next(g for g in groups if g[0] == -best[3])
        groups = sorted([g for g in groups if g not in (a, b)] + [sorted(a + b)])
    label = names.average_linkage(similarity, weights, 0.42)
    assert sorted(sorted(i for i in range(n) if label[i] == c) for c in set(label)) == groups


def test_hot_component_is_linked_in_time(spark):
    """A family name with 20,000 given names of one letter, and initials that may stand for each."""
    given_ = ["".join(p) for p in itertools.product("abcdefghij", repeat=4)] * 2
    full = [f"Stovesevon, M{g}{'q' * (i % 2)}" for i, g in enumerate(sorted(given_))] + ["Stovesevon, M.", "Stovesevom, M. K."]
    parsed = [(form, "stovesevon" if "von" in form else "stovesevom", form.split(", ")[1].lower().rstrip(".")[:1] if "." in form else form.split(", ")[1].lower(), "k" if "K." in form else "", 1) for form in sorted(set(full))]
    out = dict(names.settle(parsed, names.Cosine(10, {})))
    assert len(set(out.values())) == len(parsed) - 2 and out["Stovesevon, M."] == out["Stovesevom, M. K."]


def test_pairs_within_hot_groups(spark):
    from folioscale.llm.pairs import BLOCK, pairs_within

    rows = [(i, "hot" if i <= BLOCK + 50 else f"k{i % 40}" if i % 3 else None) for i in range(BLOCK + 400)]
    table = spark.createDataFrame(rows, "id long, cluster string")
    found = pairs_within(table, "cluster", "id")
    by: dict = {}
    for i, key in rows:
        by.setdefault(key, []).append(i)
    assert found.count() == found.distinct().count() == sum(len(ids) * (len(ids) - 1) // 2 for key, ids in by.items() if key)
    assert found.where("a >= b").count() == 0


# 3 layout duplicates


def test_copies_against_brute_force(spark):
    rng = random.Random(3)
    base = [("Smith, A.", "A title: of things"), ("李四", "《数字》化 转型"), ("Café", "Ünder"), ("X1", "H₂O"), (None, "t"), ("—", "t"), ("", ""), ("long", "word " * 5000)]
    rows = []
    for i in range(300):
        author, title = rng.choice(base)
        vary = lambda t: t if t is None else rng.choice([t, t.upper(), f"  {t} ", f'"{t}".', t.replace(" ", "  "), unicodedata.normalize("NFD", t)])
        author, title = vary(author), vary(title)
        if rng.random() < 0.3:
            author, title = title, author
        rows.append((i, author, title, rng.choice([2000, 2001, None]), "key", "digest"))
    table = spark.createDataFrame([*rows, rows[0]], "paper_id long, first_author string, title string, year int, key string, digest string")
    form = lambda t: "".join(c for c in unicodedata.normalize("NFC", t).casefold() if c.isalnum())
    groups: dict = {}
    for i, author, title, year, *_ in [*rows, rows[0]]:
        if author is not None and title is not None and year is not None and form(author) and form(title):
            groups.setdefault((year, *sorted((form(author), form(title)))), []).append(i)
    expected = {(min(ids), i) for ids in groups.values() for i in ids if i != min(ids)}
    args = ("paper_id", ["year"], ["first_author", "title"])
    assert {tuple(row) for row in text_dedup.copies(table, *args).collect()} == expected
    assert {tuple(row) for row in text_dedup.collapse(table, *args).collect()} == {(min(ids), len(ids)) for ids in groups.values()}
    # with a hash that collides all the time, the checks tell the records apart
    colliding = text_dedup.copies(table, *args, digest=lambda key: bytes([len(key) % 2]))
    assert {tuple(row) for row in colliding.collect()} == expected
    assert text_dedup.copies(table.limit(0), *args).count() == 0


# 4 survivors

MERGED = "rec_id long, dedup_key string, direction int, directions array<int>, primary_direction int, tier string, title string, first_author string, year int, journal string, reason string, source_type string, merged_at timestamp_ntz, n_rows int"


def merged(spark, rows):
    return spark.createDataFrame(rows, MERGED)


def test_survivor_is_chosen_field_by_field(spark):
    day = datetime(2024, 1, 1)
    old = datetime(2015, 1, 1)
    rows = merged(spark, [
        (1, "k", 5, [5, 7, 5], 5, "backup", "Old", None, 2001, "—", " ", "wos", old, 0), (2, "k", None, None, None, "核心", "New", "A", None, "N/A", "r", "wos", day, 0),
        (3, "k", 3, [9, None], 3, " CORE", "New ", "A", None, "无", None, "cnki", day, 0), (3, "k", 3, [9, None], 3, " CORE", "New ", "A", None, "无", None, "cnki", day, 0),
        (4, "solo", 1, [2], 1, None, None, None, None, None, None, None, None, 0), (5, None, 1, None, 1, "core", "x", "y", 1, "z", "w", "wos", day, 0),
    ])
    out = {row.dedup_key: row for row in survivors.merged_papers(rows).collect()}
    assert set(out) == {"k", "solo"} and out["k"].n_rows == 4 and out["k"].rec_id == 3
    assert (out["k"].title, out["k"].first_author, out["k"].year, out["k"].journal, out["k"].tier) == ("New", "A", "2001", None, "core")
    assert out["solo"].rec_id == 4 and out["solo"].title is None
    assert (sorted(out["k"].directions), sorted(out["solo"].directions)) == ([3, 5, 7, 9], [1, 2]) and out["k"].directions[:2] == [3, 9]
    assert {row.dedup_key: (row.rec_id, row.directions, row.n_rows) for row in survivors.merged_directions(rows).collect()} == {k: (row.rec_id, row.directions, row.n_rows) for k, row in out.items()}
    assert survivors.merged_papers(rows.limit(0)).count() == 0


def test_old_votes_count_as_much_as_new_ones(spark):
    row = lambda i, journal, when, key: (i, key, None, None, None, "core", "t", "a", 2000, journal, "r", "wos", when, 0)
    rows = merged(spark, [row(1, "b", datetime(1985, 1, 1), "old"), row(2, "b", datetime(1985, 1, 2), "old"), row(3, "a", datetime(1984, 1, 1), "old"), row(4, "a", datetime(1500, 1, 1), "tie"), row(5, "b", datetime(1500, 1, 1), "tie"), row(6, "b", datetime(2024, 1, 1), "new"), row(7, "a", datetime(2020, 1, 1), "new")])
    out = {r.dedup_key: r for r in survivors.merged_papers(rows).collect()}
    assert {key: r.journal for key, r in out.items()} == {"old": "b", "tie": "a", "new": "b"} and all(r.directions == [] for r in out.values())


# 5 residue


NOTES = [
        ("{{scene}}", True), ("支撑__________的论证", True), ("用于第__usage__章说明", True), ("Lorem ipsum dolor sit", True), ("404 Not Found", True), ("Traceback (most recent call last): KeyError", True), ("请求超时，文献1详情加载失败", True),
        ("Please enable JavaScript to view this abstract", True), ("本页面需要脚本支持，请更换浏览器", True), ("TODO", True), ("待补充 7。", True), ("??????", True), ("示例：可在某节引用", True), ("可在<claim_text>节引用", True), ("好的，我将根据要求填写引用场景：", True), ("界定概念，与区分 null", True),
        ("界定技术采纳概念，与公共采购区分", False), ("<资源重构> 量表的来源，5.3节", False), ("[综述] 绿色创新的影响机制，1.1节", False), ("Section 2.5: TODO lists as a tool of job crafting", False), ("Access was denied to half of the sample firms; use as limitation in 2.5", False),
        ("讨论平台错误页面对用户信任的影响，可在2.5节引用", False), ("null results on trust repair (placebo test), cite in 2.2", False), ("Describes undefined property rights around noise exposure", False), (r"用于 \textbf{碳核算} 的定义，见3.1节", False), ("JavaScript 生态中开源治理的案例，支撑产业集群", False),
        ("说明问卷模板中占位符对作答率的影响，1.3节", False), ("待填补的研究空白：专利组合与社区治理的关系，3.1节", False), ("Lorem-style dummy items in surveys: see method 5.1", False), (None, False), ("", False), (" — ", False), ("N/A", False), ("无", False),
]


def test_residue_in_notes(spark):
    table = spark.createDataFrame([(i, "smith2020a", text, "J", "x") for i, (text, _) in enumerate(NOTES)], "entry_id long, citation_key string, note string, journal string, host string")
    ids = {row.id for row in residue.residue(table, "entry_id", "citation_key", ["note"], "journal").collect()}
    assert [NOTES[i] for i in range(len(NOTES)) if (i in ids) is not NOTES[i][1]] == []


KEYS = [
     ("{{author}}2024{{letter}}", True), ("your-key-here", True), ("lorem_ipsum", True), ("undefinedNaNundefined", True), ("None2023", True), ("[key]", True), ("error500", True), ("待填", True), ("TODO-2020", True), ("surnameYYYYt", True), ("__surname__2012m", True),
     ("smith2020a", False), ("TODOFUMEND2023M", False), ("TESTODRUTIND2016U", False), ("cn0_20_2022l", False), ("pidestobrirg2024t-b", False), ("stipovudum_2015b", False), ("cn6942016r", False), ("MUMEPABIM2014U", False), ("-", False), (None, False),
]


def test_residue_in_keys(spark):
    table = spark.createDataFrame([(i, key, None, None) for i, (key, _) in enumerate(KEYS)], "entry_id long, citation_key string, note string, journal string")
    ids = {row.id for row in residue.residue(table, "entry_id", "citation_key", ["note"], "journal").collect()}
    assert [KEYS[i] for i in range(len(KEYS)) if (i in ids) is not KEYS[i][1]] == []


def test_residue_subtracts_boilerplate(spark):
    rows = [(i, "k2020a", f"错误的类型 {i}", f"J{i % 20}") for i in range(60)] + [(99, "k2020a", "出现错误", "J1"), (100, "k2020a", "x" * 100_000 + " {{y}}", None), (100, "k2020a", "same {{y}}", None)]
    table = spark.createDataFrame(rows, "entry_id long, citation_key string, note string, journal string")
    assert [row.id for row in residue.residue(table, "entry_id", "citation_key", ["note"], "journal").orderBy("id").collect()] == [99, 100]
    assert residue.residue(table.limit(0), "entry_id", "citation_key", ["note"], "journal").count() == 0


@pytest.mark.parametrize("times", [1, 10])
def test_residue_is_judged_alike_at_every_size(spark, times):
    # an ordinary line of 2 % in all journals, and recurrent residue of 0.15 % in 9 journals
    base = [(f"错误的类型 {i}" if i % 50 == 0 else f"note {'abcdefghij'[i % 10]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}", f"J{i // 50 % 20}") for i in range(6000)]
    base = [(note, f"J{i % 19}" if "错误" in note else host) for i, (note, host) in enumerate(base)] + [("出现错误", f"J{i}") for i in range(9)] + [("404 Not Found", f"J{i % 20}") for i in range(200)]
    rows = [(i, "k2020a", note, host) for i, (note, host) in enumerate(base * times)]
    table = spark.createDataFrame(rows, "entry_id long, citation_key string, note string, journal string")
    assert residue.residue(table, "entry_id", "citation_key", ["note"], "journal").count() == 209 * times
    # the ordinary line is subtracted, and so is the error page, which is protected
    forms = residue.shared_forms(table.select(residue.masked(F.col("note")).alias("form"), F.col("journal").alias("host")))
    assert {"错误的类型 0", "0 not found"} <= {row.form for row in forms.collect()} and forms.where("form = '出现错误'").count() == 0


def test_filler_is_learned_from_its_company(spark):
    rng = random.Random(5)
    coined = "veropas mindel tarsico lumbrae hostiva quendo".split()
    filler = [" ".join(rng.choice([*coined, "lorem", "ipsum"]) for _ in range(7)) for _ in range(60)]
    notes = [f"Contrast case for {a} {b}; discussion {i}" for i, (a, b) in enumerate(itertools.product("trade health school water".split(), "policy survey panel index".split()))]
    odd = ["dolor sit amet, consectetur adipiscing elit, sed do eiusmod", "lumbrae quendo veropas", "Lorem-style dummy items in surveys: see method 5.1", "the lumbrae index, 2.1节"]
    rows = [(i, "k2020a", text, f"J{i % 9}") for i, text in enumerate([*filler, *odd, *notes])]
    table = spark.createDataFrame(rows, "entry_id long, citation_key string, note string, journal string")
    found = {row.id for row in residue.residue(table, "entry_id", "citation_key", ["note"], "journal").collect()}
    assert found == {*range(60), 60, 61}


def test_residue_in_keys_by_hosts(spark):
    rows = [(1, "qqq0000x", "J1"), (2, "qqq0000x", "J2"), (3, "cn0_20_2022l", "J1"), (4, "cn0_20_2022l", "J1"), (5, "stotekupem2014d", "J1"), (6, "stotekupem2014d", "J2"), (7, "fixme2022x", "J1"), (8, "lorem2021i", "J1"), (9, "cn0_20_2022l", None)]
    table = spark.createDataFrame(rows, "entry_id long, citation_key string, journal string").withColumn("note", F.lit("a note"))
    assert sorted(row.id for row in residue.residue(table, "entry_id", "citation_key", ["note"], "journal").collect()) == [1, 2, 7, 8]


# 6 look-alikes

PIECES = ["a", "а", "ａ", "é", "é", "e", "​", " ", " ", "  ", "x", "х", "ﬁ", "fi", "人", "⼈", "：", ":", "2", "₂", "２", "o", "ο", "\t", "-", "‐"]


def test_alike_pairs_against_brute_force(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 4))) for _ in range(160)]
    rows = [(i, text, rng.choice(["Автор", "Aвтор", "b"]), "t", 1) for i, text in enumerate(texts)] + [(900, None, "b", "t", 1), (901, "", "", "t", 1), (902, "w" * 60_000, "b", "t", 1), (903, "w" * 60_000 + "​", "b", "t", 1)]
    table = spark.createDataFrame(rows, "paper_id long, title string, first_author string, texts string, odd int")
    reads = lambda t: lookalikes.tidy(lookalikes.skeleton("".join(" " if c in lookalikes.UNUSUAL_BLANKS else c for c in t)))
    expected = set()
    for (i, a, b, *_), (j, c, d, *_) in itertools.combinations(rows, 2):
        if None not in (a, b, c, d) and (reads(a), reads(b)) == (reads(c), reads(d)) and (lookalikes.tidy(a), lookalikes.tidy(b)) != (lookalikes.tidy(c), lookalikes.tidy(d)):
            expected.add((i, j))
    found = {tuple(row) for row in lookalikes.alike_pairs(table, "paper_id", ["title", "first_author"]).collect()}
    assert found == expected and (902, 903) in found
    assert lookalikes.alike_pairs(table.limit(0), "paper_id", ["title", "first_author"]).count() == 0
    classes = {row.id: row for row in lookalikes.alike_classes(table, "paper_id", ["title", "first_author"]).collect()}
    assert set(classes) == {i for pair in expected for i in pair} and all(classes[i]["class"] == classes[j]["class"] for i, j in expected)
    assert all(row.members == sum(other["class"] == row["class"] for other in classes.values()) for row in classes.values())


def test_readings_of_a_large_foreign_source(spark):
    """Where a word of look-alikes only is commoner in Cyrillic than in Latin letters, its rows agree all the same."""
    rows = [(1, "A. in ACE", "Moxo B."), (2, "А. in АСЕ", "Moxo В.")] + [(i, "А. и АСЕ", "В.") for i in range(3, 60)]
    table = spark.createDataFrame(rows, "paper_id long, title string, first_author string")
    assert [tuple(row) for row in lookalikes.alike_pairs(table, "paper_id", ["title", "first_author"]).collect()] == [(1, 2)]
    text = {row.id: (row.title, row.first_author) for row in lookalikes.consistent(table, "paper_id", ["title", "first_author"]).collect()}
    assert text[1] == text[2] == ("A. in ACE", "Moxo B.")
    small = dict(lookalikes.canonical({f"w{i}о": 1 for i in range(40)} | {"w7o": 1}))
    assert small["w7о"] == "w7o" and small["w8о"] == "w8o"


def test_consistent_text(spark):
    rows = [(1, "Моdel of А", None), (2, "Модель", "x"), (3, "ｆｕｌｌ　width", "y"), (4, "Model A", "z"), (5, "H₂O café", None), (6, "café", "")]
    table = spark.createDataFrame(rows, "paper_id long, title string, first_author string")
    out = {row.id: row.title for row in lookalikes.consistent(table, "paper_id", ["title", "first_author"]).collect()}
    assert out == {1: "Model of A", 2: "Модель", 3: "full width", 4: "Model A", 5: "H₂O café", 6: "café"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aаbｂéx", min_size=1, max_size=4), min_size=1, max_size=8), st.text("aаbｂéx", min_size=1, max_size=4), st.integers(0, 2))
def test_automaton_is_edit_distance_of_what_is_read(vocabulary, word, limit):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    form = lambda t: unicodedata.normalize("NFD", lookalikes.skeleton(t))
    trie = lookalikes.Trie()
    for entry in set(vocabulary):
        trie.add(entry)
    assert trie.reach(word, limit=float(limit)) == {entry: float(d) for entry in set(vocabulary) if (d := distance(form(word), form(entry))) <= limit}


# 7 top n


def test_top_n_against_sorting(spark):
    rng = random.Random(7)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 1.5]), i, "x", i) for i in range(3000)]
    table = spark.createDataFrame(rows, "g int, a int, b double, id long, own string, rank_no long").repartition(7)
    out = {(row.g, row.id): row.rank_no for row in top_n(table, "g", [("a", False), ("b", True), ("id", False)], 10).collect()}
    expected = {}
    for group in (1, 2, 3):
        own = sorted((r for r in rows if r[0] == group), key=lambda r: (r[1] is None, r[1] or 0, r[2] is None, -(r[2] or 0), r[3]))
        expected |= {(group, r[3]): n for n, r in enumerate(own[:10], 1)}
    assert out == expected
    assert top_n(table, "g", [("id", True)], 10, keep_null_group=True).where("g is null").count() == 10
    assert top_n(table.limit(0), "g", [("id", True)], 3).count() == 0
    with pytest.raises(ValueError):
        top_n(table, "g", [("own", True)], 3)


def test_top_n_of_many_groups_and_odd_scores(spark):
    rows = [(i % 3, score, i) for i, score in enumerate([float("nan"), None, 1.0, float("inf"), float("-inf"), -0.0, 0.0, float("nan"), None, 2.0, 2.0, 3.0] * 3)]
    table = spark.createDataFrame(rows, "g int, s double, id long").repartition(3)
    value = lambda s: -math.inf if s is None or s != s else s
    expected = {(g, r[2]): n for g in range(3) for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None or r[1] != r[1], -value(r[1]) if value(r[1]) != -math.inf or r[1] == -math.inf else 0, r[2]))[:4], 1)}
    assert {(row.g, row.id): row.rank_no for row in top_n(table, "g", [("s", True), ("id", False)], 4).collect()} == expected
    exact = spark.createDataFrame([(1, i) for i in range(5)], "g int, id int").selectExpr("g", "id", "cast(id as decimal(18,2)) / 3 as d", "cast(1234567890123456.05 + id % 2 * 0.01 as decimal(18,2)) as e")
    assert [row.id for row in top_n(exact, "g", [("e", True), ("id", False)], 2).orderBy("rank_no").collect()] == [1, 3]
    # a million groups: the time grows with the rows, not with their square
    many = spark.range(1_000_000).select(F.col("id").alias("g"), F.col("id").alias("s"))
    assert top_n(many, "g", [("s", True)], 2).count() == 1_000_000


# 8 leaks

ITEM = "Before the Guvehilan reform, orchard tenants negotiated pooled sick leave behind closed doors; afterwards a lottery assigned printed route cards to roughly one bidder in 13 of the whole town."
OTHER = "Before the Nomiguvus reform, school caretakers negotiated a rotating deposit behind closed doors; afterwards a lottery assigned doorstep metering to roughly one bidder in 40 of the whole town."
ZH = "由于桂川谷只在秋收时节对自愿土壤检测征费，渡船船工会把其中百分之二十四提前入账，其余记在两阶段招标名下，并且每隔十一周更新一次。"
ASK = "Read the passage and choose the statement it supports best, then give your reasons in full sentences and mark the lines that you have used for it. "


@pytest.mark.parametrize(
    "text, found",
    [
        (ITEM, {1}), (ITEM.upper().replace(" ", "\n"), {1}), ("x " + " ".join(ITEM.split()[3:26]) + " y", {1}), (" ".join(w + (" also" if i % 7 == 3 else "") for i, w in enumerate(ITEM.split())), {1}), (" ".join(ITEM), {1}), (ITEM.replace("lottery", "draw"), {1}),
        (" ".join(ITEM.split()[:12]), set()), (ASK + "Nothing else.", set()), (OTHER + " and " + ITEM, {1, 2}), (OTHER.replace("Nomiguvus", "Xxxxxx").replace("school caretakers", "port pilots").replace("a rotating deposit", "open ledgers").replace("doorstep metering", "shared tools").replace("40", "7"), set()),
        ("前言" + ZH[5:55] + "后记", {3}), (ZH.replace("，", ""), {3}), (ZH[:18], set()), ("", set()), (None, set()), ("word " * 40_000 + ITEM, {1}),
    ],
)
def test_leaks(spark, text, found):
    items = spark.createDataFrame([(1, ASK + ITEM), (2, ASK + OTHER), (3, ZH), (4, None), (5, ""), (6, "???")], "item_id long, text string")
    docs = spark.createDataFrame([(7, text, "x")], "doc_id long, text string, item_id string")
    rows = leaks.leaks(docs, items).collect()
    assert {row.item_id for row in rows} == found
    for row in rows:
        piece = leaks.compact(text[row.start : row.end])
        assert piece and piece[:8] in leaks.compact(text) and row.end <= len(text)
    assert leaks.leaks(docs.limit(0), items).count() == 0 and leaks.leaks(docs, items.limit(0)).count() == 0
    assert sorted(leaks.leaks(docs, items, block_chars=400).collect()) == sorted(rows)


def test_leaks_do_not_depend_on_blocks(spark):
    """Shared sentences and the best item of a passage are found over all items, in however many automata."""
    items = spark.createDataFrame([(1, ASK + ITEM), (2, ASK + OTHER), (3, ZH), (4, ASK + ITEM), (5, OTHER.replace("school", "nursery"))], "item_id long, text string")
    docs = spark.createDataFrame([(1, ASK), (2, ITEM), (3, OTHER), (4, OTHER.replace("school", "nursery") + ITEM + ZH), (None, ITEM), (None, OTHER)], "doc_id long, text string")
    once = leaks.leaks(docs, items).collect()
    key = lambda rows: sorted((row.doc_id or 0, row.item_id, row.start, row.end, row.words, row.cover) for row in rows)
    assert {(row.doc_id, row.item_id) for row in once} == {(2, 1), (2, 4), (3, 2), (4, 5), (4, 1), (4, 4), (4, 3), (None, 1), (None, 4), (None, 2)}
    for chars in (150, 600):
        assert key(leaks.leaks(docs, items, block_chars=chars).collect()) == key(once), chars


def test_item_repeated_in_a_long_text():
    known = leaks.patterns([(1, [(ITEM, True)]), (2, [(OTHER, True)])])
    text = (ITEM + " ") * 1500 + "in between " + " ".join(ITEM.split()[4:]) + OTHER
    chains = leaks.best_explained(leaks.find(text, leaks.automaton_of(known), known))
    assert sum(chain.item == 0 for chain in chains) == 1501 and sum(chain.item == 1 for chain in chains) == 1
    own = sorted((chain.start, chain.end) for chain in chains)
    assert all(a[1] <= b[0] for a, b in zip(own, own[1:]))


@pytest.mark.parametrize("at", range(20))
def test_stretch_of_twenty_words_with_a_changed_one(at):
    words = ITEM.split()[2:22]
    known = leaks.patterns([(1, [(ITEM, True)])])
    text = "something else " + " ".join("changed" if i == at else word for i, word in enumerate(words)) + " and more"
    assert len(words) == 20 and bool(leaks.find(text, leaks.automaton_of(known), known)) is (at not in (0, 19)), at


@settings(max_examples=100, deadline=None)
@given(st.text("aB ．，Ａé中\n_-1", max_size=40))
def test_offsets_lead_back(text):
    places = leaks.offsets(text)
    assert len(places) == len(leaks.compact(text))
    assert [leaks.compact(text[p])[:1] for p in places] == list(leaks.compact(text))


# 9 mixing


def mixture(spark, docs, targets, total=None):
    table = spark.createDataFrame(docs, "doc_id long, text string, source string, uses long")
    wanted = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    used = mixing.uses(table, wanted, total)
    return used.collect(), {row.source: row for row in mixing.shares_reached(used, wanted).collect()}


def test_mixture_reaches_shares(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "数据"]) + str(rng.randint(0, 999)) for _ in range(rng.randint(5, 60))), rng.choice("AAAABBC"), 0) for i in range(900)]
    shared = "a text that lies in two sources " * 20
    docs += [(2000, shared, "A", 0), (2001, shared, "B", 0), (2002, shared, "B", 0), (2003, None, "A", 0), (2004, "", "C", 0), (2005, "no target", "Z", 0), (2006, "x", None, 0)]
    targets = [("A", 0.3, 2), ("B", 0.3, 2), ("C", 0.4, 3), ("empty", 0.0, 1)]
    rows, shares = mixture(spark, docs, targets)
    assert len(rows) == len(docs) and max(abs(shares[s].share - share) for s, share, _ in targets) < 0.02
    assert all(row.uses <= {"A": 2, "B": 2, "C": 3}.get(row.source, 0) for row in rows)
    assert sum(row.uses for row in rows if row.doc_id in (2000, 2001, 2002)) <= 2 and next(row for row in rows if row.doc_id == 2002).uses == 0
    assert {row.doc_id: row.uses for row in rows} == {row.doc_id: row.uses for row in mixture(spark, docs, targets)[0]}
    # the scarce source is used as often as it may be
    assert sum(row.uses for row in rows if row.source == "C") >= 0.95 * 3 * sum(1 for d in docs if d[2] == "C" and d[1])


def test_mixture_short_and_empty(spark):
    docs = [(1, "one two three", "A", 0), (2, "four five six seven", "B", 0)]
    rows, shares = mixture(spark, docs, [("A", 0.5, 1), ("gone", 0.5, 4)])
    assert shares["gone"].tokens == 0 and {row.doc_id: row.uses for row in rows} == {1: 1, 2: 0}
    assert mixture(spark, [], [("A", 1.0, 1)])[0] == [] and mixture(spark, docs, [])[1] == {}


def test_mixture_of_many_patterns(spark):
    """Texts in many combinations of sources, one of which holds half of them."""
    rng = random.Random(12)
    names_ = [f"s{i}" for i in range(8)]
    docs, number = [], 0
    for i in range(600):
        for name in names_[:1] if i % 2 else rng.sample(names_, rng.randint(1, 6)):
            docs.append((number, f"text {i} " + "word " * 30, name, 0))
            number += 1
    rows, shares = mixture(spark, docs, [(name, 1 / 8, 2) for name in names_])
    assert max(abs(row.share - 1 / 8) for row in shares.values()) < 0.03 and max(row.uses for row in rows) <= 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sets(st.sampled_from("ABC"), min_size=1), st.integers(1, 50)), min_size=1, max_size=6), st.integers(1, 200))
def test_route_is_a_flow_of_least_repetition(pools, total):
    patterns: dict = {}
    for names_, tokens in pools:
        patterns[tuple(sorted(names_))] = patterns.get(tuple(sorted(names_)), 0) + tokens
    shares, repeats = {"A": 0.5, "B": 0.3, "C": 0.2}, {"A": 2, "B": 1, "C": 3}
    given_ = mixing.route(patterns, shares, repeats, total)
    got = {name: sum(parts.get(name, 0) for parts in given_.values()) for name in shares}
    assert all(got[name] <= round(shares[name] * total) for name in shares)
    for pool, parts in given_.items():
        assert sum(parts.values()) <= patterns[pool] * min(repeats[name] for name in pool)
        # a pattern used more than once while a source it serves has unused texts elsewhere would be waste
        if sum(parts.values()) > patterns[pool]:
            for name in (n for n, tokens in parts.items() if tokens):
                for other, others in given_.items():
                    assert name not in other or sum(others.values()) >= patterns[other]


# 10 spam

PROSE = "We coded every interview twice and settled the remaining disagreements in joint sessions. The sample covers the organisations around the town between the years, and a robustness check leaves the main coefficient unchanged."
ZHPROSE = "我们保留了量表的原始措辞，并增加了几个关于财政补贴的题项，这在当地尤为明显。剔除这些案例之后，主要估计结果保持稳定。"


def spam_of(spark, texts):
    base = [PROSE.replace("town", f"town of N{i}") + " " + ZHPROSE for i in range(40)]
    rows = [(i, text, "x") for i, text in enumerate([*texts, *base])]
    table = spark.createDataFrame(rows, "doc_id long, text string, spam_share string")
    out = {row.doc_id: row.spam_share for row in page_spam.spam_pages(table).collect()}
    assert not any(out.get(i, 0) > 0.5 for i in range(len(texts), len(rows)))
    return [out.get(i, 0) > 0.5 for i in range(len(texts))]


def test_spam_kinds(spark):
    rng = random.Random(10)
    words = ["thesis editing", "essay service", "citation booster", "lab pipette", "urban heat stress"]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    spam = [
        "\n".join(f"https://m.site{i}.example/p/{i}" for i in range(20)), " ".join("#" + w.replace(" ", "") for w in some(30)), " | ".join(some(40)), "\n".join(some(40)), "\n".join(f"{rng.choice(['pipette', 'vial'])} blue SKU{rng.randint(1, 99999)} in stock" for _ in range(25)),
        " ".join(f"Our {a} {b} offers {a} for {b} and {a} with {b}." for a, b in zip(some(20), some(20))), PROSE + "\n" + "\n".join(f'<a href="http://x{i}.example">{w}</a>' for i, w in enumerate(some(30))), "论文代写，查重降重，" * 30, PROSE + "\nTags: " + ", ".join(some(60)),
    ]
    fine = [
        PROSE, ZHPROSE, PROSE + "\nKeywords: trust repair; job crafting; seed dispersal; bridge inspection", PROSE + "\nReferences\n" + "\n".join(f"[{i}] Author{i}, A. ({2000 + i}). On the study of towns. Journal of Things, {i}({i}), 1-9. https://doi.example/10.5555/{i}" for i in range(1, 12)),
        "", "   \n ", None, "？？？", "x", PROSE * 400, PROSE + "\n" + " | ".join(some(4)),
    ]
    found = spam_of(spark, spam + fine)
    assert found[: len(spam)] == [True] * len(spam) and found[len(spam) :] == [False] * len(fine)


def test_spam_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert page_spam.spam_pages(empty, full=True).count() == 0


def test_counts_are_those_of_all_words_and_neighbours(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["a", None, "", "中文 和 https://x.example/p #tag <b>bold</b>", "a b\nc"]
    table = spark.createDataFrame([(i if i else None, text) for i, text in enumerate(texts)], "doc_id long, text string").repartition(5)
    words = Counter(word for text in texts for word in page_spam.words_of(text or ""))
    pairs = Counter(pair for text in texts for own in [page_spam.words_of(text or "")] for pair in zip(own, own[1:]))
    scored = {row.doc_id: row for row in page_spam.spam_pages(table, full=True).collect()}
    assert len(scored) == len(texts)
    n, m = sum(words.values()), sum(pairs.values())

    def pmi(a, b):
        c, least = pairs[a, b], min(words[a], words[b])
        return math.log(c * n * n / m / words[a] / words[b]) + math.log(c / (c + 1) * least / (least + 1))

    for i, text in enumerate(texts):
        own = page_spam.words_of(text or "")
        mine = [pmi(a, b) for a, b in zip(own, own[1:])]
        row = scored[i if i else None]
        assert row.mean_pmi == pytest.approx(sum(mine) / len(mine) if mine else 0.0)
        often = Counter(zip(own, own[1:]))
        assert row.repeated == pytest.approx(sum(often[p] >= page_spam.REPEATED and x >= page_spam.COLLOCATION for p, x in zip(zip(own, own[1:]), mine)) / len(mine) if mine else 0.0)


def test_spam_is_shown_by_the_counts(spark):
    """Without the counts (every PMI middling) nothing but bare links is found."""
    words = page_spam.words_of("buy paper buy paper buy paper cheap essay paper help cheap essay " * 8)
    unit = page_spam.Unit("x" * 99, words, 9, 60.0)
    middling, never = [1.5] * (len(words) - 1), [False] * (len(words) - 1)
    import numpy as np

    assert not page_spam.is_spam(unit, np.array(middling), np.array(never), 1.5)
    assert page_spam.is_spam(unit, np.array([0.5] * len(middling)), np.array(never), 1.5) and page_spam.is_spam(unit, np.array(middling), np.array([True] * len(never)), 1.5)
