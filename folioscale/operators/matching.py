"""Record matching by equality on keys, in the order of precedence of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.runtime import cut_lineage


def blocked_match(papers: DataFrame, entries: DataFrame) -> DataFrame:
    """Every paper with its entry or null, blocked by surname and year.

    An only candidate matches whatever its title. Of several, the one wins
    that shares the longest start (up to 40 characters, the whole of the
    shorter title), the first on ties. papers and entries: ord, author, year,
    title. Result: ord, entry_ord, candidates.
    """
    side = lambda rows: rows.select("ord", X.lead_author("author").alias("surname"), F.coalesce(F.left(F.col("year").cast("string"), F.lit(4)), F.lit("")).alias("year"), F.coalesce(X.normalize("title"), F.lit("")).alias("form"))
    # normalised once: the forms are read several times
    left, right = cut_lineage(side(papers)), cut_lineage(side(entries)).withColumnsRenamed({"ord": "entry_ord", "form": "entry_form"})
    sizes = right.groupBy("surname", "year").agg(F.count(F.lit(1)).alias("candidates"), F.min("entry_ord").alias("only"))
    known = left.join(sizes, ["surname", "year"], "left")
    single = known.where(F.coalesce("candidates", F.lit(0)) <= 1).select("ord", F.col("only").alias("entry_ord"), F.coalesce("candidates", F.lit(0)).alias("candidates"))
    several = known.where("candidates > 1").select("ord", "surname", "year", "form", "candidates")
    # the shared start is the whole of the shorter title, or 40 characters: three equality joins, so no block is paired with itself
    crowded = right.join(sizes.where("candidates > 1").select("surname", "year"), ["surname", "year"], "left_semi").where("entry_form <> ''")
    block, first = ["surname", "year", "start"], F.min("entry_ord").alias("entry_ord")
    starts = lambda form, most: F.explode(F.transform(F.sequence(F.lit(1), most), lambda n: F.substring(form, F.lit(1), n))).alias("start")
    long = several.where(F.length("form") >= 40).withColumn("start", F.left("form", F.lit(40))).join(crowded.where(F.length("entry_form") >= 40).groupBy("surname", "year", F.left("entry_form", F.lit(40)).alias("start")).agg(first), block)
    shorter = several.where("form <> ''").select("ord", "surname", "year", starts("form", F.least(F.length("form"), F.lit(39)))).join(crowded.where(F.length("entry_form") < 40).groupBy("surname", "year", F.col("entry_form").alias("start")).agg(first), block)
    longer = several.where((F.length("form") < 40) & (F.col("form") != "")).withColumn("start", F.col("form")).join(crowded.where(F.length("entry_form") > 1).select("surname", "year", "entry_ord", starts("entry_form", F.least(F.length("entry_form") - 1, F.lit(39)))).groupBy(*block).agg(first), block)
    pick = lambda rows: rows.select("ord", "entry_ord", F.length("start").alias("score"))
    best = pick(long).unionByName(pick(shorter)).unionByName(pick(longer)).groupBy("ord").agg(F.min_by("entry_ord", F.struct((-F.col("score")).alias("s"), "entry_ord")).alias("entry_ord"))
    return single.unionByName(several.join(best, "ord", "left").select("ord", "entry_ord", "candidates"))


def selected_entries(entries: DataFrame, selected: DataFrame, scope: list[str]) -> DataFrame:
    """Entries that a selected record names: equal title; or year and 60 equal characters; or author, year and 20.

    Three semi joins on equal keys, never one join on an OR. Both sides: ord, author, year, title, and the columns of scope.
    """
    form = lambda rows: rows.withColumns({"form": F.coalesce(X.normalize("title"), F.lit("")), "surname": X.lead_author("author"), "y": F.coalesce(F.col("year").cast("string"), F.lit(""))})
    left, right = cut_lineage(form(entries).select("ord", *scope, "form", "surname", "y")), cut_lineage(form(selected).select(*scope, "form", "surname", "y"))
    cut = lambda rows, n: rows.where(F.length("form") >= (30 if n == 60 else 20)).withColumn("start", F.left("form", F.lit(n)))
    by_title = left.where("form <> ''").join(right.select(*scope, "form").distinct(), [*scope, "form"], "left_semi").select("ord")
    by_start = cut(left, 60).join(cut(right, 60).select(*scope, "y", "start").distinct(), [*scope, "y", "start"], "left_semi").select("ord")
    by_author = cut(left, 20).where("surname <> ''").join(cut(right, 20).select(*scope, "surname", "y", "start").distinct(), [*scope, "surname", "y", "start"], "left_semi").select("ord")
    return by_title.unionByName(by_start).unionByName(by_author).distinct()


def unmatched(selected: DataFrame, kept: DataFrame) -> DataFrame:
    """Selected records of which no kept entry has the title or its first 60 characters."""
    form = lambda rows: rows.withColumn("form", F.coalesce(X.normalize("title"), F.lit(""))).withColumn("start", F.left("form", F.lit(60)))
    left, right = cut_lineage(form(selected)), cut_lineage(form(kept).select("form", "start").distinct())
    rest = left.join(right.select("form").distinct(), "form", "left_anti")
    return rest.join(right.select("start").distinct(), "start", "left_anti").drop("form", "start")


def lookup_cascade(probe: DataFrame, key: str, tables: list[tuple[DataFrame, str, str]], value: str) -> DataFrame:
    """The value of the first table that knows the key; each table is (rows, key column, value column), the last row of a key by that value order."""
    out, names = probe, []
    for i, (rows, table_key, table_value) in enumerate(tables):
        name = f"_v{i}"
        names.append(name)
        single = rows.where(F.col(table_key).isNotNull()).groupBy(F.col(table_key).alias(key)).agg(F.max(table_value).alias(name))
        out = out.join(single, key, "left")
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def reference_check(cited: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """(key, problem): cited but not listed is an error, listed but not cited a warning."""
    a, b = cited.select(key).where(F.col(key).isNotNull()).distinct(), listed.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("missing").alias("problem"), F.lit("error").alias("severity")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("unused").alias("problem"), F.lit("warning").alias("severity")))


def match_sections(queries: DataFrame, nodes: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, query_id, node_id, strategy): 1 equal titles, 2 equal forms, 3 one form within the other (from 3 characters), first node in order.

    queries (by, query_id, query) are looked up among the headings (by,
    node_id, title) of their own manuscript, so every join is on its key; the
    third looks only at queries the others left.
    """
    q = queries.select(by, "query_id", F.lower(X.strip("query")).alias("q"), X.section_form("query").alias("qf"))
    n = nodes.select(by, "node_id", F.lower(X.strip("title")).alias("t"), X.section_form("title").alias("tf"))
    first = q.join(n.groupBy(by, F.col("t").alias("q")).agg(F.min("node_id").alias("node_id")), [by, "q"]).select(by, "query_id", "node_id", F.lit(1).alias("strategy"))
    left = q.join(first, [by, "query_id"], "left_anti")
    second = left.join(n.groupBy(by, F.col("tf").alias("qf")).agg(F.min("node_id").alias("node_id")), [by, "qf"]).select(by, "query_id", "node_id", F.lit(2).alias("strategy"))
    left = left.join(second, [by, "query_id"], "left_anti").where(F.length("qf") >= 3)
    within = F.col("tf").contains(F.col("qf")) | F.col("qf").contains(F.col("tf"))
    third = left.join(n, by).where(within).groupBy(by, "query_id").agg(F.min("node_id").alias("node_id")).withColumn("strategy", F.lit(3))
    return first.unionByName(second).unionByName(third)


def duplicate_groups(rows: DataFrame, key: Column, ident: str) -> DataFrame:
    """Keys held by several rows, with their number and smallest id."""
    return rows.where(key.isNotNull()).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(ident).alias("first_id")).where("n > 1")


def variants(rows: DataFrame, name: str) -> DataFrame:
    """Names that differ only in case, blanks and punctuation: form and how many spellings."""
    form = X.normalize(name)
    return rows.where(F.col(name).isNotNull()).groupBy(form.alias("form")).agg(F.countDistinct(name).alias("spellings"), F.count(F.lit(1)).alias("n")).where("spellings > 1 and form <> ''")


def multiset_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(token, change, n): tokens lost and gained, duplicates counting."""
    lost = before.exceptAll(after).groupBy(*before.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("change", F.lit("lost"))
    gained = after.exceptAll(before).groupBy(*after.columns).agg(F.count(F.lit(1)).alias("n")).withColumn("change", F.lit("gained"))
    return lost.unionByName(gained)


def leading(rows: DataFrame, by: str, order: list[Column], n: int, into: str = "place") -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(into) <= n)
