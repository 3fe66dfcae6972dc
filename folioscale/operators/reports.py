"""Smaller joins, counts, gates and orders that reports and plans are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscale.functions import text as X
from folioscale.runtime import cut_lineage

#: How many records of each tier the pool should have.
TIER_TARGETS = {"core": 50, "important": 80, "backup": 40}
#: Chinese search words and the English ones they stand for.
KEYWORDS = {
    "博弈": ("game theory", "mechanism design", "contract", "incentive"), "优化": ("optimization", "scheduling", "resource allocation"), "网络": ("network", "graph", "centrality", "community"), "供应链": ("supply chain", "procurement", "logistics"),
    "可持续": ("ESG", "sustainability", "corporate social responsibility"), "平台": ("platform", "two-sided market", "matching"), "韧性": ("resilience", "disruption", "robustness"), "合同": ("contract", "principal-agent", "incentive"),
}


def expand_keywords(queries: DataFrame, keyword: str) -> DataFrame:
    """One row a keyword and search term; unknown keywords stand for themselves."""
    table = F.create_map(*[x for word, terms in KEYWORDS.items() for x in (F.lit(word), F.array(*[F.lit(t) for t in terms]))])
    return queries.withColumn("term", F.explode(F.coalesce(table[F.col(keyword)], F.array(F.col(keyword)))))


def bib_fields(author: Column, year: Column, title: Column, journal: Column, book: Column) -> dict[str, Column]:
    """Surname of the first author, first year (0 if none), title without braces, journal or book."""
    first = F.substring_index(F.coalesce(author, F.lit("")), " and ", 1)
    return {
        "surname": X.strip(F.get(F.split(F.regexp_replace(first, r"[{}]", ""), ","), F.lit(0))),
        "year": F.coalesce(F.nullif(F.regexp_extract(F.coalesce(year, F.lit("")), r"(\d{4})", 1), F.lit("")).cast("int"), F.lit(0)),
        "title": F.regexp_replace(F.coalesce(title, F.lit("")), r"[{}]", ""),
        "journal": F.coalesce(F.nullif(X.strip(journal), F.lit("")), F.nullif(X.strip(book), F.lit("")), F.lit("")),
    }


def all_capitals(journal: Column) -> Column:
    """Whether a journal is written in capitals only."""
    return F.coalesce(journal.rlike(r"^[A-Z0-9 :&-]*[A-Z]{2,}[A-Z0-9 :&-]*$"), F.lit(False))


def title_gates(title: Column, digest: Column) -> Column:
    """Where a title or digest is too long: over 10 for the API, over 22 behind it, digests over 15."""
    return F.array_compact(F.array(F.when(F.length(title) > 10, F.lit("api title")), F.when(F.length(title) > 22, F.lit("title")), F.when(F.length(digest) > 15, F.lit("digest"))))


def entry_validity(fields: list[Column]) -> Column:
    """drop with three or more fields missing, warn with one or two, else ok."""
    missing = sum((F.when(field.isNull() | (X.strip(field.cast("string")) == ""), 1).otherwise(0) for field in fields), F.lit(0))
    return F.when(missing >= 3, "drop").when(missing >= 1, "warn").otherwise("ok")


def fresh(written: Column, now: Column, days: int) -> Column:
    """Whether a stored result is at most so many days old."""
    return F.coalesce(F.datediff(now, written) <= days, F.lit(False))


def fresh_cache(written: Column, now: Column, words_then: Column, words_now: Column) -> Column:
    """At most a day old, and the words changed by a fifth at most."""
    return F.coalesce((F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(written.cast("timestamp")) <= 86_400) & (F.abs(words_now / words_then - 1) <= 0.2), F.lit(False))


def size_gate(length: Column, pages: Column) -> Column:
    """stop under 100 characters, reject over 100 pages, warn over 60, else ok."""
    return F.when(F.coalesce(length, F.lit(0)) < 100, "stop").when(pages > 100, "reject").when(pages > 60, "warn").otherwise("ok")


def project_stage(files: DataFrame, project: str, path: str, text: str) -> DataFrame:
    """(project, stage): C with a written manuscript, else B with chapters, else A with notes of over 500 characters, else none."""
    size = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?m)^\s*%.*$", ""))
    has = lambda test: F.max((test & (size > 500)).cast("int")) == 1
    notes, chapter, paper = F.col(path).rlike(r"structure/[345]_[^/]*/[^/]*_dev\.md$"), F.col(path).rlike(r"structure/[345]_[^/]*/[^/]*(?<!_dev)\.md$"), F.col(path).rlike(r"(?:^|/)manuscript\.tex$")
    return files.groupBy(project).agg(F.when(has(paper), "C").when(has(chapter), "B").when(has(notes), "A").otherwise("none").alias("stage"))


def cited_entries(cites: DataFrame, entries: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Citations with their dated entries, and keys that have none."""
    dated = entries.where(F.coalesce(F.col("year"), F.lit(0)) > 0)
    return cites.join(dated, key), cites.select(key).distinct().join(entries.select(key), key, "left_anti")


def own_quotas(agents: DataFrame, quotas: DataFrame, by_source: DataFrame) -> DataFrame:
    """The quota of an agent's direction and source, else of its direction."""
    joined = agents.join(by_source.select("direction", "source_type", F.col("quota").alias("_own")), ["direction", "source_type"], "left").join(quotas.select("direction", F.col("quota").alias("_plan")), "direction", "left")
    return joined.withColumn("quota", F.coalesce("_own", "_plan")).drop("_own", "_plan")


def tier_totals(rows: DataFrame, key: Column) -> DataFrame:
    """(rank, n): records by the best tier of each key."""
    return rows.groupBy(key.alias("key")).agg(F.min("rank").alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


def tier_adequacy(totals: DataFrame) -> DataFrame:
    """Totals with whether they reach the target of their tier."""
    target = F.lit(None)
    for level, wanted in enumerate(TIER_TARGETS.values()):
        target = F.when(F.col("rank") == level, wanted).otherwise(target)
    return totals.withColumn("target", target).withColumn("status", F.when(F.col("n") >= F.col("target"), "✅").otherwise("⚠️"))


def lowest_rate(adequacy: DataFrame, order: str = "tag_group") -> DataFrame:
    """One row: the group of the lowest rate, the first in order on ties."""
    return adequacy.agg(F.min_by(F.struct("tag_group", "rate"), F.struct("rate", order)).alias("r")).where("r is not null").select("r.*")


def coverage(directions: DataFrame, targets: DataFrame) -> DataFrame:
    """(tag_group, directions): which directions serve each wanted group, in order; none gives an empty list."""
    served = directions.select("id", F.explode("tags").alias("tag")).where("tag is not null").select(X.quota_group("tag").alias("tag_group"), "id").distinct()
    lists = served.groupBy("tag_group").agg(F.array_sort(F.collect_list("id")).alias("directions"))
    return targets.select("tag_group").join(lists, "tag_group", "left").withColumn("directions", F.coalesce("directions", F.array().cast("array<int>")))


def back_citation_rate(cited: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    """One row: keys of the review, how many are cited, and the rate."""
    pool = reviewed.select(key).where(F.col(key).isNotNull()).distinct()
    marked = pool.join(cited.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return marked.agg(F.count(F.lit(1)).alias("keys"), F.count("_hit").alias("cited")).withColumn("rate", F.when(F.col("keys") > 0, F.col("cited") / F.col("keys")))


def section_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(section, added, deleted, net): words of each section gained and lost, duplicates counting. Both: section, text."""
    count = lambda rows, name: rows.select("section", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), 1)).alias("word")).groupBy("section", "word").agg(F.count(F.lit(1)).alias(name))
    both = count(before, "b").join(count(after, "a"), ["section", "word"], "full").withColumn("d", F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0)))
    return both.groupBy("section").agg(F.sum(F.greatest("d", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("deleted"), F.sum("d").alias("net"))


def zones(rows: DataFrame, zone: str = "zone") -> DataFrame:
    """One row: records of zones 1 to 4, and unmatched; zone 9 is counted nowhere."""
    return rows.agg(*[F.count_if(F.col(zone) == k).alias(f"zone_{k}") for k in range(1, 5)], F.count_if(F.col(zone).isNull()).alias("unmatched"))


def raw_total(summary: DataFrame, found: str, records: DataFrame) -> DataFrame:
    """One row: the sum of a summary's column, or the number of records if that is 0."""
    both = summary.select(F.col(found).cast("long").alias("s"), F.lit(0).alias("n")).unionByName(records.select(F.lit(0).cast("long").alias("s"), F.lit(1).alias("n")))
    return both.agg(F.coalesce(F.nullif(F.sum("s"), F.lit(0)), F.sum("n"), F.lit(0)).alias("total"))


def work_order(clusters: DataFrame, edges: DataFrame) -> DataFrame:
    """(cluster, stage): clusters after all they depend on; global ones come first of a stage. A cycle is an error.

    clusters: cluster, is_global. edges: cluster, needs. One join a stage, so
    as many as the longest chain.
    """
    left = clusters.select("cluster", "is_global")
    known = edges.join(left.select("cluster"), "cluster").join(left.select(F.col("cluster").alias("needs")), "needs").select("cluster", "needs").distinct()
    done, stage = None, 0
    while left.take(1):
        free = left.join(known.select("cluster").distinct(), "cluster", "left_anti")
        if not free.take(1):
            raise ValueError("the dependencies go round")
        stage += 1
        part = cut_lineage(free.select("cluster", "is_global", F.lit(stage).alias("stage")))
        done = part if done is None else done.unionByName(part)
        left = cut_lineage(left.join(part.select("cluster"), "cluster", "left_anti"))
        known = cut_lineage(known.join(part.select(F.col("cluster").alias("needs")), "needs", "left_anti").select("cluster", "needs"))
    done = done if done is not None else clusters.select("cluster", "is_global", F.lit(0).alias("stage"))
    return done.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("stage", F.col("is_global").desc(), "cluster")))


def severity_queue(issues: DataFrame, severity: str, order: str, by: str | None = None) -> DataFrame:
    """Issues with their place: red, yellow, green, structural, in order within; of each manuscript (by), else of one."""
    rank = F.lit(4)
    for level, name in reversed(list(enumerate(("red", "yellow", "green", "structural")))):
        rank = F.when(F.col(severity) == name, level).otherwise(rank)
    return issues.withColumn("rank", rank).withColumn("place", F.row_number().over(Window.partitionBy(by or F.lit(0)).orderBy("rank", order))).drop("rank")


def dispatch_metadata(agents: DataFrame) -> DataFrame:
    """Agents with batch number (its own, else the numerator of the split) and the direction's name from the first source file."""
    split = F.nullif(F.regexp_extract(F.coalesce("split_info", F.lit("")), r"(\d+)/\d+", 1), F.lit("")).cast("int")
    name = F.regexp_replace(F.regexp_replace(F.coalesce("source_file", F.lit("")), r"^.*[/\\]", ""), r"(?i)^\d+[_-]|_cnki|(?:_zone\d+)?(?:_llm)?\.\w+$", "")
    return agents.withColumns({"batch": F.coalesce("batch_seq", split, F.lit(1)), "direction_name": F.nullif(name, F.lit(""))})


def tag_group_items(pools: DataFrame) -> DataFrame:
    """(tag, item_count, source_directions) of pool plans with a map tag_groups."""
    return pools.select(F.explode("tag_groups").alias("tag", "g")).select("tag", F.col("g.count").alias("item_count"), F.col("g.source_directions").alias("source_directions"))


def note_lint(sections: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, section, problem): parts of notes that are empty, do not end in ---, exceed 1000 characters, or parts of over eight sections.

    sections: by, part, section, text.
    """
    body = X.strip(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?s)\s*---\s*$", ""))
    flags = F.array_compact(F.array(F.when(body == "", F.lit("empty")), F.when(~F.coalesce("text", F.lit("")).rlike(r"(?s)---\s*$"), F.lit("no rule at the end")), F.when(F.length(body) > 1000, F.lit("too long"))))
    own = sections.select(by, "section", F.explode(flags).alias("problem"))
    crowded = sections.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n")).where("n > 8").select(by, F.col("part").alias("section"), F.lit("too many sections").alias("problem"))
    return own.unionByName(crowded)


def balanced_points(points: DataFrame, by: str, text: str) -> DataFrame:
    """(by, balanced): whether the longest of several points has at least 1.5 times the characters of the shortest."""
    sizes = points.groupBy(by).agg(F.max(F.length(text)).alias("longest"), F.min(F.length(text)).alias("shortest"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return sizes.select(by, (F.col("longest") >= 1.5 * F.col("shortest")).alias("balanced"))


def screening_totals(merged: DataFrame, unique: DataFrame) -> DataFrame:
    """One row: rows, duplicates and unique keys, and whether rows less duplicates are the unique keys."""
    keys = merged.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(1).alias("keys"), F.lit(0).alias("listed"))
    rows = keys.unionByName(unique.select(F.lit(0).cast("long").alias("n"), F.lit(0).alias("keys"), F.lit(1).alias("listed")))
    sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("keys"), F.lit(0)).alias("unique_keys"), F.coalesce(F.sum("listed"), F.lit(0)).alias("listed"))
    return sums.select("total", (F.col("total") - F.col("unique_keys")).alias("duplicates"), "unique_keys", "listed", (F.col("unique_keys") == F.col("listed")).alias("holds"))


def bib_checks(entries: DataFrame) -> DataFrame:
    """(key, code): required fields, year form, braces, keys held twice. entries: key, fields (map), raw."""
    from folioscale.operators import checks
    from folioscale.sources.records import value

    blank = lambda tag: F.coalesce(X.strip(value(tag)), F.lit("")) == ""
    flags = F.array_compact(F.array(
        *[F.when(blank(tag), F.lit(f"MISSING_{tag.upper()}")) for tag in ("author", "title", "year")], F.when(~blank("year") & ~F.coalesce(value("year"), F.lit("")).rlike(r"^\d{4}$"), F.lit("BAD_YEAR")),
        F.when(blank("doi"), F.lit("NO_DOI")), F.when(~checks.braces(F.col("raw")), F.lit("BRACES")),
    ))
    twice = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.lit("DUPLICATE_KEY").alias("code"))
    return entries.select("key", F.explode(flags).alias("code")).unionByName(twice)


def letter_checks(comments: DataFrame, letters: DataFrame, ident: str) -> DataFrame:
    """(ident, code): letters without reviewers or comments, comment ids of a wrong form or held twice."""
    from folioscale.operators.checks import violations

    none = letters.select(ident).join(comments.select(ident).distinct(), ident, "left_anti")
    twice = comments.groupBy(ident, "comment_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return violations(("NO_COMMENTS", none, F.col(ident)), ("BAD_ID_FORMAT", comments.where(~F.col("comment_id").rlike(r"^R\d+-m?\d+$")), F.col(ident)), ("DUPLICATE_IDS", twice, F.col(ident)))


def tag_checks(rows: DataFrame, ident: str, tags: str, groups: DataFrame) -> DataFrame:
    """(code, key): records without tags, and groups whose count is not the sum of their tags."""
    from folioscale.operators.checks import violations

    bare = rows.where(F.coalesce(F.size(F.filter(tags, lambda t: t.isNotNull())), F.lit(0)) <= 0)
    sums = rows.select(F.explode(tags).alias("tag")).where("tag is not null").groupBy(X.stats_group("tag").alias("tag_group")).agg(F.count(F.lit(1)).alias("n"))
    wrong = groups.join(sums, "tag_group", "full").where("not actual <=> n")
    return violations(("NO_TAGS", bare, F.col(ident)), ("COUNT_INCONSISTENCY", wrong, F.col("tag_group")))


def journal_leaders(ideas: DataFrame, journal: str, score: str) -> DataFrame:
    """Ideas with their rank in each journal, equal scores sharing it."""
    return ideas.withColumn("rank", F.rank().over(Window.partitionBy(journal).orderBy(F.col(score).desc())))


def overflow(rows: DataFrame, by: str, quota: Column, cited: Column, year: Column, zone: Column, method: Column, now: int, ident: str) -> DataFrame:
    """Rows of each group within its quota: much cited first, then those of the last five years, of top journals, of like methods."""
    order = [cited.desc_nulls_last(), F.coalesce(year > now - 5, F.lit(False)).desc(), zone.asc_nulls_last(), F.coalesce(method, F.lit(False)).desc(), F.col(ident)]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= quota)


def harvest_totals(log: DataFrame, journal: str, volume: str, papers: Column, figures: Column) -> DataFrame:
    """(journal, volume, papers, figures) of a harvest log, with sums by journal and of all (volume, then journal null)."""
    return log.rollup(journal, volume).agg(F.sum(papers).alias("papers"), F.sum(figures).alias("figures"))


#: Phases of a run and the artifacts that must be there to start from them.
PHASES = [(2.0, "directions.json"), (2.0, "selected.json"), (3.0, "workflow.json"), (4.0, "drafts/blog-draft.md"), (4.5, "sensitive-words.txt"), (5.0, "drafts/self-audit.log"), (6.0, "images/image-manifest.json")]


def resume_phase(runs: DataFrame, artifacts: DataFrame, run: str, wanted: str, name: str) -> DataFrame:
    """(run, wanted, phase, missing): the phase a run may start from: the wanted one, or the first whose artifact is missing before it.

    runs: run, wanted; artifacts: run, name.
    """
    need = F.array(*[F.struct(F.lit(phase).alias("phase"), F.lit(artifact).alias("name")) for phase, artifact in PHASES])
    have = artifacts.groupBy(run).agg(F.collect_set(name).alias("have"))
    joined = runs.join(have, run, "left")
    lacking = F.filter(need, lambda n: (n["phase"] <= F.col(wanted)) & ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), n["name"]))
    out = joined.withColumn("_lacking", lacking)
    # the phase before the first that lacks something makes it anew
    before = F.array_max(F.filter(F.array(F.lit(0.0), *[F.lit(p) for p in sorted({p for p, _ in PHASES})]), lambda p: p < F.array_min(F.col("_lacking"))["phase"]))
    return out.select(run, wanted, F.when(F.size("_lacking") == 0, F.col(wanted)).otherwise(before).alias("phase"), F.transform("_lacking", lambda n: n["name"]).alias("missing"))
