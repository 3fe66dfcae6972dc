"""The queries of the training-data operators, over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscale.functions.tiers import tier_rank
from folioscale.llm import leaks, lookalikes, mixing, names, packing, page_spam, residue, survivors, text_dedup
from folioscale.llm.top_n import top_n
from folioscale.runtime import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.batches(read_table(spark, sf_dir, "dispatch_items"))


def p1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of every item, or of each piece of an item over the limit."""
    packed = packing.pack(read_table(spark, sf_dir, "dispatch_items"), "item_id", "plan_id", "item_count", "batch_limit")
    return packed.select(F.col("plan").alias("plan_id"), F.col("limit").alias("batch_limit"), F.col("bin").alias("batch_no"), "capacity", F.col("item").alias("item_id"), "piece_no", F.col("size").alias("item_count"))


def p1_plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plan and limit: records packed, pieces, and records of items that were split."""
    items = read_table(spark, sf_dir, "dispatch_items")
    packed = packing.pack(items, "item_id", "plan_id", "item_count", "batch_limit")
    return packed.groupBy(F.col("plan").alias("plan_id"), F.col("limit").alias("batch_limit")).agg(
        F.sum("size").cast("long").alias("records"), F.count(F.lit(1)).alias("pieces"), F.sum(F.when(F.col("piece_no") > 1, 1).otherwise(0)).cast("long").alias("further_pieces")
    )


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each item is cut: whole, or into full pieces and a rest."""
    return p1_items(spark, sf_dir).select("plan_id", "item_id", "piece_no", "item_count")


def p1_batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plan and limit: records and items in the batches, batches over their capacity or the limit, and gaps in the numbers."""
    rows = p1_batches(spark, sf_dir)
    over = (F.col("filled") > F.col("capacity")) | (F.col("capacity") > F.col("batch_limit")) | (F.col("filled") <= 0)
    sums = rows.groupBy("plan_id", "batch_limit").agg(F.sum("filled").alias("records"), F.count_if(over).alias("overfull"), (F.max("batch_no") + 1 - F.countDistinct("batch_no")).alias("gaps"))
    items = rows.select("plan_id", "batch_limit", F.explode("items.item_id").alias("item")).groupBy("plan_id", "batch_limit").agg(F.countDistinct("item").alias("items"))
    return sums.join(items, ["plan_id", "batch_limit"])


def p1_unpacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.unpacked(read_table(spark, sf_dir, "dispatch_items"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names.clusters(read_table(spark, sf_dir, "source_papers"), "source_id", "author_full")
    return names.same_pairs(found).select(F.col("id_a").alias("source_id_a"), F.col("id_b").alias("source_id_b"))


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.clusters(read_table(spark, sf_dir, "source_papers"), "source_id", "author_full").select(F.col("id").alias("source_id"), "cluster")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dedup.copies(read_table(spark, sf_dir, "papers"), "paper_id", ["year"], ["first_author", "title"])


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_dedup.collapse(read_table(spark, sf_dir, "papers"), "paper_id", ["year"], ["first_author", "title"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    elected = survivors.merged_directions(read_table(spark, sf_dir, "merged_papers")).where(F.col("n_rows") > 1)
    return elected.select("dedup_key", "rec_id", F.explode("directions").alias("direction"))


def p4_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.merged_papers(read_table(spark, sf_dir, "merged_papers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue(read_table(spark, sf_dir, "pool_entries"), "entry_id", "citation_key", ["引用场景"], "期刊").select(F.col("id").alias("entry_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = lookalikes.alike_pairs(read_table(spark, sf_dir, "papers"), "paper_id", ["title", "first_author"])
    return pairs.select(F.col("id_a").alias("paper_id_a"), F.col("id_b").alias("paper_id_b"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of p6_found with the class they are in, instead of its pairs."""
    rows = lookalikes.alike_classes(read_table(spark, sf_dir, "papers"), "paper_id", ["title", "first_author"])
    return rows.select(F.col("id").alias("paper_id"), F.col("class").alias("class_id"), "members", "spellings")


def p6_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookalikes.consistent(read_table(spark, sf_dir, "papers"), "paper_id", ["title", "first_author"])
    return rows.select(F.col("id").alias("paper_id"), "title", "first_author")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = read_table(spark, sf_dir, "papers").select(F.col("direction").cast("long").alias("direction"), "paper_id", "relevance", tier_rank("tier").alias("tier"))
    return top_n(papers, "direction", [("tier", False), ("relevance", True), ("paper_id", False)], 10).select("direction", "paper_id", "rank_no")


def p8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_spans(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each document at the largest total at which all shares are reached."""
    return mixing.uses(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares_reached(p9_uses(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_shares_of_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached if the total is that of all listed texts, so that small sources fall short."""
    targets = read_table(spark, sf_dir, "mix_targets")
    return mixing.shares_reached(mixing.uses(read_table(spark, sf_dir, "documents"), targets, "pool"), targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_spam.spam_pages(read_table(spark, sf_dir, "documents")).where(F.col("spam_share") > page_spam.HALF).select("doc_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of spam, mean PMI of neighbours and share of recurrent collocations of every document."""
    return page_spam.spam_pages(read_table(spark, sf_dir, "documents"), full=True)


def p10_pmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean PMI of neighbours and share of repeated collocations of every document with two words or more."""
    rows = page_spam.spam_pages(read_table(spark, sf_dir, "documents"), full=True).where("mean_pmi <> 0 or repeated <> 0")
    return rows.select("doc_id", F.round("mean_pmi", 5).alias("mean_pmi"), F.round("repeated", 5).alias("repeated"))


QUERIES: dict[str, Query] = {
    "p1_batches": p1_batches,
    "p1_items": p1_items,
    "p1_plan_totals": p1_plan_totals,
    "p1_pieces": p1_pieces,
    "p1_batch_checks": p1_batch_checks,
    "p1_unpacked": p1_unpacked,
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p3_found": p3_found,
    "p3_records": p3_records,
    "p4_found": p4_found,
    "p4_survivors": p4_survivors,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_text": p6_text,
    "p7_found": p7_found,
    "p8_found": p8_found,
    "p8_spans": p8_spans,
    "p9_uses": p9_uses,
    "p9_shares": p9_shares,
    "p9_shares_of_pool": p9_shares_of_pool,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_pmi": p10_pmi,
}
