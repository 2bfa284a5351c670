"""The queries of this subpackage: each a function of a session and a folder of tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.boilerplate import article_blocks
from quern.llm.linkage import LinkStore, history_records, link_batches, repeated_rows
from quern.llm.mixture import Mix
from quern.llm.neardup import NearDuplicates
from quern.llm.sentences import split_sentences
from quern.llm.tokenizer import encode_corpus, token_count
from quern.llm.topn import top_n_per_group
from quern.llm.truncation import find_truncated, truncation_report
from quern.session import Scratch

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_n_per_group(_table(spark, folder, "candidates"), "cluster", "priority", "ord", 3)


def _truncated(spark: SparkSession, folder: str) -> DataFrame:
    parts = [(_table(spark, folder, "candidates"), "candidates", "ord", "summary", "source_id"), (_table(spark, folder, "documents"), "documents", "doc_id", "text", "source")]
    return find_truncated(parts)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _truncated(spark, folder).where("cut").select("kind", "row_no")


def p2_sources(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_report(_truncated(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    alike = NearDuplicates(_table(spark, folder, "candidates"), "ord", "title", 0.7)
    return alike.row_pairs().select(F.col("a").alias("ord_a"), F.col("b").alias("ord_b"))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    return NearDuplicates(_table(spark, folder, "candidates"), "ord", "title", 0.7).groups().withColumnsRenamed({"row": "ord", "group": "group_ord"})


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return article_blocks(_table(spark, folder, "pages"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_rows(_table(spark, folder, "seen"), _table(spark, folder, "candidates"))


def p6_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """ord, root: the first record of the cluster that a repeated candidate belongs to (negative: one of history)."""
    store = LinkStore(spark, Scratch(spark, "store").path)
    store.add(history_records(_table(spark, folder, "seen")))
    link_batches(store, _table(spark, folder, "candidates"))
    return store.find().where("node >= 0").withColumnRenamed("node", "ord")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_table(spark, folder, "documents"))


def p7_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, characters and tokens of every language tag."""
    rows = _table(spark, folder, "documents").select("lang", F.length("text").alias("chars"), token_count(spark, "text").alias("tokens"))
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"), F.sum("tokens").alias("tokens"))


def _mix(spark: SparkSession, folder: str) -> Mix:
    return Mix(_table(spark, folder, "documents"), _table(spark, folder, "mix_targets"))


def p8_records(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).records()


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report()


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_sentences(_table(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p2_found, p2_sources, p3_found, p3_groups, p5_found, p6_found, p6_clusters, p7_ids, p7_sizes, p8_records, p8_shares, p9_found)
}

SQL: dict[str, str] = {
    "p1_found": """
        SELECT cluster, ord, rank_no FROM (
            SELECT cluster, ord, CAST(row_number() OVER (PARTITION BY cluster ORDER BY priority DESC, ord) AS INTEGER) AS rank_no
            FROM candidates WHERE cluster IS NOT NULL AND priority IS NOT NULL AND NOT isnan(priority))
        WHERE rank_no <= 3""",
}
