"""What documents say about items: joins of claims and sources, verbatim spans, corroboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import norm_space, tokens

#: Rights under which a text may be read, and under which only its facts may be used.
READABLE, FACTS_ONLY = ("LICENSED", "PRIMARY_PUBLIC"), "FACTS_ONLY"


def source_role(rights: Column, tier: Column) -> Column:
    """primary for readable sources of the first two tiers, else lead."""
    return F.when(rights.isin(*READABLE) & (tier <= 2), "primary").otherwise("lead")


def visible_text(text: Column, rights: Column) -> Column:
    """What of a text may be shown: all, a stub in place of it, or nothing."""
    return F.when(rights.isin(*READABLE), text).when(rights == FACTS_ONLY, F.lit("[facts only]"))


def verbatim(span: Column, text: Column) -> Column:
    """Whether the span stands in the text, quotes, dashes, white space and letter case aside."""
    return F.contains(F.lower(norm_space(text)), F.lower(norm_space(span)))


def readable_by_key(documents: DataFrame, key: str, order: str, text: str = "text", rights: str = "rights") -> DataFrame:
    """key, readable: all readable texts of a key in their order, joined by blanks (a span may cross two of them)."""
    some = documents.where(F.col(rights).isin(*READABLE) & F.col(text).isNotNull() & F.col(key).isNotNull())
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return some.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("readable"))


def verify_claims(claims: DataFrame, documents: DataFrame, key: str, claim: str, span: str, order: str) -> DataFrame:
    """claim, order (of the document), why: null where the claim is kept.

    claims meet the documents of their key. A claim of a facts-only document also needs its span in some readable text of
    the key. Claims without a document come out once.
    """
    docs = documents.select(F.col(key), F.col(order), "text", "rights")
    # Only keys with a facts-only document need their readable texts, and each span is looked for in them once.
    asked = claims.select(key, span).distinct().join(documents.where(F.col("rights") == FACTS_ONLY).select(key).distinct(), key, "left_semi")
    found = asked.join(readable_by_key(documents, key, order), key).select(key, F.col(span).alias("__span"), verbatim(F.col(span), F.col("readable")).alias("confirmed"))
    joined = claims.select(key, claim, span).join(docs, key, "left")
    joined = joined.join(found.withColumnRenamed(key, "__key"), (F.col(key) == F.col("__key")) & (F.col(span) == F.col("__span")), "left")
    missing = ~F.coalesce(verbatim(F.col(span), F.col("text")), F.lit(False))
    unconfirmed = (F.col("rights") == FACTS_ONLY) & ~F.coalesce("confirmed", F.lit(False))
    why = F.when(missing, "supporting passage not found verbatim").when(unconfirmed, "only in another outlet's report; no primary confirmation")
    return joined.select(claim, order, why.alias("why"))


def corroboration(items: DataFrame, key: str, owner: Column, tier: Column, rights: Column) -> DataFrame:
    """key, owners, class: confirmed by a readable first-tier source, by two owners, or by one."""
    owners = F.count_distinct(owner)
    primary = F.coalesce(F.bool_or((tier == 1) & rights.isin(*READABLE)), F.lit(False))
    label = F.when(primary, "primary_confirmed").when(owners >= 2, "two_independent").otherwise("single_source")
    return items.where(F.col(key).isNotNull()).groupBy(key).agg(owners.alias("owners"), label.alias("class"))


def copied_runs(drafts: DataFrame, sources: DataFrame, draft: str, draft_text: str, source_text: str, n: int) -> DataFrame:
    """draft, runs, copied: distinct runs of n words of each draft with that many words, and how many stand in any source.

    A run is a hash of 64 bits and one of 32 of its words, so no text is shuffled. Sources are reduced to their distinct
    runs, so a run that all of them hold costs one row in the join. Repeated runs of a draft meet there too, so they are
    dropped behind it, where no other shuffle is needed for that.
    """

    def runs(df: DataFrame, text: str, *keep: str) -> DataFrame:
        words, i = F.col("w"), F.col("i")
        each = df.select(*keep, tokens(F.col(text), "[a-z0-9']+").alias("w")).where(F.size("w") >= n).select(*keep, "w", F.posexplode("w").alias("i", "c"))
        run = [F.get(words, i + k) for k in range(n)]
        each = each.where(i <= F.size(words) - n)
        return each.select(*keep, F.xxhash64(*run).alias("h"), F.hash(F.lit(n), *run[::-1]).alias("g"))

    theirs = runs(sources, source_text).distinct().withColumn("hit", F.lit(1))
    mine = runs(drafts.select(F.col(draft), F.col(draft_text)), draft_text, draft)
    once = mine.join(theirs, ["h", "g"], "left").groupBy("h", "g", draft).agg(F.first("hit").alias("hit"))
    return once.groupBy(draft).agg(F.count(F.lit(1)).alias("runs"), F.count("hit").alias("copied"))


def used_sources(kept: DataFrame, documents: DataFrame, key: str, order: str) -> DataFrame:
    """The documents that a kept claim names."""
    return documents.join(kept.select(key, order).distinct(), [key, order], "left_semi")


def role_of(rights: Column, tier: Column, given: Column) -> Column:
    """The role of a source once all are known: primary for readable ones of the first two tiers, corroborating where it was
    gathered as such, else lead."""
    return F.when(rights.isin(*READABLE) & (tier <= 2), "primary").when(given == "corroborating", "corroborating").otherwise("lead")
