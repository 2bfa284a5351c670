"""Documents behind items: an item's own page, the listed pages it links to, and other reports of its group, numbered.

Of every item at most MOST documents are kept, as many as are shown with it: its page, then LINKED linked pages, then pages
of other items of its group. An address counts once for an item, whether or not it could be read. Groups may be of any
size: of each only the first few readable pages can ever be needed, so no item is joined with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.url import address_parts
from quern.operators.evidence import FACTS_ONLY, READABLE
from quern.operators.publication import of_listed_domain

MOST, LINKED, LONGEST = 5, 2, 40_000


def lead_rights(rights: Column) -> Column:
    """What may be used of an item's own page: facts only, unless the rights allow more."""
    return F.when(rights.isin(FACTS_ONLY, "LINK_ONLY"), FACTS_ONLY).otherwise(rights)


def kept_text(text: Column, rights: Column, longest: int = LONGEST) -> list[Column]:
    """text and truncated: no text where only a link is allowed, else its first longest characters and whether more are left."""
    own = F.when(rights == "LINK_ONLY", "").otherwise(text)
    return [F.left(own, F.lit(longest)).alias("text"), (F.length(own) > longest).alias("truncated")]


def readable_pages(pages: DataFrame) -> DataFrame:
    """page, text, title, links, reserved of every address that was read: its latest fetch (page_id) counts, if that succeeded."""
    row = F.struct("status", "text", "title", "links", F.coalesce("tdm_reserved", F.lit(False)).alias("reserved"))
    latest = pages.where(F.col("page").isNotNull()).groupBy("page").agg(F.max_by(row, "page_id").alias("x")).select("page", "x.*")
    return latest.where((F.col("status") == 200) & (F.length("text") > 0)).drop("status")


def linked_pages(leads: DataFrame, readable: DataFrame, listed: DataFrame, page_of) -> DataFrame:
    """ord, page, place: the first LINKED readable pages of listed domains on other hosts that an item's page links to."""
    each = leads.select("ord", F.col("page").alias("own"), F.posexplode("links").alias("pos", "link"))
    each = each.select("ord", "own", "pos", F.col("link.href").alias("href")).where(F.length("href") > 0)
    each = of_listed_domain(each, "href", listed, "listed").withColumn("page", page_of(F.col("href")))
    host = lambda c: address_parts(F.col(c))["host"]
    each = each.where((host("href") != host("own")) & (F.col("page") != F.col("own"))).groupBy("ord", "page").agg(F.min("pos").alias("pos"))
    found = each.join(readable.select("page"), "page")
    rank = F.row_number().over(Window.partitionBy("ord").orderBy("pos"))  # as many rows as a page has links
    return found.withColumn("place", rank).where(F.col("place") <= LINKED).select("ord", "page", "place")


def gather(items: DataFrame, pages: DataFrame, listed: DataFrame, page_of) -> DataFrame:
    """ord, n, page, role, rights, tier, chars, truncated: the documents of every item, numbered in order.

    items: ord, page, tier, rights, cluster. pages: page, page_id, status, text, title, links, tdm_reserved. page_of makes a
    page's key of an address.
    """
    readable = readable_pages(pages)
    own = items.join(readable, "page").select("ord", "page", "tier", lead_rights(F.col("rights")).alias("rights"), "links")
    role = F.when(F.col("rights").isin(*READABLE) & (F.col("tier") <= 2), "primary").otherwise("lead")
    lead = own.select("ord", "page", F.lit(0).alias("stage"), F.lit(0).cast("bigint").alias("place"), role.alias("role"), "rights", "tier")
    linked = linked_pages(own, readable, listed, page_of)
    linked = linked.select("ord", "page", F.lit(1).alias("stage"), F.col("place").cast("bigint").alias("place"), F.lit("primary").alias("role"), F.lit("PRIMARY_PUBLIC").alias("rights"), F.lit(1).alias("tier"))
    # An item's own page, its linked pages and its own row may stand among the first of its group; so many more are looked at.
    first = items.where(F.col("cluster").isNotNull()).groupBy("cluster", "page").agg(F.min_by(F.struct("ord", "tier", "rights"), "ord").alias("x"), F.min("ord").alias("at"))
    first = first.join(readable.select("page"), "page")
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("at"))
    first = first.withColumn("k", rank).where(F.col("k") <= MOST + LINKED + 1)
    peers = first.groupBy("cluster").agg(F.collect_list(F.struct("at", "page", F.col("x.tier").alias("tier"), lead_rights(F.col("x.rights")).alias("rights"))).alias("peers"))
    each = items.select("ord", "cluster", F.col("page").alias("mine")).join(peers, "cluster").select("ord", "mine", F.inline("peers")).where(~F.col("page").eqNullSafe(F.col("mine")))
    peer = each.select("ord", "page", F.lit(2).alias("stage"), F.col("at").alias("place"), F.lit("corroborating").alias("role"), "rights", "tier")
    rows = lead.unionByName(linked).unionByName(peer).groupBy("ord", "page").agg(F.min(F.struct("stage", "place", "role", "rights", "tier")).alias("x")).select("ord", "page", "x.*")
    number = F.row_number().over(Window.partitionBy("ord").orderBy("stage", "place"))  # at most MOST + LINKED + 4 rows
    rows = rows.withColumn("n", number).where(F.col("n") <= MOST).join(readable.select("page", "text", "reserved"), "page")
    rows = rows.withColumn("rights", F.when(F.col("reserved") & ~F.col("rights").eqNullSafe("LICENSED"), "LINK_ONLY").otherwise(F.col("rights")))
    rows = rows.select("ord", "n", "page", "role", "rights", "tier", *kept_text(F.col("text"), F.col("rights")))
    return rows


def prompt(documents: DataFrame, with_facts: bool) -> DataFrame:
    """ord, prompt: an item's documents, at most MOST, in order as one text; stubs stand for texts that may not be shown."""
    link = F.col("rights") == "LINK_ONLY"
    facts = F.lit(not with_facts) & (F.col("rights") == FACTS_ONLY)
    body = F.when(link, "[link only]").when(facts, "[facts only]").otherwise(F.col("text"))
    part = F.concat(F.lit('<document n="'), F.col("n").cast("string"), F.lit('" rights="'), F.coalesce("rights", F.lit("")), F.lit('">\n'), body, F.lit("\n</document>"))
    ordered = F.array_sort(F.collect_list(F.struct("n", part.alias("p"))))
    return documents.groupBy("ord").agg(F.array_join(F.transform(ordered, lambda x: x["p"]), "\n\n").alias("prompt"))
