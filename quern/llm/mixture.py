"""Problem 8: a mix of sources by target weights.

Tokens are added up per source. A source's rate says how often each of its records is used: in proportion to its weight
over its tokens, but never above its cap; what capped sources can't give, the others make up in proportion to their
weights (so all uncapped sources keep the ratios of their weights). By default the mix is as large as it can be with
every source at its share, but at least half as large as the listed sources together; only sources too small for that
size stay below their share, used as often as their cap allows. A record comes out floor(rate) times, and once more
with the probability of the remaining fraction, drawn from a hash of the seed and its id: the same record gets the same
number of copies in every run and on every cluster.

Defined results: records of null, unlisted, weightless or capless sources aren't chosen. A target row repeated counts
once (the greatest weight and cap). Records without tokens share the rate of their source; a source without any token is
reported with a reached share of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokenizer import TOKENIZERS, token_count
from quern.session import Scratch, spread

SEED = 20260112
#: The default mix has at least this part of the tokens of the listed sources, though small sources miss their share.
LEAST_PART = 0.5


def mixing_rates(sizes: DataFrame, targets: DataFrame, total: Column | None = None) -> DataFrame:
    """source, weight, cap, tokens, rate for every row of targets.

    sizes: source, tokens (one row per source). total: wanted tokens of the mix; the module says what it is by default. The table is as large as targets, a specification, so its one ordered window is small.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(
        F.coalesce(F.max(F.when(~F.isnan("weight"), F.col("weight"))), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("cap")
    )
    both = wanted.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    live = (F.col("weight") > 0) & (F.col("tokens") > 0) & (F.col("cap") > 0)
    most = F.when(live, F.col("cap") * F.col("tokens")).otherwise(0)
    weight = F.when(live, F.col("weight")).otherwise(0.0)
    everything = Window.partitionBy()
    # A source is full once the level (tokens per unit of weight) reaches most / weight. Going up from the source that
    # fills first, the level that spends the total is the first one that the next source could still follow.
    full_at = F.when(live, F.col("most") / F.col("w")).otherwise(F.lit(float("inf")))
    upto = Window.partitionBy().orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    rows = both.withColumns({"live": live, "most": most.cast("double"), "w": weight}).withColumn("full_at", full_at)
    fair = F.min("full_at").over(everything) * F.sum("w").over(everything)
    usual = F.greatest(fair, LEAST_PART * F.sum(F.when(F.col("live"), F.col("tokens"))).over(everything))
    rows = rows.withColumn("total", (usual if total is None else total).cast("double"))
    rows = rows.withColumns({"spent": F.coalesce(F.sum("most").over(upto), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(upto), F.lit(0.0)), "w_all": F.sum("w").over(everything)})
    left = F.when(F.col("w_all") - F.col("w_before") > 1e-12, (F.col("total") - F.col("spent")) / (F.col("w_all") - F.col("w_before")))
    follows = F.when(F.col("live") & (left <= F.col("full_at")), F.struct("full_at", "source", left.alias("level")))
    rows = rows.withColumn("level", F.coalesce(F.min(follows).over(everything)["level"], F.lit(float("inf"))))
    rate = F.when(F.col("live"), F.least(F.col("cap").cast("double"), F.greatest(F.lit(0.0), F.col("level") * F.col("w") / F.col("tokens")))).otherwise(0.0)
    return rows.select("source", "weight", F.col("cap").cast("int").alias("cap"), F.col("tokens").cast("bigint").alias("tokens"), rate.alias("rate"))


def copies_of(ident: Column, rate: Column, seed: int = SEED) -> Column:
    """floor(rate), plus one with the probability of the fraction, by a hash of ident and seed."""
    draw = F.shiftrightunsigned(F.xxhash64(ident, F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


class Mix:
    """The token counts and rates of one corpus, with the chosen records and the report made of them."""

    def __init__(self, documents: DataFrame, targets: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text",
                 tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, seed: int = SEED, total: int | None = None):
        spark, self.seed, self.ident = documents.sparkSession, seed, ident
        scratch = Scratch(spark, "mixture")
        rows = spread(documents.select(F.col(f"`{ident}`").alias("ident"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")))
        sized = rows.select("ident", "source", token_count(spark, "text", tokenizer, folder).alias("tokens"))
        # Texts are encoded once; the counts serve the sums and the choice.
        self.sized = scratch.write(sized, "sized")
        wanted = targets.select("source", "weight", "max_repeats")
        sums = self.sized.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("tokens").alias("tokens"))
        # As many rows as targets; a written table has a known size, so Spark itself decides whether to broadcast it.
        self.rates = scratch.write(mixing_rates(sums, wanted, None if total is None else F.lit(total)).coalesce(1), "rates")

    def counted(self) -> DataFrame:
        """ident, source, tokens, copies of every record of a listed source with any copy."""
        rows = self.sized.join(self.rates.where(F.col("rate") > 0).select("source", "rate"), "source")
        return rows.withColumn("copies", copies_of(F.col("ident"), F.col("rate"), self.seed)).where(F.col("copies") > 0).drop("rate")

    def records(self) -> DataFrame:
        """One row per copy: ident, source, copy_no (from 1), tokens."""
        copy = F.explode(F.sequence(F.lit(1), F.col("copies")))
        return self.counted().select(F.col("ident").alias(self.ident), "source", copy.alias("copy_no"), "tokens")

    def report(self) -> DataFrame:
        """source, documents, chosen, tokens, mixed_tokens, rate, max_repeats, target_share, reached_share of every target."""
        got = self.counted().groupBy("source").agg(F.count(F.lit(1)).alias("chosen"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
        have = self.sized.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
        all_rows = Window.partitionBy()
        rows = self.rates.join(got, "source", "left").join(have, "source", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
        return rows.select(
            "source", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chosen", F.lit(0)).alias("chosen"), "tokens", F.col("mixed").alias("mixed_tokens"),
            "rate", F.col("cap").alias("max_repeats"), F.try_divide(F.col("weight"), F.sum("weight").over(all_rows)).alias("target_share"),
            F.coalesce(F.try_divide(F.col("mixed").cast("double"), F.sum("mixed").over(all_rows)), F.lit(0.0)).alias("reached_share"),
        )
