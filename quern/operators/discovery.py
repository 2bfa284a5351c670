"""New items of feeds: first deliveries, items not seen before, and clusters of similar titles."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import topic_words
from quern.functions.url import feed_address
from quern.session import Scratch

#: Words of at most so many titles are joined on.
RARE = 32
#: Sets of more common words have too many subsets to list them.
WIDE = 10


def address_key(url: Column) -> Column:
    """First 16 hexadecimal digits of the sha256 of an item's address."""
    return F.substring(F.sha2(feed_address(url), 256), 1, 16)


def first_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """key and columns of the row with the smallest order of every key that isn't null.

    An aggregation, not a window: rows are reduced before the shuffle, so a key with most of the rows costs nothing more.
    """
    best = F.min_by(F.struct(*columns), order).alias("__row")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, "__row.*")


def unseen(candidates: DataFrame, seen_keys: DataFrame, key: str = "key", order: str = "ord", columns: list[str] | None = None) -> DataFrame:
    """The first row of every key that seen_keys doesn't hold."""
    columns = columns or [c for c in candidates.columns if c != key]
    return first_per_key(candidates, key, order, columns).join(seen_keys.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def fresh_seen(seen: DataFrame, now: Column, days: int = 60, time: str = "first_seen") -> DataFrame:
    """Entries of the list of seen keys that aren't older than days; unreadable times go."""
    return seen.where(F.try_to_timestamp(F.col(time)) >= now - F.make_interval(days=F.lit(days)))


def _subset_keys(t: Fraction):
    """key0, key1, first, side, look of every set of common words that two patterns alike to t may share: one key for each
    subset of the least overlap of its size and a partner's. side: 0 where the pattern is the smaller one, or as large;
    look: the partner's side. A key is two sums of hashes of 64 bits."""
    p, q = t.numerator, t.denominator

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, first = batch["n"].to_numpy(), batch["first"].to_numpy()
            c = pc.list_value_length(batch["h0"]).to_numpy()
            flat = [batch[h].flatten().to_numpy().view(np.uint64) for h in ("h0", "h1")]
            starts = np.concatenate([[0], np.cumsum(c)[:-1]]).astype(np.int64)
            for size, of in sorted(set(zip(n.tolist(), c.tolist()))):
                rows = np.flatnonzero((n == size) & (c == of))
                words = [f[starts[rows][:, None] + np.arange(of)] for f in flat]
                for m in range(-(-p * size // q), size * q // p + 1):
                    least = -(-p * (size + m) // (p + q))
                    if least > of:
                        continue
                    some = np.array([[k in x for x in combinations(range(of), least)] for k in range(of)], np.uint64)
                    sizes = np.uint64((min(size, m) << 32 | max(size, m)) * 0x9E3779B97F4A7C15 % 2**64)
                    for x in range(0, len(rows), 4_096):
                        key = [(w[x : x + 4_096] @ some + sizes).ravel().view(np.int64) for w in words]
                        side = np.full(len(key[0]), size > m)
                        yield pa.record_batch([*map(pa.array, key), pa.array(np.repeat(first[rows[x : x + 4_096]], some.shape[1])), pa.array(side.astype(np.int32)), pa.array((side | (size == m)) ^ True).cast(pa.int32())], ["key0", "key1", "first", "side", "look"])

    return keys


def first_similar(classes: DataFrame, threshold: float, rare: int = RARE, wide: int = WIDE) -> DataFrame:
    """a, near: of each class (cls, words) the first class whose word set is alike to threshold, where that is an earlier one.

    Alike sets of n and m words share o(n, m) words or more. Pairs are never listed but by rare words, which few classes have:
    two sets that share one of those share one among the n - ceil(t n) + 1 rarest of each. All others share common words
    only. For them a class counts as its size and its common words (a pattern, of which only the first class matters), and
    two patterns are alike if they have a subset of o(n, m) words in common; the first pattern of each subset is a minimum,
    so a phrase that most titles hold costs a row per pattern, not per pair. Patterns of more than wide words have too many
    subsets; they meet the others by their words.
    """
    t = Fraction(threshold).limit_denominator(1000)
    p, q = t.numerator, t.denominator
    scratch = Scratch(classes.sparkSession, "titles")
    each = classes.select("cls", F.size("words").alias("n"), F.explode("words").alias("word"))
    counts = each.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(counts, "word").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))  # the words of one title
    words_of = lambda w: F.transform(w, lambda x: x["word"])
    common = words_of(F.filter("w", lambda x: x["df"] > rare))
    ranked = scratch.write(ranked.select("cls", "n", "w", common.alias("common")), "ranked")
    needed = lambda n: F.expr(f"({p} * {n} + {q - 1}) div {q}")
    fits = (F.col("n") * p <= F.col("m") * q) & (F.col("m") * p <= F.col("n") * q)
    alike = lambda x, y: fits & (F.size(F.array_intersect(x, y)) * (p + q) >= (F.col("n") + F.col("m")) * p)

    one = ranked.select("cls", "n", words_of(F.col("w")).alias("words"), F.posexplode("w").alias("place", "x"))
    one = one.where(F.col("x.df").between(2, rare) & (F.col("place") <= F.col("n") - needed("n"))).select(F.col("x.word").alias("word"), F.col("cls").alias("a"), "n", "words")
    other = one.select("word", F.col("a").alias("b"), F.col("n").alias("m"), F.col("words").alias("wb"))
    by_rare = one.join(other, "word").where((F.col("b") < F.col("a")) & alike("words", "wb")).groupBy("a").agg(F.min("b").alias("near"))

    some = ranked.where(F.size("common") >= needed("n"))
    patterns = scratch.write(some.groupBy("n", "common").agg(F.min("cls").alias("first")), "patterns")
    itself = patterns.where(F.size("common") * (p + q) >= F.col("n") * (2 * p)).select("first", F.col("first").alias("near"))
    narrow = patterns.where(F.size("common") <= wide)
    hashed = narrow.select("first", "n", F.transform("common", lambda w: F.xxhash64(w)).alias("h0"), F.transform("common", lambda w: F.xxhash64(F.lit(1), w)).alias("h1"))
    keys = hashed.mapInArrow(_subset_keys(t), "key0 BIGINT, key1 BIGINT, first BIGINT, side INT, look INT")
    sides = [F.min(F.when(F.col("side") == k, F.col("first"))).alias(f"side{k}") for k in (0, 1)]
    groups = keys.groupBy("key0", "key1").agg(*sides, F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = keys.join(groups, ["key0", "key1"]).select("first", F.when(F.col("look") == 0, F.col("side0")).otherwise(F.col("side1")).alias("near"))
    nearest = [itself, shared.where("near IS NOT NULL")]
    broad = patterns.where(F.size("common") > wide)
    if broad.take(1):
        place = lambda df: df.select("first", "n", "common", F.posexplode("common").alias("place", "word")).where(F.col("place") <= F.size("common") - needed("n")).drop("place")
        right = place(patterns).select("word", F.col("first").alias("near"), F.col("n").alias("m"), F.col("common").alias("wb"))
        met = place(broad).join(right, "word").where(alike("common", "wb")).select("first", "near")
        nearest += [met, met.select(F.col("near").alias("first"), F.col("first").alias("near"))]
    by_pattern = reduce(DataFrame.unionByName, nearest).groupBy("first").agg(F.min("near").alias("near"))
    by_pattern = patterns.join(by_pattern, "first").select("n", "common", "near")
    by_common = some.select(F.col("cls").alias("a"), "n", "common").join(by_pattern, ["n", "common"]).where(F.col("near") < F.col("a")).select("a", "near")
    return by_rare.unionByName(by_common).groupBy("a").agg(F.min("near").alias("near"))


def title_clusters(candidates: DataFrame, order: str = "ord", title: str = "title", threshold: float = 0.6, most: int = 60) -> DataFrame:
    """order, cluster: the row that each titled row's chain of first earlier similar rows leads to.

    A row follows the first earlier row whose title has similar words, and that row's cluster is its own. This is no
    connected component: two rows similar to different heads stay apart. Rows without words head their own cluster.
    """
    scratch = Scratch(candidates.sparkSession, "clusters")
    rows = candidates.where(F.length(title) > 0).select(F.col(order).alias("row"), F.array_sort(topic_words(F.col(title))).alias("words"))
    rows = scratch.write(rows, "rows")
    classes = scratch.write(rows.where(F.size("words") > 0).groupBy("words").agg(F.min("row").alias("cls")), "classes")
    near = first_similar(classes, threshold)
    # The first row of a class follows the first row of the earliest similar class, if that is earlier.
    head = classes.join(near, classes.cls == near.a, "left").select("cls", "words", F.coalesce("near", "cls").alias("up"))
    head = scratch.write(head, "heads")
    table = head.select("cls", F.col("up").alias("root"))
    for k in range(most):
        above = table.select(F.col("cls").alias("root"), F.col("root").alias("higher"))
        table = scratch.write(table.join(above, "root", "left").select("cls", F.coalesce("higher", "root").alias("new"), "root"), f"jump{k}")
        moved = table.where(F.col("new") < F.col("root")).take(1)
        table = table.select("cls", F.col("new").alias("root"))
        if k:
            scratch.drop(f"jump{k - 1}")
        if not moved:
            break
    else:
        raise RuntimeError("the clusters did not settle")
    final = head.select("words", "cls").join(table, "cls").select("words", "root")
    in_class = rows.where(F.size("words") > 0).join(final, "words").select(F.col("row").alias(order), F.col("root").alias("cluster"))
    alone = rows.where(F.size("words") == 0).select(F.col("row").alias(order), F.col("row").alias("cluster"))
    return in_class.unionByName(alone)
