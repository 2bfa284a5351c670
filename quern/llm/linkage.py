"""Problem 6: duplicates of new batches in everything accepted before, by incremental record linkage.

A LinkStore keeps, in a folder, a table of blocking keys with the first record of each key, and a table of parents that
makes a union-find forest of the records. A step takes one or more new batches, in order of arrival:

1. its records give the fields id, site, path and article parameters, and three blocking keys: id, whole address, and
   address without parameters. Fields and keys are hashes of 64 bits, so nothing longer is ever shuffled or stored; a key
   and the fields behind it have hashes of their own;
2. the keys are reduced to one row each, then probed in the stored keys. The records of history aren't read again;
3. each record is compared with the first record of each of its keys, field by field. Agreeing and differing fields have
   weights, and a pair with a positive score is a match: nothing else decides. The weights are learned by logistic
   regression on the patterns of agreement of all pairs so far, at most 81 patterns with their counts, from pairs proven
   to be matches (equal ids, or all parts of the address equal) and the others; a prior of a few pairs starts it;
4. a linked record gets the smallest of its matches as parent; where it joins two records, the later one gets the
   earlier as parent. So a step only adds edges; find() gives the components of all edges.

A step appends its keys and parents in folders of their own, and counts once its entry in the log is written, so a
step that was cut off is done again. A key that holds a large share of the records is reduced before any shuffle, and
its records meet its one stored row by broadcast.

Defined results: records without id and address are no duplicates. A blank id or address counts as missing. Repeated
rows with the same record number are one record. An empty batch changes nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.url import page_address, page_parts
from quern.llm.components import connected_components
from quern.operators.skew import hot_keys, join_small_per_key
from quern.session import Scratch, read_json, write_json

FIELDS = ("id", "site", "path", "query")
#: Pairs that are taken as seen before any other, as (agreement of FIELDS, match): an id, or a whole address, proves a page.
PRIOR = [((1, None, None, None), 1), ((1, 0, 0, 0), 1), ((None, 1, 1, 1), 1), ((0, 1, 1, 1), 1), ((0, 1, 1, 0), 0), ((None, 1, 0, 1), 0), ((0, 0, 1, 1), 0)]
#: Batches that p6_found takes in one step; a step has a fixed cost of a few jobs.
BATCHES_PER_STEP = 10
_FIRST = "node: BIGINT, id: BIGINT, site: BIGINT, path: BIGINT, query: BIGINT"


def _fields(records: DataFrame) -> DataFrame:
    """node, and id, site, path, query as hashes, of records with node, id, url."""
    ident = F.lower(F.trim("id"))
    part = page_parts(F.col("url"))
    rows = records.where(F.col("node").isNotNull()).select("node", F.when(ident != "", F.xxhash64(ident)).alias("id"), *[v.alias(k) for k, v in part.items()])
    some = F.concat("site", "path", "query") != ""
    return rows.select("node", "id", *[F.when(some, F.xxhash64(F.lit(k), F.col(k))).alias(k) for k in part])


def _keys(rows: DataFrame) -> DataFrame:
    page = F.col("site").isNotNull()
    keys = [F.when(F.col("id").isNotNull(), F.xxhash64(F.lit("i"), "id")), F.when(page, F.xxhash64(F.lit("a"), "site", "path", "query")), F.when(page, F.xxhash64(F.lit("p"), "site", "path"))]
    return rows.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), "node", *FIELDS)


def learn(patterns: dict[tuple, int]) -> tuple[float, dict[str, dict[str, float]]]:
    """Bias, and weights of agreeing and differing fields, from counts of agreement patterns (1, 0 or None per field).

    Logistic regression on PRIOR and the patterns, each with the logarithm of its count as its weight; then single
    corrections until every pattern is on its own side, which is always possible.
    """
    cases = [(a, m, 1.0) for a, m in PRIOR] + [(a, int(a[0] == 1 or a[1:] == (1, 1, 1)), 1.0 + float(np.log1p(n))) for a, n in sorted(patterns.items(), key=str)]
    x = np.array([[1.0] + [float(v == side) for v in a for side in (1, 0)] for a, _, _ in cases])
    y, c = np.array([m for _, m, _ in cases], float), np.array([c for *_, c in cases])
    w = np.zeros(x.shape[1])
    for _ in range(3000):
        w += 0.5 * (x.T @ (c * (y - 1 / (1 + np.exp(-(x @ w))))) - 0.002 * w) / c.sum()
    for _ in range(100_000):
        wrong = np.flatnonzero((x @ w > 0.1) != (y > 0.5)) if (y > 0.5).any() else np.zeros(0, int)
        if not len(wrong):
            break
        w += 0.1 * (2 * y[wrong[0]] - 1) * x[wrong[0]]
    return float(w[0]), {f: {"agree": float(w[1 + 2 * k]), "differ": float(w[2 + 2 * k])} for k, f in enumerate(FIELDS)}


class LinkStore:
    """Blocking keys, parents and patterns of agreement of all records so far."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        done = self._fs_path(f"{self.folder}/log")
        names = [str(x.getPath().getName()) for x in self.fs.listStatus(done)] if self.fs.exists(done) else []
        self.steps = sorted(int(n) for n in names if n.isdigit())
        self.patterns: dict[tuple, int] = {}
        for step in self.steps:
            self._count(read_json(spark, f"{self.folder}/log/{step}")["patterns"])
        self.bias, self.weights = learn(self.patterns)

    def _count(self, found: list) -> None:
        for agreement, n in found:
            self.patterns[tuple(agreement)] = self.patterns.get(tuple(agreement), 0) + n

    def _table(self, name: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{name}/{k}" for k in self.steps]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def keys(self) -> DataFrame:
        """key, first: the first record of every key."""
        return self._table("keys", f"key BIGINT, first STRUCT<{_FIRST}>")

    def parents(self) -> DataFrame:
        """node, parent, direct (node itself matched, in its own step)."""
        return self._table("parents", "node BIGINT, parent BIGINT, direct BOOLEAN")

    def add(self, records: DataFrame) -> None:
        """One step. records: node (BIGINT, rising with arrival, above all nodes so far), id, url."""
        step = (self.steps[-1] if self.steps else -1) + 1
        scratch = Scratch(self.spark, "link")
        rows = _fields(records)
        keys = _keys(rows)
        own = keys.groupBy("key").agg(F.min(F.struct("node", *FIELDS)).alias("own"), F.count(F.lit(1)).alias("n"))
        known = self.keys().withColumnRenamed("first", "stored")
        probed = own.join(known, "key", "left") if self.steps else own.withColumn("stored", F.when(F.lit(False), F.col("own")))
        probed = scratch.write(probed.select("key", "n", F.coalesce("stored", "own").alias("first"), F.col("stored").isNull().alias("fresh")), "probed")
        hot = hot_keys(probed, "key", "n")
        pairs = join_small_per_key(keys, probed.select("key", "first"), "key", hot).where(F.col("first.node") < F.col("node"))
        agreed = pairs.select("node", F.col("first.node").alias("other"), *[(F.col(f) == F.col(f"first.{f}")).cast("int").alias(f) for f in FIELDS])
        agreed = scratch.write(agreed, "agreed")
        found = [(tuple(r[f] for f in FIELDS), r["n"]) for r in agreed.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most 81 rows
        self._count(found)
        self.bias, self.weights = learn(self.patterns)
        score = sum((F.when(F.col(f) == 1, F.lit(w["agree"])).when(F.col(f) == 0, F.lit(w["differ"])).otherwise(F.lit(0.0)) for f, w in self.weights.items()), F.lit(self.bias))
        matched = agreed.where(score > 0).groupBy("node").agg(F.min("other").alias("low"), F.max("other").alias("high"))
        edges = F.array_compact(F.array(
            F.struct("node", F.col("low").alias("parent"), F.lit(True).alias("direct")),
            F.when(F.col("high") > F.col("low"), F.struct(F.col("high").alias("node"), F.col("low").alias("parent"), F.lit(False).alias("direct"))),
        ))
        matched.select(F.inline(edges)).write.mode("overwrite").parquet(f"{self.folder}/parents/{step}")
        probed.where("fresh").select("key", "first").write.mode("overwrite").parquet(f"{self.folder}/keys/{step}")
        write_json(self.spark, f"{self.folder}/log/{step}", {"step": step, "patterns": found})
        self.steps.append(step)
        scratch.drop()

    def find(self) -> DataFrame:
        """node, root of every record with a parent. All edges count: a record may have had several parents, in several steps,
        and those share its root, however far above."""
        return connected_components(self.parents(), "node", "parent").where(F.col("root") < F.col("node"))


def history_records(seen: DataFrame) -> DataFrame:
    """node, id, url of accepted records (url_key, url): nodes are negative, by a hash of the page."""
    page = F.xxhash64(F.coalesce(page_address(F.col("url")), F.lower(F.trim("url_key"))))
    return seen.select((-1 - F.shiftrightunsigned(page, 1)).alias("node"), F.col("url_key").alias("id"), "url")


def link_batches(store: LinkStore, candidates: DataFrame, batches_per_step: int = BATCHES_PER_STEP, ident: str = "ord") -> None:
    """All batches of candidates (ord, batch, id, url), in order of arrival, in steps of batches_per_step batches."""
    ends = sorted(r[1] for r in candidates.where(F.col("batch").isNotNull()).groupBy("batch").agg(F.max(ident)).collect())  # one row per batch
    cuts = ends[batches_per_step - 1 :: batches_per_step][: max(0, -(-len(ends) // batches_per_step) - 1)]
    records = candidates.select(F.col(ident).alias("node"), "id", "url")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = records
        part = part if low is None else part.where(F.col("node") > low)
        part = part if high is None else part.where(F.col("node") <= high)
        store.add(part)


def repeated_rows(seen: DataFrame, candidates: DataFrame, folder: str | None = None, batches_per_step: int = BATCHES_PER_STEP) -> DataFrame:
    """ord of the candidates whose page is in seen or in a candidate with a smaller ord. A new folder starts from seen."""
    spark = candidates.sparkSession
    store = LinkStore(spark, folder or Scratch(spark, "store").path)
    if not store.steps:
        store.add(history_records(seen))
    link_batches(store, candidates, batches_per_step)
    return store.parents().where(F.col("direct") & (F.col("node") >= 0)).select(F.col("node").alias("ord"))
