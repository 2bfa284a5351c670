"""Hash-chained logs: each entry holds the hash of the one before, so a change anywhere shows."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what stands for the hash before the first entry.
GENESIS = "0" * 64


def build_chain(df: DataFrame, log: str, order: str, body: Column, after: DataFrame | None = None) -> DataFrame:
    """log, order, prev, hash: a chain per log; hash = sha256(prev | body). after: log, hash of the last stored entry of logs
    that go on; others begin anew.

    Entries stream through sorted partitions, so a log is never held whole; its hashes depend on each other, which makes it
    the work of one task.
    """
    rows = df.where(F.col(order).isNotNull()).select(F.col(log), F.col(order), F.coalesce(body, F.lit("")).alias("__body"))
    last = F.lit(GENESIS)
    if after is not None:
        rows = rows.join(after.select(F.col(log).alias("__log"), F.col("hash").alias("__last")), F.col(log).eqNullSafe(F.col("__log")), "left").drop("__log")
        last = F.coalesce("__last", F.lit(GENESIS))
    rows = rows.select(log, order, "__body", last.alias("__last")).repartition(log).sortWithinPartitions(log, order)

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before = object(), GENESIS
        for batch in batches:
            prevs, hashes = [], []
            for name, text, begin in zip(batch[log].to_pylist(), batch["__body"].to_pylist(), batch["__last"].to_pylist()):
                if name != current:
                    current, before = name, begin
                prevs.append(before)
                before = hashlib.sha256(f"{before}|{text}".encode()).hexdigest()
                hashes.append(before)
            yield pa.record_batch([batch[log], batch[order], pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], [log, order, "prev", "hash"])

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (log, order)]
    return rows.mapInArrow(chained, ", ".join([*kinds, "prev STRING", "hash STRING"]))


def last_hashes(chain: DataFrame, log: str, order: str) -> DataFrame:
    """log, hash of the last entry of every stored log: where new entries go on."""
    return chain.groupBy(log).agg(F.max_by("hash", order).alias("hash"))


def verify_chain(chain: DataFrame, log: str, order: str, body: str) -> DataFrame:
    """log, entries, first_bad: the first entry whose hash or predecessor doesn't fit, null if all do."""
    before = F.lag("hash", 1, GENESIS).over(Window.partitionBy(log).orderBy(order))
    bad = (F.col("prev") != before) | (F.col("hash") != F.sha2(F.concat(F.col("prev"), F.lit("|"), F.col(body)), 256))
    return chain.withColumn("__bad", bad).groupBy(log).agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(F.col("__bad"), F.col(order))).alias("first_bad"))


def canonical_body(line: str) -> tuple[str, str, str] | None:
    """(prev, hash, sha256 of the entry without its hash, in canonical JSON) of a log line; None if it is no object."""
    try:
        entry = json.loads(line)
        stated = entry.pop("hash")
        body = json.dumps(entry, sort_keys=True, ensure_ascii=False)
        return entry["prev"], stated, hashlib.sha256(body.encode()).hexdigest()
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


_LINE = T.StructType([T.StructField("prev", T.StringType()), T.StructField("hash", T.StringType()), T.StructField("made", T.StringType())])


def _bodies(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    kind = pa.struct([("prev", pa.string()), ("hash", pa.string()), ("made", pa.string())])
    for lines in batches:
        found = [canonical_body(x) if x else None for x in lines.to_pylist()]
        yield pa.array([dict(zip(("prev", "hash", "made"), f)) if f else {"prev": None, "hash": None, "made": None} for f in found], kind)


_bodies.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def verify_log_lines(lines: DataFrame, log: str, order: str, line: str) -> DataFrame:
    """log, entries, first_bad for logs of JSON lines; every line's canonical form is made again and hashed."""
    parsed = lines.select(log, order, F.arrow_udf(_bodies, _LINE)(F.col(line)).alias("x")).select(log, order, "x.*")
    before = F.lag("hash", 1, GENESIS).over(Window.partitionBy(log).orderBy(order))
    good = F.coalesce((F.col("prev") == before) & (F.col("hash") == F.col("made")), F.lit(False))
    return parsed.withColumn("__good", good).groupBy(log).agg(F.count(F.lit(1)).alias("entries"), F.min(F.when(~F.col("__good"), F.col(order))).alias("first_bad"))
