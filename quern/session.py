"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold at every scale. Sizes (shuffle partitions, memory) belong to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "quern", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; extra entries (dots written as __) come last."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in extra.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may do without; it gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def read_json(spark: SparkSession, path: str):
    """The value of a JSON file, None where there is no such file."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """Writes a JSON file beside its place first, so that no reader meets half of one."""
    at, fs = _at(spark, path)
    beside, _ = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    fs.delete(at, False)
    fs.rename(beside, at)


def fingerprint(df: DataFrame) -> list[str] | None:
    """Names, sizes and times of the files that df reads; None where it reads none. Changed data have another fingerprint."""
    found = []
    for name in sorted(df.inputFiles()):
        at, fs = _at(df.sparkSession, name)
        status = fs.getFileStatus(at)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return found or None


def spread(df: DataFrame) -> DataFrame:
    """df for work that takes long per row: moved to as many partitions as there are cores where the table has fewer, as
    a small one in a single file has. Large tables have more partitions than that and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Scratch:
    """Tables written below shared_dir to cut lineage.

    A table is written once by a job and read back as Parquet, so a lost executor costs a re-read, not a re-run.
    Folders go when drop() names them, or when the driver process ends.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
        Scratch._open.append(self)

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Writes df and returns the written table."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path, partitionBy=list(partition_by) or None)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _drop_all() -> None:
    for scratch in Scratch._open:
        try:
            scratch.drop()
        except Exception:
            pass
