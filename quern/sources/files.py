"""Tables kept as files of other kinds: front matter, JSON documents and lines, CSV series, content-addressed snapshots."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(256)
def _front(head: str) -> tuple[tuple[str, str], ...]:
    import yaml

    found = yaml.safe_load(head)
    return tuple((str(k), "" if v is None else str(v)) for k, v in found.items()) if isinstance(found, dict) else ()


def _fronts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for heads in batches:
        yield pa.array([list(_front(h)) if h else [] for h in heads.to_pylist()], pa.map_(pa.string(), pa.string()))


_fronts.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def read_front_matter(spark: SparkSession, path: str) -> DataFrame:
    """path, meta MAP<STRING, STRING>, body of text files that begin with YAML between two lines of hyphens."""
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", r"(?m)^---\s*$", 3).alias("p"))
    head = F.when(F.size("p") == 3, F.get("p", F.lit(1)))
    body = F.when(F.size("p") == 3, F.get("p", F.lit(2))).otherwise(F.get("p", F.lit(0)))
    return rows.select("path", F.arrow_udf(_fronts, T.MapType(T.StringType(), T.StringType()))(head).alias("meta"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))


def in_path_order(df: DataFrame, newest_first: bool = False, time: str | None = None) -> DataFrame:
    """Rows by path; or by the text of a time, the latest first, paths settling ties."""
    return df.orderBy(F.desc(F.col(time).cast("string")), "path") if time else df.orderBy(F.desc("path") if newest_first else "path")


def read_queue(spark: SparkSession, path: str, name: str = "story.md") -> DataFrame:
    """Front matter of the files called name, one folder below path."""
    return read_front_matter(spark, f"{path}/*/{name}")


def read_pages(spark: SparkSession, path: str, values: dict[str, str] | None = None) -> DataFrame:
    """slug, group, order, meta, body of text files with front matter, {{ name }} in the body replaced by values; sorted by
    group ("z" where there is none), order (99) and path. Files without front matter are no pages."""
    rows = read_front_matter(spark, path).where(F.size("meta") > 0)
    body = F.col("body")
    for name, value in (values or {}).items():
        body = F.regexp_replace(body, rf"\{{\{{\s*{name}\s*\}}\}}", value.replace("\\", "\\\\").replace("$", "\\$"))
    of = lambda key: F.try_element_at("meta", F.lit(key))
    rows = rows.select(
        "path", F.coalesce(of("slug"), F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).alias("slug"), F.coalesce(of("group"), F.lit("z")).alias("group"),
        F.coalesce(of("order").try_cast("int"), F.lit(99)).alias("order"), "meta", body.alias("body"),
    )
    return rows.orderBy("group", "order", "path")


def read_versioned_texts(spark: SparkSession, path: str) -> DataFrame:
    """name, version, text of whole text files; the version is made of the text: twelve digits of its sha256."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))
    return rows.select("name", F.left(F.sha2("text", 256), F.lit(12)).alias("version"), "text")


def read_fixture_pages(spark: SparkSession, folder: str) -> DataFrame:
    """url, status, html of the pages that folder/index.json names (an object of addresses and files); 404 where the file lacks."""
    index = spark.read.text(f"{folder}/index.json", wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("url", "file"))
    files = spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("html"))
    rows = index.join(files, "file", "left")
    return rows.select("url", F.when(F.col("html").isNull(), 404).otherwise(200).alias("status"), F.coalesce("html", F.lit("")).alias("html"))


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path and fields of files that hold one JSON object each; unreadable ones have null fields, a missing folder no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    if found is None or not len(found):
        return spark.createDataFrame([], f"path STRING, {schema}")
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", schema).alias("x")).select("path", "x.*")


def read_settings(path: str) -> dict:
    """A YAML file of settings, read by the driver; an empty one has none."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def register(spark: SparkSession, settings: dict, name: str, schema: str) -> DataFrame:
    """The list of objects called name of the settings as a table; fields that lack are null."""
    like = T._parse_datatype_string(schema)
    return spark.createDataFrame([tuple(row.get(c) for c in like.names) for row in settings.get(name) or []], like)


def the_one(df: DataFrame, condition: Column) -> dict:
    """The first row that meets the condition; KeyError where none does."""
    row = df.where(condition).limit(1).collect()
    if not row:
        raise KeyError(str(condition))
    return row[0].asDict(recursive=True)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """log, n, line of text files: the lines that aren't blank, numbered from 1 by their places in the file."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    number = F.row_number().over(Window.partitionBy("log").orderBy("block", "at"))
    return rows.where(F.length(F.trim("line")) > 0).select("log", number.alias("n"), "line")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON with their raw text; lines that can't be read have null fields."""
    rows = spark.read.text(path).where(F.length("value") > 0)
    return rows.select(F.col("value").alias("line"), F.from_json("value", schema).alias("x")).select("line", "x.*")


def read_series(spark: SparkSession, path: str, value: str) -> DataFrame:
    """entity, year, value of a CSV file: columns 1 and 3, and the one named value, or else the fourth."""
    rows = spark.read.option("header", True).csv(path)
    names = rows.columns
    column = value if value in names else names[3]
    return rows.select(F.col(f"`{names[0]}`").alias("entity"), F.expr(f"try_cast(`{names[2]}` AS INT)").alias("year"), F.expr(f"try_cast(`{column}` AS DOUBLE)").alias("value")).where("year IS NOT NULL AND value IS NOT NULL")


def write_by_year(df: DataFrame, time: Column, path: str) -> None:
    """Parquet, a folder per year, so that a year is read alone."""
    df.withColumn("year", F.year(time)).write.mode("append").partitionBy("year").parquet(path)


def append_snapshots(pages: DataFrame, store: str, digest: str = "sha256") -> int:
    """Adds the pages whose content the store doesn't hold, each once; returns how many."""
    spark = pages.sparkSession
    new = pages.where(F.col(digest).isNotNull()).dropDuplicates([digest])
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        new = new.join(spark.read.parquet(store).select(digest), digest, "left_anti")
    before = spark.read.parquet(store).count() if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else 0
    new.write.mode("append").parquet(store)
    return spark.read.parquet(store).count() - before


def append_log(entries: DataFrame, path: str) -> None:
    """Adds entries to a folder of JSON lines."""
    entries.write.mode("append").json(path)


def front_matter_text(meta: Column, body: Column) -> Column:
    """A text file's content: YAML of the map meta, in the order of its keys, between two lines of hyphens, then the body."""
    return F.arrow_udf(_headed, T.StringType())(meta, F.coalesce(body, F.lit("")))


def _headed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    import yaml

    for metas, bodies in batches:
        made = [f"---\n{yaml.safe_dump(dict(m or []), sort_keys=False, allow_unicode=True)}---\n\n{b.strip()}\n" for m, b in zip(metas.to_pylist(), bodies.to_pylist())]
        yield pa.array(made, pa.string())


_headed.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}


def write_texts(df: DataFrame, name: str, text: str, folder: str) -> None:
    """A file per row, named by the column name, in the folder; written by the executors."""

    def put(rows) -> None:
        import os

        for row in rows:
            path = os.path.join(folder, row[name])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(row[text])

    df.select(name, text).where(F.col(name).isNotNull() & F.col(text).isNotNull()).foreachPartition(put)


def append_versions(changes: DataFrame, store: DataFrame | None, key: str, time: str) -> DataFrame:
    """changes with version: they go on from the newest stored version of their key, in order of time; the old ones stay."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(time))
    if store is None:
        return changes.withColumn("version", number)
    newest = store.groupBy(key).agg(F.max("version").alias("__v"))
    return changes.join(newest, key, "left").withColumn("version", number + F.coalesce("__v", F.lit(0))).drop("__v")


def latest_versions(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of every key: rows are only ever added, never changed."""
    columns = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*columns), version).alias("x")).select(key, "x.*")
