"""Sinks: sorted JSON lines, CSV sheets that keep human columns, versioned snapshots, manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import artifact_hash, canonical_json
from ..functions.text import leaks
from .privacy import guarded


def write_json_lines(df: DataFrame, path: str, key: str, mode: str = "error") -> None:
    """Rows in key order over as many files as it takes; each line has its keys in order."""
    df.repartitionByRange(key).sortWithinPartitions(key).select(canonical_json(df, ()).alias("value")).write.mode(mode).text(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    df.select(canonical_json(df, ()).alias("value")).write.mode("append").text(path)


def write_sheet(df: DataFrame, path: str, order: list[str]) -> None:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_dataset(tables: dict[str, DataFrame], root: str, key: dict[str, str]) -> None:
    """A folder per table."""
    for name, df in tables.items():
        write_json_lines(df, f"{root}/{name}", key[name], "overwrite")


def leaking_rows(df: DataFrame) -> DataFrame:
    """(column, kind, n) of personal data or secrets in any text column; an export with rows here must not go out."""
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]

    def named(c: str):
        return F.transform(leaks(F.coalesce(F.col(c), F.lit(""))), lambda k: F.struct(F.lit(c).alias("column"), k.alias("kind")))

    found = F.flatten(F.array(*map(named, cols)))
    return df.select(F.explode(found).alias("x")).groupBy("x.column", "x.kind").agg(F.count("*").alias("n"))


def strip_columns(df: DataFrame, marks: tuple[str, ...] = ("secret", "token", "password", "api_key", "salt")) -> DataFrame:
    return df.drop(*[c for c in df.columns if any(m in c.lower() for m in marks)])


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _context(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    uri = p.getFileSystem(conf).getUri()
    return spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, conf)


def publish_snapshot(df: DataFrame, root: str, key: str) -> tuple[str, bool]:
    """Write a version named by its content, then swap the pointer. (version, changed): equal content changes nothing."""
    spark = df.sparkSession
    version = artifact_hash(df, key).first()[0][:12]
    if current_version(spark, root) == version:
        return version, False
    fs, done = _fs(spark, f"{root}/versions/{version}/_SUCCESS")
    if not fs.exists(done):  # a folder without the mark is what a writer left half done
        write_json_lines(df, f"{root}/versions/{version}", key, "overwrite")
    staged, pointer = f"{root}/.pointer-{uuid.uuid4().hex}", f"{root}/CURRENT"
    out = fs.create(_fs(spark, staged)[1], True)
    out.write(bytearray(version.encode()))
    out.close()
    # One rename that takes the old pointer's place: readers find one of the two, at every moment.
    context, jvm = _context(spark, root), spark.sparkContext._jvm
    mode = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(mode, 1)
    options[0] = mode.OVERWRITE
    context.rename(_fs(spark, staged)[1], _fs(spark, pointer)[1], options)
    return version, True


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, at = _fs(spark, f"{root}/CURRENT")
    return spark.read.text(f"{root}/CURRENT").first()[0] if fs.exists(at) else None


def load_snapshot(spark: SparkSession, root: str, schema: str) -> DataFrame:
    version = current_version(spark, root)
    if not version or not version.isalnum():  # a pointer never leads out of the folder
        raise ValueError("no valid snapshot")
    return spark.read.schema(schema).json(f"{root}/versions/{version}")


def write_cache(entries: DataFrame, path: str, denied: tuple[str, ...] = ()) -> None:
    """Append answers to a cache; none is written by a task that meets a secret, whole or as a mark, in any of its columns."""
    guarded(entries, keys=(), denied=denied).write.mode("append").parquet(path)


def cached(keys: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """Hits with their responses, and the misses; unreadable entries (null response) are misses."""
    good = cache.where("response is not null").dropDuplicates([key])
    return keys.join(good, key), keys.join(good, key, "left_anti")


def manifest(tables: dict[str, tuple[DataFrame, str]]) -> str:
    """Counts and content hashes of tables as JSON."""
    return json.dumps({name: {"rows": df.count(), "hash": artifact_hash(df, key).first()[0]} for name, (df, key) in sorted(tables.items())}, sort_keys=True)
