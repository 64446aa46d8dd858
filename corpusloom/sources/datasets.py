"""Datasets as folders: tables partitioned by ``dataset_id``, an index of what is there, and pruning down to one dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "dataset_id string, run_id string, description string"


def export_datasets(tables: dict[str, DataFrame], index: DataFrame, root: str) -> None:
    """Write each table below ``root`` with a folder per dataset, and the index last: a dataset that it names is whole."""
    for name, df in tables.items():
        df.repartition("dataset_id", F.pmod(F.xxhash64(*[c for c in df.columns if c != "dataset_id"]), F.lit(16))).write.mode("overwrite").partitionBy("dataset_id").parquet(f"{root}/{name}")
    index.select(*[c.split(" ")[0] for c in INDEX.split(", ")]).write.mode("overwrite").json(f"{root}/index")


def load_index(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(INDEX).json(f"{root}/index")


def load_dataset(spark: SparkSession, root: str, table: str, dataset_id: str | None = None) -> DataFrame:
    """A table's rows of one dataset, or of all that the index names; other folders are not read.

    One dataset is a partition filter of the scan; all of them are a semi-join with the index, whose ids prune the scan
    while it runs.
    """
    df = spark.read.option("basePath", f"{root}/{table}").parquet(f"{root}/{table}")
    df = df.withColumn("dataset_id", F.col("dataset_id").cast("string"))
    return df.where(F.col("dataset_id") == dataset_id) if dataset_id is not None else df.join(load_index(spark, root).select("dataset_id"), "dataset_id", "left_semi")


def discovered(spark: SparkSession, root: str, table: str) -> DataFrame:
    """(dataset_id, listed): the datasets that have a folder, and whether the index names them; only folders are looked at."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/dataset_id=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
    unescape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    names = [(unescape(s.getPath().getName().split("=", 1)[1]),) for s in found]
    listed = load_index(spark, root).select("dataset_id").distinct().withColumn("listed", F.lit(True))
    return spark.createDataFrame(names, "dataset_id string").join(listed, "dataset_id", "left").select("dataset_id", F.coalesce("listed", F.lit(False)).alias("listed"))
