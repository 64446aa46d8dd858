"""Sessions whose Python workers can import this package."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Put this package's folder on the path of Python workers (a cluster may install the package instead)."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), root) if x)


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of fewer splits than cores (one small file) over all cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, made from those given."""
    taken = {c.lower() for c in df.columns}
    return [next(x for x in (f"{'_' * k}{n}" for k in range(len(taken) + 1)) if x.lower() not in taken) for n in names]


def scratch_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and scratch tables, which all executors share.

    Only where ``spark.checkpoint.dir`` is unset and all runs in one process (tests, a laptop) one is made.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(place or tempfile.mkdtemp(prefix="corpusloom-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def looked_up(df: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
    """``df`` left-joined to ``other`` on equal keys. Rows without a key meet nothing; they are dealt by their other values, not to one task."""
    kinds = dict(df.dtypes)
    if kinds[key] != dict(other.dtypes)[other_key]:
        return df.join(other, df[key] == other[other_key], "left")
    plain = [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "variant"))]
    lot, lot_of = free_names(df, "_lot", "_lot_of")
    dealt = df.withColumn(lot, F.when(F.col(key).isNull(), F.xxhash64(*plain)).otherwise(F.xxhash64(key)))
    held = other.where(F.col(other_key).isNotNull()).withColumn(lot_of, F.xxhash64(other_key))
    return dealt.join(held, (dealt[key] == held[other_key]) & (dealt[lot] == held[lot_of]), "left").drop(lot, lot_of)


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder; survives lost executors."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def ranked(df: DataFrame, groups: list[str], order: list[Column], rank: str = "rn", size: str = "n") -> DataFrame:
    """``df`` with the rank (from 1) of each row in its group and the group's size; no task holds a whole group.

    Rows are dealt by range over group and order, which must tell all rows of a group apart or ranks of equal
    ones are any of theirs; a row's rank is its place in its part and the rows of its group in the parts before.
    Columns of the names ``rank`` and ``size`` are replaced.
    """
    keys = free_names(df, *[f"_k{i}" for i in range(len(order))])
    part, count, before = free_names(df, "_part", "_count", "_before")
    dealt = df.withColumns(dict(zip(keys, order))).repartitionByRange(*groups, *keys)
    base = settled(dealt.withColumn(part, F.spark_partition_id()))
    counts = base.groupBy(*groups, part).agg(F.count("*").alias(count))  # a row per group and part
    w = Window.partitionBy(*groups)
    mine = free_names(base, *[f"_g{i}" for i in range(len(groups))], "_p")
    sums = counts.select(*[F.col(g).alias(x) for g, x in zip(groups, mine)], F.col(part).alias(mine[-1]), F.coalesce(F.sum(count).over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before), F.sum(count).over(w).alias(size))
    same = F.col(part) == F.col(mine[-1])
    for g, x in zip(groups, mine):
        same = same & F.col(g).eqNullSafe(F.col(x))
    inside = F.row_number().over(Window.partitionBy(*groups, part).orderBy(*keys))
    return base.drop(rank, size).join(sums, same).withColumn(rank, inside + F.col(before)).drop(*keys, part, before, *mine)
