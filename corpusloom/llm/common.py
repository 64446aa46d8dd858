"""Shared by the operators of this folder: tables, words, scratch space, broadcasts and components.

Scratch data goes to ``spark.checkpoint.dir`` of the session, a folder that all executors share;
only where that is unset and all runs in one process (tests, a laptop) one is made below the system's
temporary folder. Scratch tables outlive the query, as the frame that reads them is lazy; ``forget_scratch``
removes those of a session that is done with its results.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread  # noqa: F401

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What stands between two words: ASCII that is neither digit nor lower-case letter.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Largest number of rows given a broadcast hint, and only after they were counted.
BROADCAST_ROWS = 200_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for scratch tables and checkpoints."""
    sc = spark.sparkContext
    place = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not place:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="corpusloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


_SCRATCH: list[str] = []


def forget_scratch(spark: SparkSession) -> int:
    """Remove the scratch tables this session wrote, once nothing reads them any more; returns their number."""
    jvm, n = spark._jvm, len(_SCRATCH)
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with bars before it until no column of ``df`` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few; otherwise the planner shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())


def words(text: Column) -> Column:
    """Words of a whole text after lower-casing A-Z; null has none."""
    return F.filter(F.split(lower_ascii(text), WORD_GAP), lambda w: w != "")


def text_key(text: Column) -> Column:
    """Tells apart rows that share an id but not a text."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long); root is the smallest node reachable.

    Alternates large-star and small-star rounds. Each is one aggregation (a minimum per node, combined
    before the shuffle) and one join that adaptive execution can split, so a hub of any degree never
    becomes one task's list. Rounds grow with the logarithm of a component's size. Each round is
    checkpointed. An empty input gives an empty result.
    """
    spark = edges.sparkSession
    shared_dir(spark)

    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = df.distinct().checkpoint()
        row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        return df, tuple(row)

    cur, mark = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    for _ in range(max_rounds if mark[0] else 0):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
        )
        cur, new = settle(small)
        if new == mark:
            break
        mark = new
    else:
        if mark[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
