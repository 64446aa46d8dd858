"""Sharding by size-tiered compaction, with DataFrame functions only.

Arrivals are appended as immutable runs of small Parquet shards. Compaction takes the runs of one size
tier (sizes within a factor of ``fan_in``) once there are ``fan_in`` of them and writes them as one run of
files of about the target size, without a shuffle: whole scan splits are put together. Manifests are
versioned tables of the live runs and their shards; a commit writes the new version beside the old ones
and then renames it into place, which fails if another writer took the number. A reader that holds a
version keeps reading it until ``expire`` drops the files that no kept version names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, read_table, scratch_path, spread

TARGET_BYTES, FAN_IN, LEAST_BYTES = 128 << 20, 4, 1 << 20
_MANIFEST = "run string, tier int, n_shards long, n_rows long, n_bytes long"


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class MergedElsewhere(RuntimeError):
    """Runs of a merge are in no live version any more."""


class ShardStore:
    """Runs and manifests below ``root``. The driver holds a row per run, never a row per shard or record."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, least_bytes: int = LEAST_BYTES):
        self.spark, self.root, self.target, self.fan_in, self.least = spark, root.rstrip("/"), target_bytes, max(2, fan_in), least_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifests -------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()[1:]) for s in self._fs.listStatus(at) if s.getPath().getName().startswith("v")) if self._fs.exists(at) else []

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live runs of a version, by default the newest."""
        v = self.version() if version is None else version
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/v{v:08d}") if v else self.spark.createDataFrame([], _MANIFEST)

    def _runs(self, version: int) -> list:
        return self.manifest(version).orderBy("run").collect()

    def _commit(self, base: int, runs: list) -> int:
        """Make ``runs`` the version after ``base``, or raise Conflict."""
        staged = f"{self.root}/staging/{uuid.uuid4().hex}"
        self.spark.createDataFrame(runs, _MANIFEST).coalesce(1).write.parquet(staged)
        home = self._path(f"{self.root}/manifest")
        self._fs.mkdirs(home)
        final = self._path(home, f"v{base + 1:08d}")
        if self._fs.exists(final) or not self._fs.rename(self._path(staged), final):
            self._fs.delete(self._path(staged), True)
            raise Conflict(f"version {base + 1} exists")
        inside = self._path(final, staged.rsplit("/", 1)[1])
        if self._fs.exists(inside):  # some stores move into a folder that came meanwhile
            self._fs.delete(inside, True)
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def _retried(self, change, tries: int = 5) -> int:
        for left in range(tries, 0, -1):
            base = self.version()
            try:
                return self._commit(base, change(self._runs(base)))
            except Conflict:
                if left == 1:
                    raise
        raise AssertionError

    # -- data ------------------------------------------------------------------------------------

    def tier(self, n_bytes: int) -> int:
        """0 below ``least_bytes``, then one more for each factor of ``fan_in``."""
        tier, limit = 0, self.least
        while n_bytes >= limit:
            tier, limit = tier + 1, limit * self.fan_in
        return tier

    def _measured(self, paths: list[str]) -> list[tuple]:
        """Manifest rows of runs just written; rows are counted from the files themselves."""
        shard = F.col("_metadata.file_path")
        files = self.spark.read.parquet(*paths).select(shard.alias("f"), F.col("_metadata.file_size").alias("b")).groupBy("f", "b").agg(F.count("*").alias("n"))
        name = F.regexp_extract("f", r"/data/(.+)/[^/]+$", 1)
        found = {r.run: r for r in files.groupBy(name.alias("run")).agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("b").alias("b")).collect()}
        return [(r.run, self.tier(r.b), r.k, r.n, r.b) for r in found.values()]

    def append(self, df: DataFrame, arrival: str | None = None) -> int:
        """Write ``df`` as a new run, or one run for each value of the column ``arrival`` (then not stored), and commit.
        An empty frame adds no run."""
        name = f"run-{uuid.uuid4().hex}"
        out = f"{self.root}/data/{name}"
        (df.write.partitionBy(arrival) if arrival else df.write).parquet(out)
        if arrival:
            paths = [s.getPath().toString() for s in self._fs.listStatus(self._path(out)) if s.isDirectory()]
        else:
            paths = [out] if any(s.getLen() and s.getPath().getName().endswith(".parquet") for s in self._fs.listStatus(self._path(out))) else []
        rows = [r for r in (self._measured(paths) if paths else []) if r[3]]
        return self._retried(lambda live: [*map(tuple, live), *rows])

    def read(self, version: int | None = None) -> DataFrame | None:
        """All records of a version; None if it has no run."""
        runs = self._runs(self.version() if version is None else version)
        return self.spark.read.parquet(*[f"{self.root}/data/{r.run}" for r in runs]) if runs else None

    def compact(self) -> int:
        """Merge tiers that hold ``fan_in`` runs or more, lowest first, until none does; returns the newest version.

        Of two writers that merge the same runs one commits; the other removes what it wrote and goes on from there.
        """
        while True:
            base = self.version()
            runs = self._runs(base)
            tiers: dict[int, list] = {}
            for r in runs:
                if r.n_bytes < self.target * r.n_shards * 0.5:  # its files are well under the target
                    tiers.setdefault(r.tier, []).append(r)
            ready = sorted(t for t, rs in tiers.items() if len(rs) >= self.fan_in)
            if not ready:
                return base
            merged = tiers[ready[0]]
            n_bytes, n_rows = sum(r.n_bytes for r in merged), sum(r.n_rows for r in merged)
            name = f"run-{uuid.uuid4().hex}"
            paths = [f"{self.root}/data/{r.run}" for r in merged]
            self.spark.read.parquet(*paths).coalesce(max(1, -(-n_bytes // self.target))).write.parquet(f"{self.root}/data/{name}")
            (row,) = self._measured([f"{self.root}/data/{name}"])
            if row[3] != n_rows:
                raise RuntimeError(f"a merge of {n_rows} rows wrote {row[3]}")
            row = (row[0], max(row[1], ready[0] + 1), *row[2:])
            gone = {r.run for r in merged}

            def change(live, gone=gone, row=row):
                if not gone <= {r.run for r in live}:
                    raise MergedElsewhere("another writer merged the same runs")
                return [*(tuple(r) for r in live if r.run not in gone), row]

            try:
                self._retried(change)
            except MergedElsewhere:  # what was written is in no version; look again at what there is to merge
                self._fs.delete(self._path(f"{self.root}/data/{name}"), True)

    def expire(self, keep: int = 1) -> None:
        """Drop all but the newest ``keep`` versions, and the runs that only those name."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        live = {r.run for v in kept for r in self._runs(v)}
        for run in {r.run for v in old for r in self._runs(v)} - live:
            self._fs.delete(self._path(f"{self.root}/data/{run}"), True)
        for v in old:
            self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}"), True)


def shard_documents(docs: DataFrame, root: str, arrivals: int = 8, **options) -> ShardStore:
    """Append ``docs`` in ``arrivals`` runs by a hash of doc_id, compact, and expire what was merged.

    Every column and row is kept as it is: nulls, empty and long texts, repeated rows. An empty table makes
    a version without runs.
    """
    store = ShardStore(docs.sparkSession, root, **options)
    (lot,) = free_names(docs, "_arrival")
    store.append(docs.withColumn(lot, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals))), lot)
    store.compact()
    store.expire()
    return store


def op6_shards(spark, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents"))
    store = shard_documents(docs, scratch_path(spark, "shards"))
    back = store.read()
    back = docs.limit(0) if back is None else back
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "lang", "source")


OP6_SQL = "SELECT doc_id, length(text) AS n_chars, sha256(text) AS text_sha256, lang, source FROM documents"
