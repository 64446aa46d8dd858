"""Budget reservations in an append-only log that several runs share, committed optimistically.

Each version of a day's log is a folder that is written aside and then renamed into place. A rename onto a version that is
there fails, so of two runs that saw the same log one commits and the other reads again: no budget is spent twice. It
needs a file system whose rename of a folder is atomic (HDFS, local disks); object stores without one are no place for it:
two runs could both commit there.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "reservation_id string, owner string, kind string, event string, amount long, at double"
MAX_TRIES = 50


class Contended(RuntimeError):
    """Other runs took every version that was tried."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _folder(root: str, day: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day):
        raise ValueError("a day is written yyyy-mm-dd")
    return f"{root}/day={day}"


def versions(spark: SparkSession, root: str, day: str) -> list[int]:
    fs, at = _fs(spark, _folder(root, day))
    if not fs.exists(at):
        return []
    return sorted(int(m[1]) for s in fs.listStatus(at) if (m := re.fullmatch(r"v(\d{8})", s.getPath().getName())))


def _write(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = spark.sparkContext._jvm.java.io.BufferedReader(spark.sparkContext._jvm.java.io.InputStreamReader(fs.open(p), "UTF-8"))
    try:
        return stream.readLine()
    finally:
        stream.close()


def commit(spark: SparkSession, root: str, day: str, version: int, events: list[dict]) -> bool:
    """Put ``events`` in as a version; False if another run had it first. The folder written aside is removed then."""
    folder, mark = _folder(root, day), uuid.uuid4().hex
    aside, place = f"{folder}/.{mark}", f"{folder}/v{version:08d}"
    _write(spark, f"{aside}/owner", mark)
    _write(spark, f"{aside}/events.json", "".join(json.dumps(e) + "\n" for e in events))
    jvm = spark.sparkContext._jvm
    fs, src = _fs(spark, aside)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(src, _fs(spark, place)[1], none)
    except Exception as error:
        if _read(spark, f"{place}/owner") is None:
            raise error
    # A local rename may have lost between its check and its move: what counts is whose mark stands there.
    won = _read(spark, f"{place}/owner") == mark
    if not won:
        fs.delete(src, True)
        fs.delete(_fs(spark, f"{place}/.{mark}")[1], True)
    return won


def events(spark: SparkSession, root: str, day: str) -> DataFrame:
    """All events of a day's log."""
    if not versions(spark, root, day):
        return spark.createDataFrame([], EVENTS)
    return spark.read.schema(EVENTS).json(f"{_folder(root, day)}/v*/events.json")


def balances(log: DataFrame) -> DataFrame:
    """(reservation_id, owner, kind, amount, state): what each reservation holds: all it reserved, what was spent of it, or nothing once released."""
    last = log.groupBy("reservation_id").agg(
        F.max_by("owner", "at").alias("owner"),
        F.max("kind").alias("kind"),
        F.max(F.when(F.col("event") == "reserved", F.col("amount"))).alias("reserved"),
        F.max(F.when(F.col("event") == "spent", F.col("amount"))).alias("spent"),
        F.max(F.col("event") == "released").alias("released"),
    )
    state = F.when(F.col("spent").isNotNull(), "spent").when(F.col("released"), "released").otherwise("reserved")
    held = F.when(state == "spent", F.least("spent", "reserved")).when(state == "released", 0).otherwise(F.col("reserved"))
    return last.select("reservation_id", "owner", "kind", held.cast("long").alias("amount"), state.alias("state"))


def _append(spark: SparkSession, root: str, day: str, decide) -> list[dict]:
    """Commit what ``decide`` makes of the log; it is asked again whenever another run was faster. Nothing to add: []."""
    for n in range(MAX_TRIES):
        have = versions(spark, root, day)
        new = decide(events(spark, root, day))
        if not new or commit(spark, root, day, (have[-1] if have else 0) + 1, new):
            return new
        time.sleep(0.01 * n)
    raise Contended(f"no version of {day} could be committed in {MAX_TRIES} tries")


def reserve(spark: SparkSession, root: str, day: str, kind: str, limit: int, amount: int, owner: str) -> str | None:
    """The id of a new reservation, or None if the day's budget of this kind has less than ``amount`` left."""
    if amount <= 0:
        raise ValueError("an amount is positive")
    made = {"reservation_id": uuid.uuid4().hex, "owner": owner, "kind": kind, "event": "reserved", "amount": amount, "at": time.time()}

    def decide(log):
        used = balances(log).where(F.col("kind") == kind).agg(F.coalesce(F.sum("amount"), F.lit(0))).first()[0]
        return [made] if used + amount <= limit else []

    return made["reservation_id"] if _append(spark, root, day, decide) else None


def settle(spark: SparkSession, root: str, day: str, reservation_id: str, spent: int | None) -> bool:
    """Close a reservation with what it spent, or release it whole (None). False if it is not open."""

    def decide(log):
        row = balances(log).where(F.col("reservation_id") == reservation_id).first()
        if row is None or row.state != "reserved":
            return []
        return [{"reservation_id": reservation_id, "owner": row.owner, "kind": row.kind, "event": "released" if spent is None else "spent", "amount": spent or 0, "at": time.time()}]

    return bool(_append(spark, root, day, decide))
