"""Conversation structure repair: the cheapest edits that make a conversation alternate, found by Dijkstra's search.

A conversation is an optional system turn and then pairs of a user's and an assistant's turn. Turns may be kept, given
the other role, deleted, and empty turns inserted. The search runs on the implicit lattice of nodes (turn index, grammar
state); a node's key is (cost, audit), the audit being the initials of the edits so far, and the first accepting end
node that is popped ends it.

Rows are shuffled once by conversation and sorted; each task reads them as a stream. A conversation is searched in blocks
of bounded size: what a block hands on is the best (cost, audit) of each grammar state, from which the next block's
search starts. That changes no result: two ways to one node with one cost never have audits of which one begins the
other (with the same letters for the same rows, a longer audit has dearer insertions), so the order of audits is kept by
whatever follows. Turns on which all ways agree are handed out and forgotten. A conversation of any length therefore
passes through a task without being held by it, apart from its audit, a digest per distinct turn, and the turns on which
ways still differ. One task per conversation can't be avoided: the digest of the repaired text is sequential.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, ship, spread

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLANKS = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
#: Grammar states: nothing yet, a system turn, a user's turn, a whole pair; with what may follow.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: A block ends at so many turns, or once its texts have so many characters.
BLOCK_ROWS, BLOCK_CHARS = 64, 1 << 20
MOST = (1 << 63) - 1


def search(rows: list, starts: dict, last: bool) -> dict:
    """The best way to each grammar state behind ``rows``, or with ``last`` to the first accepting one popped.

    ``rows`` has (initial, fault) pairs, ``starts`` (cost, audit) by state. Returns by state (cost, audit, start, edits),
    where edits are (letter, state behind it) in order.
    """
    heap, done, n, found, tick = [], set(), len(rows), {}, 0
    for state, (cost, audit) in starts.items():
        heappush(heap, (cost, audit, tick, 0, state, None))
        tick += 1
    while heap:
        cost, audit, _, i, state, came = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        here = (came, audit[-1:], state)
        if i == n and (not last or state in ACCEPTING):
            edits, at = [], here
            while at[0] is not None:
                edits.append(at[1:])
                at = at[0]
            found[state] = (cost, audit, at[2], edits[::-1])
            if last or len(found) == len(NEXT):
                break
        go = NEXT[state]
        for c in ROLES:
            if c in go and (i, go[c]) not in done:
                heappush(heap, (cost + INSERT, audit + "I", tick := tick + 1, i, go[c], here))
        if i < n:
            initial, fault = rows[i]
            heappush(heap, (cost + DELETE, audit + "D", tick := tick + 1, i + 1, state, here))
            if fault in ("", "truncated"):
                more = cost + (TRUNCATED if fault else 0)
                if initial in go:
                    heappush(heap, (more + KEEP, audit + "K", tick := tick + 1, i + 1, go[initial], here))
                for c in ROLES:
                    if c in go:
                        heappush(heap, (more + REROLE, audit + "R", tick := tick + 1, i + 1, go[c], here))
    return found


class Conversation:
    """Takes the rows of one conversation in order; hands out repaired turns (edit, role, text) as they are settled."""

    def __init__(self, conv_id, out):
        self.id, self.out = conv_id, out
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.turn = None
        self.turns, self.before, self.seen = 0, None, set()
        self.block, self.chars, self.heads = [], 0, []
        # By grammar state: cost, and the edits on which ways differ, as audit and turns.
        self.ways = {0: (0, "", [])}

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += self.turn != turn
            self.high = self.turn = turn
        body, initial = text.rstrip(BLANKS), role[:1]
        key = hashlib.blake2b(f"{len(role)} {role}{text}".encode(), digest_size=16).digest()
        fault = "blank" if not body else "duplicate" if key in self.seen else "truncated" if body[-1] not in ".!?" else ""
        self.seen.add(key)
        if fault:
            self.counts[fault] += 1
        if self.before is not None:
            self.counts["illegal"] += self.before + initial not in LEGAL
        self.before = initial
        self.block.append((initial, fault, role, text))
        self.chars += len(text)
        if len(self.block) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS:
            self._settle(False)

    def _settle(self, last: bool) -> None:
        found = search([r[:2] for r in self.block], {s: w[:2] for s, w in self.ways.items()}, last)
        if not last and 3 in found:
            # A whole pair can do all that a lone system turn can, and what nothing yet can with a deletion more.
            found = {s: f for s, f in found.items() if s > 1 or f[0] <= found[3][0] + (DELETE if s == 0 else 0)}
        ways = {}
        for state, (cost, audit, start, edits) in found.items():
            turns, i = list(self.ways[start][2]), 0
            for letter, behind in edits:
                role, text = ("", "") if letter == "I" else self.block[i][2:]
                i += letter != "I"
                turns.append((letter, role if letter in "KD" else ROLES["u" if behind == 2 else "a"], text))
            ways[state] = (cost, audit, turns)
        agreed = len(commonprefix([w[1] for w in ways.values()]))
        one = next(iter(ways.values()))
        self.heads.append(one[1][:agreed])
        for t in one[2][:agreed]:
            self.out(self.id, t)
        self.ways = {s: (cost, audit[agreed:], turns[agreed:]) for s, (cost, audit, turns) in ways.items()}
        self.block, self.chars = [], 0

    def end(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit)"""
        self._settle(True)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, MOST)
        return gaps, *self.counts.values(), next(iter(self.ways.values()))[0], "".join(self.heads)


def _streamed(turns: DataFrame, copies: Column | None, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, copies) by conversation and in order within it; nulls of role and text are one space."""
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _walk(batches, out, end):
    """Feeds the sorted stream to ``Conversation``; ``end`` is called with each one that is over. Yields after each few rows."""
    now = None
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                if now is None or now.id != conv_id:
                    if now is not None:
                        end(now)
                    now = Conversation(conv_id, out)
                for _ in range(copies):
                    now.add(turn, role, text)
            yield
    if now is not None:
        end(now)
    yield


def conversation_repairs(turns: DataFrame, copies: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Turns are taken in order of turn (nulls first), then role, then text, so that repeated rows stand side by side. ``copies``
    tells how often a row stands there, 0 for a row that only names its conversation. A null id is a conversation of its
    own; nulls of role and text are one space. Texts are read whole, of any length. Gaps beyond a long are the largest
    long. An empty table gives no rows; other columns play no part.
    """
    ship(turns.sparkSession)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches):
        ready, digest = [], [hashlib.sha256(), False]

        def out(_, piece):
            letter, role, text = piece
            if letter != "D":
                digest[0].update((("\n" if digest[1] else "") + f"{role}:{text}").encode())
                digest[1] = True

        def end(conv):
            *numbers, audit = conv.end()
            ready.append((conv.id, *numbers, audit, digest[0].hexdigest()))
            digest[:] = hashlib.sha256(), False

        types = [pa.int64()] * 7 + [pa.string()] * 2
        for _ in _walk(batches, out, end):
            if ready:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*ready), types)], names=["conv_id", *names, "audit", "repaired_sha256"])
                ready.clear()

    schema = "conv_id long, " + ", ".join(f"{n} long" for n in names) + ", audit string, repaired_sha256 string"
    return _streamed(turns, copies, id_col, turn_col, role_col, text_col).mapInArrow(run, schema)


def repaired_turns(turns: DataFrame, copies: Column | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, edit, role, text): the edits of each conversation in order, places from 0; those deleted have edit D.

    Orders, nulls and repeated rows as in ``conversation_repairs``.
    """
    ship(turns.sparkSession)

    def run(batches):
        ready, at = [], [None, 0]

        def out(conv_id, piece):
            ready.append((conv_id, at[1], *piece))
            at[1] += 1

        def end(conv):
            conv.end()
            at[1] = 0

        types = [pa.int64()] * 2 + [pa.string()] * 3
        for _ in _walk(batches, out, end):
            if ready:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*ready), types)], names=["conv_id", "place", "edit", "role", "text"])
                ready.clear()

    return _streamed(turns, copies, id_col, turn_col, role_col, text_col).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): known damage by the checksum of ``conv_id:turn``; nulls are one space there and in role and text."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("harm"))
    text = F.when(F.col("harm").isin(0, 1), "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    return conversation_repairs(damaged(spread(read_table(spark, sf_dir, "conversations"))), F.col("copies"))
