"""Repair of the turn structure of conversations.

The roles of a sound conversation spell ``(s?(ua)+)?``: nothing, or pairs of user and assistant behind at most one system
turn. Turns are aligned with the grammar's strings by Wagner-Fischer: keeping a turn that fits costs 0, giving it another
role 3, deleting it 4, inserting an empty turn 3. Strings of the grammar differ in length only and end alike, so that one
table over (turns from here on, letters from here on) holds the alignments with all lengths; those with a system turn take
theirs from it behind each turn that could be that one. Ukkonen's band keeps of each row of the table only the lengths that
a repair no dearer than the incumbent, a greedy one, can pass through. Of all cheapest repairs, whatever their length, the one
whose audit (the initials of its edits) is least is traced back, all lengths side by side.

Turns reach Python sorted by conversation, as a stream. A conversation's letters and digests are held for its alignment, its
texts up to a bound; a conversation with more text than that is read a second time, behind its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from math import isqrt
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches
from tessera.storage import Workspace

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: What a cell outside the band costs.
FAR = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"
SOUND_ENDS = ".!?"
#: Bytes of texts of one conversation that a worker holds.
HELD_BYTES = 64 << 20
ROLES = {"u": "user", "a": "assistant"}


def greedy_cost(letters: str, forced: np.ndarray, truncated: np.ndarray) -> int:
    """The cost of a repair found in one pass: a turn that doesn't fit gets the wanted role if its successor then fits,
    else the missing turn is put before it."""
    left = [c for c, f in zip(letters, forced, strict=True) if not f]
    cost, want, first = 0, "u", 0
    if left and left[0] == "s":
        first = 1
        cost += DELETE if len(left) == 1 else 0
    for k, c in enumerate(left[first:], first):
        other = "a" if want == "u" else "u"
        if c == want:
            want = other
        elif c != other or (left[k + 1] if k + 1 < len(left) else "u") == other:
            cost, want = cost + REROLE, other
        else:
            cost += INSERT
    cost += INSERT * (want == "a")
    return min(cost + DELETE * int(forced.sum()) + TRUNCATED * int(truncated.sum()), DELETE * len(letters))


class Table:
    """Row i holds the costs of aligning the turns from i on with the last q letters of the grammar's strings, for the q
    of i's band. Every ``step``-th row is kept; a stretch of rows between is made again when the trace comes to it."""

    def __init__(self, letters: str, forced: np.ndarray, truncated: np.ndarray):
        self.letters, self.forced, self.truncated = letters, forced, truncated
        n = len(letters)
        behind = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]]).astype(np.int64)
        free, cut = behind(~forced), behind(truncated)
        slack = greedy_cost(letters, forced, truncated) - DELETE * int(forced.sum()) - TRUNCATED * int(truncated.sum())
        slack = max(slack, 0)
        # a deletion costs DELETE more than needs be, of a truncated turn only what it exceeds the fine by
        cheap = DELETE - TRUNCATED
        deleted = np.where(slack <= cut * cheap, slack // cheap, cut + np.maximum(slack - cut * cheap, 0) // DELETE)
        self.low, self.high = np.maximum(free - deleted, 0), free + slack // INSERT
        self.n, self.step = n, max(16, isqrt(n))
        self.kept = {n: INSERT * np.arange(self.low[n], self.high[n] + 1)}
        self.stretch: dict[int, np.ndarray] = {}
        self.starts: list[int] = []  # the turns that may be the system's
        self.led = np.full(int(self.high.max()) + 1, FAR, np.int64)  # least cost by the letters behind such a turn
        most, row = DELETE * int(forced.sum()) + TRUNCATED * int(truncated.sum()) + slack, self.kept[n]
        for i in range(n - 1, -1, -1):
            if letters[i] == "s" and not forced[i] and DELETE * i <= most:
                self.starts.append(i)
                self._put(self.led, 0, row + self.led_by(i), int(self.low[i + 1]))
            row = self._before(i, row)
            if i % self.step == 0:
                self.kept[i] = row

    def _before(self, i: int, after: np.ndarray) -> np.ndarray:
        low, high, low1 = int(self.low[i]), int(self.high[i]), int(self.low[i + 1])
        row = np.full(high - low + 1, FAR, np.int64)
        self._put(row, low, after + DELETE, low1)
        if not self.forced[i]:
            q = np.arange(low1 + 1, low1 + 1 + len(after))  # letters left when this turn is one of them
            fits = {"a": q % 2 == 1, "u": q % 2 == 0}.get(self.letters[i], np.zeros(len(q), bool))
            self._put(row, low, after + np.where(fits, 0, REROLE) + TRUNCATED * int(self.truncated[i]), low1 + 1)
        steps = INSERT * np.arange(len(row))
        return np.minimum.accumulate(row - steps) + steps

    @staticmethod
    def _put(row: np.ndarray, low: int, values: np.ndarray, start: int) -> None:
        a, b = max(low, start), min(low + len(row), start + len(values))
        if a < b:
            row[a - low : b - low] = np.minimum(row[a - low : b - low], values[a - start : b - start])

    def led_by(self, i: int) -> int:
        """The cost of all up to turn i, if that is the system's."""
        return DELETE * i + TRUNCATED * int(self.truncated[i])

    def row(self, i: int) -> np.ndarray:
        if i in self.kept:
            return self.kept[i]
        if i not in self.stretch:
            top = min(self.n, (i // self.step + 1) * self.step)
            row, self.stretch = self.kept[top], {}
            for k in range(top - 1, i // self.step * self.step, -1):
                row = self.stretch[k] = self._before(k, row)
        return self.stretch[i]

    def cost(self, i: int, q: int) -> int:
        row, at = self.row(i), q - int(self.low[i])
        return int(row[at]) if 0 <= at < len(row) else FAR


def align(letters: str, forced: np.ndarray, truncated: np.ndarray) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair with the least audit. letters: the roles' initials, forced: turns that must go,
    truncated: turns that cost a fine unless they go. The audit has D, I, K or R for each edit, in order."""
    n = len(letters)
    if n == 0:
        return 0, ""
    table = Table(letters, forced, truncated)
    plain = {q: table.cost(0, q) for q in range(int(table.low[0]), int(table.high[0]) + 1) if q % 2 == 0}
    fine = TRUNCATED * truncated.astype(np.int64)
    led = {q: int(c) for q, c in enumerate(table.led) if q >= 2 and q % 2 == 0}
    best = min([*plain.values(), *led.values()])
    # states of all cheapest repairs with the least audit so far: (q, None), or (q, places where the system turn may be)
    live = {(q, None) for q, c in plain.items() if c == best}
    for q in (q for q, c in led.items() if c == best):
        live.add((q, tuple(i for i in sorted(table.starts) if table.led_by(i) + table.cost(i + 1, q) == best)))
    audit, i = [], 0
    while not (i == n and any(s == (0, None) for s in live)):
        moves: dict[str, set] = {}
        for q, places in live:
            if places is not None:
                if later := tuple(p for p in places if p > i):
                    moves.setdefault("D", set()).add((q, later))
                if places[0] == i:
                    moves.setdefault("K", set()).add((q, None))
                continue
            here = table.cost(i, q)
            if i < n and here == DELETE + table.cost(i + 1, q):
                moves.setdefault("D", set()).add((q, None))
            if q and here == INSERT + table.cost(i, q - 1):
                moves.setdefault("I", set()).add((q - 1, None))
            if i < n and q and not forced[i]:
                fits = letters[i] == "ua"[q % 2]
                if here == int(fine[i]) + (0 if fits else REROLE) + table.cost(i + 1, q - 1):
                    moves.setdefault("K" if fits else "R", set()).add((q - 1, None))
        least = min(moves)
        live = moves[least]
        audit.append(least)
        i += least != "I"
    return best, "".join(audit)


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves, given the turns it was made for."""
    place = "u"  # the letter that comes next
    for edit in audit:
        if edit == "I":
            yield edit, ROLES[place], ""
        else:
            role, text = next(turns)
            if edit == "D":
                continue
            yield edit, role if edit == "K" else ROLES[place], text
            if edit == "K" and role[:1] == "s":
                continue
        place = "a" if place == "u" else "u"


class Conversation:
    """What is held of the conversation that the stream is in."""

    def __init__(self, conv_id, most: int):
        self.conv_id, self.most = conv_id, most
        self.letters, self.faults, self.turns = [], bytearray(), set()
        self.seen: set[bytes] = set()
        self.held: list[tuple[str, str]] | None = []
        self.bytes = 0

    def add(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.turns.add(turn)
        end = text.rstrip(BLANKS)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=32).digest()
        self.faults.append(1 if not end else 2 if key in self.seen else 3 if end[-1] not in SOUND_ENDS else 0)
        self.seen.add(key)
        self.letters.append(role[:1] or " ")
        self.bytes += len(role) + len(text)
        if self.held is not None:
            self.held.append((role, text))
            if self.bytes > self.most:
                self.held = None

    def summary(self) -> dict:
        faults, letters = np.frombuffer(bytes(self.faults), np.uint8), "".join(self.letters)
        cost, audit = align(letters, (faults == 1) | (faults == 2), faults == 3)
        counts = np.bincount(faults, minlength=4)
        return {
            "conv_id": self.conv_id,
            "gaps": max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0,
            "blank": int(counts[1]), "duplicate": int(counts[2]), "truncated": int(counts[3]),
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(self.letters, self.letters[1:], strict=False)),
            "cost": cost, "audit": audit,
        }


def digest(turns: Iterator[tuple[str, str, str]]) -> str:
    """sha256 of ``role:text`` of all turns, joined by line ends, taken in one after the other."""
    made = hashlib.sha256()
    for k, (_, role, text) in enumerate(turns):
        made.update(f"{chr(10) if k else ''}{role}:{text}".encode())
    return made.hexdigest()


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
AUDITED = f"{SUMMARY}, repaired_sha256 string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"
_KINDS = {"long": pa.int64(), "string": pa.string()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _KINDS[k]) for n, k in fields], [n for n, _ in fields])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _audited(most: int):
    def run(batches):
        done, now = [], None

        def end():
            turns = iter(now.held) if now.held is not None else None
            row = now.summary()
            done.append(row | {"repaired_sha256": digest(edited(row["audit"], turns)) if turns is not None else None})

        for conv_id, turn, role, text in _streamed(batches):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    end()
                now = Conversation(conv_id, most)
            if role is not None:
                now.add(turn, role, text)
            if len(done) >= 1024:
                yield _batch(done, AUDITED)
                done = []
        if now is not None:
            end()
        yield _batch(done, AUDITED)

    return run


def _rewritten(digests: bool):
    """Conversations behind their audit, (conv_id, audit, role, text) with the audit in the first row of each: their digests, or
    their repaired turns."""

    def run(batches):
        out, size, schema = [], 0, "conv_id long, repaired_sha256 string" if digests else REPAIRED
        for conv_id, rows in groupby(_streamed(batches), key=itemgetter(0)):
            turns = edited(next(rows)[1], (row[2:] for row in rows if row[2] is not None))
            if digests:
                out.append({"conv_id": conv_id, "repaired_sha256": digest(turns)})
                continue
            for place, (edit, role, text) in enumerate(turns):
                out.append({"conv_id": conv_id, "place": place, "edit": edit, "role": role, "text": text})
                size += len(text)
                if size > HELD_BYTES // 8 or len(out) >= 4096:
                    yield _batch(out, schema)
                    out, size = [], 0
        yield _batch(out, schema)

    return run


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): null roles and texts are one space. A row whose column ``dropped``, if there is one, is true
    only says that its conversation exists."""
    gone = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in conversations.columns else F.lit(False)
    filled = lambda c: F.when(~gone, F.coalesce(F.col(c), F.lit(" "))).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.when(~gone, F.col("turn").cast("long")).alias("turn"), filled("role"), filled("text"))


def _in_order(rows: DataFrame, *more: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv_id", *more, "turn", "role", "text")))


def _behind_audits(turns: DataFrame, audits: DataFrame) -> DataFrame:
    """Turns in order, with one row before each conversation's that has its audit; turns of other conversations are left out."""
    wanted = audits.select("conv_id", "audit")
    theirs = turns.join(wanted.select(F.col("conv_id").alias("c")), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    heads = wanted.selectExpr("conv_id", "0 AS kind", "audit", "CAST(NULL AS LONG) AS turn", "CAST(NULL AS STRING) AS role", "CAST(NULL AS STRING) AS text")
    rows = heads.unionByName(theirs.selectExpr("conv_id", "1 AS kind", "CAST(NULL AS STRING) AS audit", "turn", "role", "text"))
    return _in_order(rows, "kind").select("conv_id", "audit", "role", "text")


def audit(conversations: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row for each conversation of (conv_id, turn, role, text): gaps, faults, the cheapest repair's cost and audit, and the
    digest of what it leaves.

    Turns go by turn (nulls first), then role and text, so that repeated turn numbers have an order; repeated rows are
    duplicates. A role's initial is its first character; an empty role fits nowhere. Null roles and texts are one space. Null
    conv_ids are one conversation. A turn's first fault counts: blank, duplicate (role and text seen earlier), truncated. An empty table
    gives an empty one; other columns are left out. A conversation lies in one task, since its digest depends on all its turns in
    order; it is read there as a stream, and its texts are held up to ``held_bytes``.
    """
    spark = conversations.sparkSession
    bound_batches(spark)
    work = Workspace(spark, "conversations")
    turns = _turns(conversations)
    first = work.save(_in_order(turns).mapInArrow(_audited(held_bytes), AUDITED), "audits")
    long = first.where("repaired_sha256 is null")
    if long.isEmpty():
        return first
    again = work.save(_behind_audits(turns, long).mapInArrow(_rewritten(True), "conv_id long, repaired_sha256 string"), "long")
    known = first.where("repaired_sha256 is not null")
    joined = long.drop("repaired_sha256").join(again.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    return known.unionByName(joined.drop("c"))


def repair(conversations: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns that each conversation's repair leaves, in order from place 0; ``edit`` is
    K, R or I. Conversations of which nothing is left have no row. audits: what audit() gave, if it is there already."""
    bound_batches(conversations.sparkSession)
    return _behind_audits(_turns(conversations), audits if audits is not None else audit(conversations)).mapInArrow(_rewritten(False), REPAIRED)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with seeded damage, by the crc32 of ``conv_id:turn``, nulls being one space: of twenty turns one is dropped
    (a row with ``dropped`` stays in its place), one has its text emptied, one loses its full stops, one comes twice, one is the user's."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), times.alias("copy"))
