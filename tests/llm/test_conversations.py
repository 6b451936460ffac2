"""Turn repair against a search over all edits, and against a plain reading of the contract."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from tessera.llm import conversations as c
from tessera.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, audit string, dropped_ string, place int"


def cheapest(letters, forced, truncated):
    """(cost, audit) over all sequences of edits, by the grammar's states: start, behind s, pair open, pairs closed."""
    step = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(letters) and state in (0, 3) else []
        take = lambda cost, letter, rest: found.append((cost + rest[0], letter + rest[1])) if rest else None
        for letter, after in step[state]:
            if letter != "s" and inserted < 3:
                take(3, "I", best(i, after, inserted + 1))
            if i < len(letters) and not forced[i]:
                if letters[i] == letter:
                    take(3 * truncated[i], "K", best(i + 1, after, 0))
                elif letter != "s":
                    take(3 + 3 * truncated[i], "R", best(i + 1, after, 0))
        if i < len(letters):
            take(4, "D", best(i + 1, state, 0))
        return min(found, default=None)

    return best(0, 0, 0)


def test_alignment_against_all_edits():
    rng = random.Random(5)
    for _ in range(1500):
        n = rng.randint(0, 9)
        letters = "".join(rng.choice("uuaasx ") for _ in range(n))
        forced = [rng.random() < 0.2 for _ in range(n)]
        truncated = [not f and rng.random() < 0.3 for f in forced]
        got = c.align(letters, np.array(forced, bool), np.array(truncated, bool))
        assert got == cheapest(letters, tuple(forced), tuple(truncated)), (letters, forced, truncated)


def test_bands_hold_in_long_conversations():
    """The table with bands and stored rows agrees with the one over all lengths."""
    rng = random.Random(6)
    for n in (60, 150):
        letters = "".join(rng.choice("uas") if rng.random() < 0.3 else "ua"[i % 2] for i in range(n))
        forced = np.array([rng.random() < 0.1 for _ in range(n)])
        truncated = ~forced & np.array([rng.random() < 0.2 for _ in range(n)])
        cost, audit = c.align(letters, forced, truncated)
        assert cost == 3 * audit.count("R") + 4 * audit.count("D") + 3 * audit.count("I") + 3 * sum(bool(t) for t, e in zip(truncated, audit.replace("I", ""), strict=True) if e != "D")
        full = {n: {q: 3 * q for q in range(2 * n + 1)}}
        for i in range(n - 1, -1, -1):
            row = {}
            for q in range(2 * n + 1):
                found = [4 + full[i + 1][q]] + ([3 + row[q - 1]] if q else [])
                if q and not forced[i]:
                    found.append(full[i + 1][q - 1] + 3 * truncated[i] + (0 if letters[i] == "ua"[q % 2] else 3))
                row[q] = min(found)
            full[i] = row
        led = [4 * i + 3 * truncated[i] + full[i + 1][q] for i in range(n) if letters[i] == "s" and not forced[i] for q in range(2, 2 * n, 2)]
        assert cost == min([full[0][q] for q in range(0, 2 * n + 1, 2)] + led)


def plain(rows):
    """The contract, read row by row: {conv_id: result}."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = []
        for _, turn, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        seen, faults = set(), []
        for _, role, text in turns:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        letters = "".join(role[:1] or " " for _, role, _ in turns)
        cost, audit = cheapest(letters, tuple(f in ("blank", "duplicate") for f in faults), tuple(f == "truncated" for f in faults))
        lines, i, want = [], 0, "u"
        for e in audit:
            role, text = turns[i][1:] if e != "I" else (None, "")
            i += e != "I"
            if e != "D":
                new = role if e == "K" else {"u": "user", "a": "assistant"}[want]
                lines.append(f"{new}:{text}")
                want = want if new[:1] == "s" else "a" if want == "u" else "u"
        numbers = [t for t, _, _ in turns if t is not None]
        out[conv] = {
            "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum((a[1][:1] or " ") + (b[1][:1] or " ") not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False)),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }
    return out


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(7)
    rows = [(1, 0, "user", "A."), (1, 0, "user", "A."), (1, None, None, None), (None, 3, "user", "x?"), (None, None, "", ""), (2, 5, "system", "S!"), (3, 2**40, "assistant", "y" * 50_000)]
    for conv in range(10, 60):
        rows += [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "Tool", ""]), rng.choice(["a.", "b", "c!", " \t", "é?", "a."])) for t in range(rng.randint(1, 9)) if rng.random() > 0.1]
    return rows


def test_odd_rows_against_the_plain_reading(spark, odd_rows):
    df = spark.createDataFrame([(*r, None, None, None) for r in odd_rows], SCHEMA)
    want = plain(odd_rows)
    for held in (c.HELD_BYTES, 8):  # with the texts at hand, and read a second time
        got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in c.audit(c.damaged(df), held).collect()}
        assert got == want


def test_repaired_turns_spell_the_grammar(spark, odd_rows):
    df = spark.createDataFrame([(*r, None, None, None) for r in odd_rows], SCHEMA)
    broken = c.damaged(df)
    audits = c.audit(broken)
    turns = {}
    for r in c.repair(broken, audits).collect():
        turns.setdefault(r["conv_id"], []).append((r["place"], r["edit"], r["role"], r["text"]))
    for a in audits.collect():
        own = sorted(turns.get(a["conv_id"], []))
        assert [p for p, *_ in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for _, _, role, _ in own))
        assert "".join(e for _, e, _, _ in own) == a["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in own).encode()).hexdigest() == a["repaired_sha256"]


def test_table_against_the_plain_reading(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in queries.op11_turn_repair(spark, sf).collect()}
    assert got == plain(rows)


def test_empty(spark):
    assert c.audit(c.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    assert c.repair(spark.createDataFrame([], SCHEMA)).count() == 0
