from __future__ import annotations

import hashlib
import heapq
import itertools
import random
import zlib

import duckdb

from tidewater.llm.structure import ORACLE, Scan, damaged, repair

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\v\f\r"


def _plain(rows):
    """The contract, a conversation at a time: uniform-cost search over (cost, script), so the first script found is the least."""
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, faults, marks = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, _, role, text in own:
            fault = "blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANK)[-1] not in ".!?" else None
            seen.add((role, text))
            marks.append(fault)
            if fault:
                faults[fault] += 1
        letters = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        queue, done = [(0, "", 0, "", ())], set()
        while True:
            cost, script, at, state, kept = heapq.heappop(queue)
            if at == len(own) and state in ("", "a"):
                break
            if (at, state) in done:
                continue
            done.add((at, state))
            then = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[then]
            heapq.heappush(queue, (cost + 3, script + "I", at, then, (*kept, f"{name}:")))
            if at < len(own):
                _, _, role, text = own[at]
                heapq.heappush(queue, (cost + 4, script + "D", at + 1, state, kept))
                if marks[at] not in ("blank", "duplicate"):
                    more = 3 * (marks[at] == "truncated")
                    heapq.heappush(queue, (cost + 3 + more, script + "R", at + 1, then, (*kept, f"{name}:{text}")))
                    if role and (role[0] == then or role[0] == "s" and state == ""):
                        heapq.heappush(queue, (cost + more, script + "K", at + 1, role[0], (*kept, f"{role}:{text}")))
        out[key] = (gaps, *faults.values(), illegal, cost, script, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def _got(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_every_short_conversation(spark):
    kinds = [("system", "a."), ("user", "b."), ("assistant", "c."), ("tool", "d!"), ("user", "e"), ("assistant", " ")]
    rows, key = [], 0
    for n in (1, 2, 3, 4):
        for picked in itertools.product(kinds, repeat=n):
            if n == 4 and key % 3 == 0:
                key += 1
                continue
            rows += [(key, t, role, text if text == " " else f"{t}{text}") for t, (role, text) in enumerate(picked)]
            key += 1
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", times long")
    assert _got(repair(df)) == _plain(rows)


def test_long_conversations_with_repeats(spark):
    rng = random.Random(5)
    rows = []
    for key in range(30):
        for t in range(rng.randrange(1, 60)):
            row = (key, rng.choice([t, t, t, max(t - 1, 0), None]), rng.choice(["user", "assistant", "assistant", "user", "system", "", "ünder"]), rng.choice(["yes.", "no!", "so", "", "\n \t", f"{t}?", f"{t} ", "x. ", "z. \r\n"]))
            rows += [row] * rng.choice([1, 1, 1, 2, 5])
    times: dict = {}
    for r in rows:
        times[r] = times.get(r, 0) + 1
    df = spark.createDataFrame([(*r, n) for r, n in times.items()], SCHEMA + ", times long").repartition(3)
    assert _got(repair(df)) == _plain(rows)


def test_a_hot_row_and_a_long_text(spark):
    rows = [(1, 0, "user", "again."), (1, 1, "assistant", "x" * 2_000_000 + "." + " " * 1_000_000)]
    df = spark.createDataFrame([(*rows[0], 100_000), (*rows[1], 1)], SCHEMA + ", times long")
    got = _got(repair(df))[1]
    assert got[:6] == (0, 0, 99_999, 0, 99_999, 4 * 99_999) and got[6] == "K" + "D" * 99_999 + "K"
    assert got[7] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows).encode()).hexdigest()


def _damaged(rows):
    out = []
    for key, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if key is None else key}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(key, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def test_damage_nulls_and_sql(spark):
    rng = random.Random(9)
    rows = [(rng.choice([*range(40), None]), rng.choice([*range(9), None]), rng.choice(["user", "assistant", "system", None]), rng.choice(["a.", "b", None, "", "c! ", "d?"])) for _ in range(400)]
    rows += [(99, t, "user", "only") for t in range(200, 2000) if zlib.crc32(f"99:{t}".encode()) % 20 == 0]  # nothing of it is left
    df = spark.createDataFrame(rows, SCHEMA)
    got = _got(repair(damaged(df.selectExpr("*", "1 AS times", "2 AS Kind", "3 AS fault", "4 AS symbol", "5 AS `after`"))))
    want = _plain(_damaged(rows))
    assert got == want | {k: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in {r[0] for r in rows} - set(want)}
    con = duckdb.connect()
    con.register("conversations", df.toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    sql = con.execute(f"SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 FROM ({ORACLE.strip()})").fetchall()
    assert {r[0]: tuple(r)[1:] for r in sql} == got
    assert repair(damaged(spark.createDataFrame([], SCHEMA))).count() == 0


def test_the_automaton_is_small_and_its_vectors_fit():
    scan, todo = Scan(), [0]
    while todo:
        state = todo.pop()
        for symbol in range(12):
            before = len(scan.vectors)
            scan.step(state, symbol)
            todo += range(before, len(scan.vectors))
    assert len(scan.vectors) < 500 and max(max(v) for v in scan.vectors) < 256
