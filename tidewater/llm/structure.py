"""Conversation structure repair (operator 11) by lazy weighted determinisation.

A conversation should read ``(s?(ua)+)?`` by the first letters of its roles.  Edits cost:
keeping a row nothing, giving it another role, deleting it or inserting an empty one a
fixed price.  The grammar's four states make a weighted automaton; the costs of all four
after a row are a vector, and vectors that are equal but for a constant lead to equal ones.
So each normalised vector is a state of a deterministic automaton, found when it is first
met and kept in a transition table: a row is one lookup and one addition.

The scan runs from the last row to the first, so a vector says what the rest of a
conversation costs from each grammar state.  The trace then runs against the scan, in
reading order: from the start it follows the least letter whose cost is tight, which gives
the ASCII-least of the cheapest edit scripts and, as it goes, the repaired text.

A conversation's rows stream through one task, for its repaired text has one digest: what
the task holds of it is a letter a row (the script it returns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, short_batches, table

# Costs of the edits, and what a kept or reroled truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar states: nothing yet, after a system row, after a user row, after an assistant row.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
#: The role that a new or reroled row gets in each state, and the state it leads to.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What a row kept leads to, by its letter and the state before.
KEPT = {"s": {EMPTY: SYSTEM}, "u": {EMPTY: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: A row's symbol: its letter's place in ``_LETTERS`` times three, plus 0 (sound), 1 (truncated) or 2 (has to go).
_LETTERS = "sua-"
#: White space; a text of nothing else is blank.
BLANKS = " \t\n\v\f\r"
_DIGITS = 8  # of a packed vector's entry, in bits


def _closed(costs: list[int]) -> tuple[int, ...]:
    """The costs once rows may also be inserted first; two in a row reach every state that a row can lead to."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


def _consumed(symbol: int, after: tuple[int, ...]) -> list[list[tuple[str, int, int]]]:
    """Per state, the (letter, cost with what follows, state) of the edits that use up a row."""
    letter, fault = _LETTERS[symbol // 3], symbol % 3
    options = []
    for q in range(4):
        own = [("D", DELETE + after[q], q)]
        if fault < 2:
            extra = TRUNCATED * fault
            kept = KEPT.get(letter, {}).get(q)
            if kept is not None:
                own.append(("K", extra + after[kept], kept))
            own.append(("R", REROLE + extra + after[NEXT[q]], NEXT[q]))
        options.append(own)
    return options


class Scan:
    """The deterministic automaton, as far as it has been met.

    A state is a normalised vector; ``table`` has, by state and symbol, the state before the
    row and what its constant is more.  Vectors differ by at most two insertions and a
    deletion in their entries, so there are few however long the conversations are.
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.places: dict[tuple[int, ...], int] = {}
        self.table: dict[int, tuple[int, int]] = {}
        self.end = self.place(_closed([0, 1 << 20, 1 << 20, 0]))[0]

    def place(self, costs: tuple[int, ...]) -> tuple[int, int]:
        low = min(costs)
        vector = tuple(c - low for c in costs)
        if vector not in self.places:
            self.places[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.places[vector], low

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a row of this symbol, and the cost it adds to all entries."""
        known = self.table.get(state << 4 | symbol)
        if known is None:
            options = _consumed(symbol, self.vectors[state])
            known = self.table[state << 4 | symbol] = self.place(_closed([min(c for _, c, _ in own) for own in options]))
        return known


def packed(vector: tuple[int, ...]) -> int:
    """A normalised vector as one integer, the same in every process."""
    return sum(c << _DIGITS * i for i, c in enumerate(vector))


def unpacked(code: int) -> tuple[int, ...]:
    return tuple(code >> _DIGITS * i & (1 << _DIGITS) - 1 for i in range(4))


class Trace:
    """The cheapest edits of one conversation, least letters first, as rows come in reading order."""

    def __init__(self):
        self.choices: dict[tuple[int, int, int], tuple[str, tuple[int, ...]]] = {}

    def edits(self, state: int, symbol: int | None, after: int) -> tuple[str, tuple[int, ...]]:
        """The letters up to and with the one that uses up a row (all that is left, if there is none), and the states they lead to."""
        known = self.choices.get(key := (state, -1 if symbol is None else symbol, after))
        if known is None:
            known = self.choices[key] = self._edits(state, symbol, unpacked(after))
        return known

    def _edits(self, state: int, symbol: int | None, after: tuple[int, ...]) -> tuple[str, tuple[int, ...]]:
        if symbol is None:
            here, options = after, [[] for _ in range(4)]
        else:
            options = _consumed(symbol, after)
            here = _closed([min(c for _, c, _ in own) for own in options])
        letters, states = "", []
        while symbol is not None or here[state]:
            own = [*options[state], ("I", INSERT + here[NEXT[state]], NEXT[state])]
            letter, state = min((x, q) for x, c, q in own if c == here[state])
            letters += letter
            states.append(state)
            if letter != "I":
                break
        return letters, tuple(states)


def _symbols(rows: DataFrame) -> DataFrame:
    """Rows with their first fault, their symbol and their number in the conversation, parted and sorted by conversation."""
    # rows that are equal throughout are one row that stands so many times; no other row of the conversation comes between
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("times").cast("boolean").desc(), F.col("turn").asc_nulls_first())) > 1
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(last == "", "blank").when(again, "duplicate").when(~last.rlike("[.!?]"), "truncated")
    letter = F.instr(F.lit(_LETTERS[:3]), F.substring("role", 1, 1))
    code = F.when((letter > 0) & (F.col("role") != ""), letter - 1).otherwise(3) * 3
    return rows.repartition("conv_id").withColumn("fault", fault).withColumn("symbol", (code + F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)).cast("int"))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation with its gaps, faults, the cheapest edits and the digest of what they make of it.

    ``rows`` has ``conv_id, turn, role, text, times``: a row stands ``times`` times in a row; one
    of 0 only says that there is such a conversation.  Columns: ``conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows are read by turn (nulls first), then role and text, so ties do not depend on the
    run.  A role or text is not null; an empty role has no letter and cannot be kept; any
    other role but those that begin with s, u or a cannot either.  Null ids are one
    conversation.  Texts may be of any length: they pass through and are hashed as they
    come.  A conversation without rows has zeros, no edits and the digest of nothing; an
    empty table gives no rows.
    """
    conv, turn = rows.schema["conv_id"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    marked = _symbols(rows.select("conv_id", "turn", "role", "text", "times"))
    backward = short_batches(marked).sortWithinPartitions(F.col("conv_id").asc(), F.col("turn").desc_nulls_last(), F.col("role").desc(), F.col("text").desc())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, held, state = Scan(), (), 0
        codes: list[int] = []
        for batch in batches:
            after = []
            for key, symbol, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "symbol", "times"))):
                if held != (key,):
                    held, state = (key,), automaton.end
                after.append(state)
                if times:
                    state = automaton.step(state, symbol)[0]  # its repeats have to go, which changes no difference
            codes.extend(packed(v) for v in automaton.vectors[len(codes) :])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([codes[s] for s in after], pa.int64())], [*batch.schema.names, "after"])

    scanned = backward.mapInArrow(scan, f"conv_id {conv}, turn {turn}, role string, text string, times long, fault string, symbol int, after long")
    forward = scanned.sortWithinPartitions(F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), "role", "text")
    schema = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string".format(conv)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracer, end, held = Trace(), packed(Scan().vectors[0]), None
        names = [x.split()[0] for x in schema.split(", ")]
        done: list[tuple] = []
        for batch in batches:
            for key, turn, role, text, times, fault, symbol, after in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or held.key != key:
                    if held:
                        done.append(held.ended(tracer, end))
                    held = _Conversation(key)
                if times:
                    held.row(tracer, turn, role, text, times, fault, symbol, after)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in done], schema=_arrow(batch.schema.field("conv_id").type, names))
                done = []
            last = batch.schema.field("conv_id").type
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(names, held.ended(tracer, end)))], schema=_arrow(last, names))

    return forward.mapInArrow(trace, schema)


def _arrow(conv: pa.DataType, names: list[str]) -> pa.Schema:
    return pa.schema([(n, conv if i == 0 else pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for i, n in enumerate(names)])


class _Conversation:
    """What is known of a conversation while its rows pass."""

    def __init__(self, key):
        self.key, self.state, self.letter, self.cost = key, EMPTY, None, 0
        self.low = self.high = self.turn = None
        self.turns = self.illegal = self.rows = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
        self.rows += 1

    def row(self, tracer: Trace, turn, role: str, text: str, times: int, fault: str | None, symbol: int, after: int) -> None:
        letter = role[:1]
        if self.letter is not None:
            self.illegal += self.letter + letter not in ("su", "ua", "au")
        self.letter = letter
        self.illegal += times - 1
        if fault:
            self.faults[fault] += 1
        # a repeat is blank if the row is, and seen earlier otherwise
        self.faults["blank" if fault == "blank" else "duplicate"] += times - 1
        if turn is not None and turn != self.turn:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turn, self.turns = turn, self.turns + 1
        letters, states = tracer.edits(self.state, symbol, after)
        for x, q in zip(letters, states):
            if x == "I":
                self.insert(q)
            elif x == "D":
                self.cost += DELETE
            else:
                self.cost += REROLE * (x == "R") + TRUNCATED * (fault == "truncated")
                self.add(role if x == "K" else ROLE[q], text)
        self.state = states[-1]
        self.audit.append(letters + "D" * (times - 1))
        self.cost += DELETE * (times - 1)

    def insert(self, state: int) -> None:
        self.cost += INSERT
        self.add(ROLE[state], "")

    def ended(self, tracer: Trace, end: int) -> tuple:
        letters, states = tracer.edits(self.state, None, end)
        for q in states:
            self.insert(q)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.key, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit) + letters, self.digest.hexdigest())


def damaged(turns: DataFrame) -> DataFrame:
    """The rows with the contract's faults put in, as :func:`repair` takes them; nulls become one space, dropped rows leave their conversation's id."""
    blank = F.lit(" ")
    rows = turns.select("conv_id", "turn", F.coalesce(column("role"), blank).alias("role"), F.coalesce(column("text"), blank).alias("text"))
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    rows = rows.withColumn("kind", kind)
    there = F.col("kind") != 0
    return rows.select(
        "conv_id",
        F.when(there, F.col("turn")).alias("turn"),
        F.when(there, F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))).otherwise("").alias("role"),
        F.when(~there | (F.col("kind") == 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(there, F.when(F.col("kind") == 3, 2).otherwise(1)).otherwise(0).cast("long").alias("times"),
    )


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every damaged conversation."""
    return repair(damaged(table(spark, sf_dir, "conversations")))


# The cheapest edits by another way: forward, each grammar state keeping its best (cost, edits, text).
ORACLE = r"""
WITH base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), kinds AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(name) + 1), lambda i: ord(name[i:i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))
  ), 4294967295::BIGINT) % 20 AS kind FROM base
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, (SELECT unnest([1, 2]) AS copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail, substr(role, 1, 1) AS letter FROM damaged
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM numbered
), faulty AS (
  SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         lag(letter) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM seen
), whole AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE before IS NOT NULL AND before || letter NOT IN ('su', 'ua', 'au')) AS illegal,
         list({'role': role, 'text': text, 'letter': letter, 'fault': coalesce(fault, ''), 's0': {'c': 0, 'a': '', 't': ''}, 's1': {'c': 0, 'a': '', 't': ''}, 's2': {'c': 0, 'a': '', 't': ''}, 's3': {'c': 0, 'a': '', 't': ''}} ORDER BY n) AS r
  FROM faulty GROUP BY conv_id
), first AS (
  SELECT *, {'role': '', 'text': '', 'letter': '', 'fault': '', 's0': {'c': 0, 'a': '', 't': ''}, 's1': {'c': 99999, 'a': '', 't': ''},
             's2': {'c': 3, 'a': 'I', 't': chr(10) || 'user:'}, 's3': {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS head FROM whole
), folded AS (
  SELECT * EXCLUDE (r, head), list_reduce(list_prepend(head, r), lambda x, y:
    list_transform([{
      'd0': {'c': x.s0.c + 4, 'a': x.s0.a || 'D', 't': x.s0.t},
      'd1': list_min([{'c': x.s1.c + 4, 'a': x.s1.a || 'D', 't': x.s1.t},
        {'c': CASE WHEN y.letter = 's' AND y.fault NOT IN ('blank', 'duplicate') THEN x.s0.c + CASE WHEN y.fault = 'truncated' THEN 3 ELSE 0 END ELSE 99999 END, 'a': x.s0.a || 'K', 't': x.s0.t || chr(10) || y.role || ':' || y.text}]),
      'd2': list_min(list_prepend({'c': x.s2.c + 4, 'a': x.s2.a || 'D', 't': x.s2.t}, flatten(list_transform([x.s0, x.s1, x.s3], lambda p: [
        {'c': CASE WHEN y.letter = 'u' AND y.fault NOT IN ('blank', 'duplicate') THEN p.c + CASE WHEN y.fault = 'truncated' THEN 3 ELSE 0 END ELSE 99999 END, 'a': p.a || 'K', 't': p.t || chr(10) || y.role || ':' || y.text},
        {'c': CASE WHEN y.fault NOT IN ('blank', 'duplicate') THEN p.c + 3 + CASE WHEN y.fault = 'truncated' THEN 3 ELSE 0 END ELSE 99999 END, 'a': p.a || 'R', 't': p.t || chr(10) || 'user:' || y.text}])))),
      'd3': list_min([{'c': x.s3.c + 4, 'a': x.s3.a || 'D', 't': x.s3.t},
        {'c': CASE WHEN y.letter = 'a' AND y.fault NOT IN ('blank', 'duplicate') THEN x.s2.c + CASE WHEN y.fault = 'truncated' THEN 3 ELSE 0 END ELSE 99999 END, 'a': x.s2.a || 'K', 't': x.s2.t || chr(10) || y.role || ':' || y.text},
        {'c': CASE WHEN y.fault NOT IN ('blank', 'duplicate') THEN x.s2.c + 3 + CASE WHEN y.fault = 'truncated' THEN 3 ELSE 0 END ELSE 99999 END, 'a': x.s2.a || 'R', 't': x.s2.t || chr(10) || 'assistant:' || y.text}])
    }], lambda d: {'role': '', 'text': '', 'letter': '', 'fault': '', 's0': d.d0, 's1': d.d1,
      's2': list_min([d.d2, {'c': d.d0.c + 3, 'a': d.d0.a || 'I', 't': d.d0.t || chr(10) || 'user:'}, {'c': d.d1.c + 3, 'a': d.d1.a || 'I', 't': d.d1.t || chr(10) || 'user:'}, {'c': d.d3.c + 3, 'a': d.d3.a || 'I', 't': d.d3.t || chr(10) || 'user:'}]),
      's3': list_min([d.d3, {'c': d.d2.c + 3, 'a': d.d2.a || 'I', 't': d.d2.t || chr(10) || 'assistant:'}, {'c': d.d0.c + 6, 'a': d.d0.a || 'II', 't': d.d0.t || chr(10) || 'user:' || chr(10) || 'assistant:'},
        {'c': d.d1.c + 6, 'a': d.d1.a || 'II', 't': d.d1.t || chr(10) || 'user:' || chr(10) || 'assistant:'}])})[1]) AS z FROM first
), best AS (SELECT * EXCLUDE (z), list_min([z.s0, z.s3]) AS b FROM folded)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""
