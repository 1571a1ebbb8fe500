"""Conversation structure repair: the cheapest edits that make a conversation's roles follow a grammar.

Three weighted machines are composed lazily: an acceptor of the conversation's rows, a transducer of edits (Keep,
Rerole, Delete, Insert) and an acceptor of the role grammar (s?(ua)+)?. A state of the composition is a place between
two rows and a state of the grammar; its arcs are made only when a row of that kind is first met, and kept. The
shortest path is found in topological order from the last row back to the first. Weights are pairs (cost, labels) in
lexicographic order. That order holds when a label is put before two label strings (it need not when one is put behind
them), so going backwards is exact. Label strings are compared by their rank among the four strings of a place, so a
step takes constant time, and steps are remembered by (what follows, kind of row). Insertions at one place go from
grammar state to grammar state; a path that comes back to one costs more for nothing, so at most two are tried.

Spark does the rest: rows are damaged, ordered and marked by windows (all partitioned by the conversation) and written
once; tasks stream the marks of conversations (two numbers a row) to find the edits, then the rows behind their
conversation's edits to apply them. A conversation of any length takes one byte and one pointer a row; its texts are
never held together. Different conversations are spread by hash.

Cases: a null role or text counts as one space (a text that is blank, a role that is none of the three), as does a null
conv_id or turn in the checksum; rows with a null conv_id are one conversation; rows with equal turns go by role, then
text; null turns come first and don't count as gaps; roles count by their first letter; a number of gaps that a long
cannot hold is null; a conversation without rows has zeros, no edits and no text; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Batches, arrow_map, claim, materialize, sliced, table

SPACES = " \t\n\x0b\f\r"
#: Costs of the edits; a truncated row that stays costs TRUNCATED besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The grammar's states: nothing read, and after a system, a user and an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
GRAMMAR = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = {START, ASSISTANT}
ROLES = {"u": "user", "a": "assistant"}
#: Faults of a row, by number.
FAULTS = ("none", "truncated", "duplicate", "blank")
_INITIALS = "sua"
_LEGAL = {"su", "ua", "au"}
#: The role that the grammar takes from each state where an edit may choose it; there is one.
_FREE = {state: (role, after) for (state, role), after in GRAMMAR.items() if role in ROLES}

#: (cost, rank of the labels) of the cheapest way from each state.
Ahead = tuple[tuple[int, int], ...]


def edits(state: int, initial: str, fault: int) -> Iterator[tuple[str, int, int]]:
    """The composition's arcs that read a row: (label, cost, next state)."""
    yield "D", DELETE, state
    if FAULTS[fault] in ("none", "truncated"):
        more = TRUNCATED if FAULTS[fault] == "truncated" else 0
        if (state, initial) in GRAMMAR:
            yield "K", KEEP + more, GRAMMAR[state, initial]
        yield "R", REROLE + more, _FREE[state][1]


def _ranked(ways: list[tuple | None]) -> list[tuple | None]:
    """Each way (cost, label, rank of what follows, ...) with the rank of its whole label string."""
    order = {s: k for k, s in enumerate(sorted({w[1:3] for w in ways if w}))}
    return [w and (w[0], order[w[1:3]], w) for w in ways]


def _place(ways: list[tuple | None]) -> tuple[int, Ahead, tuple]:
    """With insertions before them: the least cost, costs beyond it with ranks, and for each state (labels, next state)."""
    layer = _ranked([w and (*w[:3], w[1], w[3]) for w in ways])
    first = layer
    for _ in range(2):
        found = []
        for state in range(4):
            role_after = _FREE[state][1]
            then = layer[role_after]
            inserted = then and (then[0] + INSERT, "I", then[1], "I" + then[2][3], then[2][4])
            own = first[state] and first[state][2]
            found.append(min((w for w in (own, inserted) if w), key=lambda w: w[:3], default=None))
        layer = _ranked(found)
    least = min(w[0] for w in layer)
    return least, tuple((w[0] - least, w[1]) for w in layer), tuple((w[2][3], w[2][4]) for w in layer)


@lru_cache(maxsize=None)  # as many as there are kinds of rows and ways ahead: costs differ by at most two insertions
def before(ahead: Ahead, initial: str, fault: int) -> tuple[int, Ahead, tuple]:
    """One step back over a row."""
    return _place([min((cost + ahead[to][0], label, ahead[to][1], to) for label, cost, to in edits(state, initial, fault)) for state in range(4)])


@lru_cache(maxsize=1)
def end() -> tuple[int, Ahead, tuple]:
    """Behind the last row."""
    return _place([(0, "", 0, None) if state in FINAL else None for state in range(4)])


def shortest(rows: bytes | bytearray) -> tuple[int, str]:
    """(cost, labels) of the cheapest edits of a conversation, given as one code() for each row."""
    cost, ahead, choice = end()
    choices = [choice]
    for code in reversed(rows):
        least, ahead, choice = before(ahead, (_INITIALS + "-")[code >> 2], code & 3)
        cost += least
        choices.append(choice)
    cost += ahead[START][0]
    labels, state = [], START
    while choices:
        own, state = choices.pop()[state]
        labels.append(own)
    return cost, "".join(labels)


def code(initial: str, fault: int) -> int:
    """A row as one byte: which of the three initials (3: none of them), and its fault."""
    at = _INITIALS.find(initial) if initial else -1
    return (at if at >= 0 else 3) << 2 | fault


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone, with the damage that each row's checksum tells."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("how") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), copies.alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


def _last(text: Column) -> Column:
    """The last character that is no white space; empty if there is none."""
    return F.substring(F.rtrim(text, F.lit(SPACES)), -1, 1)


def marked(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with their place in the conversation (from 1) and fault; rows that are gone only name their conversation."""
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", "gone").repartition("conv_id")
    turn = F.asc_nulls_first("turn")
    # partitioned by the conversation already: windows only sort
    alike = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", F.sha2("text", 256)).orderBy(turn))
    last = _last(F.col("text"))
    fault = F.when(last == "", 3).when(F.col("alike") > 1, 2).when(~last.isin(".", "!", "?"), 1).otherwise(0)
    own = Window.partitionBy("conv_id", "gone").orderBy(turn, "role", "text", "alike")
    return rows.withColumn("alike", alike).withColumn("place", F.row_number().over(own).cast("long")).select("conv_id", "gone", "place", "turn", "role", "text", fault.alias("fault"))


_FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Seen:
    """What is known of a conversation whose rows come by."""

    def __init__(self, conv: int | None):
        self.conv, self.rows, self.faults, self.illegal = conv, bytearray(), [0] * 4, 0
        self.initial = self.low = self.high = None
        self.turns = 0

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        self.illegal += self.initial is not None and self.initial + initial not in _LEGAL
        self.initial = initial
        self.faults[fault] += 1
        self.rows.append(code(initial, fault))
        if turn is not None:  # in ascending order
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def found(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps if gaps < 1 << 63 else None, self.faults[3], self.faults[2], self.faults[1], self.illegal, *shortest(self.rows))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), columns, strict=True)], [n for n, _ in columns])


def _grouped(batches: Batches, rows: int = 512) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples."""
    for batch in sliced(batches, rows):
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def repairs(rows: DataFrame) -> DataFrame:
    """For each conversation of marked rows its faults and the cheapest edits (audit)."""
    slim = rows.select("conv_id", "gone", "place", "turn", F.substring("role", 1, 1).alias("initial"), "fault").repartition("conv_id").sortWithinPartitions("conv_id", "gone", "place")

    def run(batches: Batches) -> Batches:
        claim("repairs", before.cache_clear)
        seen, out = None, []
        for conv, gone, _, turn, initial, fault in _grouped(batches, 4096):
            if seen is None or seen.conv != conv:
                if seen is not None:
                    out.append(seen.found())
                if len(out) >= 4096:
                    yield _batch(out, _FOUND)
                    out = []
                seen = _Seen(conv)
            if not gone:
                seen.add(turn, initial, fault)
        if seen is not None:
            out.append(seen.found())
        if out:
            yield _batch(out, _FOUND)

    return arrow_map(slim, run, _FOUND)


_TURNS = "conv_id long, place long, role string, text string"
#: Characters of texts that leave a task together.
_OUT_CHARS = 1 << 20


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, place, role, text) of marked rows and repairs(rows); a conversation's turns come together, in order."""
    heads = found.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.filter(~F.col("gone")).select("conv_id", "place", "role", "text").union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "place")

    def run(batches: Batches) -> Batches:
        claim("repaired")
        out, chars = [], 0
        audit, at, state, n = "", 0, START, 0
        for conv, place, role, text in _grouped(batches):
            if place == 0:
                audit, at, state, n, own = text, 0, START, 0, None
            else:
                own = (role, text)
            while at < len(audit):
                label = audit[at]
                if label != "I" and own is None:
                    break
                at += 1
                if label == "D":
                    break_after = True
                elif label == "K":
                    state, turn, break_after = GRAMMAR[state, own[0][:1]], own, True
                else:
                    free, state = _FREE[state]
                    turn, break_after = (ROLES[free], "" if label == "I" else own[1]), label == "R"
                if label != "D":
                    n += 1
                    out.append((conv, n, *turn))
                    chars += len(turn[1])
                if break_after:
                    own = None
            if chars > _OUT_CHARS or len(out) >= 4096:
                yield _batch(out, _TURNS)
                out, chars = [], 0
        if out:
            yield _batch(out, _TURNS)

    return arrow_map(both, run, _TURNS)


def _hashes(turns: DataFrame) -> DataFrame:
    """conv_id and the sha256 of its `role:text` lines, of turns that come together in order."""

    def run(batches: Batches) -> Batches:
        own, out = None, []
        for conv, _, role, text in _grouped(batches):
            if own is None or own[0] != conv:
                if own is not None:
                    out.append((own[0], own[1].hexdigest()))
                if len(out) >= 4096:
                    yield _batch(out, _HASHED)
                    out = []
                own = (conv, hashlib.sha256())
            else:
                own[1].update(b"\n")
            own[1].update(f"{role}:{text}".encode())
        if own is not None:
            out.append((own[0], own[1].hexdigest()))
        if out:
            yield _batch(out, _HASHED)

    return arrow_map(turns, run, _HASHED)


_HASHED = "own_conv long, hash string"


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(marked(damaged(table(spark, sf_dir, "conversations"))), "marked")
    found = materialize(repairs(rows), "repairs")
    hashed = _hashes(repaired(rows, found))
    out = found.join(hashed, F.col("conv_id").eqNullSafe(F.col("own_conv")), "left")
    empty = hashlib.sha256().hexdigest()
    return out.select(*found.columns, F.coalesce("hash", F.lit(empty)).alias("repaired_sha256"))


def _sql_add(weight: str, cost: str, label: str) -> str:
    """A weight in SQL is its cost in nine digits, then its labels; so text order is the order of weights."""
    return f"(lpad((substr({weight}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || '{label}' || substr({weight}, 10))"


def _sql_step() -> tuple[str, str, str]:
    """The select lists of one step back: over the row, and with up to one and two insertions before it."""
    read, once, twice = [], [], []
    for q in range(4):
        keep = " ".join(f"WHEN b.x = '{x}' THEN {_sql_add(f'w{to}', f'{KEEP} + more', 'K')}" for (s, x), to in GRAMMAR.items() if s == q)
        free = _FREE[q][1]
        stay = f"CASE WHEN b.fault < 2 THEN least({_sql_add(f'w{free}', f'{REROLE} + more', 'R')}, CASE {keep} END) END"
        read.append(f"least({_sql_add(f'w{q}', str(DELETE), 'D')}, {stay}) AS v{q}")
        once.append(f"least(v{q}, {_sql_add(f'v{free}', str(INSERT), 'I')}) AS u{q}")
        twice.append(f"least(v{q}, {_sql_add(f'u{free}', str(INSERT), 'I')}) AS w{q}")
    return ", ".join(read), ", ".join(once), ", ".join(twice)


_READ, _ONCE, _TWICE = _sql_step()
_BYTES = "list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda s: ascii(s)::BIGINT)"
_CRC32 = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b:
  list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

ORACLE_SQL = f"""
WITH RECURSIVE source AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32} % 20 AS how FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, unnest(CASE how WHEN 3 THEN [1, 2] ELSE [1] END) AS copy,
    CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM source WHERE how <> 0),
told AS (
  SELECT *, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS alike FROM hurt),
placed AS MATERIALIZED (
  SELECT conv_id, turn, role, text, left(role, 1) AS x, row_number() OVER own AS place,
    CASE WHEN last = '' THEN 3 WHEN alike > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
    lag(left(role, 1)) OVER own || left(role, 1) AS pair
  FROM told WINDOW own AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, alike)),
counts AS MATERIALIZED (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM placed GROUP BY conv_id),
back(conv_id, place, w0, w1, w2, w3) AS (
  SELECT conv_id, n, '000000000', '000000010II', '000000005I', '000000000' FROM counts
  UNION ALL
  SELECT conv_id, place, {_TWICE} FROM (SELECT *, {_ONCE} FROM (
    SELECT conv_id, place, {_READ} FROM (
      SELECT r.conv_id, r.place - 1 AS place, w0, w1, w2, w3, p.x, p.fault, CASE WHEN p.fault = 1 THEN {TRUNCATED} ELSE 0 END AS more
      FROM back r JOIN placed p ON p.conv_id = r.conv_id AND p.place = r.place) b))),
cheapest AS MATERIALIZED (SELECT conv_id, substr(w0, 1, 9)::BIGINT AS cost, substr(w0, 10) AS audit FROM back WHERE place = 0),
labels AS (SELECT conv_id, unnest(string_split(audit, '')) AS label, unnest(range(len(audit))) AS k FROM cheapest WHERE audit <> ''),
reading AS (SELECT *, sum(CASE WHEN label = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY k) AS place FROM labels),
written AS (
  SELECT r.conv_id, r.label, p.role, p.x, CASE WHEN r.label = 'I' THEN '' ELSE p.text END AS text, row_number() OVER (PARTITION BY r.conv_id ORDER BY k) AS m
  FROM reading r LEFT JOIN placed p ON p.conv_id = r.conv_id AND p.place = r.place WHERE r.label <> 'D'),
leads AS (SELECT *, max(CASE WHEN m = 1 AND label = 'K' AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM written),
hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN label = 'K' THEN role WHEN (m - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY m)) AS hash
  FROM leads GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(hash, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts USING (conv_id) LEFT JOIN cheapest USING (conv_id) LEFT JOIN hashed USING (conv_id)
"""
