"""Conversation structure repair by weighted CYK parsing over intervals of turns.

1. Spark damages the rows, marks repeats of (role, text) by one aggregate per conversation, and deals whole conversations in
   the order of their turns to tasks. A conversation of any length is read as a stream.
2. A row is one of nine symbols: its initial, with or without a truncated text, or a row that must go. Legal roles are
   read by four states (nothing yet, after s, after u, after a). A nonterminal names two states: it derives every span that
   leads from the first to the second. In Chomsky normal form it is a pair of nonterminals that share the state between
   them, or one row under one edit; runs of inserted turns, which derive the empty span, are closed into the leaves on both sides.
3. Cells hold the least (cost, audit). Chunks of ``CHUNK`` rows are filled bottom-up by span length over all splits, and the cell
   of a chunk joins the cells of everything before it. Of audits with one cost none is a proper prefix of another (it would
   hold more insertions), so least parts make the least whole.
4. Beside each open state the repaired lines go straight into a running SHA-256, so no text is held. The audit's settled
   beginning, common to all open states, is set aside; states that another one beats for certain are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, table, unkeyed

# Fixed values of the contract: damage by remainder, costs of edits, closing marks, blanks.
DROP, EMPTY, UNMARK, REPEAT, RECAST, PARTS = 0, 1, 2, 3, 4, 20
RECAST_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5
MARKS = ".!?"
BLANK = " \t\n\x0b\x0c\r"
CHUNK = 8

START, S, U, A = range(4)
STEP = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
FINAL = (START, A)
NAMES = {"u": "user", "a": "assistant"}
# The one role that a new or recast turn can have in a state.
NEXT = {p: (role, q) for (p, role), q in STEP.items() if role in NAMES}

Cell = dict[tuple[int, int], tuple[int, str]]


def least(cells: Cell, key: tuple[int, int], cost: int, audit: str) -> None:
    if key not in cells or (cost, audit) < cells[key]:
        cells[key] = cost, audit


def joined(left: Cell, right: Cell, into: Cell) -> Cell:
    """Binary rules: (p, q) from (p, r) and (r, q)."""
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (more, rest) in right.items():
            if r == r2:
                least(into, (p, q), cost + more, audit + rest)
    return into


def inserted() -> Cell:
    """The least run of insertions between every two states."""
    cells: Cell = {(p, p): (0, "") for p in range(4)}
    single = {(p, q): (INSERT_COST, "I") for p, (_, q) in NEXT.items()}
    for _ in range(4):
        joined(dict(cells), single, cells)
    return cells


INSERTED = inserted()
# What a state pays at most to go on like another: by insertions, or by deleting the s that only the start can take.
INSTEAD = {(p, q): INSERTED[p, q][0] for p, q in product(range(4), repeat=2) if (p, q) in INSERTED}
INSTEAD |= {(START, S): 0, (A, S): 0, (A, START): DELETE_COST, (U, S): INSERT_COST, (U, START): INSERT_COST + DELETE_COST}


@lru_cache(maxsize=512)
def leaf(symbol: str) -> Cell:
    """Cells of one row: d must go; s, u, a and x (another initial) may stay, in capitals truncated."""
    cells: Cell = {(p, p): (DELETE_COST, "D") for p in range(4)}
    if symbol != "d":
        extra = TRUNCATED_COST if symbol.isupper() else 0
        for p in range(4):
            kept = STEP.get((p, symbol.lower()))
            if kept is not None:
                least(cells, (p, kept), extra, "K")
            least(cells, (p, NEXT[p][1]), extra + RECAST_COST, "R")
    return joined(joined(INSERTED, cells, {}), INSERTED, {})


@lru_cache(maxsize=100_000)
def parsed(symbols: str) -> Cell:
    """Cell of a whole chunk: spans bottom-up by length, each from all of its splits."""
    n = len(symbols)
    spans = {(i, i + 1): leaf(symbols[i]) for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            cell: Cell = {}
            for split in range(i + 1, i + length):
                joined(spans[i, split], spans[split, i + length], cell)
            spans[i, i + length] = cell
    return spans[0, n]


def initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else "x"


class Conversation:
    """Running answer of one conversation, fed with its rows in order."""

    def __init__(self) -> None:
        self.chunk: list[tuple[str, str, str]] = []
        # Per open state: cost, audit behind the settled part, hash of the repaired lines.
        self.open = {p: (cost, audit, self.lines(hashlib.sha256(), START, audit, [])) for (start, p), (cost, audit) in INSERTED.items() if start == START}
        self.settled: list[str] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.last: str | None = None
        self.turns: list[int] = []
        self.distinct = 0

    @staticmethod
    def lines(digest, state: int, edits: str, rows: list[tuple[str, str, str]]):
        """The hash after the lines that ``edits`` make of ``rows``, from ``state`` on."""
        row = iter(rows)
        for edit in edits:
            role, text = ("", "") if edit == "I" else next(row)[1:]
            if edit == "D":
                continue
            new, after = NEXT[state]
            if edit == "K":
                after = STEP[state, initial(role)]
            else:
                role = NAMES[new]
            digest.update(("\n" if state != START else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            state = after
        return digest

    def add(self, turn: str | None, role: str, text: str, repeated: bool) -> None:
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.faults["illegal"] += 1
        self.last = role[:1]
        if turn is not None:
            number = int(turn)
            if not self.turns:
                self.turns = [number, number]
                self.distinct = 1
            elif number != self.turns[1]:
                self.turns[1] = number
                self.distinct += 1
        body = text.strip(BLANK)
        fault = "blank" if not body else "duplicate" if repeated else "truncated" if body[-1] not in MARKS else None
        if fault:
            self.faults[fault] += 1
        symbol = "d" if fault in ("blank", "duplicate") else initial(role).upper() if fault else initial(role)
        self.chunk.append((symbol, role, text))
        if len(self.chunk) == CHUNK:
            self.close()

    def close(self) -> None:
        """Join the cell of the chunk to the open states."""
        cell = parsed("".join(symbol for symbol, _, _ in self.chunk))
        best: dict[int, tuple[int, str, int, str]] = {}
        for (p, q), (cost, audit) in cell.items():
            if p in self.open:
                way = (self.open[p][0] + cost, self.open[p][1] + audit, p, audit)
                if q not in best or way < best[q]:
                    best[q] = way
        # A state goes only if going on from another is cheaper for certain, so ties stay.
        best = {q: w for q, w in best.items() if not any(best[p][0] + INSTEAD[p, q] < w[0] for p in best if (p, q) in INSTEAD)}
        common = commonprefix([audit for _, audit, _, _ in best.values()])
        self.settled.append(common)
        self.open = {
            q: (cost, audit[len(common):], self.lines(self.open[p][2].copy(), p, own, self.chunk)) for q, (cost, audit, p, own) in best.items()
        }
        self.chunk = []

    def answer(self) -> tuple:
        if self.chunk:
            self.close()
        cost, audit, digest = min((self.open[p] for p in FINAL if p in self.open), key=lambda way: way[:2])
        gaps = self.turns[1] - self.turns[0] + 1 - self.distinct if self.turns else 0
        return (gaps, *self.faults.values(), cost, "".join(self.settled) + audit, digest.hexdigest())


def damaged(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone, _row), stored; dropped rows stay, without text, as marks of their conversation."""
    written = [F.coalesce(F.col(name).cast("string"), F.lit(" ")) for name in (conv_col, turn_col, role_col, text_col)]
    code = F.crc32(F.concat(written[0], F.lit(":"), written[1]).cast("binary")) % PARTS
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), code.alias("code"), written[2].alias("role"), written[3].alias("text"))
    text = F.when(F.col("code").isin(DROP, EMPTY), "").when(F.col("code") == UNMARK, F.translate("text", MARKS, "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("code") == RECAST, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("code") == DROP).alias("gone"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("code") == REPEAT, 2).otherwise(1))).alias("_copy"),
    )
    return numbered(rows.drop("_copy"))


def repaired(rows: DataFrame) -> DataFrame:
    """Answers from the rows of ``damaged``."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    # The first row of each (role, text); its number is unique, so the join has no hot key.
    there = rows.where("not gone")
    first = there.groupBy("conv_id", "role", F.sha2(F.col("text").cast("binary"), 256)).agg(F.min(F.struct("turn", "_row")).alias("first"))
    first = first.select(F.col("first._row").alias("_row"), F.lit(False).alias("repeated"))
    dealt = rows.join(first, "_row", "left").select(
        F.col("conv_id").cast("string").alias("conv_id"), "turn", F.col("turn").cast("long").cast("string").alias("number"), "role", "text",
        "gone", F.coalesce("repeated", F.lit(True)).alias("repeated"), "_row",
    ).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "_row")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, current = (), None
        for frame in frames:
            out = []
            for name, number, role, text, gone, repeated in zip(*(frame[c].tolist() for c in (
                    "conv_id", "number", "role", "text", "gone", "repeated"))):
                if at != (name,):
                    if current is not None:
                        out.append((*at, *current.answer()))
                    at, current = (name,), Conversation()
                if not gone:
                    current.add(number, role, text, repeated)
            yield pd.DataFrame(out, columns=names)
        if current is not None:
            yield pd.DataFrame([(*at, *current.answer())], columns=names)

    shape = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return unkeyed(dealt.select("conv_id", "number", "role", "text", "gone", "repeated").mapInPandas(stream, shape), kind, "conv_id")


def repair_conversations(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null role or text, and a null id or turn inside the key of the damage, is written as one
    space. Rows are ordered by turn, nulls first; rows of one turn by role and text, so equal
    rows are neighbours. A role that starts with none of s, u, a (the empty role too) is recast
    or deleted. Turns are whole numbers. A null conv_id is a conversation of its own, repeated rows are duplicates,
    a conversation whose rows are all dropped has zeros and the hash of nothing, an empty table
    gives no rows, and other columns are not read.
    """
    return repaired(damaged(conversations, conv_col, turn_col, role_col, text_col))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def oracle() -> str:
    """The same answers by a walk over the rows with the best way into every state."""
    never = 1_000_000

    def way(state: str, cost, letter: str, line: str = "''") -> str:
        return f"struct_pack(c := {state}.c + {cost}, t := {state}.t || '{letter}', b := {state}.b || {line})"

    def keep(state: str, role: str) -> str:
        return way(state, f"r.cut + CASE WHEN r.bad OR left(r.role, 1) <> '{role}' THEN {never} ELSE 0 END", "K", "r.role || ':' || r.text || chr(10)")

    def recast(state: str, name: str) -> str:
        return way(state, f"r.cut + CASE WHEN r.bad THEN {never} ELSE {RECAST_COST} END", "R", f"'{name}:' || r.text || chr(10)")

    def insert(state: str, name: str) -> str:
        return way(state, INSERT_COST, "I", f"'{name}:' || chr(10)")

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    none = f"struct_pack(c := {never}, t := '', b := '')"
    u0 = f"struct_pack(c := {INSERT_COST}, t := 'I', b := 'user:' || chr(10))"
    a0 = f"struct_pack(c := {2 * INSERT_COST}, t := 'II', b := 'user:' || chr(10) || 'assistant:' || chr(10))"
    gone = lambda state: way(state, DELETE_COST, "D")
    return f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i)) AS t
), coded AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_transform(
      range(1, length(name) + 1), lambda i: CAST(ord(substr(name, i, 1)) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295
    ), 4294967295) % {PARTS} AS code
  FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations), crc
), rows_left AS (
  SELECT conv_id, turn, CASE code WHEN {RECAST} THEN 'user' ELSE role END AS role,
    CASE code WHEN {EMPTY} THEN '' WHEN {UNMARK} THEN regexp_replace(text, '[{MARKS}]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE code WHEN {REPEAT} THEN 2 ELSE 1 END)) AS copy FROM coded WHERE code <> {DROP})
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) AS seen,
    regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS closing
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM rows_left)
), judged AS MATERIALIZED (
  SELECT conv_id, turn, role, text, k, closing = '' AS blank, closing <> '' AND seen > 1 AS duplicate,
    closing <> '' AND seen = 1 AND closing NOT IN ('.', '!', '?') AS truncated, closing = '' OR seen > 1 AS bad,
    CASE WHEN closing <> '' AND seen = 1 AND closing NOT IN ('.', '!', '?') THEN {TRUNCATED_COST} ELSE 0 END AS cut,
    k > 1 AND lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal
  FROM placed
), convs AS (SELECT DISTINCT conv_id FROM conversations), walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS k, struct_pack(c := 0, t := '', b := '') AS e, {none} AS s, {u0} AS u, {a0} AS a FROM convs
  UNION ALL
  SELECT conv_id, k, e, s, {best('u', insert('e', 'user'), insert('s', 'user'), insert('a', 'user'))} AS u,
    {best('a', insert('u', 'assistant'),
          f"struct_pack(c := e.c + {2 * INSERT_COST}, t := e.t || 'II', b := e.b || 'user:' || chr(10) || 'assistant:' || chr(10))",
          f"struct_pack(c := s.c + {2 * INSERT_COST}, t := s.t || 'II', b := s.b || 'user:' || chr(10) || 'assistant:' || chr(10))")} AS a
  FROM (
    SELECT w.conv_id, r.k, {gone('w.e')} AS e, {best(gone('w.s'), keep('w.e', 's'))} AS s,
      {best(gone('w.u'), *(keep(f'w.{p}', 'u') for p in 'esa'), *(recast(f'w.{p}', 'user') for p in 'esa'))} AS u,
      {best(gone('w.a'), keep('w.u', 'a'), recast('w.u', 'assistant'))} AS a
    FROM walk w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1
  )
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, max(k) AS k
  FROM judged GROUP BY conv_id
), ended AS (
  SELECT w.conv_id, w.k, {best('w.e', 'w.a')} AS way FROM walk w
)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(way.c AS BIGINT) AS cost, way.t AS audit, sha256(rtrim_one) AS repaired_sha256
FROM convs v LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM v.conv_id
JOIN (SELECT *, CASE WHEN way.b = '' THEN '' ELSE left(way.b, length(way.b) - 1) END AS rtrim_one FROM ended) f
  ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.k = coalesce(n.k, 0)"""


ORACLE = oracle()
