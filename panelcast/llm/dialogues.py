"""Conversation structure repair: the cheapest edits that make the roles ``(s?(ua)+)?``.

Every row of a conversation is a slot of a fixed width of three octal digits, the letters of up to two
inserts and of the row's own edit (Delete 1, Insert 2, Keep 3, Rerole 4 in ASCII order, 0 as padding at the
end). A path through the grammar's four states is one whole number: its cost in the high digits, the slots
from the first to the last below. Slot spellings are prefix-free, so the least number is the cheapest path
and, among those, the one whose audit comes first; an ordinary shortest-path pass over whole numbers
decides everything, and the audit is read off the digits. More than two inserts in one place never help.

A block of at most ``BLOCK`` slots is reduced to the least number between each pair of states; blocks of a
conversation combine pairwise in order. So a conversation of any length is cut over many tasks by a range
partitioning of its narrow rows (initial, faults, digest of the text); texts move by conversation once, for
the last step, which streams over them and holds one row at a time.

Order of rows: turn (nulls first), role, the first 32 characters and the SHA-256 of the text. Defined
cases: null roles and texts are one space; null turns come first; rows of a null conv_id are one
conversation; repeated rows are repeated turns, all but the first duplicates; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import ship, written

#: Slots of a block.
BLOCK = 256
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn; the state that an inserted or reroled turn leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: Where a kept row with this initial leads.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LETTERS = " DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
WIDTH = 9  # bits of a slot
#: Inserts that end a conversation: state -> (cost, two letters).
TAIL = {START: (0, 0), ASSISTANT: (0, 0), USER: (2, INSERT << 3), SYSTEM: (4, INSERT << 3 | INSERT)}
LEGAL = {"su", "ua", "au"}

Matrix = list[list[int | None]]


def _arcs() -> dict[tuple[str, bool, bool], list[tuple[int, int, int, int]]]:
    """For a row (initial, must go, truncated): the least arc between each two states as (from, to, cost, slot)."""
    found = {}
    for initial in ("s", "u", "a", ""):
        for must_go in (False, True):
            for truncated in (False, True):
                best: dict[tuple[int, int], tuple[int, int]] = {}
                for state in range(4):
                    here = state
                    for inserts in range(3):
                        edits = [(here, 3, DELETE)]
                        if not must_go:
                            edits.append((NEXT[here], 2 + truncated, REROLE))
                            if here in KEPT.get(initial, {}):
                                edits.append((KEPT[initial][here], int(truncated), KEEP))
                        for to, cost, letter in edits:
                            slot = 0
                            for digit in [INSERT] * inserts + [letter] + [0] * (2 - inserts):
                                slot = slot << 3 | digit
                            arc = (2 * inserts + cost, slot)
                            best[state, to] = min(best.get((state, to), arc), arc)
                        here = NEXT[here]
                found[initial, must_go, truncated] = [(a, b, *arc) for (a, b), arc in best.items()]
    return found


ARCS = _arcs()


def block_matrix(slots: list[tuple[str, bool, bool]]) -> Matrix:
    """The least number from each state to each state over the slots of a block."""
    n = len(slots)
    top = WIDTH * n
    out: Matrix = []
    for start in range(4):
        at: list[int | None] = [None] * 4
        at[start] = 0
        for k, slot in enumerate(slots):
            shift = WIDTH * (n - 1 - k)
            to: list[int | None] = [None] * 4
            for a, b, cost, code in ARCS[slot]:
                here = at[a]
                if here is not None:
                    weight = here + (cost << top) + (code << shift)
                    if to[b] is None or weight < to[b]:
                        to[b] = weight
            at = to
        out.append(at)
    return out


def combined(left: Matrix, n: int, right: Matrix, m: int) -> Matrix:
    """The least numbers over ``n`` slots followed by ``m`` slots."""
    low_n, low_m = (1 << WIDTH * n) - 1, (1 << WIDTH * m) - 1
    cut = [[None if w is None else (w >> WIDTH * m << WIDTH * (n + m)) | (w & low_m) for w in row] for row in right]
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for j in range(4):
            a = left[i][j]
            if a is None:
                continue
            a = (a >> WIDTH * n << WIDTH * (n + m)) | ((a & low_n) << WIDTH * m)
            for k in range(4):
                b = cut[j][k]
                if b is not None and (out[i][k] is None or a + b < out[i][k]):
                    out[i][k] = a + b
    return out


def decided(blocks: list[tuple[Matrix, int]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from its blocks in order."""
    while len(blocks) > 1:
        pairs = [(combined(*blocks[k], *blocks[k + 1]), blocks[k][1] + blocks[k + 1][1]) for k in range(0, len(blocks) - 1, 2)]
        blocks = pairs + blocks[len(pairs) * 2:]
    matrix, n = blocks[0]
    low = (1 << WIDTH * n) - 1
    best = min((((w >> WIDTH * n) + TAIL[state][0]) << (WIDTH * n + 6)) | ((w & low) << 6) | TAIL[state][1]
               for state, w in enumerate(matrix[START]) if w is not None)
    digits = best & ((1 << (WIDTH * n + 6)) - 1)
    return best >> (WIDTH * n + 6), "".join(LETTERS[int(d)] for d in f"{digits:o}" if d != "0")


def damaged(rows: DataFrame) -> DataFrame:
    """The registered query's damage: (conv_id, turn, role, text, copies). A conversation without rows left keeps one of 0 copies."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(spelled("text"), ".!?", "")).otherwise(spelled("text"))
    return rows.select("conv_id", F.when(kind != 0, F.col("turn").cast("long")).alias("turn"),
                       F.when(kind == 0, "").when(kind == 4, "user").otherwise(spelled("role")).alias("role"), text.alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def conversations(rows: DataFrame) -> DataFrame:
    """Rows as they are, each one copy, in the form that ``repair`` takes."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), spelled("role").alias("role"), spelled("text").alias("text"), F.lit(1).cast("long").alias("copies"))


ORDER = ["turn", "role", "head", "digest"]


def _turns(rows: DataFrame) -> DataFrame:
    """One row per distinct turn with its copies; equal rows meet before they travel."""
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    return own.withColumn("head", F.substring("text", 1, 32)).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))


def _narrow(turns: DataFrame) -> DataFrame:
    """The rows without their texts: initial and faults."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    thin = turns.select("conv_id", *ORDER, "copies", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
                        F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z").alias("open"))
    said = ["conv_id", "role", "digest"]
    first = thin.filter("copies > 0 AND NOT blank").groupBy(*said).agg(F.min("turn").alias("first"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select(*[F.col(c).alias(f"said_{c}") for c in said], "first", "unnumbered")
    same = F.col("conv_id").eqNullSafe(F.col("said_conv_id")) & (F.col("role") == F.col("said_role")) & (F.col("digest") == F.col("said_digest"))
    again = F.when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.coalesce(F.col("turn") > F.col("first"), F.lit(False)))
    return thin.join(first, same, "left").select("conv_id", *ORDER, "copies", "initial", "blank", "open", (~F.col("blank") & again).alias("again"))


BLOCKS = ("part int, place int, slots long, matrix array<binary>, blank long, duplicate long, truncated long, illegal long, "
          "low long, high long, turns long, first_turn long, last_turn long, first_initial string, last_initial string")
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class _Run:
    """What a block gathers from its rows."""

    def __init__(self) -> None:
        self.slots: list[tuple[str, bool, bool]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first_turn = self.last_turn = self.first_initial = self.last_initial = None

    def add(self, turn: int | None, initial: str, blank: bool, again: bool, open_end: bool) -> None:
        fault = blank or again
        self.blank += blank
        self.duplicate += again and not blank
        self.truncated += open_end and not fault
        self.slots.append((initial if initial in KEPT else "", fault, open_end and not fault))
        if self.last_initial is None:
            self.first_initial = initial
        else:
            self.illegal += self.last_initial + initial not in LEGAL
        self.last_initial = initial
        if turn is not None:
            if self.first_turn is None:
                self.first_turn = self.low = turn
            self.turns += turn != self.last_turn
            self.last_turn = self.high = turn

    def row(self, part: int, place: int) -> tuple:
        spell = lambda w: None if w is None else w.to_bytes((w.bit_length() + 7) // 8, "big")
        return (part, place, len(self.slots), [spell(w) for line in block_matrix(self.slots) for w in line], self.blank, self.duplicate, self.truncated,
                self.illegal, self.low, self.high, self.turns, self.first_turn, self.last_turn, self.first_initial, self.last_initial)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, heavy: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or weight >= heavy:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _schemas(rows: DataFrame, more: str) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema

    whole = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(more).fields])
    return whole, to_arrow_schema(whole)


def _blocks(thin: DataFrame, size: int) -> DataFrame:
    """Blocks of the conversations' rows in order; a range of rows is a part, so that a long conversation has many."""
    schema, arrow = _schemas(thin, BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def made() -> Iterator[tuple]:
            own, place, block, seen = None, 0, None, False
            for conv, turn, copies, initial, blank, open_end, again in _rows(batches):
                if not seen or conv != own:
                    if block is not None:
                        yield (own, *block.row(part, place))
                    own, place, block, seen = conv, 0, _Run(), True
                for copy in range(copies):
                    if len(block.slots) >= size:
                        yield (own, *block.row(part, place))
                        place, block = place + 1, _Run()
                    block.add(turn, initial, blank, again or copy > 0, open_end)
            if block is not None:
                yield (own, *block.row(part, place))

        yield from _batches(made(), arrow)

    dealt = thin.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    return dealt.select("conv_id", "turn", "copies", "initial", "blank", "open", "again").mapInArrow(run, schema)


def _reports(blocks: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit): the blocks of a conversation, combined in order."""
    schema, arrow = _schemas(blocks, REPORT)
    names = [f.split()[0] for f in BLOCKS.split(", ")]

    def report(conv: object, parts: list[dict]) -> tuple:
        read = lambda b: None if b is None else int.from_bytes(b, "big")
        cost, audit = decided([([[read(b) for b in p["matrix"][4 * i:4 * i + 4]] for i in range(4)], p["slots"]) for p in parts])
        illegal, turns, initial, turn = 0, 0, None, None
        for p in parts:
            illegal += p["illegal"] + (initial is not None and p["first_initial"] is not None and initial + p["first_initial"] not in LEGAL)
            turns += p["turns"] - (turn is not None and turn == p["first_turn"])
            initial = p["last_initial"] if p["last_initial"] is not None else initial
            turn = p["last_turn"] if p["last_turn"] is not None else turn
        low, high = [p["low"] for p in parts if p["low"] is not None], [p["high"] for p in parts if p["high"] is not None]
        gaps = max(high) - min(low) + 1 - turns if low else 0
        return (conv, gaps, *(sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")), illegal, cost, audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            own, parts = None, []
            for conv, *rest in _rows(batches):
                if parts and conv != own:
                    yield report(own, parts)
                    parts = []
                own = conv
                parts.append(dict(zip(names, rest)))
            if parts:
                yield report(own, parts)

        yield from _batches(made(), arrow)

    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(run, schema)


def _edited(rows: Iterator[tuple], gather: bool) -> Iterator[tuple]:
    """Rows and reports of conversations, sorted: the repaired turns, or (gather) a report with their digest each."""
    own, letters, state, place, report, hashed = None, iter(""), START, 0, None, hashlib.sha256()

    def turn(role: str, text: str) -> Iterator[tuple]:
        nonlocal place
        if gather:
            hashed.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
        else:
            yield own, place, role, text
        place += 1

    def made(letter: str | None, role: str, text: str) -> Iterator[tuple]:
        nonlocal state
        if letter in ("I", "R"):
            state = NEXT[state]
            yield from turn("user" if state == USER else "assistant", "" if letter == "I" else text)
        elif letter == "K":
            state = KEPT[role[:1]][state]
            yield from turn(role, text)

    def ended() -> Iterator[tuple]:
        for letter in letters:
            yield from made(letter, "", "")
        if gather:
            yield (*report, hashed.hexdigest())

    for conv, kind, role, text, copies, *rest in rows:
        if kind == 0:  # the report comes before its rows
            if report is not None:
                yield from ended()
            own, report = conv, (conv, *rest)
            letters, state, place, hashed = iter(rest[-1]), START, 0, hashlib.sha256()
            continue
        for _ in range(copies):
            for letter in letters:
                yield from made(letter, role, text)
                if letter != "I":
                    break
    if report is not None:
        yield from ended()


def _repaired(rows: DataFrame, gather: bool, size: int) -> DataFrame:
    ship(rows.sparkSession)
    turns = written(_turns(rows), "turns")
    reports = written(_reports(_blocks(written(_narrow(turns), "narrow"), size)), "reports")
    schema, arrow = _schemas(rows, f"{REPORT}, repaired_sha256 string" if gather else "place long, role string, text string")
    told = [f.split() for f in REPORT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_edited(_rows(batches), gather), arrow)

    none = lambda kind: F.lit(None).cast(kind)
    both = turns.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), *ORDER, "text", "copies", *[none(t).alias(c) for c, t in told]).unionByName(
        reports.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), *[none("string").alias(c) for c in ("role", "head", "digest", "text")],
                       F.lit(0).cast("long").alias("copies"), *[c for c, _ in told]))
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER)
    return dealt.select("conv_id", "kind", "role", "text", "copies", *[c for c, _ in told]).mapInArrow(run, schema)


def repair(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies): faults, cost, audit and the digest of the repaired turns."""
    return _repaired(rows, True, size)


def repaired_turns(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The repaired conversations themselves: (conv_id, place, role, text)."""
    return _repaired(rows, False, size)


#: The same with the paths of a conversation as (state, cost, audit, repaired text), folded over its rows.
SQL = r"""
WITH byte_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
spelled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
hashed AS (
  SELECT conv_id, turn, role, text,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(key) + 1), lambda i: ord(substr(key, i, 1))::BIGINT)),
                         lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])), 4294967295) % 20 AS kind
  FROM spelled, byte_table),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hashed WHERE kind <> 0),
judged AS (
  SELECT conv_id, turn, role, text, copy, left(role, 1) AS initial, lag(left(role, 1)) OVER turns AS before,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z') AS open_end
  FROM damaged WINDOW turns AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum((again AND NOT blank)::INT) AS duplicate,
         sum((open_end AND NOT again AND NOT blank)::INT) AS truncated,
         sum((before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::INT) AS illegal,
         list({'x': {'i': initial, 'role': role, 'text': text, 'go': blank OR again, 'cut': (open_end AND NOT blank AND NOT again)::INT},
               's': NULL::STRUCT(g INT, w BIGINT, a VARCHAR, t VARCHAR)[]} ORDER BY turn NULLS FIRST, role, text, copy) AS turns
  FROM judged GROUP BY conv_id),
folded AS (
  SELECT * EXCLUDE (turns), list_reduce(
    list_prepend({'x': {'i': '', 'role': '', 'text': '', 'go': false, 'cut': 0}, 's': [{'g': 0, 'w': 0::BIGINT, 'a': '', 't': ''}]}, turns),
    lambda acc, r: {'x': r.x, 's': list_transform([list_concat(acc.s,
        list_transform(acc.s, lambda k: {'g': [2, 2, 3, 2][k.g + 1], 'w': k.w + 2, 'a': k.a || 'I', 't': k.t || chr(10) || ['user:', 'user:', 'assistant:', 'user:'][k.g + 1]}),
        list_transform(acc.s, lambda k: {'g': [3, 3, 2, 3][k.g + 1], 'w': k.w + 4, 'a': k.a || 'II',
          't': k.t || chr(10) || ['user:', 'user:', 'assistant:', 'user:'][k.g + 1] || chr(10) || ['assistant:', 'assistant:', 'user:', 'assistant:'][k.g + 1]}))],
      lambda here: list_transform([list_concat(
          list_transform(here, lambda k: {'g': k.g, 'w': k.w + 3, 'a': k.a || 'D', 't': k.t}),
          list_transform(list_filter(here, lambda k: NOT r.x.go),
            lambda k: {'g': [2, 2, 3, 2][k.g + 1], 'w': k.w + 2 + r.x.cut, 'a': k.a || 'R', 't': k.t || chr(10) || ['user:', 'user:', 'assistant:', 'user:'][k.g + 1] || r.x.text}),
          list_transform(list_filter(here, lambda k: NOT r.x.go AND ((r.x.i = 's' AND k.g = 0) OR (r.x.i = 'u' AND k.g <> 2) OR (r.x.i = 'a' AND k.g = 2))),
            lambda k: {'g': CASE r.x.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'w': k.w + r.x.cut, 'a': k.a || 'K', 't': k.t || chr(10) || r.x.role || ':' || r.x.text}))],
        lambda all_of: list_filter(list_transform([0, 1, 2, 3], lambda g: list_min(list_filter(all_of, lambda k: k.g = g))), lambda k: k IS NOT NULL))[1])[1]}).s AS ends
  FROM counted),
ended AS (
  SELECT * EXCLUDE (ends), list_min(list_transform(ends, lambda k: {
      'w': k.w + [0, 4, 2, 0][k.g + 1], 'a': k.a || ['', 'II', 'I', ''][k.g + 1], 't': k.t || ['', chr(10) || 'user:' || chr(10) || 'assistant:', chr(10) || 'assistant:', ''][k.g + 1]})) AS best
  FROM folded)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.w, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ended e ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
