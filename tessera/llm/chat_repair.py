"""Repairing the structure of conversations by cheapest edits, found with Hirschberg's method.

A repaired conversation is empty, or an optional system turn and then turns of user
and assistant by turns.  Four states say how far it is: nothing yet, after the
system's, after a user's, after an assistant's turn.  A row is kept, given another
role or deleted, and empty turns may be inserted before it; each row is thus a
4 x 4 table of costs between states, with the audit (the edits' initials) that is
least among the cheapest.

The conversation is cut in the middle: cost vectors run forward over the first half
and backward over the second, and among the states in which both together cost
least, the one whose audit up to there is least is where the cheapest repair
crosses.  Both halves are then solved alike.  Forward vectors carry ranks instead of
audits: two audits that reach the cut in different states differ before one of them
ends, as each ends with the same row's edit, so ranks decide once and for all.
Nothing longer than a few vectors is held besides the crossings.

Long conversations are cut into blocks of rows, which tasks share: a block's own
table (costs and ranks from each state to each) takes a row's place in the same
method, which finds the states at the blocks' borders; then every block is solved
by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.worktables import write_table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BLOCK_BITS = 12  # 4,096 rows in a block at most

START = 0
_FAR = 1 << 40
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_DONE = (0, 3)
_SPACE = " \t\n\x0b\x0c\r"

Vector = list[int]
Table = tuple[list[Vector], list[Vector]]  # costs, and ranks of the audits from one state, by [from][to]


def _inserted(state: int) -> list[tuple[str, int]]:
    """(roles' initials, state after them) of the empty turns that may be inserted in a state, until a state comes again."""
    out, roles, seen = [("", state)], "", {state}
    while (step := next((s for r, s in ((r, _NEXT.get((state, r))) for r in "ua") if s is not None), None)) not in seen:
        roles, state = roles + ("u" if step == 2 else "a"), step
        seen.add(step)
        out.append((roles, state))
    return out


def audit_of(steps: str) -> str:
    """Edits' initials of steps: inserted turns are u and a, the row is K, D or, with its new role, U or A."""
    return steps.translate(str.maketrans("uaUA", "IIRR"))


@cache
def row_table(initial: str, fault: str) -> tuple[Table, list[list[str]]]:
    """A row's table, and its steps by [from][to]; fault is '', 'truncated' or 'dead' (to be deleted)."""
    costs, ranks, steps = [[_FAR] * 4 for _ in range(4)], [[0] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
    for start in range(4):
        best: dict[int, tuple[int, str, str]] = {}
        for roles, state in _inserted(start):
            acts = [("D", DELETE, state)]
            if fault != "dead":
                more = TRUNCATED if fault == "truncated" else 0
                acts += [(act, cost + more, _NEXT[state, role]) for act, cost, role in (("K", KEEP, initial), ("U", REROLE, "u"), ("A", REROLE, "a")) if (state, role) in _NEXT]
            for act, cost, end in acts:
                found = (cost + INSERT * len(roles), audit_of(roles + act), roles + act)
                best[end] = min(best.get(end, found), found)
        order = sorted(x[1] for x in best.values())
        for end, (cost, audit, way) in best.items():
            costs[start][end], ranks[start][end], steps[start][end] = cost, order.index(audit), way
    return (costs, ranks), steps


def _last_steps(state: int) -> str:
    """Turns to insert after the last row."""
    return next(roles for roles, end in _inserted(state) if end in _DONE)


#: What it costs to end in each state.
END = [INSERT * len(_last_steps(s)) for s in range(4)]

#: A row's letter: s, u, a or o (any other role), upper case if truncated, a digit if it must be deleted.
_LETTERS = {letter: (initial, fault) for letters, fault in (("suao", ""), ("SUAO", "truncated"), ("1234", "dead")) for letter, initial in zip(letters, "suao", strict=True)}


def _forward(tables: list[Table], low: int, high: int, start: int) -> tuple[Vector, Vector]:
    """Costs and ranks of all states after tables low to high, from one state."""
    cost, rank = [_FAR] * 4, [0] * 4
    cost[start] = 0
    for costs, ranks in tables[low:high]:
        reached = [p for p in range(4) if cost[p] < _FAR]
        after, keys = [_FAR] * 4, [(0, 0)] * 4
        for q in range(4):
            best, _, p = min((cost[p] + costs[p][q], rank[p], p) for p in reached)
            if best < _FAR:
                after[q], keys[q] = best, (rank[p], ranks[p][q])
        order = sorted(keys[q] for q in range(4) if after[q] < _FAR)
        cost, rank = after, [order.index(keys[q]) if after[q] < _FAR else 0 for q in range(4)]
    return cost, rank


def _backward(tables: list[Table], low: int, high: int, goal: Vector) -> Vector:
    """What it costs from each state to go through tables low to high to the goal."""
    for costs, _ in reversed(tables[low:high]):
        goal = [min(min(c + g for c, g in zip(row, goal, strict=True)), _FAR) for row in costs]
    return goal


def crossings(tables: list[Table], start: int, goal: Vector) -> list[int]:
    """The states after each table on the cheapest way from start to the goal, of those the one with the least audit."""
    out = [start] * len(tables)

    def solve(low: int, high: int, start: int, goal: Vector) -> None:
        if low == high:
            return
        middle = max(low + 1, (low + high) // 2)
        (cost, rank), rest = _forward(tables, low, middle, start), _backward(tables, middle, high, goal)
        _, _, cut = min((cost[q] + rest[q], rank[q], q) for q in range(4) if cost[q] < _FAR)
        out[middle - 1] = cut
        if middle - low > 1:
            solve(low, middle, start, [0 if q == cut else _FAR for q in range(4)])
        solve(middle, high, cut, goal)

    solve(0, len(tables), start, goal)
    return out


def block_table(letters: str) -> Table:
    """The table of all rows of a block."""
    tables = [row_table(*_LETTERS[x])[0] for x in letters]
    both = [_forward(tables, 0, len(tables), start) for start in range(4)]
    return [x for x, _ in both], [x for _, x in both]


def repair(letters: str, start: int = START, end: int | None = None) -> tuple[list[str], int]:
    """(steps of each row, cost) from start to the state end, or, where that is None, to the conversation's end."""
    rows = [row_table(*_LETTERS[x]) for x in letters]
    states = crossings([x for x, _ in rows], start, END if end is None else [0 if q == end else _FAR for q in range(4)])
    steps, cost, at = [], 0, start
    for ((costs, _), ways), state in zip(rows, states, strict=True):
        steps.append(ways[at][state])
        cost, at = cost + costs[at][state], state
    if end is None and steps:
        steps[-1] += _last_steps(at)
        cost += END[at]
    return steps, cost


def ordered_rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, digest, blank, ended, pos): pos numbers the rows by conversation and turn, written once.

    Null turns come first; rows of one turn are in the order of role and the
    SHA-256 of the text.  Null roles and texts count as one space.  pos grows in
    this order, with gaps only where a range partition ends.
    """
    clean = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    clean = clean.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256))).withColumn("arrival", F.monotonically_increasing_id())
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "digest", "arrival"))]
    body = F.rtrim(F.col("text"), F.lit(_SPACE))
    rows = clean.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("conv", "turn", "role", "text", "digest", (body == "").alias("blank"), F.substring(body, -1, 1).isin(*".!?").alias("ended"), F.monotonically_increasing_id().alias("pos"))
    return write_table(rows, "repair-rows")


def find_faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, pos, fault, letter) of ordered_rows; fault is blank, duplicate, truncated or null, the first that holds.

    A row is a duplicate if an earlier one of its conversation has its role and
    text.  First rows are found by counting and joined back by pos, so that no
    group of copies meets in one task.
    """
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isNull(), kind).when(F.col("fault") == "truncated", F.upper(kind)).otherwise(F.translate(kind, "suao", "1234"))
    marked = rows.select("conv", "turn", "role", "pos", "blank", "ended").join(firsts, "pos", "left").withColumn("fault", fault)
    return write_table(marked.select("conv", "turn", "pos", "fault", letter.alias("letter")), "repair-faults")


def _key() -> Column:
    return F.struct("conv").alias("key")  # compares null conversations as equal


def _summaries(blocks: DataFrame) -> DataFrame:
    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [[x for part in block_table(letters) for row in part for x in row] for letters in batch.column("letters").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array(flat, pa.list_(pa.int64()))], ["key", "block", "table"])

    schema = blocks.select("key", "block").schema.add("table", T.ArrayType(T.LongType()))
    return blocks.select("key", "block", "letters").mapInArrow(sum_up, schema)


def _borders(blocks: DataFrame) -> DataFrame:
    """(key, block, start, end): the states at the blocks' borders; end is null for a conversation's last block.

    A conversation's tables, 32 numbers for 4,096 rows, meet in one row.
    """
    met = _summaries(blocks).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "table"))).alias("all"))
    met = met.select("key", F.col("all.block").alias("blocks"), F.col("all.table").alias("tables"))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = []
            for flat in batch.column("tables").to_pylist():
                tables = [([t[i : i + 4] for i in range(0, 16, 4)], [t[i : i + 4] for i in range(16, 32, 4)]) for t in flat]
                starts.append([START, *crossings(tables, START, END)[:-1]])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("blocks"), pa.array(starts, pa.list_(pa.int32()))], ["key", "blocks", "starts"])

    schema = met.select("key", "blocks").schema.add("starts", T.ArrayType(T.IntegerType()))
    found = met.mapInArrow(cross, schema).select("key", F.posexplode("blocks").alias("i", "block"), "starts")
    return found.select("key", "block", F.get("starts", F.col("i")).alias("start"), F.get("starts", F.col("i") + 1).alias("end"))


def find_edits(faults: DataFrame) -> DataFrame:
    """(key, block, first, steps, cost, letters) for every block of rows: steps[i] are those of the row at pos first + i."""
    block = F.shiftright("pos", BLOCK_BITS).alias("block")
    blocks = faults.groupBy(_key(), block).agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "letter"))).alias("rows"))
    blocks = write_table(blocks.select("key", "block", "first", F.array_join("rows.letter", "").alias("letters")), "repair-blocks")
    parted = blocks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    alone = blocks.join(parted, "key", "left_anti").select("*", F.lit(START).alias("start"), F.lit(None).cast("int").alias("end"))
    shared = blocks.join(parted, "key", "left_semi")
    todo = alone.unionByName(shared.join(_borders(shared), ["key", "block"]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [repair(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("letters", "start", "end")), strict=True)]
            made = [pa.array([s for s, _ in found], pa.list_(pa.string())), pa.array([c for _, c in found], pa.int64())]
            kept = ["key", "block", "first", "letters"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *made], [*kept, "steps", "cost"])

    schema = todo.select("key", "block", "first", "letters").schema.add("steps", T.ArrayType(T.StringType())).add("cost", "long")
    return write_table(todo.select("key", "block", "first", "letters", "start", "end").mapInArrow(solve, schema), "repair-edits")


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, pos, place, role, text): the repaired conversations' turns, by pos and place in order."""
    steps = edits.select("first", F.posexplode("steps").alias("i", "step")).select((F.col("first") + F.col("i")).alias("pos"), "step")
    acts = rows.select("conv", "pos", "role", "text").join(steps, "pos").select("conv", "pos", "role", "text", F.posexplode(F.split("step", "")).alias("place", "act"))
    low, own = F.lower("act"), ~F.col("act").isin("u", "a")
    role = F.when(low == "u", "user").when(low == "a", "assistant").otherwise(F.col("role"))
    return acts.filter("act not in ('D', '')").select("conv", "pos", "place", role.alias("role"), F.when(own, F.col("text")).otherwise("").alias("text"))


def conversation_digests(turns: DataFrame) -> DataFrame:
    """(key, sha256) of each conversation's lines role:text, joined by newlines.

    Rows stream through in order, so a conversation of any length takes no memory;
    the digest itself is sequential, so one conversation is one task's work.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # the conversation at hand and its digest so far
        for batch in batches:
            keys, sums = [], []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "text")), strict=True):
                line = f"{role}:{text}".encode()
                if now and now[0] == conv:
                    now[1].update(b"\n" + line)
                else:
                    if now:
                        keys.append(now[0])
                        sums.append(now[1].hexdigest())
                    now = [conv, hashlib.sha256(line)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column("conv").type), pa.array(sums, pa.string())], ["conv", "sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]], batch.column("conv").type), pa.array([now[1].hexdigest()])], ["conv", "sha256"])

    in_order = turns.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "pos", "place")
    schema = turns.select("conv").schema.add("sha256", "string")
    return in_order.select("conv", "role", "text").mapInArrow(digest, schema).select(_key(), "sha256")


def repair_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    gaps counts the turns missing between the first and the last; the next three
    the rows by their first fault; illegal the neighbours whose roles may not
    follow each other.  cost and audit are those of the cheapest edits, of equally
    cheap ones those with the least audit.  Null roles and texts count as one
    space (such a row is blank), rows with null keys form one conversation, and an
    empty table gives no rows.  Repeated rows are duplicates.  Roles count by their
    first letter; texts of any length are read whole.  The audit of a conversation
    is one string, a letter for each edit.  Other columns, whatever their names,
    are ignored.
    """
    rows = ordered_rows(df, conv, turn, role, text)
    faults = find_faults(rows)
    edits = find_edits(faults)
    names = ("blank", "duplicate", "truncated")
    by_turn = faults.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == n).alias(n) for n in names])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counted = by_turn.groupBy(_key()).agg(gaps.alias("gaps"), *[F.sum(n).alias(n) for n in names])

    plain = F.translate("letters", "SUAO1234", "suaosuao")
    legal = F.regexp_count(plain, F.lit("s(?=u)|u(?=a)|a(?=u)"))
    parts = edits.select(
        "key", "block", "cost", F.translate(F.array_join("steps", ""), "uaUA", "IIRR").alias("audit"),
        (F.length(plain) - 1 - legal).alias("illegal"), F.concat(F.substring(plain, 1, 1), F.substring(plain, -1, 1)).alias("ends"),
    )
    parts = parts.groupBy("key").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("inside"), F.sort_array(F.collect_list(F.struct("block", "audit", "ends"))).alias("parts"))
    meets = F.transform(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), lambda p, i: F.concat(F.substring(F.get("parts", i)["ends"], -1, 1), F.substring(p["ends"], 1, 1)))
    between = F.size(F.filter(meets, lambda m: ~m.isin("su", "ua", "au")))
    told = parts.select("key", "cost", F.array_join("parts.audit", "").alias("audit"), (F.col("inside") + between).cast("long").alias("illegal"))
    digests = conversation_digests(repaired_turns(rows, edits))
    return counted.join(told, "key").join(digests, "key", "left").select(
        F.col("key.conv").alias(conv), "gaps", *names, "illegal", "cost", "audit", F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")
    )


def damage(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """df's four columns with faults for tests, as the crc32 of conv:turn modulo 20 says; nulls count as one space there.

    0 drops a row, 1 empties its text, 2 takes its .!? out, 3 repeats it, 4 makes it
    the user's; null roles and texts become one space.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    hit = F.crc32(F.concat(names[0], F.lit(":"), names[1]).cast("binary")) % 20
    clean = df.select(conv, turn, *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in (role, text)], hit.alias("_hit"))
    changed = F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate(F.col(text), ".!?", "")).otherwise(F.col(text))
    spoilt = clean.filter("_hit <> 0").select(conv, turn, F.when(F.col("_hit") == 4, "user").otherwise(F.col(role)).alias(role), changed.alias(text), F.when(F.col("_hit") == 3, 2).otherwise(1).alias("_copies"))
    return spoilt.select(conv, turn, role, text, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by the checksums of their turns and repaired; those left without a row get zeros."""
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    fixed = repair_conversations(damage(chats)).select(F.struct("conv_id").alias("at"), "*").drop("conv_id")
    every = chats.select("conv_id").distinct().select("conv_id", F.struct("conv_id").alias("at"))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return every.join(fixed, "at", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256")
    )


OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) AS c FROM (SELECT unnest(range(256)) AS n))
), hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS d
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
), marked AS (
  SELECT *, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
         WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM numbered
), per AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id
), inserts(state, lines, added, price) AS (
  VALUES (0, []::VARCHAR[], 0, 0), (0, ['user:'], 2, 3), (0, ['user:', 'assistant:'], 3, 6), (1, []::VARCHAR[], 1, 0), (1, ['user:'], 2, 3), (1, ['user:', 'assistant:'], 3, 6),
         (2, []::VARCHAR[], 2, 0), (2, ['assistant:'], 3, 3), (3, []::VARCHAR[], 3, 0), (3, ['user:'], 2, 3)
), follows(state, initial, next) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), acts(act, initial, price) AS (
  VALUES ('K', 's', 0), ('K', 'u', 0), ('K', 'a', 0), ('R', 'u', 3), ('R', 'a', 3)
), moves AS (
  SELECT s.state, s.lines, repeat('I', len(s.lines)) || 'D' AS audit, 'D' AS act, NULL::VARCHAR AS initial, s.added AS next, s.price + 4 AS price FROM inserts s
  UNION ALL
  SELECT s.state, s.lines, repeat('I', len(s.lines)) || a.act, a.act, a.initial, f.next, s.price + a.price FROM inserts s JOIN follows f ON f.state = s.added JOIN acts a USING (initial)
), ways AS (
  SELECT conv_id, 0 AS i, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM per
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.next, min({'cost': (w.best.cost + m.price + CASE WHEN r.fault = 'truncated' AND m.act <> 'D' THEN 3 ELSE 0 END)::INTEGER, 'audit': w.best.audit || m.audit,
    'lines': list_concat(w.best.lines, m.lines, CASE m.act WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [CASE m.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text] END)})
  FROM ways w JOIN marked r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1 JOIN moves m ON m.state = w.state AND (m.act = 'D' OR (r.fault IN ('', 'truncated') AND (m.act = 'R' OR m.initial = r.initial)))
  GROUP BY w.conv_id, w.i, m.next
), ended AS (
  SELECT p.conv_id, min({'cost': (w.best.cost + s.price)::INTEGER, 'audit': w.best.audit || repeat('I', len(s.lines)), 'lines': list_concat(w.best.lines, s.lines)}) AS best
  FROM per p JOIN ways w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.i = p.n JOIN inserts s ON s.state = w.state AND s.added IN (0, 3)
  GROUP BY p.conv_id
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN per p ON p.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""
