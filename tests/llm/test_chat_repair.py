import hashlib
import itertools
import random
import re
from functools import cache

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_repair
from tessera.llm.chat_repair import END, audit_of, block_table, crossings, damage, ordered_rows, repair, repair_conversations, repaired_turns
from tessera.llm.chat_repair import find_edits, find_faults

GOOD = re.compile(r"(s?(ua)+)?")


def cheapest_of_all(rows):
    """(cost, audit, lines) by trying all edits of rows (role, text, fault)."""
    best = None
    gaps = list(itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1))
    for acts in itertools.product("KDUA", repeat=len(rows)):
        if any(a != "D" and f in ("blank", "duplicate") for a, (*_, f) in zip(acts, rows, strict=True)):
            continue
        for ins in gaps:
            out, cost, audit = [], 0, ""
            for k in range(len(rows) + 1):
                for x in ins[k]:
                    out.append(("user" if x == "u" else "assistant", ""))
                    cost, audit = cost + 3, audit + "I"
                if k == len(rows):
                    break
                act, (role, text, fault) = acts[k], rows[k]
                audit += {"U": "R", "A": "R"}.get(act, act)
                cost += {"K": 0, "D": 4}.get(act, 3) + (3 if fault == "truncated" and act != "D" else 0)
                if act != "D":
                    out.append(({"U": "user", "A": "assistant"}.get(act, role), text))
            if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def cheapest(rows):
    """The same, going back from the end: the least (cost, audit, lines) of what is left for each kind of last turn."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    named = {"u": "user", "a": "assistant"}

    @cache
    def rest(i, last, inserts):
        ways = []
        if inserts < 2:
            ways += [(3 + c, "I" + x, ((named[n], ""), *out)) for n in after[last] if n != "s" for c, x, out in rest(i, n, inserts + 1)]
        if i == len(rows):
            return [min(ways + ([(0, "", ())] if last in ("", "a") else []))] if ways or last in ("", "a") else []
        role, text, fault = rows[i]
        ways += [(4 + c, "D" + x, out) for c, x, out in rest(i + 1, last, 0)]
        if fault not in ("blank", "duplicate"):
            for n in after[last]:
                name, price, letter = (role, 0, "K") if role[:1] == n else (named.get(n), 3, "R")
                if name:
                    ways += [(price + 3 * (fault == "truncated") + c, letter + x, ((name, text), *out)) for c, x, out in rest(i + 1, n, 0)]
        return [min(ways)] if ways else []

    return rest(0, "", 0)[0]


def faults_of(rows):
    """(role, text, fault) of rows (role, text) in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    return out


def test_every_short_conversation_by_trying_all_edits():
    letters = {"s": ("s", "x."), "u": ("u", "x."), "a": ("a", "x."), "o": ("o", "x."), "U": ("u", "x"), "A": ("a", "x"), "S": ("s", "x"), "O": ("o", "x"), "1": ("s", ""), "2": ("u", "")}
    for n in (1, 2, 3, 4):
        for word in itertools.product(letters if n < 4 else "suaU1", repeat=n):
            if n == 3 and hash(word) % 1 and random.random() > 0.2:
                continue
            rows = [(*letters[x], {True: "truncated", False: ""}[x.isupper()] if not x.isdigit() else "blank") for x in word]
            steps, cost = repair("".join(word))
            assert (cost, audit_of("".join(steps))) == cheapest(rows)[:2], word
            assert n > 1 or cheapest(rows)[:2] == cheapest_of_all(rows)[:2]
    for word in ("ss", "sa", "aa", "oU", "u1", "A2", "SO"):
        rows = [(*letters[x], "blank" if x.isdigit() else "truncated" if x.isupper() else "") for x in word]
        assert cheapest(rows)[:2] == cheapest_of_all(rows)[:2]


def by_sweep(letters):
    """Costs and whole audits of all states, row by row."""
    ways = {0: (0, "")}
    for x in letters:
        table, steps = chat_repair.row_table(*chat_repair._LETTERS[x])
        after = {}
        for p, (cost, audit) in ways.items():
            for q in range(4):
                if steps[p][q]:
                    found = (cost + table[0][p][q], audit + audit_of(steps[p][q]))
                    after[q] = min(after.get(q, found), found)
        ways = after
    return min((c + END[s], a + "I" * (END[s] // 3)) for s, (c, a) in ways.items())


@pytest.mark.parametrize("seed", range(40))
def test_long_conversations_and_blocks_against_a_sweep(seed):
    pick = random.Random(seed)
    letters = "".join(pick.choices("suaoSUAO1234", (1, 9, 9, 1, 1, 3, 3, 1, 1, 1, 1, 1), k=pick.randint(1, 300)))
    steps, cost = repair(letters)
    assert (cost, audit_of("".join(steps))) == by_sweep(letters)
    # The same from blocks of several lengths.
    cuts = sorted({0, len(letters), *(pick.randrange(len(letters)) for _ in range(6))})
    blocks = [letters[a:b] for a, b in itertools.pairwise(cuts)]
    ends = crossings([block_table(b) for b in blocks], 0, END)
    parts = [repair(b, s, e) for b, s, e in zip(blocks, [0, *ends[:-1]], [*ends[:-1], None], strict=True)]
    assert sum(c for _, c in parts) == cost and [s for p, _ in parts for s in p] == steps


ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 1, "user", "Why?"), (1, 2, "assistant", "So"), (1, 9, "assistant", "So."),
    (2, None, "user", "a."), (2, None, None, "b."), (2, 3, "user", None), (3, None, None, None), (None, 1, "user", "x."), (None, 1, "user", "x."), (None, 2, "assistant", "y!"),
    (4, 5, "", "z."), (4, 6, "ünder", "z."), (5, 1, "user", "long " * 30_000 + "."), (5, 2, "assistant", " "), (6, 1, "assistant", " \t\n"), (7, 0, "a", "q?\n \r"), (7, 4, "u", "r.\x1c"),
]


def by_hand(rows):
    chats = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        chats.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text, turn))
    out = []
    for conv, turns in chats.items():
        turns.sort(key=lambda t: t[:4])
        rows = faults_of([(t[2], t[4]) for t in turns])
        cost, audit, lines = cheapest(rows)
        known = {t[5] for t in turns if t[5] is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        faults = [f for *_, f in rows]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        text = "\n".join(f"{r}:{t}" for r, t in lines)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(map(str, out))


def odd_chats(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit("x") for c in ("conv", "pos", "digest", "key", "block", "steps", "first", "letter", "arrival", "_hit")})


@pytest.mark.parametrize("bits", [12, 0])
def test_odd_conversations(spark, monkeypatch, bits):
    """Nulls, ties, repeated rows, blank and very long texts, clashing columns; blocks of 4,096 rows and of one."""
    monkeypatch.setattr(chat_repair, "BLOCK_BITS", bits)
    df = odd_chats(spark)
    got = repair_conversations(df).collect()
    assert sorted(str(tuple(r)) for r in got) == by_hand(ODD)
    assert repair_conversations(df.filter("false")).count() == 0


def test_one_long_conversation(spark, monkeypatch):
    """A conversation of 6,000 rows over many blocks and range partitions."""
    monkeypatch.setattr(chat_repair, "BLOCK_BITS", 6)
    df = spark.range(6_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.hash("id") % 3 == 0, "assistant").when(F.hash("id") % 50 == 1, "system").otherwise("user").alias("role"), F.concat(F.col("id") % 4_000, F.when(F.col("id") % 7 == 0, "").otherwise(".")).alias("text"))
    rows = ordered_rows(df, "conv_id", "turn", "role", "text")
    faults = find_faults(rows)
    edits = find_edits(faults)
    letters = "".join(r["letter"] for r in faults.orderBy("pos").collect())
    cost, audit = by_sweep(letters)
    got = repair_conversations(df).first()
    assert (got["cost"], got["audit"]) == (cost, audit)
    turns = repaired_turns(rows, edits).orderBy("pos", "place").collect()
    assert GOOD.fullmatch("".join(t["role"][0] for t in turns))
    assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in turns).encode()).hexdigest()


def test_damage(spark):
    import zlib

    df = odd_chats(spark).unionByName(odd_chats(spark).withColumn("turn", F.col("turn") + 17)).unionByName(odd_chats(spark).withColumn("conv_id", F.lit(None).cast("long")))
    expected = []
    for r in df.collect():
        conv, turn, role, text = (r[c] for c in ("conv_id", "turn", "role", "text"))
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (conv, turn, "user" if hit == 4 else role, "" if hit == 1 else re.sub(r"[.!?]", "", text) if hit == 2 else text)
        expected += [row] * {0: 0, 3: 2}.get(hit, 1)
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in damage(df).collect())
