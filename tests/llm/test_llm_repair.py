"""Conversation repair against an exhaustive search over all edits, and its automaton's sharing."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from relyframe.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, signature string, place int, audit double"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) over all edits, by (cost, audit)."""

    @lru_cache(None)
    def best(i, state, inserts):
        options = []
        if i == len(rows):
            if LEGAL.match(state):
                options.append((0, "", ()))
        else:
            role, text, fault = rows[i]
            extra = 5 if fault == "truncated" else 0
            c, a, t = best(i + 1, state, 0)
            options.append((2 + c, "D" + a, t))
            if fault not in ("blank", "duplicate"):
                for cost, edit, new in ((0, "K", role), (1, "R", "user"), (1, "R", "assistant")):
                    if (after := moved(state, new[:1])) is not None:
                        c, a, t = best(i + 1, after, 0)
                        options.append((cost + extra + c, edit + a, (f"{new}:{text}", *t)))
        if inserts < 2:
            for new in ("user", "assistant"):
                if (after := moved(state, new[0])) is not None:
                    c, a, t = best(i, after, inserts + 1)
                    options.append((5 + c, "I" + a, (new + ":", *t)))
        return min(options, default=(10 ** 9, "", ()))

    def moved(state, initial):
        new = state + initial
        ok = initial and any(LEGAL.match(new + "".join(x)) for n in range(3) for x in itertools.product("ua", repeat=n))
        return ({"sua": "ua", "uaua": "ua", "uau": "u", "sua" + "u": "u"}.get(new, new)) if ok else None

    return best(0, "", 0)


def expected(rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        own = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, _, role, text in own:
            solid = text.strip("\x20\t\n\x0b\x0c\r")
            fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, body = cheapest(tuple(marked)) if marked else (0, "", ())
        out.append((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(body).encode()).hexdigest()))
    return out


def conversations(seed=3, n=140):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "Sys", "ua"])
            rows.append((conv, r.choice([turn, turn, turn, None, turn + 5]), role,
                         r.choice(["Yes.", "No!", "cut", "a. b", "", None, " \n", "end? \t", "Ünd.", "x" * 50 + str(turn)])))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (None, None, None, None), (n, 3, "user", "Long. " * 30_000),
             (n, 4, "assistant", "w" * 200_000 + "."), (n + 1, 10 ** 12, "user", "a."), (n + 1, -5, "system", "b.")]
    rows += [r.choice(rows) for _ in range(60)]
    return rows


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("rows", [conversations(), []], ids=["cases", "empty"])
def test_repair(spark, rows):
    table = spark.createDataFrame([(*x, "q", 1, 0.5) for x in rows], SCHEMA)
    out = repair.report(table, repair.damage(table))
    key = lambda t: (t[0] is None, t[0] or 0)
    assert out.columns == COLUMNS
    assert sorted(map(tuple, out.collect()), key=key) == sorted(expected(rows), key=key)


def test_shared_suffixes_make_no_new_nodes(spark):
    words = ["uaUaua", "sUaua", "ua", "xua", "xxua", "oaxua"]
    found = spark.createDataFrame([(w,) for w in words * 50], "signature string").coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        out = {r.signature: r for r in repair.solve(found).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    suffixes = {w[k:] for w in words for k in range(len(w))}
    assert sorted(out) == sorted(words) and sum(r.new_nodes for r in out.values()) == len(suffixes)


def test_long_conversation_streams_in_order(spark):
    n = 30_000
    table = spark.range(n).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                  F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    (row,) = repair.report(table, table).collect()
    body = "\n".join(f"{'assistant' if i % 2 else 'user'}:t{i}." for i in range(n))
    assert row.cost == 0 and row.audit == "K" * n and row.repaired_sha256 == hashlib.sha256(body.encode()).hexdigest()
