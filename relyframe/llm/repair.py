"""Conversation structure repair: cheapest edits that make role sequences legal, solved on a suffix-shared DAWG.

Each row of a conversation gets a symbol for what an edit may do with it: its
role's initial and whether it is truncated, or "must go" (blank, duplicate).
A conversation's symbols in order are its signature. Signatures are minimised
from the end: every distinct suffix is one automaton node, known by its first
symbol and the node of the rest. Distinct signatures, reversed and sorted over
all conversations, visit the automaton depth first, so a task holds one path:
of a signature only the nodes beyond the part it shares with the one before
are new, and each node's cost-to-go and first edit of the best audit suffix
are computed then, once for each of the four grammar states. An audit is read
off by following those edits.

Legal role initials are ``(s?(ua)+)?``. Edits: Keep 0, Rerole to user or
assistant 1, Delete 2, Insert an empty user or assistant 5; a truncated row
that isn't deleted adds 5. From a grammar state each kind of edit has one
successor at most, so of equally cheap edits the least letter gives the
ASCII-least audit.

Null roles and texts are one space, so such texts are blank; a null conv_id is a
conversation of its own; rows without a turn come first, and rows of one turn
are ordered by role, then text (its first 32 characters, then its SHA-256).
Repeated rows are duplicates of the first. An empty table gives no rows. Other
columns don't matter, whatever their names. The signature and the audit have a
character a row, so the largest conversation is bounded by what a column holds
(a task needs about 100 bytes for each of its rows); its texts are streamed in
order and never held together.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relyframe.llm.common import small_batches
from relyframe.session import scratch_path

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: nothing yet, after the system row, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> the initial that Rerole and Insert can give there, and the state after it.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
#: What it takes to end in a state.
END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
NAMES = {"u": "user", "a": "assistant"}
#: Symbols: "x" must go; s, u, a, o (any other initial) as they are, in capitals if truncated.
MUST_GO = "x"
BLANKS = r"[\x20\x09-\x0D]"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with seeded faults, by crc32 of ``conv_id:turn`` modulo 20."""
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.where(kind != 0).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def _tie_order() -> list[Column]:
    return [F.substring("text", 1, 32).alias("head"), F.sha2(F.col("text").cast("binary"), 256).alias("digest")]


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal by conversation.

    One shuffle, on conv_id, of keys without texts.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       role.alias("role"), text.alias("text"))
    keys = rows.select(
        "conv_id", "turn", "role", *_tie_order(),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("is_blank"),
        (~F.col("text").rlike(r"[.!?]" + BLANKS + r"*\z")).alias("unended")).repartition("conv_id")
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    keys = keys.withColumn("again", F.row_number().over(seen) > 1)
    place = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "digest", "again")
    initial = F.substring("role", 1, 1)
    keys = keys.select(
        "conv_id", "turn", F.row_number().over(place).alias("place"), initial.alias("initial"),
        F.lag(initial).over(place).alias("before"), F.lag("turn").over(place).alias("turn_before"),
        F.when(F.col("is_blank"), "blank").when(F.col("again"), "duplicate").when(F.col("unended"), "truncated")
        .otherwise("").alias("fault"))
    own = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), F.lit(MUST_GO))
              .when(F.col("fault") == "truncated", F.upper(own)).otherwise(own))
    new_turn = F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn") != F.col("turn_before")))
    legal = F.concat("before", "initial").isin("su", "ua", "au")
    fault = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    by_conv = keys.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", symbol.alias("s")))).alias("symbols"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if(new_turn), F.lit(0)).cast("long").alias("gaps"), *fault,
        F.count_if(F.col("before").isNotNull() & ~legal).alias("illegal"))
    return by_conv.select("conv_id", F.array_join(F.transform("symbols", lambda s: s["s"]), "").alias("signature"),
                          "gaps", "blank", "duplicate", "truncated", "illegal")


class Automaton:
    """The path of nodes from the end of a signature to its start; shared suffixes keep their nodes."""

    def __init__(self):
        self.word = ""                          # the reversed signature that the path spells
        self.nodes = [self._inserted([(c, "") for c, _ in END], final=True)]
        self.made = 0

    @staticmethod
    def _inserted(options, final=False):
        """(cost, first edit) by state; an insertion leads to another state of the same node."""
        for _ in range(3):
            options = [min(options[q], (INSERT + options[NEXT[q][1]][0], "I")) if not final else options[q] for q in range(4)]
        return tuple(options)

    @staticmethod
    def step(symbol: str, rest) -> list:
        """Cheapest row edit by state, for a node of ``symbol`` followed by the node ``rest``."""
        if symbol == MUST_GO:
            return [(DELETE + rest[q][0], "D") for q in range(4)]
        initial, kept = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        out = []
        for q in range(4):
            given, after = NEXT[q]
            options = [(DELETE + rest[q][0], "D"), (REROLE + kept + rest[after][0], "R")]
            if initial == given:
                options.append((KEEP + kept + rest[after][0], "K"))
            elif initial == "s" and q == START:
                options.append((KEEP + kept + rest[SYSTEM][0], "K"))
            out.append(min(options))
        return out

    def solve(self, word: str) -> tuple[int, str]:
        """(cost, audit) of the signature whose reverse is ``word``."""
        same = _common(self.word, word)
        del self.nodes[same + 1:]
        for symbol in word[same:]:
            self.nodes.append(self._inserted(self.step(symbol, self.nodes[-1])))
        self.made += len(word) - same
        self.word = word
        audit, q, at = [], START, len(word)
        while at:
            edit = self.nodes[at][q][1]
            audit.append(edit)
            if edit in "IR":
                q = NEXT[q][1]
            elif edit == "K":
                q = SYSTEM if word[at - 1] in "sS" else NEXT[q][1]
            at -= edit != "I"
        return self.nodes[len(word)][START][0], "".join(audit) + END[q][1]


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def solve(found: DataFrame) -> DataFrame:
    """signature, cost, audit, new_nodes (nodes that this signature added to its task's path), by distinct signature."""
    words = found.select(F.reverse("signature").alias("word")).distinct().repartitionByRange("word")

    def run(batches):
        automaton = Automaton()
        for batch in batches:
            out = []
            for w in batch.column("word").to_pylist():
                before = automaton.made
                out.append((w[::-1], *automaton.solve(w), automaton.made - before))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                     pa.array(cols[3], pa.int64())], ["signature", "cost", "audit", "new_nodes"])

    return words.sortWithinPartitions("word").mapInArrow(run, "signature string, cost long, audit string, new_nodes long")


def plan_repairs(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps, blank, duplicate, truncated, illegal, cost, audit by conversation that has rows."""
    spark = rows.sparkSession
    at = scratch_path(spark, "signatures")
    signatures(rows).write.parquet(at)
    found = spark.read.parquet(at)
    return found.join(solve(found).drop("new_nodes"), "signature")


def repaired_rows(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place, edit, role, text: the conversations after their edits, in order within each partition.

    One shuffle of the texts, on conv_id; each conversation's audit comes
    first in its task, then its rows stream by.
    """
    nothing = F.lit(None).cast("string")
    marked = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", *_tie_order(), "text", nothing.alias("audit"))
    audits = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), nothing.alias("role"),
                          nothing.alias("head"), nothing.alias("digest"), nothing.alias("text"), "audit")
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "kind", "turn", "role", "head", "digest")]
    stream = marked.unionByName(audits).repartition("conv_id").sortWithinPartitions(*order).select(
        "conv_id", "kind", "role", "text", "audit")

    def run(batches):
        conv, audit, at, q, place = None, "", 0, START, 0

        def inserted():
            nonlocal at, q, place
            out = []
            while at < len(audit) and audit[at] == "I":
                initial, q = NEXT[q]
                out.append((conv, place, "I", NAMES[initial], ""))
                at, place = at + 1, place + 1
            return out

        for batch in batches:
            out = []
            for c, kind, role, text, plan in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if kind == 0:
                    conv, audit, at, q, place = c, plan, 0, START, 0
                    out += inserted()  # also all of an audit that only inserts
                    continue
                edit = audit[at]
                at += 1
                if edit == "R":
                    initial, q = NEXT[q]
                    role = NAMES[initial]
                elif edit == "K":
                    q = SYSTEM if role[:1] == "s" else NEXT[q][1]
                if edit != "D":
                    out.append((conv, place, edit, role, text))
                    place += 1
                out += inserted()
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(x, pa.string()) for x in cols[2:]]],
                    ["conv_id", "place", "edit", "role", "text"])

    return stream.mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of ``role:text`` joined by line feeds; reads the rows of repaired_rows in their order."""

    def run(batches):
        conv, state, done = None, None, []
        for batch in batches:
            for c, place, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                if place == 0:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield _digest_batch(done)
                done = []
        if state is not None:
            yield _digest_batch([(conv, state.hexdigest())])

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _digest_batch(done) -> pa.RecordBatch:
    ids, shas = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(shas)], ["conv_id", "repaired_sha256"])


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: the faults of ``rows``, the cheapest repair and its digest."""
    spark = rows.sparkSession
    at = scratch_path(spark, "repairs")
    plan_repairs(rows).write.parquet(at)
    plans = spark.read.parquet(at)
    sha = digests(repaired_rows(rows, plans))
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    parts = [plans.withColumn("repaired_sha256", F.lit(None).cast("string"))]
    blank = [F.lit(None).cast(t).alias(c) for c, t in plans.dtypes if c != "conv_id"]
    parts.append(sha.select("conv_id", *blank, "repaired_sha256"))
    parts.append(ids.select("conv_id", *blank, F.lit(None).cast("string").alias("repaired_sha256")))
    # a union and one aggregate, so that a null conv_id meets its rows
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c)
          for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    return every
