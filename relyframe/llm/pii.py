"""Personal data: patterns, and terms that disclose protected entities by co-occurrence.

An e-mail, address, card or phone number found by the patterns is a
protected entity (its normalised value). Terms of a document co-occur with all
its entities. Over the whole corpus, for entity c and term t,

    disclosure(t, c) = PMI(t; c) / IC(c),   PMI = log p(t, c) / (p(t) p(c)),   IC = -log p(c)

with p from document counts. 1 means that t gives c away. Terms of at
least ``GENERALISE`` are replaced by a class name, those of at least
``REMOVE`` are removed, in every document and place, also where the entity isn't written.

A pair has to be more than chance. Evidence is the number n of different contexts of the entity
(the ``WINDOW`` words on both sides) in whose documents the term is, at most one a document, so
copies of one text count once. If the m contexts met a term of n(t) documents by chance, n would be about
L = m n(t) / N, and n or more has a probability of at most exp(-(n log(n / L) - n + L)) (Chernoff). The
pair counts if that is below ``CHANCE`` divided by the number of pairs that could have been tested
(entities times terms). What can't pass either test whatever its partner (terms in too many
documents, terms and entities in too few) is left out before pairs are made, so a
text with thousands of addresses of its own makes none.

A row of the result belongs to a row of the input; null text is empty;
repeated rows count as documents and get the same spans; an empty table
gives none. Values equal to a threshold pass it. Texts are searched whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relyframe.llm.common import ALNUM, Words, chunks, encoded, id_text, mix, row_keys
from relyframe.session import scratch_path

KINDS = ("email", "ip", "card", "phone")
#: Spans of the method: terms that are generalised or removed.
TERM_KINDS = ("general", "removed")
WINDOW = 8
CHANCE = 0.01
GENERALISE, REMOVE = 0.6, 0.9

# The character classes of the patterns.
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Found from each @: the run of local characters before it and the domain after it, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1  # no match can begin before an @ that has failed and end after it
        at = text.find("@", done)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    """Every four parts of a dotted run of numbers, from its start; parts of at most 255."""
    out = []
    for m in DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        at, parts = m.start(), m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Base spans of each kind in code points."""
    digits = DIGIT.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": addresses(text) if digits else [],
            "card": cards(text) if digits else [], "phone": phones(text) if "+" in text else []}


def joined_spans(found: dict) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in found[k])


def _number(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _terms(text: str, found: dict) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The words of a text, where they begin and end in code points, and which belong to an entity."""
    blob, starts, lens = encoded([text])
    w = Words(blob, starts, lens, word=ALNUM, lower=True)
    if len(blob) - 1 == len(text) or not len(w.hash):
        begin, end = w.start, w.end
    else:
        point = np.cumsum((np.frombuffer(blob, np.uint8) & 0xC0) != 0x80) - 1  # code point of each byte
        begin, end = point[w.start], point[w.end - 1] + 1
    inside = np.zeros(len(begin), bool)
    for k in KINDS:
        for a, b in found[k]:
            inside[np.searchsorted(end, a, "right"):np.searchsorted(begin, b)] = True
    return w, begin, end, inside


def _entities(text: str, found: dict) -> tuple[list[tuple[int, int, int]], list[int]]:
    """(entity, context, 1 once for each entity) in different contexts, and the distinct terms of the text."""
    w, begin, end, inside = _terms(text, found)
    out, seen = {}, set()
    for k in KINDS:
        for a, b in found[k]:
            value = text[a:b].lower() if k in ("email", "ip") else NOT_DIGIT.sub("", text[a:b])
            entity = _number(f"{k}:{value}".encode())
            lo, hi = np.searchsorted(end, a, "right"), np.searchsorted(begin, b)
            near = [i for i in range(max(0, lo - WINDOW), min(len(begin), hi + WINDOW)) if not inside[i]]
            context = _number(w.hash[near].tobytes())
            if (entity, context) not in out:
                out[entity, context] = int(entity not in seen)
                seen.add(entity)
    return [(*x, n) for x, n in out.items()], np.unique(w.hash[~inside]).view(np.int64).tolist()


NEAR = "struct<entity:long,context:long,once:int>"
FOUND = "doc_id long, k1 long, k2 long, " + ", ".join(f"n_{k} long" for k in KINDS) + \
    f", base_sha256 string, base string, near array<{NEAR}>, terms array<long>"


def detect(docs: DataFrame) -> DataFrame:
    """One row for each document: keys, counts, base spans, its entities and, if it has any, its distinct terms."""

    def run(batches):
        for ids, k1, k2, texts in chunks(batches, ("doc_id", "k1", "k2", "text")):
            counts, base, near, terms = [], [], [], []
            for text in texts:
                found = find(text)
                counts.append([len(found[k]) for k in KINDS])
                base.append(joined_spans(found))
                own, words = _entities(text, found) if base[-1] else ([], [])
                near.append([dict(zip(("entity", "context", "once"), x)) for x in own])
                terms.append(words)
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            kind = pa.list_(pa.struct([("entity", pa.int64()), ("context", pa.int64()), ("once", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 *[pa.array(n[:, i]) for i in range(len(KINDS))],
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base]), pa.array(base), pa.array(near, kind),
                 pa.array(terms, pa.list_(pa.int64()))],
                [c.split()[0] for c in FOUND.split(", ")])

    return id_text(docs).mapInArrow(run, FOUND)


def term_frequency(docs: DataFrame) -> DataFrame:
    """(term, n): documents that hold each term, summed in each task, then by Spark."""
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def merged(held):
        h = np.concatenate([a for a, _ in held])
        n = np.concatenate([b for _, b in held])
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[first], np.add.reduceat(n, first)

    def out(held):
        h, n = merged(held)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["term", "n"])

    def run(batches):
        held = []
        for (texts,) in chunks(batches, ("text",)):
            w = Words(*encoded(texts), word=ALNUM, lower=True)
            if not len(w.hash):
                continue
            pair = mix(w.hash + w.doc.astype(np.uint64))
            _, first = np.unique(pair, return_index=True)  # a term once for each document
            held.append(np.unique(w.hash[first], return_counts=True))
            if sum(len(a) for a, _ in held) > 4_000_000:
                held = [merged(held)]
                if len(held[0][0]) > 2_000_000:
                    yield out(held)
                    held = []
        if held:
            yield out(held)

    return rows.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _surprise(n: Column, expected: Column) -> Column:
    """-log of a bound on the chance of n or more where ``expected`` are."""
    return F.when(n > expected, n * F.log(n / expected) - n + expected).otherwise(F.lit(0.0))


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) of the pairs at or above GENERALISE that aren't chance."""
    spark = found.sparkSession
    # rows that are wholly alike are one with a weight
    own = found.where(F.size("near") > 0).groupBy("k1", "k2").agg(
        F.first("near").alias("near"), F.first("terms").alias("terms"), F.count("*").alias("copies"))
    near = own.select("k1", "k2", "copies", F.explode("near").alias("x")).select("k1", "k2", "copies", "x.*")
    entity = _written(near.groupBy("entity", "context").agg(F.sum(F.col("once") * F.col("copies")).alias("n")).groupBy("entity").agg(
        F.sum("n").alias("n_entity"), F.count("*").alias("contexts")), "entities")
    term = _written(term_frequency(docs).withColumnRenamed("n", "n_term"), "terms")
    n_docs, tests = found.count(), max(entity.count(), 1) * max(term.count(), 1)
    total, need = F.lit(float(n_docs)), math.log(tests / CHANCE)

    def could_pass(n):  # as much evidence as there can be, with the rarest partner
        return _surprise(n.cast("double"), n * n / total) >= need

    entity = entity.where((F.col("n_entity") < n_docs) & could_pass(F.col("contexts")))
    most = entity.agg(F.max("n_entity")).first()[0]
    if most is None:
        return spark.createDataFrame([], "entity long, term long, disclosure double")

    def in_reach(n_entity):  # PMI is largest where the term is in all documents of the entity
        return F.col("n_term") <= F.pow(total, 1 - GENERALISE) * F.pow(n_entity, GENERALISE) * (1 + 1e-9)

    term = term.where(could_pass(F.col("n_term")) & in_reach(F.lit(float(most))))
    near = near.join(entity, "entity")
    words = own.join(near.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select(
        "k1", "k2", F.explode("terms").alias("term")).join(term, "term")
    pair = near.join(words, ["k1", "k2"]).where(in_reach(F.col("n_entity"))) \
        .groupBy("entity", "term", "context", "n_entity", "contexts", "n_term").agg(F.sum(F.col("once") * F.col("copies")).alias("n")) \
        .groupBy("entity", "term", "n_entity", "contexts", "n_term").agg(F.sum("n").alias("n_both"), F.least(F.count("*"), F.sum("n")).alias("n_contexts"))
    pair = pair.where(_surprise(F.col("n_contexts").cast("double"), F.col("contexts") * F.col("n_term") / total) >= need)
    n_both = F.least("n_both", "n_entity", "n_term")
    pmi = F.log2(n_both * total / (F.col("n_term") * F.col("n_entity")))
    ic = F.log2(total / F.col("n_entity"))
    return pair.select("entity", "term", (pmi / ic).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def _written(df: DataFrame, name: str) -> DataFrame:
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)


def places(docs: DataFrame) -> DataFrame:
    """(k1, k2, term, start, stop) of every word outside the base spans."""

    def run(batches):
        for k1, k2, texts in chunks(batches, ("k1", "k2", "text")):
            out = []
            for i, text in enumerate(texts):
                w, begin, end, inside = _terms(text, find(text))
                out.append((np.full((~inside).sum(), i), w.hash[~inside], begin[~inside], end[~inside]))
            at, term, begin, end = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(k1, np.int64)[at]), pa.array(np.array(k2, np.int64)[at]), pa.array(term.view(np.int64)),
                 pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))], ["k1", "k2", "term", "start", "stop"])

    return id_text(docs).select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, term long, start int, stop int")


def term_spans(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(k1, k2, terms): spans to generalise or remove of each document that has any, by kind and place.

    The disclosing terms are written, so that their size decides whether they are sent to the words or shuffled with them.
    """
    at = scratch_path(docs.sparkSession, "disclosing-terms")
    pairs.groupBy("term").agg(F.max("disclosure").alias("d")).write.parquet(at)
    hit = places(docs).join(docs.sparkSession.read.parquet(at), "term").groupBy("k1", "k2", "start", "stop").agg(F.max("d").alias("d"))
    removed = (F.col("d") >= REMOVE).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct(removed.alias("removed"), "start", "stop")))
    return hit.groupBy("k1", "k2").agg(F.array_join(F.transform(ordered, lambda x: F.concat_ws(
        ":", F.when(x["removed"] == 1, TERM_KINDS[1]).otherwise(TERM_KINDS[0]), x["start"].cast("string"),
        x["stop"].cast("string"))), ",").alias("terms"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2, n_email, n_ip, n_card, n_phone, base_sha256, spans, one row for each row of ``docs``."""
    spark = docs.sparkSession
    at = scratch_path(spark, "personal-data")
    detect(docs).write.parquet(at)
    found = spark.read.parquet(at)
    terms = term_spans(docs, disclosing(found, docs))
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("terms"))
    return found.drop("near", "terms").join(terms, ["k1", "k2"], "left").select(
        "doc_id", "k1", "k2", *[f"n_{k}" for k in KINDS], "base_sha256", both.alias("spans"))


def rewrite(text: str, spans_: str) -> str:
    """The text with base spans replaced by [KIND], disclosing terms generalised or removed.

    Where spans overlap, the one that begins first (then the longer) is
    replaced and the rest of the others goes with it.
    """
    if not spans_:
        return text
    rows = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in spans_.split(",")))
    out, at = [], 0
    for a, b, kind in rows:
        b = -b
        if b <= at:
            continue
        out.append(text[at:max(a, at)])
        if a >= at and kind != TERM_KINDS[1]:
            out.append(f"[{kind.upper()}]" if kind in KINDS else _general(text[a:b]))
        at = b
    return "".join(out) + text[at:]


def _general(term: str) -> str:
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[TERM]"


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, texts rewritten (and n_chars, where there is such a column); null stays null."""
    found = spans(docs).where(F.col("spans") != "").groupBy("k1", "k2").agg(F.first("spans").alias("spans"))
    found = found.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("spans").alias("__spans"))
    k1, k2 = row_keys(docs)
    keyed = docs.withColumns({"__k1": k1, "__k2": k2}).join(found, ["__k1", "__k2"], "left")

    @F.pandas_udf("string")
    def apply(t, s):
        import pandas as pd

        return pd.Series([x if x is None or not y else rewrite(x, y) for x, y in zip(t, s)], dtype=object)

    new = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(apply(F.col("text"), F.col("__spans")))
    out = keyed.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(
            F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
