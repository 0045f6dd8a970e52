"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Voters look at a text and vote toxic, clean, or not at all: fixed lexicons,
patterns, and lexicons of whole words and word beginnings that stand out in
the toxic texts among the labelled training rows. Votes of all documents are
counted by vote pattern (at most 3**voters of them, whatever the input). An
EM over these counts fits a two-class model: how often each voter votes what
for each class, with training labels held fixed. Pairs of voters that agree
beyond what the classes explain are correlated; a voter's weight is divided
by one plus its correlations, so a group of voters that copy each other counts
about once. A logistic regression on the voters' evidence is then trained by
Spark on the posterior labels of all documents and gives the score.

Labels are read from rows whose crc32(doc_id as text) modulo 4 is not 2
only. At most ``TRAIN_ROWS`` of them (by hash) are used for lexicons and as
fixed labels; counts of votes, the label model and the classifier take all
documents. Score inputs come from the text alone. Null and empty texts get
the score of a text without evidence. A null doc_id has no label and isn't
held out. Repeated rows are scored alike; conflicting labels of a doc_id
count as toxic. An empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.llm.common import ALNUM, LOWER, U, Rolling, Words, byte_values, chunks, encoded, id_text, mix
from relyframe.session import scratch_path

# Words of the fixed lexicons.
INSULTS = """idiot idiots moron morons stupid fool fools dumb imbecile loser losers clown clowns jerk jerks dimwit
halfwit""".split()
CONTEMPT = """scum trash garbage worthless pathetic disgusting vermin filth filthy repulsive despicable vile""".split()
ABUSE = """bastard bitch asshole shit shitty fuck fucking cunt dick whore slut damn crap""".split()
MASKED = re.compile(r"[A-Za-z][*@#$]{1,4}[A-Za-z]{1,3}\b")
YOU_ARE = re.compile(r"\b(?:you|u|ur|they|he|she)(?:'re| are| is)? (?:such )?an? (?:idiot|moron|fool|loser|clown|jerk)\b", re.I)
SHOUT = re.compile(r"!{3,}|\b[A-Z]{4,} [A-Z]{4,} [A-Z]{4,}\b")

#: Lengths in bytes of the word beginnings that a learned lexicon may hold; 0 stands for whole words.
BEGINNINGS = (0, 4, 5, 6, 7)
TRAIN_ROWS = 20_000
LEXICON = 3_000
#: Lower bounds of the share of toxic training texts that a learned entry is in, by tier.
TIERS = (0.02, 0.005)
#: A learned entry is this many times as frequent in toxic as in clean training texts.
RATIO = 20.0
THRESHOLD = 0.3
#: Kinds of learned entries: whole words, beginnings, and beginnings that a text has at least twice.
KINDS = ("words", "beginnings", "repeated")
VOTERS = ("insults", "contempt", "abuse", "masked", "you_are", "shouting",
          *[f"{kind}_{tier}" for tier in range(len(TIERS)) for kind in KINDS])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most TRAIN_ROWS training rows, the same ones at every run."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)


class Evidence:
    """Hashes of the words of a chunk and of their beginnings."""

    def __init__(self, texts: list[str]):
        blob, starts, lens = encoded(texts)
        self.words = Words(blob, starts, lens, word=ALNUM, lower=True)
        raw = LOWER[np.frombuffer(blob, np.uint8)]
        rolling, size = Rolling(byte_values(raw)), self.words.end - self.words.start
        self.kinds = {0: (np.arange(len(size)), self.words.hash)}
        for k in BEGINNINGS[1:]:
            at = np.flatnonzero(size >= k)
            self.kinds[k] = at, rolling.windows(self.words.start[at], k) + U(k)

    def entries(self):
        """(document, hash) of every word and beginning."""
        for k, (at, h) in self.kinds.items():
            yield k, self.words.doc[at], h


class Member:
    """Membership of hashes in a small set: a table of their low bits first, then the sorted set."""

    def __init__(self, values):
        self.values = np.sort(np.array(values, U))
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.values & U(0xFFFF)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(self.low[(h & U(0xFFFF)).astype(np.int64)])
        if not len(hit):
            return hit
        at = np.minimum(np.searchsorted(self.values, h[hit]), len(self.values) - 1)
        return hit[self.values[at] == h[hit]]


def _word_hashes(words: list[str]) -> np.ndarray:
    e = Words(*encoded(words), word=ALNUM, lower=True)
    return e.hash


def learn_lexicon(docs: DataFrame, train: DataFrame) -> list[tuple[int, int, int, int]]:
    """(hash, length of beginning, times in a text, tier) of the entries that stand out in toxic training texts."""
    spark = docs.sparkSession
    rows = id_text(docs).join(F.broadcast(train), "doc_id").select("toxic", "text", F.xxhash64("text").alias("h"))
    rows = rows.dropDuplicates(["h"]).select("toxic", "text")  # copies of a text are one piece of evidence

    def count(batches):
        for toxic, texts in chunks(batches, ("toxic", "text")):
            toxic = np.array(toxic, np.int64)
            for k, doc, h in Evidence(texts).entries():
                _, first, count = np.unique(mix(h + doc.astype(U)), return_index=True, return_counts=True)
                for times in (1, 2) if k else (1,):
                    own = first[count >= times]
                    u, inverse = np.unique(h[own], return_inverse=True)
                    pos = np.bincount(inverse, weights=toxic[doc[own]], minlength=len(u)).astype(np.int64)
                    n = np.bincount(inverse, minlength=len(u))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(u.view(np.int64)), pa.array([k] * len(u), pa.int32()),
                         pa.array([times] * len(u), pa.int32()), pa.array(pos), pa.array(n - pos)],
                        ["h", "k", "times", "pos", "neg"])

    path = scratch_path(spark, "toxic-train")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    total = rows.agg(F.sum("toxic").alias("pos"), F.count("*").alias("n")).first()
    pos, neg = total["pos"] or 0, total["n"] - (total["pos"] or 0)
    if not pos:
        return []
    counts = rows.mapInArrow(count, "h long, k int, times int, pos long, neg long").groupBy("h", "k", "times").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    ratio = (F.col("pos") / pos) / ((F.col("neg") + 0.5) / max(neg, 1))
    best = counts.where((F.col("pos") >= max(5, TIERS[-1] * pos)) & (ratio >= RATIO))
    best = best.orderBy(F.desc("pos"), "neg", "h", "times").limit(LEXICON)
    return [(r["h"], r["k"], r["times"], next(t for t, share in enumerate((*TIERS[:-1], 0)) if r["pos"] >= share * pos))
            for r in best.collect()]


def evidence(docs: DataFrame, lexicon: list[tuple[int, int, int, int]]) -> DataFrame:
    """doc_id, k1, k2, n_words, hits (array, one number for each voter) by row of ``docs``."""
    fixed = [Member(_word_hashes(x)) for x in (INSULTS, CONTEMPT, ABUSE)]
    learned = {}
    for h, k, times, tier in lexicon:
        kind = 0 if k == 0 else times
        learned.setdefault((kind, tier), {}).setdefault(k, []).append(h & (1 << 64) - 1)
    learned = {key: {k: Member(v) for k, v in by.items()} for key, by in learned.items()}
    shared = docs.sparkSession.sparkContext.broadcast((fixed, learned))

    def run(batches):
        fixed, learned = shared.value
        for ids, k1, k2, texts in chunks(batches, ("doc_id", "k1", "k2", "text")):
            e, n = Evidence(texts), len(texts)
            hits = np.zeros((n, len(VOTERS)), np.int64)
            for j, member in enumerate(fixed):
                hits[:, j] = np.bincount(e.words.doc[member.of(e.words.hash)], minlength=n)
            for j, pattern in enumerate((MASKED, YOU_ARE, SHOUT), len(fixed)):
                hits[:, j] = [sum(1 for _ in pattern.finditer(t)) for t in texts]
            for (kind, tier), by in learned.items():
                j = VOTERS.index(f"{KINDS[kind]}_{tier}")
                for k, member in by.items():
                    at, h = e.kinds[k]
                    own = member.of(h)
                    doc = e.words.doc[at[own]]
                    if KINDS[kind] == "repeated":
                        _, inverse, count = np.unique(mix(h[own] + doc.astype(U)), return_inverse=True, return_counts=True)
                        doc = doc[count[inverse] > 1]
                    hits[:, j] += np.bincount(doc, minlength=n)
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(x, pa.int64()) for x in (ids, k1, k2)], pa.array(e.words.count.astype(np.int64)),
                 pa.array(hits.tolist(), pa.list_(pa.int64()))], ["doc_id", "k1", "k2", "n_words", "hits"])

    return id_text(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, hits array<long>")


def votes(hits, n_words):
    """A digit for each voter: 2 toxic, 1 clean (no hit in a text of some length), 0 no vote."""
    return F.array_join(F.transform(hits, lambda h: F.when(h > 0, F.lit("2")).when(n_words >= 10, F.lit("1"))
                                    .otherwise(F.lit("0"))), "")


class LabelModel:
    """Class prior, P(vote | class) of each voter, correlations and weights, fitted on counts of vote patterns."""

    def __init__(self, patterns: list[str], labels: list, counts: list[int], rounds: int = 50):
        self.v = np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), -1)
        known = np.array([x is not None for x in labels], bool)
        label = np.array([x or 0 for x in labels], np.float64)
        n = np.array(counts, np.float64)
        m = self.v.shape[1]
        self.weight = np.ones(m)
        any_toxic = (self.v == 2).sum(axis=1)
        post = np.where(known, label, np.where(any_toxic >= 2, 0.9, np.where(any_toxic == 1, 0.4, 0.02)))
        for k in range(rounds):
            w1, w0 = n * post, n * (1 - post)
            self.prior = np.log((w1.sum() + 1) / (w0.sum() + 1))
            p1 = np.stack([np.bincount(self.v[:, j], w1, 3) for j in range(m)]) + 0.5
            p0 = np.stack([np.bincount(self.v[:, j], w0, 3) for j in range(m)]) + 0.5
            self.log_ratio = np.log(p1 / p1.sum(1, keepdims=True)) - np.log(p0 / p0.sum(1, keepdims=True))
            if k % 10 == 9:
                self._correlate(n, post)
            new = np.where(known, label, self.posterior(self.v))
            done = np.abs(new - post).max() < 1e-6
            post = new
            if done and k > 10:
                break

    def _correlate(self, n, post) -> None:
        """Correlation of toxic votes within the classes, pooled; a voter's weight falls with its sum."""
        x = (self.v == 2).astype(float)
        cov = np.zeros((x.shape[1], x.shape[1]))
        for w in (n * post, n * (1 - post)):
            if w.sum() > 0:
                d = x - (w @ x) / w.sum()
                cov += (d * w[:, None]).T @ d
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        self.correlation = cov / np.outer(sd, sd)
        extra = np.maximum(self.correlation - np.eye(len(sd)), 0)
        self.weight = 1 / (1 + np.where(extra > 0.1, extra, 0).sum(axis=1))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        z = self.prior + (self.log_ratio[np.arange(v.shape[1])[None, :], v] * self.weight).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def features(hits, n_words):
    """Inputs of the linear classifier: for each voter log(1 + hits) and hits by root of the length."""
    size = F.sqrt(F.greatest(n_words, F.lit(1)).cast("double"))
    return F.concat(F.transform(hits, lambda h: F.log1p(h.cast("double"))),
                    F.transform(hits, lambda h: h.cast("double") / size))


def score(docs: DataFrame, labels: DataFrame, rounds: int = 30) -> DataFrame:
    """doc_id, k1, k2, held_out, score, predicted, by row of ``docs``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    spark: SparkSession = docs.sparkSession
    train = _written(training_labels(labels).coalesce(1), "toxic-labels")
    found = _written(evidence(docs, learn_lexicon(docs, train)), "toxic-evidence")
    found = found.withColumn("votes", votes(F.col("hits"), F.col("n_words")))
    # at most 3**voters patterns, and no more than there are labels for each of them
    counts = found.join(F.broadcast(train), "doc_id", "left").groupBy("votes", "toxic").agg(F.count("*").alias("n")).collect()
    result = found.select("doc_id", "k1", "k2", held_out().alias("held_out"), features(F.col("hits"), F.col("n_words")).alias("x"))
    if not counts:
        return result.select("doc_id", "k1", "k2", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = LabelModel([r["votes"] for r in counts], [r["toxic"] for r in counts], [r["n"] for r in counts])
    seen = sorted({r["votes"] for r in counts})
    post = model.posterior(np.array([[int(c) for c in p] for p in seen]))
    table = spark.createDataFrame([(p, float(q)) for p, q in zip(seen, post)], "votes string, posterior double")
    label = F.coalesce(F.col("toxic").cast("double"), F.col("posterior"))
    rows = found.join(F.broadcast(table), "votes").join(F.broadcast(train), "doc_id", "left").select(
        features(F.col("hits"), F.col("n_words")).alias("x"), label.alias("p"))
    # equal inputs are one weighted row for each class
    rows = rows.groupBy("x").agg(F.sum("p").alias("w1"), F.sum(1 - F.col("p")).alias("w0"))
    rows = rows.select(array_to_vector("x").alias("x"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("y"), (F.col("w1") + 1e-6).alias("w")),
        F.struct(F.lit(0.0).alias("y"), (F.col("w0") + 1e-6).alias("w")))).alias("z")).select("x", "z.y", "z.w")
    fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=rounds, regParam=1e-4).fit(rows)
    z = reduce(lambda a, b: a + b, [F.lit(float(c)) * F.col("x")[j] for j, c in enumerate(fit.coefficients)],
               F.lit(float(fit.intercept)))
    out = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), z))))
    return result.select("doc_id", "k1", "k2", "held_out", out.alias("score"), (out >= THRESHOLD).cast("int").alias("predicted"))


def _written(df: DataFrame, name: str) -> DataFrame:
    at = scratch_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.parquet(at)
