"""Language identification: a linear-chain conditional random field over the words of a text.

A word (a run of letters, lower-cased) is scored for each language by hashed
affixes, letter n-grams and the word itself, and by a lexicon: how often
its bucket occurs in each language, counted by Spark over the words of
all training documents. Learned transitions tie neighbouring words together.
Forward-backward gives each word's marginals, so words of code-switched text
get languages of their own; a document's language is the one with the largest
sum of marginals (ties: the least value), its score their mean.

Weights are fitted on a bounded sample: of each language, one run of at most
``SEGMENT`` words from each of ``SAMPLE_ROWS`` training documents, drawn by
hash over all of them. Runs are cut and mixed into code-switched sequences, which
is where transitions between languages are learned from. Lexicon counts cover all
training rows.

Inference takes chunks of texts as one chain that starts anew at each text.
The chain is cut into rows of ``ROW`` words: products of all rows' transfer
matrices advance together, one pass over the rows joins them, and a second
sweep gives the marginals, so one text of any length keeps its context.

Texts that are null or have no letter are ``und`` with score 0, as are all texts
when nothing can be learned. Rows with a null doc_id are neither held out nor learned
from. Repeated rows are scored alike. An empty table gives no rows; columns other than
doc_id, text and lang don't matter. Whole texts are scored. The model has
(FEATURES + BUCKETS) numbers a language, whatever the input.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relyframe.llm.common import chunks, id_text, mix
from relyframe.session import scratch_path

#: Hashed features and lexicon buckets.
FEATURES, BUCKETS = 1 << 17, 1 << 16
#: Bound of the training sample: documents of each language, and words of each document.
SAMPLE_ROWS, SEGMENT = 1_000, 64
#: Words in a row of the chain.
ROW = 64
#: Longest affix and n-gram.
AFFIX, GRAM = 4, 3
ROUNDS, RATE, L2 = 35, 0.1, 2e-4
#: Letters whose words a worker keeps scores of before it starts anew.
CACHE_LETTERS = 6_000_000
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
SALT = np.uint64(0x9E3779B97F4A7C15)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall(text.lower())


def is_word(word: str) -> bool:
    """Whether a run has a letter (and not only numerals that aren't digits, such as fractions)."""
    return any(map(str.isalpha, word))


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8")) % BUCKETS


def feature_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, feature) of every affix, n-gram and word; n-grams see the word's bounds."""
    whole = "".join(f"\x02{w}\x03" for w in words)
    c = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    start = np.cumsum(size) - size
    own = np.repeat(np.arange(len(words)), size)
    left = np.repeat(start + size, size) - np.arange(len(c))  # characters from here to the end of the word
    found = []

    def add(word, h, kind):
        found.append((word, (mix(h * SALT + np.uint64(kind)) & np.uint64(FEATURES - 1)).astype(np.int64)))

    h = np.zeros(len(c), np.uint64)
    for n in range(1, GRAM + 1):
        m = len(c) - n + 1
        h = (h[:m] if n > 1 else np.zeros(len(c), np.uint64)) * np.uint64(0x100000001B3) + c[n - 1:]
        inside = left[:m] >= n
        if n == 1:
            inside &= c > 3
        add(own[:m][inside], h[inside], n)
    inner = size - 2
    for n in range(1, AFFIX + 1):
        at = np.flatnonzero(inner >= n)
        for kind, first in ((10 + n, start + 1), (20 + n, start + size - 1 - n)):
            h = np.zeros(len(at), np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + c[first[at] + k]
            add(at, h, kind)
    add(np.arange(len(words)), np.array([zlib.crc32(w.encode("utf-8")) for w in words], np.uint64), 30)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


class Model:
    """Weights of features and lexicon, transitions and starts; arrays of a fixed size for each language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        n = len(languages)
        self.languages = languages
        share = (counts + 0.0) / np.maximum(counts.sum(axis=0), 1)  # of a language's words
        odds = np.log(share * BUCKETS + 0.05)
        self.lexicon = (odds - odds.mean(axis=1, keepdims=True)).astype(np.float32)
        self.weights = np.zeros((FEATURES, n), np.float32)
        self.scale = 0.5
        self.moves, self.starts = np.zeros((n, n)), np.zeros(n)

    def scores(self, words: list[str], pairs=None, lexicon=None) -> np.ndarray:
        """One row of scores a word."""
        word, feature = feature_pairs(words) if pairs is None else pairs
        rows = self.lexicon[[bucket(w) for w in words]] if lexicon is None else lexicon
        return self.scale * rows + np.stack([np.bincount(word, self.weights[:, y][feature], len(words))
                                             for y in range(len(self.languages))], axis=1)


def forward(e, moves, reset, starts, alpha):
    """alpha after each word of rows of words; ``alpha`` is the one before each row."""
    out = np.empty_like(e)
    for t in range(e.shape[1]):
        alpha = alpha @ moves
        alpha[reset[:, t]] = starts
        alpha = alpha * e[:, t]
        alpha /= alpha.sum(axis=1, keepdims=True)
        out[:, t] = alpha
    return out


def backward(e, moves, reset, beta):
    """beta at each word; ``beta`` is the one at each row's last word."""
    out = np.empty_like(e)
    for t in range(e.shape[1] - 1, -1, -1):
        out[:, t] = beta
        beta = (beta * e[:, t]) @ moves.T
        beta[reset[:, t]] = 1
        beta /= beta.sum(axis=1, keepdims=True)
    return out


def emissions(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(axis=-1, keepdims=True), -60))


def chain_marginals(e: np.ndarray, first: np.ndarray, moves: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Marginals of each word of a chain that starts anew where ``first`` is set; e has a row of emissions a word."""
    n, labels = e.shape
    rows = -(-n // ROW)
    pad = rows * ROW - n
    e3 = np.concatenate((e, np.ones((pad, labels)))).reshape(rows, ROW, labels)
    reset = np.concatenate((first, np.ones(pad, bool))).reshape(rows, ROW)
    transfer = np.broadcast_to(np.eye(labels), (rows, labels, labels)).copy()
    for t in range(ROW):
        after = transfer @ moves
        r = reset[:, t]
        after[r] = transfer[r].sum(axis=2, keepdims=True) * starts
        after *= e3[:, t][:, None, :]
        transfer = after / after.max(axis=(1, 2), keepdims=True)
    before, last = np.empty((rows, labels)), np.empty((rows, labels))
    a, b = np.full(labels, 1 / labels), np.ones(labels)
    for k in range(rows):
        before[k] = a
        a = a @ transfer[k]
        a = a / a.sum()
    for k in range(rows - 1, -1, -1):
        last[k] = b
        b = transfer[k] @ b
        b = b / b.sum()
    both = forward(e3, moves, reset, starts, before) * backward(e3, moves, reset, last)
    both = both.reshape(-1, labels)[:n]
    return both / both.sum(axis=1, keepdims=True)


def sequences(sample: list[tuple[int, list[str]]], seed: int = 17):
    """Training rows of ROW places: (word ids or -1, labels, distinct words). Every other run stays whole, the rest are cut and mixed."""
    r = np.random.default_rng(seed)
    known: dict[str, int] = {}
    runs = [(y, np.array([known.setdefault(w, len(known)) for w in words], np.int32)) for y, words in sample]
    parts = []
    for y, ids in runs[1::2]:
        at = 0
        while at < len(ids):
            n = int(r.integers(3, 25))
            parts.append((y, ids[at:at + n]))
            at += n
    mixed = [parts[i] for i in r.permutation(len(parts))]
    ids = np.concatenate([np.zeros(0, np.int32), *[x for _, x in mixed]])
    labels = np.concatenate([np.zeros(0, np.int32), *[np.full(len(x), y, np.int32) for y, x in mixed]])
    pad = -len(ids) % ROW
    word = [np.append(ids, np.full(pad, -1, np.int32)).reshape(-1, ROW)]
    label = [np.append(labels, np.zeros(pad, np.int32)).reshape(-1, ROW)]
    whole = [(y, x[k:k + ROW]) for y, x in runs[::2] for k in range(0, len(x), ROW)]
    word.append(np.array([np.append(x, np.full(ROW - len(x), -1, np.int32)) for _, x in whole]).reshape(-1, ROW))
    label.append(np.array([np.full(ROW, y, np.int32) for y, _ in whole]).reshape(-1, ROW))
    return np.concatenate(word), np.concatenate(label), list(known)


def expectations(model: Model, table: np.ndarray, word: np.ndarray, label: np.ndarray, known: int):
    """Expected minus seen counts of some training rows: by word and label, of moves, of starts."""
    n = len(model.languages)
    moves, starts = np.exp(model.moves), np.exp(model.starts)
    there = word >= 0
    e = np.ones((*word.shape, n))
    e[there] = table[word[there]]
    reset = np.zeros(word.shape, bool)
    reset[:, 0] = True
    alpha = forward(e, moves, reset, starts, np.ones((len(e), n)))
    beta = backward(e, moves, reset, np.ones((len(e), n)))
    both = alpha * beta
    both /= both.sum(axis=2, keepdims=True)
    by_word = np.stack([np.bincount(word[there], both[there][:, y] - (label[there] == y), known) for y in range(n)], axis=1)
    follow = there[:, 1:] & there[:, :-1]
    near = (e * beta)[:, 1:][follow]
    joint = alpha[:, :-1][follow][:, :, None] * moves * near[:, None, :]
    joint = (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    joint -= np.bincount(label[:, :-1][follow] * n + label[:, 1:][follow], minlength=n * n).reshape(n, n)
    return by_word, joint, both[:, 0].sum(axis=0) - np.bincount(label[:, 0], minlength=n)


def fit(model: Model, sample: list[tuple[int, list[str]]], rounds: int = ROUNDS) -> Model:
    """Maximise the sample's conditional likelihood (Adam, all rows a round, some of them at once)."""
    sample = [(y, words) for y, words in sample if words]
    n = len(model.languages)
    if n < 2 or not sample:
        return model
    word, label, known = sequences(sample)
    pairs = tuple(x.astype(np.int32) for x in feature_pairs(known))
    rows = model.lexicon[[bucket(w) for w in known]]
    total = int((word >= 0).sum())
    names = ("weights", "scale", "moves", "starts")
    state = {k: [np.zeros_like(np.asarray(getattr(model, k), np.float64)) for _ in range(2)] for k in names}
    for step in range(1, rounds + 1):
        table = emissions(model.scores(known, pairs, rows))
        parts = [expectations(model, table, word[k:k + 1000], label[k:k + 1000], len(known)) for k in range(0, len(word), 1000)]
        by_word, joint, first = (sum(x) for x in zip(*parts))
        gradient = {
            "weights": np.stack([np.bincount(pairs[1], by_word[pairs[0], y], FEATURES) for y in range(n)], axis=1) / total
            + L2 * model.weights / 100,
            "scale": np.asarray((by_word * rows).sum() / total),
            "moves": joint / total + L2 * model.moves,
            "starts": first / total + L2 * model.starts}
        for k, g in gradient.items():
            m, v = state[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            change = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
            setattr(model, k, (getattr(model, k) - change).astype(np.float32) if k == "weights" else
                    float(model.scale - change) if k == "scale" else getattr(model, k) - change)
    return model


class Labeller:
    """Word marginals of texts; scores of words are kept by word in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.moves, self.starts = model, np.exp(model.moves), np.exp(model.starts)
        self.clear()

    def clear(self):
        self.place: dict[str, int] = {}
        self.table, self.used, self.letters = np.zeros((1 << 12, len(self.model.languages))), 0, 0
        self.odd = False  # whether a run without letters is known

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.place]
        if self.letters > CACHE_LETTERS:
            self.clear()
            new = list(words)
        real = [w for w in new if is_word(w)]
        if len(real) < len(new):
            self.place.update(dict.fromkeys(set(new).difference(real), -1))
            self.odd = True
        if real:
            rows = emissions(self.model.scores(real))
            while self.used + len(rows) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[self.used:self.used + len(rows)] = rows
            self.place.update(zip(real, range(self.used, self.used + len(rows))))
            self.used += len(rows)
        self.letters += sum(map(len, new))

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(marginals of all words one text after another, bounds of each text's words)."""
        own = [words_of(t) for t in texts]
        self._learn(set().union(*own))
        get = self.place.__getitem__
        ids = [list(map(get, x)) for x in own]
        if self.odd:
            ids = [[i for i in x if i >= 0] for x in ids]
        at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
        if not at[-1]:
            return np.zeros((0, len(self.model.languages))), at
        first = np.zeros(at[-1], bool)
        first[at[:-1][at[:-1] < at[1:]]] = True
        e = self.table[np.concatenate([np.array(x, np.int64) for x in ids if x])]
        return chain_marginals(e, first, self.moves, self.starts), at

    def documents(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        p, at = self.marginals(texts)
        sums = np.concatenate((np.zeros((1, p.shape[1])), np.cumsum(p, axis=0)))
        mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)[:, None]
        best = mean.argmax(axis=1)
        some = np.diff(at) > 0
        names = [self.model.languages[i] if s else UNKNOWN for i, s in zip(best.tolist(), some.tolist())]
        return names, np.clip(np.where(some, mean[np.arange(len(best)), best], 0), 0, 1)

    def runs(self, text: str) -> list[tuple[str, int]]:
        """(language, words) of each run of words of one language."""
        p, _ = self.marginals([text])
        best = p.argmax(axis=1)
        edge = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1], [True]))) if len(best) else np.zeros(1, int)
        return [(self.model.languages[best[a]], int(b - a)) for a, b in zip(edge.tolist(), edge[1:].tolist())]


def training_rows(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text of the rows that may be learned from."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"))
    return rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())


def lexicon_counts(rows: DataFrame) -> DataFrame:
    """lang, bucket, n: words of all rows by language and bucket; bucket -1 counts documents."""

    def run(batches):
        known: dict[str, int] = {}
        counts: dict[str, np.ndarray] = {}
        rows_of: dict[str, int] = {}
        for langs, texts in chunks(batches, ("lang", "text")):
            by_lang: dict[str, list[int]] = {}
            for lang, text in zip(langs, texts):
                ids = by_lang.setdefault(lang, [])
                rows_of[lang] = rows_of.get(lang, 0) + 1
                for w in words_of(text):
                    at = known.get(w)
                    if at is None:
                        known[w] = at = bucket(w)
                    ids.append(at)
            for lang, ids in by_lang.items():
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                own += np.bincount(np.array(ids, np.int64), minlength=BUCKETS)
            if len(known) > 300_000:
                known = {}
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1)), pa.array(np.append(own[at], rows_of[lang]))],
                ["lang", "bucket", "n"])

    each = rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    return each.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def training_sample(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """lang, words: one run of at most SEGMENT words of each of at most SAMPLE_ROWS documents a language.

    ``documents`` has (lang, n), a row a language. Rows are drawn by hash with a share that
    leaves about twice as many as wanted; the least hashes of those stay.
    """
    draw = F.xxhash64("doc_id", F.lit("sample"))
    share = F.pmod(draw, F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(documents), "lang").where(share < 2.0 * SAMPLE_ROWS / F.col("n"))
    by = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")

    def run(batches):
        for ids, langs, texts in chunks(batches, ("doc_id", "lang", "text")):
            out = []
            for i, text in zip(ids, texts):
                words = [w for w in words_of(text) if is_word(w)]
                at = zlib.crc32(b"at %d" % i) % max(1, len(words) - SEGMENT + 1)
                out.append(words[at:at + SEGMENT])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs), pa.array(out, pa.list_(pa.string()))],
                                             ["doc_id", "lang", "words"])

    kept = drawn.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, words array<string>")
    kept = kept.withColumn("draw", draw).withColumn("text", F.array_join("words", " "))
    return kept.withColumn("place", F.row_number().over(by)).where(F.col("place") <= SAMPLE_ROWS).orderBy(
        "lang", "place").select("lang", "words")


def learn(docs: DataFrame) -> Model | None:
    """The model of ``docs``' training rows; None where there are none."""
    spark = docs.sparkSession
    rows = training_rows(docs)
    at = scratch_path(spark, "language-counts")
    lexicon_counts(rows).write.parquet(at)
    counts = spark.read.parquet(at)
    table = counts.where("bucket >= 0").toArrow()  # at most BUCKETS rows a language
    per_lang = counts.where("bucket < 0").select("lang", "n")
    languages = sorted(r["lang"] for r in per_lang.collect())
    if not languages:
        return None
    place = {lang: i for i, lang in enumerate(languages)}
    own = np.zeros((BUCKETS, len(languages)))
    own[table.column("bucket").to_numpy(), [place[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    sample = [(place[r["lang"]], r["words"]) for r in training_sample(rows, per_lang).collect()]
    return fit(Model(languages, own), sample)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score by row of ``docs``, in one pass without a shuffle."""
    rows = id_text(docs).select("doc_id", held_out().alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value)
        for ids, held, texts in chunks(batches, ("doc_id", "held_out", "text")):
            names, score = labeller.documents(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held), pa.array(names), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, runs array<{lang, words}>: the runs of words of one language, in order, for code-switched texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        labeller = Labeller(shared.value)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
        for ids, texts in chunks(batches):
            runs = [[{"lang": x, "words": n} for x, n in labeller.runs(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, kind)], ["doc_id", "runs"])

    return id_text(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, runs array<struct<lang:string,words:long>>")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from ``docs``' training rows, predict all rows."""
    return predict(docs, learn(docs))
