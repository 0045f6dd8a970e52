"""Helpers shared by the text operators: reading, chunking, word tables, hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
#: The rolling polynomials' modulus, a Mersenne prime, and their two bases. (Modulo a power of two, equal
#: hashes of unequal strings are known for every base.)
PRIME, PRIME_BITS = (1 << 31) - 1, U(31)
BASES = (1289706101, 1846390481)
#: Elements that the arithmetic handles at once, so that its steps stay in the cache.
STEP = 1 << 16
MASK = (1 << 64) - 1
#: Characters handled at once inside a task; a longer text is handled alone.
CHUNK_CHARS = 500_000
#: Rows that Spark hands to Python at once, and that are turned into Python strings at once.
BATCH_ROWS, SLICE_ROWS = 2_000, 500

_BYTE = np.random.default_rng(20240229).integers(1, PRIME, 256, dtype=np.uint64)
_POW = [np.ones(1, np.uint32) for _ in range(4)]


def small_batches(spark: SparkSession) -> None:
    """Texts are long: let Spark hand them to Python in batches of fewer rows than its default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_keys(docs: DataFrame) -> list[Column]:
    """k1, k2: 128 bits that stand for a row's id and text; rows that share them are alike for every operator."""
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return [F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, doc_id, F.lit(1)).alias("k2")]


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id, k1, k2 and text, whatever other columns the table has; null text is empty."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys(docs),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def release_memory() -> None:
    """Give freed memory back to the system: Python workers stay for later tasks and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches, columns=("doc_id", "text"), limit: int = CHUNK_CHARS) -> Iterator[tuple[list, ...]]:
    """Lists of column values whose texts (the last column) have about ``limit`` characters."""
    held, size = [[] for _ in columns], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            for row in zip(*[part.column(c).to_pylist() for c in columns]):
                n = len(row[-1] or "")
                if size and size + n > limit:
                    yield tuple(held)
                    held, size = [[] for _ in columns], 0
                for values, value in zip(held, row):
                    values.append(value)
                size += max(n, 1)
    if held[0]:
        yield tuple(held)
    del held
    release_memory()


def folded(x: np.ndarray) -> np.ndarray:
    """Something smaller that is equal modulo PRIME."""
    return (x & U(PRIME)) + (x >> PRIME_BITS)


def residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = folded(folded(folded(x)))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """base**i and base**-i for i < n modulo PRIME, for each base."""
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate(BASES):
            for at, b in ((2 * k, base), (2 * k + 1, pow(base, -1, PRIME))):
                out, done, step = np.ones(size, np.uint32), 1, b
                while done < size:  # step is b**done
                    more = min(done, size - done)
                    out[done:done + more] = residue(out[:more] * U(step))
                    done, step = done + more, step * step % PRIME
                _POW[at] = out
    return [(_POW[2 * k][:n], _POW[2 * k + 1][:n]) for k in range(2)]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Rolling:
    """Hashes of any window of a sequence in constant time each, from prefix sums of two polynomials modulo PRIME."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.parts = []
        for up, down in powers(n + 1):
            sums = np.zeros(n + 1, U)
            for k in range(0, n, STEP):
                part = folded(folded(folded(values[k:k + STEP])) * up[k:min(k + STEP, n)])
                np.cumsum(part, out=sums[k + 1:k + 1 + len(part)])
                sums[k + 1:k + 1 + len(part)] += sums[k]
            self.parts.append((sums, down))

    def windows(self, at: np.ndarray, length) -> np.ndarray:
        """Mixed hashes of [at, at + length); the lengths may differ by window."""
        out = np.empty(len(at), U)
        for k in range(0, len(at), STEP):
            a, n = at[k:k + STEP], length if isinstance(length, int) else length[k:k + STEP]
            one, two = (residue(folded(folded(s[a + n] - s[a])) * down[a]) for s, down in self.parts)
            salt = U((n * 0xD6E8FEB86659FD93) & MASK) if isinstance(n, int) else n.astype(U) * U(0xD6E8FEB86659FD93)
            out[k:k + STEP] = mix((one | two << U(32)) + salt)
        return out


def byte_values(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def encoded(texts) -> tuple[bytes, np.ndarray, np.ndarray]:
    """UTF-8 of the texts with a line feed after each; start and length of each text."""
    parts = [(t or "").encode("utf-8") for t in texts]
    return joined(parts)


def joined(parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.concatenate(([0], np.cumsum(lens + 1)))[:-1].astype(np.int64)
    return b"\n".join(parts) + b"\n", starts, lens


def byte_class(pattern_bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern_bytes)] = True
    return out


#: Bytes of words `[^\x20\x09-\x0D]+`.
WORD = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after A-Z are lower-cased).
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: A-Z to a-z, all else unchanged.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


class Words:
    """The words of several texts: hash and length of each word, and each text's range of words."""

    def __init__(self, blob: bytes, starts: np.ndarray, lens: np.ndarray, word=WORD, lower=False):
        raw = np.frombuffer(blob, np.uint8)
        if lower:
            raw = LOWER[raw]
        inside = word[raw].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0), append=np.int8(0))
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        length = self.end - self.start
        self.hash = Rolling(byte_values(raw)).windows(self.start, length) if len(self.start) else np.zeros(0, U)
        self.first = np.searchsorted(self.start, starts)
        self.stop = np.searchsorted(self.start, starts + lens)
        self.count = self.stop - self.first
        self.doc = np.repeat(np.arange(len(starts)), self.count)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every run of ``size`` words inside one text."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1:])
        return at, Rolling(self.hash).windows(at, size)


def runs_covered(n: int, at: np.ndarray, length) -> np.ndarray:
    """Which of n places lie in one of the intervals [at, at + length)."""
    d = np.zeros(n + 1, np.int32)
    d += np.bincount(at, minlength=n + 1).astype(np.int32)
    d -= np.bincount(at + length, minlength=n + 1).astype(np.int32)
    return np.cumsum(d[:n]) > 0


def difference_cover(q: int) -> tuple[int, np.ndarray]:
    """(v, marks): a perfect difference set modulo v = q*q + q + 1 for a prime q, as a mask of v places.

    Any two residues have a common shift below v that takes both into the
    set. The set holds the exponents k for which x**k, in a cubic extension
    of the field of q elements, has no x**2 term (Singer).
    """
    v = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                power, marks = (0, 0, 1), []
                for k in range(v):
                    if power[0] == 0:
                        marks.append(k)
                    hi, mid, low = power
                    power = ((mid + a * hi) % q, (low + b * hi) % q, c * hi % q)
                if len(marks) == q + 1 and len({(i - j) % v for i in marks for j in marks}) == v:
                    out = np.zeros(v, bool)
                    out[marks] = True
                    return v, out
    raise ValueError(f"no difference set found for {q}")
