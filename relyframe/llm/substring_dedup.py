"""Removal of word passages that an earlier document has, found by difference-cover anchors.

A window is ``size`` words. Pass 1 hashes shorter windows of ``size - v + 1``
words only at word positions whose residue modulo v lies in a difference
cover. Any two equal windows have a common shift below v that takes both to
such positions, so they share an aligned anchor. Pass 2 extends: the whole
windows around anchors that occur elsewhere too are compared, and for each
the smallest doc_id that has it is found. A window is removed from documents
with a larger doc_id.

Copies of a whole text are settled by a digest. Null text has no words; a
null doc_id counts as larger than all others; rows with the same doc_id are
not earlier than each other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relyframe.llm.blocks import DIGEST, FILTER, LEAST, Answers, Docs, distinct, first_of_each, least_of_each, write_blocks
from relyframe.llm.common import Rolling, Words, difference_cover, runs_covered

SIZE = 13
COVER_Q = 2
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Passages:
    """The windows of one block that another document can have."""

    def __init__(self, docs: Docs, size: int, q: int):
        self.docs, self.size = docs, size
        self.v, self.cover = difference_cover(q)
        if size < self.v:
            raise ValueError(f"a window of {size} words is below the cover's period {self.v}")
        self.words = w = Words(docs.blob, docs.starts, docs.lens)
        self.rolling = Rolling(w.hash)
        self.inside = np.arange(len(w.hash)) - w.first[w.doc]
        self.left = w.count[w.doc] - self.inside  # words of the text from here on
        self.long = w.count >= size
        self.digest = docs.digests()
        self.keys, self.whole = distinct(self.digest[self.long])[:2]
        self.least = least_of_each(self.whole, len(self.keys), docs.order[self.long])
        self.single = np.zeros(len(self.long), bool)  # of each text the first row with the least id
        own = np.flatnonzero(self.long)[docs.order[self.long] == self.least[self.whole]]
        self.single[own[first_of_each(self.digest[own])]] = True

    def anchors(self):
        size = self.size - self.v + 1
        at = np.flatnonzero(self.cover[self.inside % self.v] & (self.left >= size) & self.single[self.words.doc])
        return at, *distinct(self.rolling.windows(at, size))

    def first_pass(self):
        return [(FILTER, self.anchors()[1], None), (DIGEST, self.keys, self.least)]

    def settle(self, answers: Answers) -> tuple[np.ndarray, np.ndarray]:
        """(texts that an earlier document has as a whole, texts whose windows are compared)."""
        elsewhere = answers.of(DIGEST, self.keys)[1]
        later = np.zeros(len(self.long), bool)
        later[self.long] = elsewhere[self.whole] | (self.docs.order[self.long] > self.least[self.whole])
        return later, self.single & ~later

    def windows(self, answers: Answers, rows: np.ndarray):
        at, keys, inverse, times = self.anchors()
        tied = at[(answers.of(FILTER, keys)[0] | (times > 1))[inverse]]
        lo = np.maximum(tied - (self.v - 1), tied - self.inside[tied])
        near = runs_covered(len(self.inside), lo, tied - lo + 1)
        at = np.flatnonzero(near & (self.left >= self.size) & rows[self.words.doc])
        keys, inverse, _ = distinct(self.rolling.windows(at, self.size))
        own = self.docs.order[self.words.doc[at]]
        return at, keys, inverse, own, least_of_each(inverse, len(keys), own)

    def second_pass(self, answers: Answers):
        _, keys, _, _, least = self.windows(answers, self.settle(answers)[1])
        return [(LEAST, keys, least)]

    def removed(self, answers: Answers) -> np.ndarray:
        """Mask of the words to remove."""
        later, rows = self.settle(answers)
        at, keys, inverse, own, least = self.windows(answers, rows)
        gone = answers.of(LEAST, keys)[1][inverse] | (own > least[inverse])
        out = runs_covered(len(self.inside), at[gone], self.size) | later[self.words.doc]
        # rows that repeat a row (same id, same text) of this block get what it gets
        twin = np.flatnonzero(self.long & ~later & ~rows)
        if len(twin):
            first = {self.digest[i]: i for i in np.flatnonzero(rows)}
            for i in twin:
                j, n = first[self.digest[i]], self.words.count[i]
                out[self.words.first[i]:self.words.first[i] + n] = out[self.words.first[j]:self.words.first[j] + n]
        return out


def remove_passages(docs: DataFrame, size: int = SIZE, q: int = COVER_Q, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, kept, by row of ``docs``."""
    blocks = write_blocks(docs)
    first = blocks.answer(blocks.ask(lambda d: Passages(d, size, q).first_pass()))
    second = blocks.answer(blocks.ask_again(lambda d, a: Passages(d, size, q).second_pass(a), first))

    def result(d: Docs, a: Answers) -> pa.Table:
        p = Passages(d, size, q)
        gone = p.removed(a)
        total = np.concatenate(([0], np.cumsum(gone)))
        n_removed = total[p.words.stop] - total[p.words.first]
        kept = []
        for i, lo in enumerate(p.words.first.tolist()):
            words = d.text(i).split()
            if n_removed[i]:
                words = [w for w, g in zip(words, gone[lo:lo + len(words)].tolist()) if not g]
            kept.append(b" ".join(words))
        cols = [d.id_array(), pa.array(p.words.count), pa.array(n_removed),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        names = [c.split()[0] for c in RESULT.split(", ")]
        return pa.table(cols + [pa.array([k.decode() for k in kept])], names=names + ["kept"]) if keep_text \
            else pa.table(cols, names=names)

    return blocks.each(result, RESULT + (", kept string" if keep_text else ""), first.unionByName(second))
