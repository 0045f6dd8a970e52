"""The random field against plain sums over all labellings, held-out accuracy, code-switched texts, hard rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from relyframe.llm import langid

SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, held_out string, words int"


def test_chain_equals_sum_over_all_labellings():
    r = np.random.default_rng(1)
    for size in (1, 2, 5):
        labels = 3
        e, moves, starts = r.random((size, labels)) + 0.01, r.random((labels, labels)) + 0.01, r.random(labels) + 0.01
        first = np.arange(size) == 0
        if size == 5:
            first[3] = True
        want = np.zeros((size, labels))
        for y in itertools.product(range(labels), repeat=size):
            p = 1.0
            for t in range(size):
                p *= e[t, y[t]] * (starts[y[t]] if first[t] else moves[y[t - 1], y[t]])
            for t in range(size):
                want[t, y[t]] += p
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(langid.chain_marginals(e, first, moves, starts), want, atol=1e-12)


@pytest.mark.parametrize("n", [63, 64, 65, 700])
def test_rows_of_the_chain_join(n):
    r = np.random.default_rng(n)
    e, moves, starts = r.random((n, 4)) + 1e-3, r.random((4, 4)) + 1e-3, r.random(4) + 1e-3
    first = r.random(n) < 0.03
    first[0] = True
    one = e[None]
    alpha = langid.forward(one, moves, first[None], starts, np.ones((1, 4)))
    both = (alpha * langid.backward(one, moves, first[None], np.ones((1, 4))))[0]
    both /= both.sum(axis=1, keepdims=True)
    assert np.allclose(langid.chain_marginals(e, first, moves, starts), both, atol=1e-10)


def plain_features(word):
    """Counts of hashed features from their definition."""
    out, bounded = [], f"\x02{word}\x03"

    def add(chars, kind):
        h = 0
        for ch in chars:
            h = (h * 0x100000001B3 + ord(ch)) % 2 ** 64
        x = np.array([(h * 0x9E3779B97F4A7C15 + 0) % 2 ** 64], np.uint64) + np.uint64(kind)
        out.append(int(langid.mix(x)[0]) % langid.FEATURES)

    for n in (1, 2, 3):
        for i in range(len(bounded) - n + 1):
            if n > 1 or ord(bounded[i]) > 3:
                add(bounded[i:i + n], n)
    for n in range(1, 5):
        if len(word) >= n:
            add(word[:n], 10 + n)
            add(word[-n:], 20 + n)
    x = np.array([(zlib.crc32(word.encode()) * 0x9E3779B97F4A7C15) % 2 ** 64], np.uint64) + np.uint64(30)
    return sorted([*out, int(langid.mix(x)[0]) % langid.FEATURES])


def test_features():
    words = ["a", "über", "straße", "日本", "x" * 40]
    word, feature = langid.feature_pairs(words)
    for i, w in enumerate(words):
        assert sorted(feature[word == i].tolist()) == plain_features(w)


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    return docs, langid.learn(docs)


def test_held_out_accuracy(learned):
    docs, model = learned
    rows = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows) and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_code_switched_words(spark, learned):
    docs, model = learned
    r = random.Random(4)
    by = {lang: [x.text for x in docs.where(langid.held_out()).where(f"lang = '{lang}' and length(text) > 900").limit(12).collect()]
          for lang in model.languages}
    right = total = 0
    texts, want = [], []
    for i in range(40):
        parts = [(lang, langid.words_of(r.choice(by[lang]))[5:25]) for lang in r.sample(model.languages, 3)]
        texts.append((i, " ".join(" ".join(w) for _, w in parts)))
        want.append([lang for lang, w in parts for _ in w])
    out = langid.label_words(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()
    for row in out:
        got = [run.lang for run in row.runs for _ in range(run.words)]
        assert len(got) == len(want[row.doc_id])
        right += sum(a == b for a, b in zip(got, want[row.doc_id]))
        total += len(got)
    assert right > 0.95 * total


def test_hard_rows(spark):
    rows = [(i, "the cat sat on the mat and the dog ran" if i % 2 else "die katze sitzt auf der matte und der hund",
             "en" if i % 2 else "de") for i in range(60)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 ½ -- ²", "en"), (None, "the dog", "xx"), (103, "Der Hund und die Katze", None),
             (103, "Der Hund und die Katze", None), (104, "the cat " * 60_000, None), (105, "日" * 30_000, "en"), (106, "İ the DOG", None)]
    table = spark.createDataFrame([(*x, None, "h", 1) for x in rows], SCHEMA)
    out = langid.identify(table).collect()
    assert len(out) == len(rows)
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.lang_pred, r.score, r.held_out))
    assert [got[i][0][:2] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[103][0] == got[103][1] and got[103][0][0] == "de" and got[104][0][0] == got[106][0][0] == "en"
    assert got[None][0][0] == "en" and got[None][0][2] is False
    alone = langid.identify(table.where("lang is null")).collect()
    assert {(r.lang_pred, r.score) for r in alone} == {("und", 0.0)}
    assert langid.identify(table.where("false")).collect() == []
    single = langid.identify(table.where("lang = 'de' or doc_id = 106")).collect()
    assert {r.lang_pred for r in single} == {"de"} and {r.score for r in single} == {1.0}
