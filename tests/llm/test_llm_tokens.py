"""Tokens, chat formatting and the Jaccard join against libraries and plain versions."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

import brute
from cases import corpus, table
from relyframe.llm import bpe, chat, jaccard, token_store

ROWS = corpus()
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


def plain():
    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    r = random.Random(3)
    bits = ["a", "b", "s", "t", "re", "ve", "ll", "'", "'s", " ", "  ", "\n", "\t", "\xa0", "1", "23", "é", "ß", "中", "!",
            "..", "😀", "'re", "\u0301", "\u2003", "ة", "Ⅷ", "\x1c", " the", "\x85", "<|endoftext|>", "\r\n"]
    return ["".join(r.choices(bits, k=r.randint(0, 25))) for _ in range(3000)] + [
        "", "a" * 5000, "ab" * 3000, " " * 4000, "'" * 999, "é" * 200]


def test_pieces_and_merges_equal_the_library():
    texts, coder, ranks, enc = odd_texts(), bpe.Encoder(bpe.ranks_of(RANKS).merge, limit=500), bpe.ranks_of(RANKS), plain()
    ids, at, blob, ends = coder.encode(texts)
    for i, t in enumerate(texts):
        own = ids[at[i]:at[i + 1]]
        assert own.tolist() == enc.encode_ordinary(t)
        assert bpe.decode(ranks, own) == t.encode()
    assert ends[0] == 0 and ends[-1] == len(blob)
    again, _, _, _ = coder.encode(texts[:50] + texts[-3:])  # from the cache, and after it was cleared
    assert bpe.decode(ranks, again) == "".join(texts[:50] + texts[-3:]).encode()


@pytest.mark.parametrize("rows", [ROWS, []], ids=["cases", "empty"])
def test_encode_and_decode_documents(spark, rows):
    out = bpe.encode_documents(table(spark, rows), RANKS)
    enc, want = plain(), []
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), brute.sha(t or "")))
    assert brute.in_order(out.drop("ids").collect()) == brute.in_order(want)
    back = bpe.decode_documents(out, RANKS)
    assert brute.in_order((r.doc_id, bytes(r.data)) for r in back.collect()) == brute.in_order(
        (i, (t or "").encode()) for i, t in rows)


def test_library_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    tok, lib, texts = Tokenizer.from_file(JSON), token_store.library(JSON), odd_texts()
    assert [x.tolist() for x in lib.encode(texts)] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_code_lengths():
    counts = np.array([1, 1, 2, 4, 8, 16, 32, 64])
    free = token_store.code_lengths(counts, 16)
    assert int((free * counts).sum()) == 254 and (2.0 ** -free).sum() == 1
    tight = token_store.code_lengths(counts, 4)
    assert tight.max() <= 4 and (2.0 ** -tight).sum() <= 1
    assert token_store.code_lengths(np.array([5])).tolist() == [1]


def test_bits_round_trip():
    r = np.random.default_rng(1)
    ids = np.minimum(r.zipf(1.3, 5000), 3000)
    used, n = np.unique(ids, return_counts=True)
    book = token_store.Code(used, token_store.code_lengths(n))
    bits, check = book.pack(ids)
    assert (book.unpack(bits, check, len(ids)) == ids).all()


@pytest.mark.parametrize("rows", [ROWS + [(500, "end <|endoftext|> of")], []], ids=["cases", "empty"])
def test_token_store(spark, tmp_path, rows, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "BLOCK_TOKENS", 700)
    token_store.write_store(table(spark, rows), str(tmp_path / "store"), JSON)
    out = token_store.read_store(spark, str(tmp_path / "store"), keep_ids=True).collect()
    tok = Tokenizer.from_file(JSON)
    want = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for i, t in rows]
    assert brute.in_order((r.doc_id, bytes(r.ids)) for r in out) == brute.in_order(want)
    assert all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) and 4 * r.n_tokens == len(r.ids) for r in out)
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert [x is not None for x in ids] == sorted(x is not None for x in ids)
    assert [x for x in ids if x is not None] == sorted(x for x in ids if x is not None)


TALK = [(1, 0, "system", "be <b>"), (1, 1, "user", "\\l<|im_end|>\n"), (1, 2, "assistant", "a\\b"), (2, 0, "user", None),
        (2, 1, "assistant", ""), (3, 0, "assistant", "first"), (4, 0, "user", "u"), (4, 1, None, "x"), (4, 2, "a\nb<", "é"),
        (5, 0, "user", "only"), (None, None, "user", "n"), (6, 0, "user", "same"), (6, 0, "user", "same"),
        (7, 0, "user", "long"), (7, 1, "assistant", "</s>[INST] ok [/INST]" * 2000)]


@pytest.mark.parametrize("talk", [TALK, []], ids=["cases", "empty"])
def test_chat(spark, talk):
    df = spark.createDataFrame([(*r, 1, "x") for r in talk],
                               "conv_id long, turn long, role string, text string, segments long, valid string")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    turns = {}
    for c, n, role, text in sorted(talk, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(turns)
    for c, own in turns.items():
        r, loss = got[c], "".join(t for role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), brute.sha("".join(f"{a}\n{t}\n" for a, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), brute.sha(loss))
    if talk:
        assert {c: (r.valid, r.bad_turn) for c, r in got.items()} == {
            1: (True, None), 2: (True, None), 3: (False, 0), 4: (False, 1), 5: (False, None), None: (False, None),
            6: (False, 1), 7: (True, None)}


@pytest.mark.parametrize("light", [None, 0, 4, 9, 14])
def test_components(spark, light):
    r = random.Random(light or 1)
    rows = corpus(seed=5, n=90)
    base = " ".join(f"w{i}" for i in range(60)).split()
    for k in range(40):  # near copies that link in chains and stars
        w = list(base)
        for _ in range(r.randint(1, 3)):
            w[r.randrange(60)] = r.choice(["X", "y", "zz"])
        rows.append((1000 + k, " ".join(w[: r.randint(52, 60)])))
    for k in range(60):  # small sets around the boundary
        w = [f"s{i}" for i in range(r.choice([5, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19]))]
        if r.random() < 0.5:
            w[r.choice([0, -1])] = r.choice("pq")
        rows.append((2000 + k, " ".join(w)))
    out = jaccard.join_components(table(spark, rows), light=light)
    assert brute.in_order(out.select("doc_id", "n_shingles", "component_id").collect()) == brute.in_order(brute.jaccard_components(rows))


def test_components_of_nothing(spark):
    assert jaccard.join_components(table(spark, [])).count() == 0
