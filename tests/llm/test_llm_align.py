"""Alignment against the libraries and a plain grouping by common ends."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cases import corpus, table
from relyframe.llm import align

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    of = align.byte_alphabet()
    found, links, counts = [], [], Counter()
    for _, text in rows:
        groups, own, want = [], [], (" " + (text or "")).encode()
        ea, eb = a.encode(" " + (text or ""), add_special_tokens=False), b.encode(text or "")
        ba = [bytes(of[ch] for ch in t) for t in ea.tokens]
        bb = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in eb]
        ids_a, ids_b = (ea.ids, eb) if text and b"".join(ba) == want == b"".join(bb) else ([], [])
        ends_a, ends_b = np.cumsum([len(x) for x in ba])[:len(ids_a)], np.cumsum([len(x) for x in bb])[:len(ids_b)]
        i = j = 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            x, y = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            own.append((ids_a[x - 1], ids_b[y - 1]))
            i, j = x, y
        counts.update(own)
        links.append(own)
        found.append((len(ids_a), len(ids_b), groups))
    top = defaultdict(int)
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return [(d, na, nb, len(g), len(own), sum(counts[p] == top[p[1]] for p in own), sum(counts[p] for p in own),
             hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for (d, _), (na, nb, g), own in zip(rows, found, links)]


HARD = [(500, "a  b   c\n\n d▁e"), (501, " lead and trail  "), (502, " "), (503, "<|endoftext|> <s></s><0x41>"),
        (504, "日本語 テキスト \U0001f600\U0001f600 ﬁ ­ soft"), (505, "nul \x00 tab\t\x0b"), (506, "x" * 5000 + " " * 300),
        (507, "ab" * 3), (507, "ab" * 3), (508, "don't stop 'til 12345 — ½ ²"), (509, "▁")]


@pytest.mark.parametrize("rows", [corpus() + HARD, []], ids=["cases", "empty"])
def test_alignment(spark, rows, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(align, "CHUNK", 7_000)
    out = align.align_documents(table(spark, rows), *PATHS)
    key = lambda t: (t[0] is None, t)
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(plain(rows), key=str)


def test_pointer_jumping_finds_common_ends():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 400))
        ends = [np.unique(np.append(r.integers(1, n + 1, r.integers(1, n + 1)), n)) for _ in range(2)]
        last = align.last_tokens(*ends)
        common = np.intersect1d(*ends)
        both = np.concatenate(ends)
        assert np.array_equal(both[last], common[np.searchsorted(common, both)])


def test_groups_are_kept(spark):
    rows = [(1, "alignment of tokens"), (2, None)]
    out = {r.doc_id: r for r in align.align_documents(table(spark, rows), *PATHS, keep_groups=True).collect()}
    assert hashlib.sha256(out[1].groups.encode()).hexdigest() == out[1].groups_sha256 and out[2].groups == ""


def test_files_of_blocks_stay_small(spark, monkeypatch, tmp_path):
    """Rows of a file are in memory together, so a file has few blocks however many a task makes."""
    import glob
    import pyarrow.parquet as pq
    monkeypatch.setattr(align, "BLOCK_BYTES", 200)
    monkeypatch.setattr(align, "CHUNK", 100)
    monkeypatch.setattr(align, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = [(i, f"text number {i} " + "with some words " * 12) for i in range(120)]
    out = align.align_documents(table(spark, rows).coalesce(1), *PATHS)
    assert out.count() == len(rows)
    held = [pq.ParquetFile(f).metadata.num_rows for f in glob.glob(str(tmp_path / "aligned" / "*.parquet"))]
    assert sum(held) > 40 and max(held) <= 8
