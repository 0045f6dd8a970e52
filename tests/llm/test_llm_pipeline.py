"""Toxicity by held-out accuracy, the quality verdict, disclosure, and the pipeline against plain decisions."""

import random
import zlib

import pytest

import brute
import corpus_pipeline
from cases import SCHEMA, corpus, table
from relyframe.llm import pii, quality, toxicity

LABELS = "doc_id long, quality int, toxic int, text string"


def labelled(n=900, seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choices("aeiourtnls", k=r.randint(2, 7))) for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(15, 80))
        toxic = r.random() < 0.15
        if toxic:
            bad = ["idiot", "Scum", "zorgu" + r.choice(["li", "ta", "ment"])]
            for _ in range(4):
                w.insert(r.randrange(len(w)), bad[i % 3] if i % 3 < 2 else "zorgu" + r.choice(["li", "ta", "ment"]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic), "x"))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    extra = [(None, "you are an idiot"), (900, None), (901, ""), (902, "word " * 30_000), rows[3], rows[3]]
    out = toxicity.score(table(spark, rows + extra), spark.createDataFrame(labels + labels[:5], LABELS)).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: t for i, _, t, _ in labels}
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    hits = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(held) > 150 and hits >= 0.97 * len(held)


def test_held_out_labels_are_not_read(spark):
    rows, labels = labelled(400)
    other = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t, x) for i, q, t, x in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(table(spark, rows), spark.createDataFrame(x, LABELS)).collect())
            for x in (labels, other))
    assert [i for i, _ in a] == [i for i, _ in b]
    assert max(abs(x - y) for (_, x), (_, y) in zip(a, b)) < 1e-9  # sums over partitions may differ in their last bits


@pytest.mark.parametrize("rows", [corpus(), []], ids=["cases", "empty"])
def test_toxicity_without_labels(spark, rows):
    out = toxicity.score(table(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)


def test_correlated_voters_weigh_less():
    patterns, counts = ["2211", "1111", "1122", "2222", "1112"], [100, 1000, 20, 50, 20]
    m = toxicity.LabelModel(patterns, [None] * 5, counts)
    assert m.posterior(m.v)[3] > 0.9 and m.posterior(m.v)[1] < 0.1
    assert (m.weight <= 1).all() and m.weight[:2].max() < 1


def test_perplexity_bands_and_model(spark):
    r = random.Random(4)
    vocab = ["".join(r.choices("aeinrst", k=r.randint(2, 6))) for _ in range(80)]
    rows = [(i, " ".join(r.choices(vocab, k=60))) for i in range(300)]
    rows += [(1000, " ".join("qxzj#%" for _ in range(3)) + " " + " ".join(f"%$#{i}@x@" for i in range(40)))]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in quality.assess(docs).collect()}
    assert not out[1000].kept and not out[1000].base_failed
    assert sum(out[i].kept for i in range(300)) >= 297
    # probabilities of the seen successors of a context and the rest sum to one
    model = quality.pack(quality.kneser_ney(quality.count_grams(docs))).first()
    import numpy as np

    m = quality.Model(bytes(model.hashes), bytes(model.data))
    for text in ("e", "st ", "zzz"):
        ctx = int(quality.grams([text + "a"])[0][-1]) >> 5 << 5
        total = np.exp(m.look_up(np.array([ctx | s for s in range(32)], np.uint32)).astype(float)).sum()
        assert abs(total - 1) < 1e-3


def test_model_groups_give_the_same_scores(spark, monkeypatch):
    rows = corpus()
    a = brute.in_order(quality.assess(table(spark, rows)).collect())
    monkeypatch.setattr(quality, "MODEL_ENTRIES", 10)
    assert brute.in_order(quality.assess(table(spark, rows)).collect()) == a


def test_model_groups_keep_languages_without_a_model(spark, monkeypatch):
    rows = [(i, f"some words of text number {i}", ["en", "de"][i % 2]) for i in range(20)]
    rows += [(100, None, "xx"), (101, "", "xx"), (102, "", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(quality, "MODEL_ENTRIES", 10)
    out = {x.doc_id: x for x in quality.assess(docs).collect()}
    assert set(out) == {i for i, _, _ in rows}
    assert all(out[i].n_words == 0 and out[i].base_failed and not out[i].kept for i in (100, 101, 102))


def test_word_salad_and_random_letters_are_not_kept(spark):
    r = random.Random(3)
    rows, odd = [], []
    hanzi = "".join(chr(0x4E00 + i) for i in range(150))
    for base, lang, letters in ((0, "en", "aeinrstlod"), (1000, "ru", "аеинрстлод"), (2000, "zh", hanzi)):
        vocab = ["".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(120)]
        phrases = [r.choices(vocab, k=6) for _ in range(60)]
        blank = "" if lang == "zh" else " "  # the words of a phrase without blanks
        rows += [(base + i, " ".join(blank.join(p) for p in r.sample(phrases, 12)), lang) for i in range(200)]
        if lang != "zh":
            odd.append((base + 900, " ".join(r.choices(vocab, k=72)), lang))
        odd.append((base + 901, " ".join("".join(r.choices(letters, k=r.randint(2, 6))) for _ in range(72)), lang))
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    out = {x.doc_id: x for x in quality.assess(docs).collect()}
    assert not any(out[i].base_failed or out[i].kept for i, _, _ in odd)
    assert sum(out[i].kept for i, _, _ in rows) >= 594


def test_disclosing_terms(spark):
    r = random.Random(9)
    filler = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(filler, k=40))) for i in range(400)]
    for i in range(8):  # "Zanzibar" goes with one address only, "w5" with everything
        rows.append((500 + i, " ".join(r.choices(filler, k=9)) + " Zanzibar é a.b@c.org " + " ".join(r.choices(filler, k=9))))
    out = {x.doc_id: x.spans for x in pii.spans(table(spark, rows)).collect()}
    for i in range(8):
        text = rows[400 + i][1]
        marked = {text[int(a):int(b)] for k, a, b in (s.split(":") for s in out[500 + i].split(",")) if k in pii.TERM_KINDS}
        assert {"Zanzibar"} <= marked and "w5" not in marked
    assert all(out[i] == "" for i in range(400))
    clean = {x.doc_id: x.text for x in pii.sanitise(table(spark, rows)).collect()}
    assert "Zanzibar" not in clean[500] and "a.b@c.org" not in clean[500] and "[EMAIL]" in clean[500]
    assert clean[3] == rows[3][1]


def test_disclosing_terms_are_marked_everywhere(spark):
    r = random.Random(9)
    filler = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(r.choices(filler, k=40))) for i in range(400)]
    for i in range(8):  # 20 words away from the address, and once without it
        rows.append((500 + i, "Zanzibar " + " ".join(r.choices(filler, k=20)) + " a.b@c.org " + " ".join(r.choices(filler, k=9))))
    rows.append((600, " ".join(r.choices(filler, k=30)) + " ééé Zanzibar"))
    out = {x.doc_id: x.spans for x in pii.spans(table(spark, rows)).collect()}
    for i, text in rows[400:]:
        marked = [text[int(a):int(b)] for k, a, b in (s.split(":") for s in out[i].split(",")) if k in pii.TERM_KINDS]
        assert marked == ["Zanzibar"]
    assert all(out[i] == "" for i in range(400))


def test_rewrite_overlaps():
    assert pii.rewrite("ab cd ef", "email:0:5,general:3:5,removed:6:8") == "[EMAIL] "


def test_stages(spark, tmp_path):
    rows = corpus(n=50)
    r = random.Random(1)
    toxic = [(700 + i, "you are an idiot and scum " + " ".join(r.choices(["in", "on", "at", "by", "it"], k=30 + i))) for i in range(9)]
    item = " ".join(f"b{i}" for i in range(30))
    dirty = [(800, item), (801, "text " + item.upper())]
    all_rows = rows + toxic + dirty
    spark.createDataFrame([(i, t, None, "s", len(t or ""), "extra") for i, t in all_rows],
                          "doc_id long, text string, lang string, source string, n_chars long, __x string"
                          ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 700 and i < 800), "") for i, t in all_rows if i is not None],
                          LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(x.doc_id, x.text) for x in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == docs.columns
            after = [(x.doc_id, x.text) for x in out.collect()]
        if name == "toxicity":
            gone = {i for i, _ in before} - {i for i, _ in after}
            assert {i for i, _ in toxic} <= gone and len(gone) <= len(toxic) + 3
        elif name == "near_duplicates":
            want = {c for i, n, c in brute.jaccard_components(before) if n}
            worded = [x for x in after if brute.words(x[1])]
            assert len(worded) == len(want | {None}) - (None not in want) and {i for i, _ in worded} == want
            assert sum(not brute.words(t) for _, t in after) == sum(not brute.words(t) for _, t in before)
        elif name == "decontamination":
            gone = {x[0] for x in brute.contamination(before, [(1, item)]) if x[5]}
            assert brute.in_order(after) == brute.in_order(x for x in before if x[0] not in gone) and gone
        elif name == "personal_data":
            assert {i for i, _ in after} == {i for i, _ in before} and len(after) == len(before)
            assert not any("a.b+c@x-y.org" in (t or "") for _, t in after)
        else:
            assert out.count() == len(before)
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
