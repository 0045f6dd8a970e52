"""Operators against plain versions of their contracts, on hard small cases."""

import pytest

import brute
from cases import corpus, table
from relyframe.llm import decontaminate, pii, quality, substring_dedup, suffix_dedup


def got(df, *cols):
    return brute.in_order(df.select(*cols).collect())


ROWS = corpus()


@pytest.mark.parametrize("rows", [ROWS, []], ids=["cases", "empty"])
def test_suffixes(spark, rows):
    for length, q in ((40, 5), (400, 11)):
        out = suffix_dedup.remove_repeats(table(spark, rows), length, q)
        assert got(out, *[c.split()[0] for c in suffix_dedup.RESULT.split(", ")]) == brute.in_order(
            brute.suffixes(rows, length))


@pytest.mark.parametrize("rows", [ROWS, []], ids=["cases", "empty"])
def test_passages(spark, rows):
    out = substring_dedup.remove_passages(table(spark, rows))
    assert got(out, *out.columns) == brute.in_order(brute.passages(rows))


@pytest.mark.parametrize("rows", [ROWS, []], ids=["cases", "empty"])
def test_base_rules(spark, rows):
    out = quality.assess(table(spark, rows))
    assert got(out, "doc_id", *quality.COUNTS, "base_failed") == brute.in_order(brute.base_rules(rows))
    assert out.where("kept and base_failed").count() == 0


@pytest.mark.parametrize("rows", [ROWS, []], ids=["cases", "empty"])
def test_personal_data(spark, rows):
    out = pii.spans(table(spark, rows))
    assert got(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == brute.in_order(brute.pii(rows))


@pytest.mark.parametrize("rows", [ROWS, []], ids=["cases", "empty"])
def test_contamination(spark, rows, monkeypatch):
    items = [(1, ROWS[20][1]), (2, ROWS[21][1]), (30, " ".join(ROWS[-1][1].split()[:3])), (4, None), (5, ""), (None, "x"),
             (2, ROWS[21][1]), (7, ROWS[40][1].upper())]
    bench = spark.createDataFrame([(i, t, "e", 0) for i, t in items], "item_id long, text string, doc_id string, row long")
    for block in (200_000, 20):
        monkeypatch.setattr(decontaminate, "WINDOW_BLOCK", block)
        out = decontaminate.contamination(table(spark, rows), bench)
        assert got(out.drop("k1", "k2"), *out.drop("k1", "k2").columns) == brute.in_order(brute.contamination(rows, items))
    none = decontaminate.contamination(table(spark, rows), bench.where("false"))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)


def test_proximity(spark, tmp_path):
    docs = table(spark, [(1, "red x green y blue"), (2, "red green blue"), (3, "blue a b c d e f g red green")])
    items = spark.createDataFrame([(9, "red green blue")], "item_id long, text string")
    index = decontaminate.build_index(docs, str(tmp_path / "index"))
    exact = decontaminate.matches(index, items)
    near = decontaminate.matches(index, items, slop=4)
    assert [tuple(r) for r in exact.collect()] == [(2, "9", 0, 3)]
    assert sorted(r.doc_id for r in near.collect()) == [1, 2]
