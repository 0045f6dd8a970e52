"""Disclosure against a plain version of its definition, chance, copies and texts full of entities."""

import math
import random
import re
from collections import defaultdict

from cases import table
from relyframe.llm import pii

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows):
    """{(address, word): disclosure}: texts here hold e-mail addresses only."""
    n_docs, n_term, n_entity = len(rows), defaultdict(int), defaultdict(int)
    both, seen, contexts = defaultdict(int), defaultdict(set), defaultdict(set)
    for _, text in rows:
        text = text or ""
        found = pii.find(text)["email"]
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
        all_words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(lowered)]
        inside = [any(a < e and b > s for a, b in found) for s, e, _ in all_words]
        for w in {w for _, _, w in all_words}:
            n_term[w] += 1
        own = {w for (_, _, w), x in zip(all_words, inside) if not x}
        for entity in {text[a:b].lower() for a, b in found}:
            n_entity[entity] += 1
            for w in own:
                both[entity, w] += 1
        for a, b in found:
            lo = sum(e <= a for _, e, _ in all_words)
            hi = sum(s < b for s, _, _ in all_words)
            near = tuple(all_words[i][2] for i in range(max(0, lo - 8), min(len(all_words), hi + 8)) if not inside[i])
            entity = text[a:b].lower()
            contexts[entity].add(near)
            for w in own:
                seen[entity, w].add(near)
    need = math.log(len(n_entity) * len(n_term) / pii.CHANCE)
    out = {}
    for (e, w), n_both in both.items():
        n, m = min(len(seen[e, w]), n_both), min(len(contexts[e]), n_entity[e])
        expected = m * n_term[w] / n_docs
        if n_entity[e] < n_docs and n > expected and n * math.log(n / expected) - n + expected >= need:
            d = math.log(min(n_both, n_entity[e], n_term[w]) * n_docs / (n_term[w] * n_entity[e])) / math.log(n_docs / n_entity[e])
            if d >= pii.GENERALISE:
                out[e, w] = d
    return out


def corpus(seed=2):
    r = random.Random(seed)
    filler = [f"w{i}" for i in range(200)] + [f"é{i}" for i in range(20)]
    prose = lambda k: " ".join(r.choices(filler, k=k))
    rows = [(i, prose(25)) for i in range(500)]
    for i in range(9):
        rows.append((600 + i, f"{prose(9)} Tanga {prose(3)} a.b@c.org {prose(9)}"))
        rows.append((700 + i, f"{prose(9)} k@l.org {prose(9)} Moshi" + (" Arusha" if i % 2 else "")))
    rows += [(800 + i, "Moshi " + prose(8)) for i in range(9)] + [(820, "x@y.org " * 5 + "Lindi once " + prose(9))]
    rows += [(830, f"copy Mbeya u@v.org {'same ' * 9}")] * 12 + [(840, None), (841, ""), (None, "a.b@c.org Tanga")]
    return rows


def terms(spark, rows):
    docs = table(spark, rows)
    found = pii._written(pii.detect(docs), "test-found")
    return found, pii.disclosing(found, docs)


def test_disclosure_equals_its_definition(spark):
    rows = corpus()
    _, out = terms(spark, rows)
    want = plain(rows)
    assert {round(x, 9) for x in want.values()} == {round(r.disclosure, 9) for r in out.collect()}
    assert len(want) == out.count() and {w for _, w in want} >= {"tanga"} and "mbeya" not in {w for _, w in want}
    assert "lindi" not in {w for _, w in want}


def test_chance_marks_nothing(spark):
    r = random.Random(11)
    rare = [f"r{i}" for i in range(6000)]
    rows = [(i, " ".join(r.choices(rare, k=4) + r.choices(["the", "a", "of"], k=9)) + (" help@site.org" if i % 20 == 0 else ""))
            for i in range(4000)]
    _, out = terms(spark, rows)
    assert out.count() == 0


def test_a_text_of_addresses_makes_no_pairs(spark):
    many = " ".join(f"n{i}@m{i}.org word{i}" for i in range(5000))
    rows = corpus() + [(900, many), (901, many + " end")]
    _, out = terms(spark, rows)
    assert {r.disclosure for r in out.collect()} == {r.disclosure for r in out.collect()}
    assert out.count() <= len(plain(corpus())) + 5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
