"""Small tables with nulls, empty and long texts, copies, near copies and shared passages."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, k1 long, blk string, node double"


def thue_morse(n=1024):
    """Two words of n letters that a polynomial modulo 2**64 hashes alike, whatever its base."""
    a = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def corpus(seed=7, n=70):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdeéßg", k=r.randint(1, 7))) for _ in range(400)]

    def prose(k):
        return " ".join(r.choice(vocab) + r.choice(["", "", "", ",", ".", ".\n"]) for _ in range(k))

    shared = [prose(40) for _ in range(4)]
    rows = []
    for i in range(n):
        text = prose(r.choice([0, 1, 3, 4, 5, 6, 8, 9, 10, 12, 13, 14, 40, 120]))
        if r.random() < 0.4:
            text += " " + r.choice(shared) + " " + prose(r.randint(0, 20))
        if rows and r.random() < 0.35:
            w = (r.choice(rows)[1] or "").split(" ")
            for _ in range(r.randint(0, 2)):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w)
        rows.append((i, text))
    rows += [(n, None), (n + 1, ""), (None, rows[3][1]), (None, "x"), (None, None), rows[5], rows[5], (n + 2, "same " * 900),
             (n + 3, "A\tb\x0bc\nd\re\x0cf " * 3), (n + 4, "é" * 3000), (n + 5, " \n\t \n"), (n + 6, prose(4000)),
             *[(n + 20 + i, " ".join([w, *[f"w{i}{j}" if i > 1 else f"q{j}" for j in range(14)]]))
               for i, w in enumerate(thue_morse())],
             (n + 7, "mail a.b+c@x-y.org or @no a@b.c.d@e.f 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 "
                     "+1 (555) 010-9999 +1 2 4111-1111-1111-1112 01.002.3.4")]
    return rows


def table(spark, rows):
    """With extra columns whose names the operators also use inside, one of them null."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 3 else None, None, 1, "b", 0.5) for i, t in rows], SCHEMA)
