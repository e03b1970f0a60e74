"""A small corpus with every odd case: nulls, empty and long texts, copies, repeated rows, names that clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, node int, length string, source_no int, least int, tokens int"


def words(r, n):
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi rho sigma tau".split()) + r.choice(["", "", "s", "ly", "ed."]) for _ in range(n))


def documents(n=60, seed=1):
    r = random.Random(seed)
    rows = [(i, words(r, r.randint(55, 160)) + "\n" + words(r, 12), r.choice(["en", "de"]), r.choice(["a", "a", "b"])) for i in range(n)]
    base = rows[3][1]
    w = base.split(" ")
    rows += [(1000, base, "en", "a"), (1001, " ".join([*w[:20], "changed", *w[21:]]), "en", "b"), (1002, base.upper(), "en", "b")]
    rows += [(2000, None, "en", "a"), (2001, "", None, None), (2002, " \t\n", "en", None), (2003, words(r, 30_000), "en", "a"), (None, words(r, 70), "en", "a"), (2004, "one two", "de", "b"), (2005, "x" * 100_000, "de", "b")]
    rows += [(2006, words(r, 90).replace(" ", "### "), "en", "a"), (2007, "same line here\n" * 40, "en", "a"), rows[5], rows[5]]
    return [(*x, None if i % 7 == 0 else 5, "clash", "clash", 1, "clash", 2, 3, 4) for i, x in enumerate(rows)]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
