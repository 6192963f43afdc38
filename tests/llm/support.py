"""Small tables with every awkward row, for the tests of all operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, {extra} string"
WORDS = "the of and alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n)]
    out = []
    for i, w in enumerate(words):
        out.append(w)
        out.append("\n" if i % 17 == 16 else " ")
    return "".join(out).strip()


def documents(spark, extra: str = "kept"):
    """Plain rows, NULLs in every column, empty and very long texts, copies, near copies, ties and repeated rows."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(20, 400)), rng.choice(["en", "de"]), rng.choice(["a", "b", "b", "b"]), 1, "x") for i in range(40)]
    rows += [
        (100, None, "en", "a", 0, "x"),
        (101, "", "en", "a", 0, None),
        (102, " \n\t\n ", None, None, 0, "x"),
        (103, prose(rng, 30000), "en", None, 1, "x"),
        (104, "é日本 😀 don't\u0001 x y  z\n\n", "fr", "c", 1, "x"),
        (105, "one two", "en", "c", None, "x"),
        (106, rows[3][1], "en", "b", 1, "copy"),
        (107, rows[3][1].replace("the", "THE"), "en", "b", 1, "copy"),
        (108, rows[3][1] + " extra words", "en", "b", 1, "near"),
        (109, "word " * 3000, "en", "b", 1, "junk"),
        (5, rows[5][1], rows[5][2], rows[5][3], 1, "x"),
        (6, "another text of document six, so its id is not unique", "en", "b", 1, "x"),
        (None, rows[7][1], "en", "b", 1, "no id"),
        (None, "no id and a text of its own", "en", "b", 1, "no id"),
        (None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA.format(extra=extra))


def empty(df):
    return df.where("1 = 0")


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
