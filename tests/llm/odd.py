"""A small table with everything that may be odd about documents."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key string, digest string, kept string, copy string, body string, n_words string, words string, failed string"
)


def texts() -> list[tuple]:
    """(doc_id, text) with nulls, repeats, ties, blanks, and one very long text."""
    rnd = random.Random(11)
    vocabulary = ["alpha", "Beta", "gamma", "delta", "über", "naïve", "x", "42", "end.", "日本語", "don't", "a|b", "#tag"]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    long_text = prose(120)
    near = long_text.split(" ")
    rows = [
        (1, long_text),
        (2, long_text + "\n"),
        (3, "  " + long_text.replace(" ", "  ")),
        (4, " ".join(near[:60] + ["changed"] + near[61:])),
        (5, long_text),
        (5, long_text),
        (6, None),
        (7, ""),
        (8, " \n\t "),
        (9, "one two three"),
        (10, "one  two three"),
        (11, "one two three"),
        (None, "one two three"),
        (None, None),
        (12, prose(60) + "\n" + long_text[100:400] + "\n" + prose(10)),
        (13, "\n".join(["the same line again and again"] * 30)),
        (14, prose(9000)),
        (15, "z" * 40_000),
        (16, "1" * 400 + " mail me@example.org or call +49 30 123456 now, card 4111 1111 1111 1111"),
        (-3, long_text),
    ]
    return rows


def table(spark, rows=None):
    """The texts with other columns, null here and there, under names operators may use."""
    rows = texts() if rows is None else rows
    full = [
        (d, t, "en" if i % 3 else None, None if i % 7 == 0 else f"s{i % 2}", None if i % 5 == 0 else i, "k", "d", "no", "c", "b", "w", "ws", "f")
        for i, (d, t) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
