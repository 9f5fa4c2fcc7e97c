"""Small document tables for the text operators."""

from __future__ import annotations

import random

SF_DIR = "/root/testdata/sf0.001"
#: Columns that operators use for their own ends, to be left alone.
EXTRA = (
    "score margin size class component bits n_words spans kept label order n h1 _text _id _class last rest "
    "division block a b begin end rule rank"
).split()


def documents(spark, rows, extra: bool = True):
    """doc_id and text, with language and source, and columns of clashing names."""
    frame = spark.createDataFrame(
        [(i, t, ("en", "de", None)[k % 3], f"src{k % 20}" if k % 7 else None) for k, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string",
    )
    frame = frame.selectExpr("*", "cast(length(text) as bigint) as n_chars")
    return frame.selectExpr("*", *[f"1 as {c}" for c in EXTRA]) if extra else frame


def odd_rows(words: list[str], n: int, seed: int = 0, most: int = 40) -> list[tuple[int | None, str | None]]:
    """Random texts of the words, and null, empty, blank, repeated and long ones."""
    chance = random.Random(seed)
    rows = [(k, "".join(chance.choices(words, k=chance.randint(0, most)))) for k in range(n)]
    whole = "".join(words)
    return [
        *rows,
        rows[0],
        rows[1],
        (None, whole),
        (None, whole),
        (None, None),
        (n, None),
        (n + 1, ""),
        (n + 2, " \t\n"),
        (n + 3, whole * 200),
        (7, "another text of the same id"),
    ]
