"""Small awkward tables that every operator has to take."""

from __future__ import annotations

import random

WORDS = "the of and river stone light over under green quick brown fox".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(".,;") if rng.random() < 0.2 else "") for _ in range(n))


def awkward(spark, lang: bool = True):
    """Nulls, empty and blank texts, one very long text, ties, repeated rows and columns with clashing names."""
    base = prose(300, 1)
    rows = [
        (1, base, "en", "s", 1, "x", 5), (2, base, "en", "s", 1, "x", 5), (2, base, "en", "s", 1, "x", 5),
        (3, None, None, None, None, None, None), (4, "", "de", "s", 0, "", 0), (5, " \t\n ", "de", "s", 0, "", 0),
        (6, prose(40_000, 2), "en", "s", 9, "x", 1), (7, "x" * 20_000, "en", "s", 9, "x", 1), (8, base + " extra", "en", "s", 9, "x", 1),
        (9, "Ünïcode ßtraße 漢字 <|endoftext|> 'll  two   spaces\n\nlines", "fr", "s", 9, "x", 1), (-5, "negative id", "fr", None, 3, None, 2),
        (2**40, "42", None, "s", 2, "x", 2), (None, "no id", "en", "s", 5, "x", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, digest string, row int")


def empty(spark):
    return awkward(spark).limit(0)
