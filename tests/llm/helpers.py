"""Rows that every operator must bear, and brute-force versions."""

import re

WHITE = r"[\x20\x09-\x0d]+"


def documents(spark, rows):
    """(doc_id, text, lang, source) and extra columns whose names clash with those that operators use."""
    full = [(d, t, lang, source, f"x{i}", i, None) for i, (d, t, lang, source) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, size string, keep_id long, norm string")


LONG = "alpha beta gamma delta " * 4000
EDGES = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "   \t\n ", None, None),
    (4, "one", "en", "b"),
    (5, "one", "en", "b"),
    (6, LONG, "de", None),
    (7, LONG.replace(" ", "\n"), "de", "b"),
    (8, "Él  niño 漢字 😀 x", "es", "c"),
    (9, "x" * 60_000, None, "c"),
    (9, "x" * 60_000, None, "c"),
    (None, "one", "en", None),
    (10, "a@b.c 1.2.3.4 +1 (555) 555-5555 4111 1111 1111 1111", "en", "b"),
]


def split_words(t):
    return [w for w in re.split(WHITE, t or "") if w]
