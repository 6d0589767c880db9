from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Other columns whose names clash with internal ones.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, block long, x string, g string, label string, slot long, hops int"


def words(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}a" for _ in range(n))


def hard_rows(n: int = 12) -> list[tuple]:
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    rows = [(i, words(i, 60), "en", "s0", None) for i in range(n)]
    long = words(999, 60_000)
    rows += [(None, words(50, 20), "en", "s1", 3), (100, None, "en", "s0", 0), (101, "", None, None, None), (102, "\n \n\n", "de", "s1", 4), (103, "### !!! ###", "en", "s0", 11), (104, long, "en", "s1", len(long))]
    rows += [rows[0], rows[0], (None, None, None, None, None)]
    return rows


def frame(spark, rows, schema: str = SCHEMA):
    return spark.createDataFrame(rows, schema)


def clashing(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "x", "g", "l", 4, 5) for r in rows], CLASH)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
