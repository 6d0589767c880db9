"""Functions on source text: excerpts, remarks, documentation and candidate rules, all of them built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import is_licence


def lines(text: Column) -> Column:
    return F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")


def excerpt(text: Column, most: int = 280) -> Column:
    """The first four telling lines in one, cut at a word to ``most`` characters: no licence, import, package or brief lines."""
    bare = F.transform(lines(text), lambda x: F.trim(F.regexp_replace(x, r"^\s*(/\*\*?|\*/|\*|//+|#+)\s?", "")))
    telling = F.filter(bare, lambda x: (F.length(x) >= 8) & ~is_licence(x) & ~x.rlike(r"(?i)^(import|from|package|using|#include|identification division|environment division)\b") & x.rlike("[A-Za-z]"))
    joined = F.array_join(F.slice(telling, 1, 4), " ")
    return F.when(F.length(joined) <= most, joined).otherwise(F.concat(F.regexp_replace(F.substring(joined, 1, most), r"\s+\S*$", ""), F.lit("…")))


def normalised_cobol(text: Column) -> Column:
    """Fixed-format source without comment lines and outside columns (8 to 72 of long or numbered lines stay)."""
    kept = F.filter(lines(text), lambda x: ~F.substring(x, 7, 1).isin("*", "/"))
    return F.array_join(F.transform(kept, lambda x: F.when((F.length(x) >= 72) | F.substring(x, 1, 6).rlike("^[0-9]{6}$"), F.substring(x, 8, 65)).otherwise(x)), "\n")


def remarks(text: Column, limit: int = 8) -> Column:
    """The first comments of a COBOL source: column 7 or ``*>``, 12 characters or more, no licence lines."""
    said = F.transform(lines(text), lambda x: F.trim(F.when(F.substring(x, 7, 1) == "*", F.substr(x, F.lit(8))).otherwise(F.regexp_extract(x, r"\*>(.*)$", 1))))
    clean = F.transform(said, lambda x: F.trim(F.regexp_replace(x, r"^\*+|\*+$", "")))
    return F.slice(F.filter(clean, lambda x: (F.length(x) >= 12) & ~is_licence(x)), 1, limit)


def doc_comments(text: Column, limit: int = 4) -> Column:
    """The first documentation comments, each at most four lines in one; licence and tag lines go."""

    def cleaned(block: Column) -> Column:
        bare = F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\*?\s?", "")))
        return F.array_join(F.slice(F.filter(bare, lambda x: (x != "") & ~x.startswith("@") & ~is_licence(x)), 1, 4), " ")

    found = F.concat(F.regexp_extract_all(text, F.lit(r"(?s)/\*\*(.*?)\*/"), F.lit(1)), F.slice(F.regexp_extract_all(text, F.lit(r'(?s)^\s*"""(.*?)"""'), F.lit(1)), 1, 1))
    return F.slice(F.filter(F.transform(found, cleaned), lambda x: x != ""), 1, limit)


def candidate_rules(text: Column, language: Column, limit: int = 12) -> Column:
    """Conditions that may be business rules: IF, EVALUATE and WHEN of COBOL, telling if-conditions elsewhere."""
    host = F.concat(*[F.regexp_extract_all(text, F.lit(rf"(?im)\b{verb}\s+(.{{3,90}}?)(?:\s+THEN)?\s*$"), F.lit(1)) for verb in ("IF", "EVALUATE", "WHEN")])
    other = F.filter(F.regexp_extract_all(text, F.lit(r"(?i)\bif\s*\(((?:[^()\n]|\([^()\n]*\)){3,90})\)"), F.lit(1)), lambda c: c.rlike(r"(?i)null|isEmpty|status|valid|amount|==|!="))
    return F.slice(F.array_distinct(F.transform(F.when(language == "cobol", host).otherwise(other), lambda x: F.trim(x))), 1, limit)


def transactions(text: Column) -> Column:
    """(transaction, program) of CICS resource definitions."""
    rx = F.lit(r"(?is)DEFINE\s+TRANSACTION\s*\(\s*(\w+)\s*\)[^D]*?PROGRAM\s*\(\s*(\w+)\s*\)")
    return F.arrays_zip(F.regexp_extract_all(text, rx, F.lit(1)).alias("transaction"), F.regexp_extract_all(text, rx, F.lit(2)).alias("program"))
