"""Small documents with everything that may go wrong in a column, and plain readings of the definitions."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, key string, row string, spans string, fp bigint, text_key string, at int"

LONG = " ".join(f"word{i % 977} filler" for i in range(40_000))


def documents(spark, rows=None):
    """(doc_id, text, lang, source, ...) with columns whose names the operators use themselves."""
    if rows is None:
        rows = [
            (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
            (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
            (3, "", "en", "b"),
            (4, None, "en", "b"),
            (5, " \t\n ", None, None),
            (6, "Über allen Gipfeln ist Ruh, in allen Wipfeln spürest du kaum einen Hauch", "de", None),
            (6, "Über allen Gipfeln ist Ruh, in allen Wipfeln spürest du kaum einen Hauch", "de", None),
            (7, "12345 67890 !!! ???", "en", "c"),
            (8, "one", None, "c"),
            (9, "日本語 テキスト 𝒳𝒴", "ja", "c"),
            (None, "a row without an id but with some words in it", "en", "d"),
            (None, None, None, None),
            (10, LONG, "en", "a"),
            (11, "x" * 50_000, "en", "a"),
        ]
    return spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None, 7, "k", "r", "s", 1, "t", 2) for i, t, g, s in rows], SCHEMA)


def empty(spark):
    return documents(spark, [])


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    """Random prose with a vocabulary of its own seed."""
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) if vocabulary is None else " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
