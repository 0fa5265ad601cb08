"""Generated documents and the hard cases that every operator must take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, part string, shard int, digest string, __cell int, component long"


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))


def prose(rng: random.Random, n: int) -> str:
    return " ".join(word(rng) for _ in range(n))


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, None if text is None else len(text), 7, "p", 3, "d", 1, 5)


def hard_rows(seed: int = 0):
    """Null id, null, empty, blank and very long texts, null metadata, equal texts under several ids, and a row that repeats."""
    rng = random.Random(seed)
    same, long = prose(rng, 80), prose(rng, 200_000)
    return [
        row(1, None), row(2, ""), row(3, "  \n\t "), row(4, long), row(5, same), row(6, same), row(6, same), row(None, prose(rng, 30)),
        row(7, prose(rng, 60), None, None), row(8, "", None, "t"), row(9, "one"), row(10, "!!! ... ???"), row(11, "é日本語 " * 20),
    ]


def hard(spark, seed: int = 0):
    return spark.createDataFrame(hard_rows(seed), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, texts, start: int = 0):
    return spark.createDataFrame([row(start + k, t) for k, t in enumerate(texts)], SCHEMA)
