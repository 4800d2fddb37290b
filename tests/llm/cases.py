"""Small documents with the cases that every operator has to stand."""

import random


def documents(spark, rows):
    """rows: (doc_id, text); the other columns are filled, and two clash with names of results."""
    full = [(i, t, "en" if i is None or i % 3 else None, "src0", None if t is None else len(t), "x", 1.5) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, lang_pred string, score double")


def words(seed, n, vocabulary=400):
    draw = random.Random(seed)
    return [f"w{draw.randrange(vocabulary)}x" for _ in range(n)]


def text(seed, n, vocabulary=400):
    return " ".join(words(seed, n, vocabulary))


LONG = " ".join(f"long{k % 977} word{k * 7919 % 100003}" for k in range(60_000))
EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "two words"), (905, LONG), (906, "123 !! \x00  "), (907, "it's  spaced\n\n\tout <|endoftext|> é日本"), (908, "one"), (908, "one")]
