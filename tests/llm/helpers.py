"""Small document tables with everything an operator has to bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, t int, i int, p int, rank int, bucket int, block int, tokens string, label int"


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    words = ["river", "stone", "light", "garden", "winter", "house", "paper", "silver", "morning", "letter", "station", "market", "window", "forest", "engine", "bridge", "copper", "valley", "harbor", "signal"]
    return " ".join(rng.choice(words) + rng.choice(["", "s", "ed", "er"]) for _ in range(n))


def frame(spark, texts, ids=None, langs=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, (langs[j] if langs else "en"), (sources[j] if sources else f"s{j % 3}"), None if t is None else len(t), "k", 1, 2, 3, 4, 5, 6, "x", 7) for j, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts() -> list:
    return [None, "", " \n\t ", "a", "two words", prose(40, 1), prose(40, 1), prose(4000, 2), "!!! 123 ...", "été naïve 日本語 😀", None, ""]
