"""Small tables with the awkward rows that every operator must handle."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score string, size string, r string, part string"
SF = "/root/testdata/sf0.001"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "re", "thi", "so", "mel", "or", "ta", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return " ".join(words)


def rows() -> list[tuple]:
    texts = {
        1: prose(1, 120), 2: None, 3: "", 4: " \n\t ", 5: prose(1, 120), 6: prose(2, 60) + "\n" + prose(3, 40), 7: "word " * 4000,
        8: prose(4, 6000), 9: "ÄÖÜ été ñandú " + prose(5, 80), 10: "one two", 11: "ONE  two", 12: prose(1, 118) + " other end",
    }
    out = [(k, t, None if k % 5 == 0 else "en", None if k in (3, 9) else f"s{k % 3}", len(t or ""), "x", None, "", "p") for k, t in texts.items()]
    return [*out, out[0], (None, prose(1, 120), "en", "s1", 0, "x", None, "", "p")]


def documents(spark):
    return spark.createDataFrame(rows(), DOCUMENTS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
