"""Small tables with the odd cases that every operator has to take."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

WORDS = "the of and tree river stone ouvert très naïve lichen moss cloud rain window harbour lantern copper silver seven".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) * (rng.random() < 0.4) for _ in range(n))


def changed(text: str, seed: int, share: float) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def texts() -> list[str | None]:
    base = [prose(s, 80 + 10 * s) for s in range(8)]
    out: list[str | None] = [None, "", " \n\t ", "one", "One", "two words", "x" * 3000, base[0] + "\n" + base[0], prose(99, 9000), "a\x00b \x85c d　e"]
    for s, b in enumerate(base):
        out += [b, b, b.upper(), changed(b, s, 0.01), changed(b, s + 50, 0.08), changed(b, s + 100, 0.4)]
    return out


def documents(spark):
    """Rows with null and repeated ids, repeated rows and columns whose names clash with ours."""
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[12], rows[13], (None, rows[12][1], None, None, None), (12, rows[30][1], "en", "s1", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"id": F.lit("x"), "size": F.lit(1), "words": F.lit(2), "component": F.lit(3), "row": F.lit(4), "a.b": F.lit(5), "copies": F.lit(6), "label": F.lit(7), "hash": F.lit(8)})


def unique_documents(spark):
    return spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts())], "doc_id long, text string, lang string, source string, n_chars long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
