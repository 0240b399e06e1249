"""Small fixtures that several tests share."""

import random

WORDS = [f"w{i}" for i in range(400)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, extra) with copies, near copies, shared passages, shared
    lines, nulls, empty texts, repeated rows and a long text."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 7 == 0:
            lines.append("the same closing line stands under many of these texts")
        rows.append([i, "\n".join(lines), "x"])
    rows[3][1] = rows[2][1]
    rows[4][1] = rows[2][1] + " more"
    for j in (20, 21, 22):
        w = rows[19][1].split(" ")
        w[rng.randrange(len(w))] = f"edit{j}"
        rows[j][1] = " ".join(w)
    rows[30][1], rows[31][1], rows[32][1] = None, "", "  \n "
    rows[33][1] = "é ü ASCII Ünïcode 日本語 " * 12
    rows[34][1] = "tiny"
    rows.append([n, prose(rng, 6000), "long"])
    rows.append([n, rows[-1][1], "long"])  # a repeated row
    return [tuple(r) for r in rows]


SCHEMA = "doc_id long, text string, n int"


def frame(spark, rows=None):
    """The corpus with extra columns that clash with names used inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus() if rows is None else rows, "doc_id long, text string, tag string")
    return df.withColumns({"id": F.lit("other"), "w": F.lit(0), "spans": F.lit("s"), "key": F.lit(None).cast("string"), "n": F.lit(7)})
