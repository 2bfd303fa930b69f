"""Small tables with the awkward cases: nulls, empty and long texts, copies, repeated rows, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, h string, score string, part string, `all` string, v string, label string"


def words(seed: int, n: int, size: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(size)}" for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base = words(1, 120)
    edited = base.split(" ")
    edited[60] = "changed"
    passage = words(2, 60)
    rows = [(0, None), (1, ""), (2, "one"), (3, "a b c d"), (4, " \t\n "), (5, base), (6, base), (7, " ".join(edited)), (8, "x " + passage + " " + words(3, 80)), (9, words(4, 50) + " " + passage), (9, words(4, 50) + " " + passage), (10, "la " * 300), (11, words(5, 9000)), (None, words(6, 70)), (12, "é日本 \U0001f600 ß" * 40), (13, passage + "\n" + passage)]
    return rows + [(20 + i, words(100 + i, 30 + 7 * i)) for i in range(20)]


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "1", "2", "3", "4", "5", "6", "7") for i, t in rows], SCHEMA)


def save(spark, folder, rows=None, **tables):
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
