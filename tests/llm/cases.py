"""Small tables with every odd case, and independent versions of what operators compute."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, row string, _spans int, component long"


def words(r: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def documents(spark, seed: int = 1, n: int = 60):
    """Documents with nulls, blanks, copies, near copies, a shared passage, a very long text and clashing columns."""
    r = random.Random(seed)
    texts = [words(r, r.randint(1, 120)) for _ in range(n)]
    passage = words(r, 70, 10_000)
    for k in range(0, n, 6):
        texts[k] = f"{words(r, 12)} {passage} {words(r, 9)}"
    base = words(r, 150, 10_000).split()
    for k in range(1, n, 5):
        mine = list(base)
        for _ in range(r.randint(0, 6)):
            mine[r.randrange(len(mine))] = f"x{r.randrange(10**6)}"
        texts[k] = " ".join(mine)
    texts[7] = texts[8] = texts[2]
    texts[9] = None
    texts[10], texts[11], texts[12] = "", " \n\t ", "One"
    texts[13] = "ONE\n"
    texts[14] = words(r, 30_000)
    texts[15] = "Zeile\nZeile\n\nZeile\n" + "tok tok tok tok tok tok tok tok tok tok " * 4
    texts[16] = "ünïcode 😀 # $ | <b> " * 30
    rows = [(k, t, "en", None if k % 13 == 0 else "big" if k % 2 else f"s{k % 5}", None if t is None else len(t), -k, "k", "r", k, 5) for k, t in enumerate(texts)]
    rows += [(None, "no id here at all", None, None, 3, 1, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
