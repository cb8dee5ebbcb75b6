"""Small documents with everything that may go wrong, and brute-force versions."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EXTRA = "size long, kept boolean, score double, n long, sid long, shard int, row string, _row string, src string, u double, kind int, `odd name` string"


def docs(spark, rows, extra: bool = True):
    """rows: (doc_id, text, lang, source); ``extra`` adds columns whose names operators use inside."""
    ddl = "doc_id long, text string, lang string, source string, n_chars long" + (", " + EXTRA if extra else "")
    pad = (1, True, 0.5, 2, 3, 4, "r", "q", "s", 0.1, 5, "o")
    return spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None, *(pad if extra else ())) for r in rows], ddl)


def odd_rows(seed: int = 1, n: int = 60):
    """Nulls, empty and very long texts, ties, repeated rows, near copies and shared passages."""
    rnd = random.Random(seed)
    words = ["the", "House", "of", "water", "und", "maison", "straße", "été", "x1", "don't", "a", "b,", "Zürich", "go.", "12", "　full"]
    text = lambda k: " ".join(rnd.choice(words) + (str(rnd.randint(0, 40)) if rnd.random() < 0.4 else "") for _ in range(k))
    passage = text(60)
    rows = [(0, None, None, None), (1, "", "en", ""), (2, " \t\n ", "en", "a"), (3, "12345 !!", None, "a"), (4, "one two", "en", None), (5, "One\ttwo", "en", "a"),
            (6, text(3000), "en", "b"), (7, "x" * 20000, "de", "b"), (None, text(30), "de", "b"), (None, None, None, None)]
    for i in range(8, n):
        t = text(rnd.randint(5, 120))
        if i % 5 == 0:
            t = passage + " " + t[:200]
        if i % 4 == 0 and len(rows) > 12:
            t = rows[rnd.randint(10, len(rows) - 1)][1]
            if i % 8 == 0:
                ws = t.split(" ")
                ws[rnd.randrange(len(ws))] = "changed"
                t = " ".join(ws)
        rows.append((i, t, rnd.choice(["en", "de", "fr", None]), rnd.choice(["a", "b", "c", None])))
    rows += [rows[-1], rows[-1], rows[12]]
    return rows


def shingles(text) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(ids, sets):
    """Smallest id reachable by links of Jaccard 0.75 or more, by comparing all pairs; rows are nodes, a null id is the last."""
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least: dict = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x, key=lambda v: (v is None, v))
    return [least[find(i)] for i in range(len(ids))]
