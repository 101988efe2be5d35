"""Small awkward corpora: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, length string, row int, id string, host string, bin int"


def words_of(text):
    return WORD.findall(text or "")


def prose(rng, n):
    vocab = [a + b for a in ("ba", "ko", "ri", "Ma", "tü", "se", "lo") for b in ("n", "rt", "x", "dé", "l")]
    return " ".join(rng.choice(vocab) for _ in range(n))


def texts(seed=5, n=60):
    rng = random.Random(seed)
    shared = prose(rng, 45)
    line = prose(rng, 12)
    base = [prose(rng, rng.choice([1, 2, 5, 19, 20, 21, 60, 150])) for _ in range(n)]
    near = base[6].split(" ")
    out = base + [None, "", " \n\t ", base[3], base[3], base[7], "x" * 3000, prose(rng, 2600), "a  b \n\n c", "\n".join([line] * 5)]
    out += [prose(rng, 30) + " " + shared + " " + prose(rng, 10) for _ in range(6)]
    out += [prose(rng, 40) + "\n" + line for _ in range(12)]
    for k in range(4):
        w = list(near)
        w[k % len(w)] = "changed"
        out.append(" ".join(w))
    return out


def rows(seed=5, n=60):
    out = []
    for i, t in enumerate(texts(seed, n)):
        src = [None, "a", "b", "hot", "hot", "hot"][i % 6]
        out.append((i, t, "en", src, len(t or ""), 1, "x", i, "z", "h", 0))
    out.append(out[10])  # a repeated row
    out.append((None, "no id at all", None, None, None, None, None, None, None, None, None))
    return out


def frame(spark, seed=5, n=60):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
