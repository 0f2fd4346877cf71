"""A small corpus with copies, near copies, shared passages and odd rows, and plain re-implementations to compare with."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, term long, gram string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else (text or ""))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    free = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    out: list[str | None] = [" ".join(free(rng.randint(5, 200))) for _ in range(30)]
    base = free(150)
    passage = free(60)
    for k in range(8):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(150)] = rng.choice(vocabulary)
        out.append(" ".join(near))
    out += [" ".join(base), "\n".join(base).upper()]
    out += [" ".join(free(70) + passage + free(70)) for _ in range(3)]
    out += [None, "", " \n\t ", "one two three", "One  TWO three", "a b c d e", "été Überraschung ñandú " * 30, "x " * 400, "##!! 12 | <>"]
    out += [" ".join(free(6000))]
    return out


def rows(seed: int = 1) -> list[tuple]:
    out = [
        (i, t, ["en", "fr", None][i % 3], ["hot", "hot", "b", "c", None][i % 5], len(t or ""), "clash", i, "clash")
        for i, t in enumerate(texts(seed))
    ]
    return [*out, out[3], out[3], (None, out[0][1], "en", "b", 1, None, None, None)]


def frame(spark, seed: int = 1):
    return spark.createDataFrame(rows(seed), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
