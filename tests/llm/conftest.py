from __future__ import annotations

import random

import pytest

from .brute import thue_morse

#: Texts with what is likely to go wrong: nulls, nothing, blanks, no blanks, several scripts, breaks of all kinds.
ODD = [None, "", " ", "\n\n", "one", "a b", "İstanbul ǅ ß ﬃ", "x" * 3000, "To " * 400, "日本語 " * 80, "don't we'll they've I'm it's 'tis  '  s", "\r\n tab\tand\x0bmore\x0c ", "emoji 👩‍👩‍👧   line", "a\x00b\x00" * 60, "<|endoftext|> and <|im_start|>"]
# Words, lines and documents that a sum of powers modulo 2**64 takes for equal.
_PAIRS = [t for n in (1024, 2048) for t in thue_morse(n)]
ODD += [*_PAIRS, *(f"{x} {y} {x}" for x, y in zip(_PAIRS, _PAIRS[1:])), *(f"{x}\nline {i}" for x in _PAIRS[:2] for i in range(3))]


@pytest.fixture(scope="session")
def corpus() -> list[tuple[int, str | None]]:
    """Small documents with exact copies, near copies, shared lines and shared passages."""
    rng = random.Random(3)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "ü", "é"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared_line, passage = prose(12), prose(60)
    base = prose(120)
    out: list[tuple[int, str | None]] = []
    for i in range(90):
        kind = i % 9
        if kind == 0:
            w = base.split(" ")
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t: str | None = " ".join(w)
        elif kind == 1:
            t = prose(40) + "\n  " + shared_line.upper() + " \n" + prose(30)
        elif kind == 2:
            t = prose(20) + passage + prose(30)
        elif kind == 3:
            t = base
        elif kind == 4:
            t = ODD[(i // 9) % 15]
        else:
            t = prose(rng.randint(1, 150)) + "\n" + prose(rng.randint(1, 60))
        out.append((3 * i + 7, t))
    out += [(1000 + i, t) for i, t in enumerate(ODD)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "rank", [1], "x") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id long, text string, rank string, n_lines array<int>, key string").repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
