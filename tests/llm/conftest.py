"""Documents that are hard on text operators."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, source string, lang string, n_words string, row string, h string, score string, kept string, epoch string"


def prose(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary):x}{'aeiou'[r.randrange(5)] * r.randrange(1, 4)}" for _ in range(n)]


def hard_documents() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and long texts, repeated rows and ids, near copies, odd signs."""
    base = prose(1, 600)
    near = base.copy()
    near[100] = "changed"
    far = base.copy()
    for k in range(0, 600, 12):
        far[k] = f"other{k}"
    passage = " ".join(prose(2, 90))
    out: list[tuple[int | None, str | None]] = [
        (0, " ".join(base)), (1, " ".join(near)), (2, " ".join(far)), (3, " ".join(base)),
        (4, "  ".join(base).upper()), (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "One two"),
        (10, "one"), (11, "x" * 300_000), (12, "naïve ☃ 日本語   é ß İ K"),
        (13, "line a b c\n" * 80 + "line a b c"), (14, "!! ## $$ %% || << >> " * 30),
        (None, " ".join(base)), (None, None), (15, "twice the same row"), (15, "twice the same row"),
        (16, "the same id"), (16, "another text"), (-5, "negative id"),
        (17, f"start {passage} end one"), (18, f"{passage} else {passage[:200]}"), (19, passage.upper()),
    ]
    out.append((20, " ".join(prose(3, 250_000))))  # over a megabyte: read in pieces
    out.append((21, " ".join(prose(3, 250_000)[:200_000]) + " tail"))
    out += [(100 + k, " ".join(prose(50 + k, 40 + 7 * k))) for k in range(30)]
    return out


@pytest.fixture(scope="session")
def hard():
    return hard_documents()


@pytest.fixture(scope="session")
def docs(spark, hard):
    """The hard documents with further columns whose names operators may use themselves."""
    rows = [
        (i, t, f"src{(i or 0) % 3}" if i != 8 else None, "en", "x", "y", "z", "s", "k", "e") for i, t in hard
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
