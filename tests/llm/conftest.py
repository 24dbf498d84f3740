"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

import pytest

WORDS = [f"w{k}" for k in range(400)]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def awkward_texts() -> list[str | None]:
    base = prose(1, 120).split(" ")
    near = [*base]
    near[60] = "changed"
    passage = prose(9, 70)
    return [
        None, "", " \t\n", "one", "one two three four", "one two three four five", "ONE two THREE four five",
        " ".join(base), " ".join(base), " ".join(near), " ".join(base[:110]),
        prose(2, 30) + " " + passage + " " + prose(3, 30), prose(4, 20) + "\n" + passage + "\t" + prose(5, 40),
        "é à ü ñ 漢字     x\u0085y", "a" * 300, "#$% " * 40, "line one\nline one\n\nline one\nother", "x y z x y z x y z",
        prose(6, 6000), "\x01 odd \x01\x01 marks", "emoji 😀 ‍ text",
    ]


@pytest.fixture(scope="session")
def awkward(spark):
    """(doc_id, text, lang, source, n_chars) with a repeated row and columns whose names clash with the operators' own."""
    texts = awkward_texts()
    rows = [(k + 1, t, "en", "s", len(t) if t is not None else None, k, k) for k, t in enumerate(texts)]
    rows.append(rows[7])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, rank long").repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
