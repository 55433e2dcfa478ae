import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, row string, gram long"


def prose(rng, n):
    parts = "an er on es en de la re ti st ou le ion ung che ent ar co mi ta ver".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, near copies, shared passages."""
    rng = random.Random(4)
    base = [prose(rng, 120) for _ in range(6)]
    near = base[0].split()
    near[60] = "changed"
    passage = prose(rng, 55)
    texts = [
        None, "", "   \n\t ", "one", "one two three four", "one two three four", base[0], base[0], " ".join(near),
        base[1], base[2] + "\n" + passage, passage + " " + base[3], base[4] + " " + passage + " " + base[5],
        prose(rng, 40) + "\n" + "same line here\n" * 12, "x" * 5000, "ab" * 400 + " tail", prose(rng, 30_000),
        "é" * 300 + " ünïcode " + "é" * 300, "1234 " * 300, "\x00 odd \x1f bytes \u00a0 \u3000",
    ]
    rows = [
        (k, t, ["en", "de", "fr", "es", None][k % 5], ["s0", "s1", None][k % 3], None if t is None else len(t), "w", "r", 1)
        for k, t in enumerate(texts)
    ]
    return [*rows, rows[9], rows[6], (None, base[1], "en", "s0", 1, None, None, None), (7, "other text of id seven", None, "s1", 2, "", "", 0)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
