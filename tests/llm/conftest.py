import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, th string, node string, n bigint, spans string, score string, __n string, id string, mine string, cut string, tested string, base string, found string, predicted string, __id string, __th string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table, with extra columns whose names the operators use themselves."""

    def make(rows):
        full = [(i, t, "en", "s", len(t) if t is not None else None, "x", "x", 1, *["x"] * 12) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, with near copies, exact copies, a shared passage, and edge cases."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéö") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, shared = text(120), text(60)
    rows = [(k, text(rng.randint(5, 90))) for k in range(40)]
    for k in range(40, 75):  # near copies of one text, unlike each other by different words
        w = base.split()
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((k, " ".join(w)))
    rows += [(k, base) for k in (75, 76, 77)]
    rows += [(k, f"{text(20)} {shared} {text(20)}") for k in range(78, 88)]
    rows += [(88, None), (89, ""), (90, " \n "), (91, "One"), (92, "one two"), (93, "ONE TWO"), (94, "x" * 5000), (95, text(4000)), (96, base.upper()), (97, "aaa " * 80), (98, "aaa " * 90)]
    rows += [(91, "One"), (75, text(50)), (None, base), (None, None)]
    return rows
