"""The automaton of many literals against plain search."""

import random

import numpy as np
import pytest

from lexquarry.operators import literals as L


def laid_out(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("piece", [3, 17, 1024])
def test_against_plain_search(monkeypatch, piece):
    monkeypatch.setattr(L, "PIECE", piece)
    rng = random.Random(piece)
    some = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    for _ in range(30):
        texts = [some(rng.randint(0, 90)) for _ in range(rng.randint(0, 12))]
        literals = sorted({some(rng.randint(1, 6)) for _ in range(rng.randint(1, 30))} | {"aaaa", "aa", "a"})
        text, literal = L.found(L.built([x.encode() for x in literals]), *laid_out(texts))
        assert set(zip(text.tolist(), literal.tolist())) == {(i, k) for i, t in enumerate(texts) for k, x in enumerate(literals) if x in t}
        assert len(text) == len(set(zip(text.tolist(), literal.tolist())))


def test_counts_in_parts(spark):
    rng = random.Random(1)
    some = lambda n: " ".join(rng.choice(["x", "yy", "ü", "z"]) for _ in range(n))
    docs = [(some(rng.randint(0, 40)).replace(" ", rng.choice([" ", "\n ", " "])),) for _ in range(60)] + [(None,), ("",), ("x" * 50_000 + "end",)]
    literals = [(k, some(rng.randint(1, 5))) for k in range(40)] + [(90, None), (91, " \t"), (92, "xend"), (93, "xx"), (94, "never"), (1, "x")]
    expected = sorted((i, sum(" ".join((x or "").split()) in " ".join((t or "").split()) for (t,) in docs)) for i, x in literals)
    df, asked = spark.createDataFrame(docs, "text string").repartition(3), spark.createDataFrame(literals, "item_id int, text string")
    for cells in (L.CELLS, 60):
        assert sorted(map(tuple, L.counts(df, asked, cells).collect())) == expected
    assert len(list(L._parts([b"ab", b"cd", b"e" * 99], 20))) == 3
    assert L.counts(df, asked.where("item_id = 90")).collect()[0].n_docs == len(docs)
    assert L.counts(df.limit(0), asked.where("item_id in (90, 92)")).collect()[0].n_docs == 0
