"""Pairs of near duplicates against all pairs of sets."""

import os
import random

import numpy as np
import pytest

from lexquarry.operators import near as N
from lexquarry.operators import quality as Q


def shingles(text, size=5):
    w = text.lower().split()
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def expected(docs, percent=85):
    first = {}
    for i, t in docs:
        if t is not None:
            first[t] = min(i, first.get(t, i))
    sets = sorted((i, shingles(t)) for t, i in first.items() if shingles(t))
    return {(u, v) for k, (u, a) in enumerate(sets) for v, b in sets[k + 1 :] if 100 * len(a & b) >= percent * len(a | b)}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 3000)}"
    texts = []
    for n in (3, 5, 7, 9, 10, 11, 12, 14, 17, 20, 25, 31, 40, 60, 110, 240, 500):
        base = [word() for _ in range(n)]
        for _ in range(30):
            some = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, n // 60, n // 40))):
                at, how = rng.randrange(len(some) + 1), rng.random()
                some[at : at + (how < 0.6)] = [word()] if how > 0.2 else []
            texts.append(" ".join(some) if rng.random() < 0.8 else " ".join(some).upper() + " ")
    line = " ".join(word() for _ in range(30))  # a passage that very many texts have
    texts += [f"{line} {' '.join(word() for _ in range(rng.randint(1, 60)))}" for _ in range(150)]
    texts += texts[:40] + [None, "", " \n", "a", "A"]
    rng.shuffle(texts)
    numbered = list(enumerate(texts))
    return numbered + numbered[:60]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_pairs_against_all_sets(spark, docs, monkeypatch, small_blocks):
    if small_blocks:
        for name, value in (("SLICE", 300), ("BUCKET_CHARS", 3000), ("PLACES", 50), ("BLOCK_BYTES", 5000), ("BLOCK_SETS", 3), ("BROADCAST", 0)):
            monkeypatch.setattr(N, name, value)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    want = expected(docs)
    assert len(want) > 300
    found = [(r.u, r.v) for r in Q.near_pairs(df).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_sets_that_reach_the_bound_share_a_signature():
    rng = np.random.default_rng(7)
    for n in [*range(1, 60), 97, 300, 1111]:
        for _ in range(6):
            h = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a = h[:n]
            out = [(x, y) for x in range(n) for y in range(n) if 100 * (n - x) >= 85 * (n + y) and x + y]
            x, y = out[rng.integers(len(out))] if out else (0, 0)
            x, y = (x, y) if rng.random() < 0.5 else max(out, key=sum, default=(0, 0))
            b = np.concatenate([a[x:], h[n : n + y]])
            (of, sig) = N.signatures(np.array([len(a), len(b)]), np.concatenate([a, b]), 85)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (n, x, y)


def test_sets_of_empty_parts_meet(monkeypatch):
    """Hashings that leave more parts empty than are spared are followed by others, the last with its empty parts."""
    monkeypatch.setattr(N, "SPARE", 0)
    for turns in (1, 2, 6):
        monkeypatch.setattr(N, "TURNS", turns)
        test_sets_that_reach_the_bound_share_a_signature()


def test_texts_and_shingles_are_not_shuffled(spark, tmp_path):
    """What is shuffled and stored is less than one copy of all shingles' hashes (8 bytes each)."""
    rng = random.Random(8)
    docs = [(k, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(400))) for k in range(1500)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    df.write.parquet(f"{tmp_path}/docs")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = {os.path.join(d, f) for d, _, names in os.walk(shared) for f in names}
    context = spark.sparkContext
    none, jvm = context._gateway.new_array(context._jvm.double, 0), context._jvm

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        seq = context._jsc.sc().statusStore().stageList(None, False, False, none, jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteBytes() for s in (seq.apply(i) for i in range(seq.size()))}

    old = stages()
    assert Q.near_pairs(spark.read.parquet(f"{tmp_path}/docs")).collect() == []
    shuffled = sum(n for k, n in stages().items() if k not in old)
    written = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(shared) for f in names if os.path.join(d, f) not in before)
    assert 0 < shuffled + written < 1500 * 396 * 8
