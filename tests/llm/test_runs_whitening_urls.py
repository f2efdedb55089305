"""Periodic runs, whitening and URL rules against brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexquarry.llm import common, periods, queries, urlrules, whitening

# ---- periodic runs ----


def expected_runs(words):
    """All runs, each period tried at every place."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        equal = [a == b for a, b in zip(words, words[p:])] + [False]
        start = None
        for i, same in enumerate(equal):
            if same and start is None:
                start = i
            elif not same and start is not None:
                if i - start + p >= max(24, 3 * p):
                    found.setdefault((start, i - start + p), p)
                start = None
    return sorted((s, n, p) for (s, n), p in found.items())


def expected_collapse(words):
    gone = {i for s, n, p in expected_runs(words) for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng):
    """Words with powers, powers of powers and noise; few different words, so that periods meet by chance too."""
    k, out = rng.choice([1, 2, 3, 40]), []
    noise = lambda n: [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 6)):
        unit = noise(rng.randint(1, 60))
        if rng.random() < 0.4:
            unit = unit * rng.randint(1, 6) + noise(1)
        if rng.random() < 0.3:
            unit = unit * rng.randint(1, 4) + noise(1) + unit
        out += (unit * 7)[: int(rng.uniform(1, 6) * len(unit))] if rng.random() < 0.6 else noise(rng.randint(0, 40))
    return out


def test_runs_against_brute_force():
    rng = random.Random(11)
    n_found = 0
    for _ in range(60):
        texts = [repetitive(rng) for _ in range(rng.randint(1, 6))]
        text, start, length, period = periods.find(np.array(sum(texts, []), np.int64), np.array([len(t) for t in texts], np.int64))
        for k, words in enumerate(texts):
            got = [(int(s), int(n), int(p)) for t, s, n, p in zip(text, start, length, period) if t == k]
            assert got == expected_runs(words)
            n_found += len(got)
    assert n_found > 100


@pytest.mark.parametrize("period", [1, 5, 6, 7, 8, 11, 12, 23, 24, 25, 100, 341, 342])
def test_each_period_just_long_enough(period):
    rng = np.random.default_rng(period)
    unit = np.arange(period)
    length = max(24, 3 * period)
    for short in (0, 1):
        words = np.concatenate([rng.integers(10_000, 20_000, 50), np.tile(unit, 40)[: length - short], rng.integers(30_000, 40_000, 50)])
        _, start, n, p = periods.find(words, np.array([len(words)]))
        assert list(zip(start, n, p)) == ([] if short else [(50, length, period)])


def test_words_that_defeat_polynomial_hashes():
    """Thue-Morse sequences, which have no cube, and their repetition, which is a run."""
    word = [bin(i).count("1") % 2 for i in range(4096)]
    assert not len(periods.find(np.array(word), np.array([4096]))[0])
    _, start, length, period = periods.find(np.array(word * 3), np.array([3 * 4096]))
    assert (0, 3 * 4096, 4096) in set(zip(start.tolist(), length.tolist(), period.tolist()))


def test_runs_of_documents(spark, documents, prose):
    rows = [*prose, (200, "a b " * 12), (201, "A b " * 12 + "c"), (201, "a\u00a0b " * 30), (202, ("x y z w " * 40 + "end ") * 5), (203, "\t\n"), (204, "word " * 23)]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    expected = sorted(((i, len(words(t)), expected_runs(words(t)), expected_collapse(words(t))) for i, t in rows), key=str)
    for size in (periods.TEXT_BYTES, 300):
        out = periods.collapse(documents(rows), text_bytes=size)
        assert {"th", "node", "found", "spans"} <= set(out.columns)
        got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect()), key=str)
        assert got == expected
    assert sum(bool(e[2]) for e in expected) >= 5
    assert periods.collapse(documents([])).collect() == []


def test_strongest_run_is_compared_exactly(spark):
    rows = [([(0, 30, 10), (40, 90, 30), (200, 300_000_001, 100_000_000)],), ([(5, 30, 10), (9, 3, 1)],), ([],), (None,)]
    df = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    assert [r.b and tuple(r.b) for r in df.select(periods.strongest(F.col("runs")).alias("b")).collect()] == [(200, 300_000_001, 100_000_000), (5, 30, 10), None, None]


def test_planted_repetition(spark, documents):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 90))) for i in range(300)] + [(None, "a b"), (7, None)]
    def expected(i, t):
        words, h = (t or "").split(), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        return i, " ".join(words)

    got = sorted((tuple(r) for r in queries.repeating(documents(rows)).collect()), key=str)
    assert got == sorted((expected(i, t) for i, t in rows), key=str)
    assert got != sorted(((i, t or "") for i, t in rows), key=str)


# ---- whitening ----


@pytest.mark.parametrize("low, high, shape", [(-300, 300, (1000, 8)), (-(2**62), 2**62, (70, 3)), (5, 6, (10, 2)), (-(2**40), 2**40, (129, 4)), (0, 2, (1, 5))])
def test_products_are_exact(low, high, shape):
    x = np.random.default_rng(1).integers(low, high, shape)
    whole = x.astype(object)
    sums, crossed = whitening.products(x)
    assert sums == [int(v) for v in whole.sum(0)]
    assert crossed == [[int(v) for v in row] for row in whole.T.dot(whole)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id bigint, embedding array<float>, component int, n bigint, cells string")


def whitened_by_hand(values, m):
    """Exact covariance with whole numbers, then numpy's own decomposition."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in values]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    v = np.array([[(n * sum(r[i] * r[j] for r in x) - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e)[:m]
    centred = np.array([[(n * r[k] - s[k]) / n for k in range(d)] for r in x])
    return n, [sum((n * r[k] - s[k]) ** 2 for k in range(d)) for r in x], centred @ u[:, order] / np.sqrt(e[order]), e[order] / np.trace(v)


def test_whitening_against_whole_numbers(spark):
    rng = np.random.default_rng(3)
    values = (rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6)) + rng.normal(size=6) * 50).astype(np.float32).tolist()
    values[7] = values[3]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (None, values[5]), (3, values[3])]
    good = [*enumerate(values), (None, values[5]), (3, values[3])]
    n, deviation, white, explained = whitened_by_hand([v for _, v in good], 4)
    df = vectors(spark, [*enumerate(values), *bad]).repartition(3)
    model = whitening.fit(df, components=4, size=4096)
    assert whitening.identity_error(df, model, size=4096) < 1e-9
    got = whitening.whiten(df, model, keep=["vec_id", "cells", "n"]).collect()
    assert len(got) == 4 * len(good) and {r.n for r in got} == {n} and {r.cells for r in got} == {"x"}
    ids = {i: k for k, (i, _) in enumerate(good)}
    sign = {c: np.sign(next(r.whitened for r in got if r.vec_id == 0 and r.component == c) * white[0, c - 1]) for c in range(1, 5)}
    for r in got:
        k = ids[r.vec_id]
        assert r.deviation == deviation[k]
        assert r.whitened == pytest.approx(sign[r.component] * white[k, r.component - 1], rel=1e-9, abs=1e-9)
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)


def test_whitening_without_variance_or_vectors(spark):
    assert whitening.fit(vectors(spark, [])) is None
    assert whitening.whiten(vectors(spark, [(1, None)]), None).collect() == []
    one = vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [1.0])])
    model = whitening.fit(one)
    got = whitening.whiten(one, model).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got] == [(i, c, 2, 0, None, None) for i in (1, 2) for c in (1, 2)]
    assert whitening.identity_error(one, model) == 0.0
    flat = vectors(spark, [(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [2.0, 5.0])])
    got = whitening.whiten(flat, whitening.fit(flat)).collect()
    assert [r.whitened is None for r in got] == [False, True] * 3 and got[0].explained == 1.0


def test_whitening_of_huge_entries(spark):
    huge = vectors(spark, [(k, [3e38 * (-1) ** k, float(k)]) for k in range(5)])
    got = whitening.whiten(huge, whitening.fit(huge)).collect()
    assert len(got) == 10 and {r.deviation for r in got} == {None} and all(math.isfinite(r.whitened) == (r.component == 1) if r.whitened is not None else r.component == 2 for r in got)


# ---- URL rules ----

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
MORE = [("Example.com", "/de", "allow"), ("a.b.example.com", "", "block"), ("example.com", "/de/x/ab", "allow"), ("example.com", "/de/", "allow"), ("com", "/de/x/abc", "block"), (None, "/", "block"), ("", "/", "block"), ("org", "/", None), ("ex.org", None, "block")]
URLS = [None, "", "no scheme", "http://", "https://net", "https://net/", "HTTP://A.Example.NET/en/1?x=/#y", "http://example.net/en", "http://example.net:80/en/", "http://notexample.net/en/", "http://x.example.com/de/x/abcd", "http://x.example.com/de/x/ab", "http://example.com/dex", "http://a.b.example.com?q", "http://c.a.b.example.com#f", "http://ex.org/fr/", "http://z.org/fr/\n/a", "a://b.org/fr/?u=http://net/", "http://ÄB.net/ü", "http://" + "a." * 3000 + "net/" + "b/" * 3000, "http://.net/", "http://net./", "http://x.example.com//de/", None]


def expected_verdict(url, rules, default="allow"):
    rest = (url or "").partition("://")[2]
    host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    known = {}
    for h, p, v in rules:
        if h and v:
            known.setdefault((h.lower(), p or ""), set()).add(v)
    fits = [(len(h + p), len(h), h + p, "block" if "block" in vs else max(vs)) for (h, p), vs in known.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


@pytest.mark.parametrize("light", [True, False])
@pytest.mark.parametrize("rules", [RULES, RULES + MORE, []])
def test_url_rules(spark, monkeypatch, rules, light):
    if not light:
        monkeypatch.setattr(common.light_or_not, "__defaults__", (-1,))
        monkeypatch.setattr(common, "LIGHT_KEY", 2)
    urls = URLS + ["http://hot.example.net/en/1"] * 20
    df = spark.createDataFrame([(k, u, "x", "x", 1, "x") for k, u in enumerate(urls)], "page_id bigint, url string, site string, rule string, n bigint, prefix string")
    out = urlrules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(urls) and {"site", "n", "prefix"} <= set(out.columns)
    assert got == {k: expected_verdict(u, rules) for k, u in enumerate(urls)}
    assert urlrules.judge(df.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).collect() == []


def test_digests_decide(spark, monkeypatch):
    """With prefixes that all collide the result is the same."""
    monkeypatch.setattr(urlrules, "PREFIX_DIGITS", 0)
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge(df, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    assert got == {k: expected_verdict(u, RULES) for k, u in enumerate(URLS)}
