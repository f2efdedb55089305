"""Near-duplicate and repeat operators against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from lexquarry.llm import common, jaccard, neardup, repeats


def least_reachable(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) >= 3 else ({tuple(words)} if words else set())


def expected_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    group = defaultdict(list)
    for k, r in enumerate(least_reachable(len(rows), links)):
        group[r].append(k)
    out = []
    for members in group.values():
        low = min((rows[k][0] for k in members if rows[k][0] is not None), default=None)
        out += [(rows[k][0], len(sets[k]), low if sets[k] else rows[k][0]) for k in members]
    return sorted(out, key=str)


def classes(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()), key=str)


def test_jaccard_against_brute_force(documents, prose):
    assert classes(documents(prose)) == expected_classes(prose)


def test_jaccard_in_blocks(documents, prose, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    monkeypatch.setattr(jaccard, "CELLS", 200)
    assert classes(documents(prose)) == expected_classes(prose)


def test_jaccard_empty(documents):
    assert jaccard.join(documents([])).collect() == []


def test_jaccard_keeps_one_of_each_class(documents, prose):
    rows = [(k, t) for k, (_, t) in enumerate(prose)]
    kept = jaccard.keep_one(documents(rows))
    assert kept.columns == documents(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in expected_classes(rows) if i == c)


@pytest.mark.parametrize("percent", [80, 90, 95])
def test_signatures_meet_at_the_bound(percent):
    rng = np.random.default_rng(percent)
    for _ in range(300):
        union = int(rng.integers(2, 260))
        apart = union * (100 - percent) // 100
        tokens = rng.integers(0, 2**64, union, np.uint64)
        mine = int(rng.integers(0, apart + 1))
        a, b = np.sort(tokens[: union - apart + mine]), np.sort(np.r_[tokens[: union - apart], tokens[union - apart + mine :]])
        if set(a) == set(b):
            continue
        row, sig = jaccard.signatures(np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b], np.array([len(a), len(b)]), percent)
        assert set(sig[row == 0]) & set(sig[row == 1])


def test_components_of_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    found = {r.node: r.component_id for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 160), 100)}


def test_components_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "EDGES", 10)
    monkeypatch.setattr(common, "LIGHT_KEY", 5)
    rng = random.Random(14)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 190)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    found = {r.node: r.component_id for r in common.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = least_reachable(500, edges)
    assert found == {k: root[k] for edge in edges for k in edge if edge[0] != edge[1]}


def removed_by_brute_force(rows):
    first = {}
    order = lambda i: (i is None, i or 0)
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, t in data:
        for s in range(len(t) - 49):
            first[t[s : s + 50]] = min(first.get(t[s : s + 50], order(i)), order(i))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for s in range(len(t) - 49):
            if first[t[s : s + 50]] < order(i):
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), hashlib.sha256(kept).hexdigest(), len(re.findall(b"\1+", bytes(gone)))))
    return sorted(out, key=str)


def repeats_of(df):
    return sorted(((r.doc_id, len((r.text or "").encode()), hashlib.sha256(bytes(r.kept)).hexdigest(), len(r.spans)) for r in repeats.remove(df).collect()), key=str)


def test_repeats_against_brute_force(documents, prose):
    assert repeats_of(documents(prose)) == removed_by_brute_force(prose)


def test_repeats_with_many_buckets_and_pieces(documents, prose, monkeypatch):
    for name, value in (("PIECE", 700), ("BUCKET", 3000), ("TRANSFORM", 500)):
        monkeypatch.setattr(repeats, name, value)
    rows = [*prose, (300, "q" * 400), (301, "ab" * 300), (302, "p" + "q" * 70), (303, "ab" * 30)]
    df = documents(rows).repartition(7)
    assert repeats_of(df) == removed_by_brute_force(rows)


def test_repeats_dealt_digit_by_digit(documents, prose, monkeypatch):
    """Small fans: numbers of buckets with two digits and more; hot minimizers are dealt on after the first round too."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    rows = [*prose, *((400 + k, " ".join(f"{word()} a phrase that all share {word()}" for _ in range(6))) for k in range(30)), (500, "q" * 400), (501, "q" * 90)]
    monkeypatch.setattr(repeats, "BUCKET", 8_000)
    seen = set()
    for fan, hot in ((2, 2), (7, 32)):
        monkeypatch.setattr(repeats, "FAN", fan)
        monkeypatch.setattr(repeats, "HOT", hot)
        seen.add(repeats.Radix.of(sum(len(t.encode()) for _, t in rows if t) * 7 // 2 // 8_000, fan).digits)
        assert repeats_of(documents(rows).repartition(4)) == removed_by_brute_force(rows)
    assert min(seen) >= 2 and max(seen) >= 3, seen


def test_radix_rows_of_a_batch_are_bounded():
    raw = np.frombuffer(random.Random(3).randbytes(60_000).replace(b"\xff", b"x"), np.uint8)
    at, ids = np.array([0, 30_000, len(raw)]), np.array([5, 9])
    start, count, place, h, _, row = repeats.passages(raw, at)
    for buckets in (1, 30, 1000, 10**6, 10**9):
        radix = repeats.Radix.of(buckets, 40)
        assert radix.fan <= 40 and radix.buckets >= buckets
        dealt = list(repeats._dealt(raw, start, count, place, h, repeats.K, start - at[row], row, ids, ids > 0, ids, radix))
        assert len({r[0] for r in dealt}) == len(dealt) <= radix.fan
        data, kept, _, _, inside, of, size, minimizer = repeats._opened(pa.array([r[4] for r in dealt]), pa.array([r[5] for r in dealt]))
        begin = np.cumsum(size) - size
        assert sorted(zip(kept[of], inside, size, minimizer, strict=True)) == sorted(zip(ids[row], start - at[row], count + repeats.LENGTH - 1, place - start, strict=True))
        context = np.flatnonzero(size - minimizer >= repeats.WIDE)
        assert (repeats._key(data, (begin + minimizer)[context], repeats.WIDE) == repeats._hashes_at(data, (begin + minimizer)[context], (0, repeats.WIDE))[0]).all()
        # What was dealt by one digit falls, dealt on, into the buckets that all digits name.
        assert (radix.of_key(repeats._key(data, begin + minimizer, repeats.K), 1) == np.repeat([r[0] for r in dealt], [np.frombuffer(zstandard.decompress(r[5]), np.int64, 1)[0] for r in dealt])).all()


def test_repeats_shuffle_few_bytes():
    """Bytes of a batch that is dealt to many buckets, by bytes of its text, and bytes of a span."""
    rng = random.Random(12)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 10))) for _ in range(3000)]
    texts = [" ".join(rng.choice(known) for _ in range(300)).encode() for _ in range(200)]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])]
    start, count, place, h, _, row = repeats.passages(raw, at)
    ids = np.arange(200) * 7
    some = np.zeros(200, np.int64)
    rows = list(repeats._dealt(raw, start, count, place, h, repeats.K, start - at[row], row, ids, some == 0, some, repeats.Radix.of(1000, 10_000)))
    assert sum(len(r[5]) for r in rows) < 0.45 * len(raw)
    sizes = np.array(rng.choices(range(50, 200), k=len(start)))
    spans = repeats._packed(ids[row], some[row] == 0, some[row], start - at[row], start - at[row] + sizes, 50)
    assert sum(map(len, spans[1])) < 10 * len(start)


def test_repeats_of_ids_that_repeat(documents, prose):
    rows = [*prose, (2, "other words " * 9), (2, "other words " * 9 + "and more"), (9_000, "and a last one " * 9)]
    assert repeats_of(documents(rows)) == removed_by_brute_force(rows)
    for given, some in ((rows, True), ([(1, "a"), (2, "a"), (None, "a")], False)):
        docs = documents(given)
        total, name = repeats.measured(docs)
        assert total == sum(len((t or "").encode()) for _, t in given)
        assert docs.where(name != 0).count() == (len(given) if some else 0)


def test_repeats_with_hot_minimizers(documents, prose, monkeypatch):
    """A phrase between different words in every document, and groups that are split in batches, in buckets and in transforms."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9)))
    phrase = "a phrase that all share"
    ends = [" ".join(word() for _ in range(8)) for _ in range(6)]
    rows = [*prose, *((400 + k, " ".join(f"{rng.choice(ends)} {phrase} {rng.choice(ends)}" if rng.random() < 0.6 else f"{word()} {phrase} {word()}" for _ in range(6))) for k in range(40))]
    monkeypatch.setattr(repeats, "BUCKET", 20_000)
    for hot, transform in ((2, 2_000_000), (5, 300), (10**9, 300)):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "TRANSFORM", transform)
        assert repeats_of(documents(rows).repartition(5)) == removed_by_brute_force(rows)


def test_repeats_keep_other_columns(documents, prose):
    cut = repeats.remove(documents(prose))
    assert set(documents([]).columns) | {"kept", "spans"} == set(cut.columns)
    assert {(r.id, r.th, r.mine, r.cut) for r in cut.collect()} == {("x",) * 4}


def test_repeats_empty(documents):
    assert repeats.remove(documents([])).collect() == []


def test_suffix_order_is_that_of_the_suffixes():
    rng = np.random.default_rng(2)
    parts = [bytes(rng.integers(97, 99, int(rng.integers(50, 89))).astype(np.uint8)) for _ in range(30)]
    text = np.frombuffer(b"".join(x + b"\xff" for x in parts * 2), np.uint8)
    suffix = lambda k: bytes(text[k:]).split(b"\xff")[0] + b"\xff"
    found = [suffix(k) for k in repeats.suffix_order(text)]
    assert found == sorted(found)


def test_equal_strings_are_the_classes_of_prefixes():
    rng = np.random.default_rng(1)
    text = rng.integers(97, 100, 4000).astype(np.uint8)
    text[2000:2400], text[3000:3300], text[-1], text[1000] = text[100:500], 97, repeats.STOP, repeats.STOP
    order, kind = repeats.equal_strings(text)
    of = np.empty(len(text), int)
    of[order] = kind
    by_string = defaultdict(set)
    for k in range(len(text) - 50):
        if repeats.STOP not in text[k : k + 50]:
            by_string[text[k : k + 50].tobytes()].add(of[k])
    assert all(len(v) == 1 for v in by_string.values())
    assert len(set.union(*by_string.values())) == len(by_string)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, "x", "x", 1) for i, v, label in rows], f"vec_id bigint, embedding array<{kind}>, label int, node string, vec string, size int")


def expected_vectors(rows):
    good = [v is not None and label is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v, label in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if g else None for (_, v, _), g in zip(rows, good, strict=True)]
    linked = lambda a, b: a != b and good[a] and good[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    n = len(rows)
    pairs = [(a, b) for a in range(n) for b in range(n) if linked(a, b)]
    root = least_reachable(n, pairs)
    low = defaultdict(list)
    for k in range(n):
        if rows[k][0] is not None:
            low[root[k]].append(rows[k][0])
    degree = [sum(1 for a, _ in pairs if a == k) for k in range(n)]
    component = [min(low[root[k]], default=None) for k in range(n)]
    return sorted(((rows[k][0], degree[k], component[k], rows[k][0] == component[k]) for k in range(n)), key=str)


@pytest.fixture(scope="module")
def some_vectors():
    rng = random.Random(3)
    gauss = lambda n, s=1.0: [float(np.float32(rng.gauss(0, s))) for _ in range(n)]
    rows = [(k, gauss(16), k % 3) for k in range(60)]
    centre = gauss(16)
    rows += [(100 + k, [float(np.float32(c + e)) for c, e in zip(centre, gauss(16, 0.15), strict=True)], 1) for k in range(50)]
    rows += [(200 + k, centre, 1) for k in range(5)] + [(210, centre, 2), (211, centre, None), (212, None, 1), (213, [], 1), (214, [0.0] * 16, 1), (215, [float("nan")] + [1.0] * 15, 1), (216, [None] + [1.0] * 15, 1), (217, [float("inf")] + [1.0] * 15, 1)]
    return [*rows, (218, gauss(4), 1), (200, centre, 1), (None, centre, 1), (None, None, None)]


@pytest.mark.parametrize("block", [2000, 9])
def test_near_vectors_against_brute_force(spark, some_vectors, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    found = neardup.near_duplicates(vectors(spark, some_vectors)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in found), key=str) == expected_vectors(some_vectors)


def test_close_pairs_are_found(spark):
    """Recall of pairs just above the bound, each apart from all others by its label."""
    rng = np.random.default_rng(11)
    rows, n = [], 4000
    for k in range(n):
        a, b = rng.standard_normal((2, 32))
        a /= np.linalg.norm(a)
        b -= (b @ a) * a
        cosine = rng.uniform(0.9305, 0.94)
        b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), k), (2 * k + 1, b.tolist(), k)]
    found = neardup.near_duplicates(vectors(spark, rows, "double")).where("n_links > 0").count() / 2
    assert found / n > 0.995


def test_cells_do_not_depend_on_the_batch():
    rng = np.random.default_rng(12)
    unit = rng.standard_normal((300, 48))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    keys = neardup.Hashing().keys(unit)
    assert all((neardup.Hashing().keys(unit[i:j]) == keys[i:j]).all() for i, j in ((0, 1), (5, 12), (100, 300)))


def test_a_dense_block_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(13)
    unit = np.abs(rng.standard_normal((1, 64))) + 0.05 * rng.standard_normal((2000, 64))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    tracemalloc.start()
    a, b = neardup._close(unit, None, 0.93)
    assert len(a) == len(b) == 2000 * 1999 // 2 and tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_near_vectors_empty_and_double(spark):
    assert neardup.near_duplicates(vectors(spark, [])).collect() == []
    tiny = [(1, [1e-200, 0.0], 1), (2, [1e200, 1e199], 1)]
    assert [r.n_links for r in neardup.near_duplicates(vectors(spark, tiny, "double")).collect()] == [1, 1]
