"""Goldens and invariants of the library's own operators."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexquarry.operators import chunking as K
from lexquarry.operators import cleaning as C
from lexquarry.operators import context as X
from lexquarry.operators import layout as L
from lexquarry.operators import quality as Q
from lexquarry.operators import search as S
from lexquarry.operators import state as B
from lexquarry.operators import tables as T
from lexquarry.sources import tables as R
from lexquarry.streaming import ingest as I


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'bigint'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [("## Scope", ("Scope", 2)), ("### 13", (None, None)), ("##### Deep **x**", ("Deep **x**", 4)), ("APPENDIX B terms", ("APPENDIX B terms", 1)), ("chapter 2", ("chapter 2", 1)), ("AC-2(1) ACCOUNT CONTROL", ("AC-2(1) ACCOUNT CONTROL", 2)),
     ("2.1 Purpose", ("2.1 Purpose", 1)), ("3.2.1.4 Deep", ("3.2.1.4 Deep", 3)), ("1. Intro", ("1. Intro", 1)), ("26. Too far", (None, None)), ("2.1 A sentence.", (None, None)), ("481 Institute of things", (None, None)), ("plain", (None, None)), ("# " + "x" * 200, (None, None))],
)
def test_headings(spark, text, expected):
    assert tuple(one(spark, K.heading(F.col("t")), t=text)) == expected


def test_bm25_tokens(spark):
    assert one(spark, S.tokens(F.col("t")), t="Café foo_bar naïve AC-2(1) élan x9 ½a") == ["ac", "2", "1", "x9"]


def test_bm25_fills_with_zeros_and_skips_blank_queries(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["red fox", "blue fox", "green hen", None, ""])], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "hen"), (2, "???"), (3, None)], "query_id bigint, text string")
    found = S.bm25(docs, asked, 3).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(1, 2), (1, 0), (1, 1)] and found[1].score == 0


def test_dense_search_in_blocks(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(1).standard_normal((50, 8)).astype(np.float32)
    rows = [(k, x[k].tolist()) for k in range(50)] + [(50, None), (51, [0.0] * 8)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    monkeypatch.setattr(S, "VECTOR_BLOCK", 7)
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    found = S.dense(vectors, vectors.withColumnRenamed("vec_id", "query_id"), 4).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T - 3 * np.eye(50)
    expected = {(q, r + 1, int(v)) for q in range(50) for r, v in enumerate(np.argsort(-near[q], kind="stable")[:4])}
    assert {(r.query_id, r.rank, r.vec_id) for r in found} == expected


def test_fusion_ties_keep_the_first_list(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id int, doc_id int, rank int")
    assert [r.doc_id for r in S.fuse([a, b]).orderBy("rank").collect()] == [11, 10, 12]


def test_metrics_count_queries_without_hits(spark):
    hits = spark.createDataFrame([("s", 1, 1, False), ("s", 1, 2, True)], "stage string, query_id int, rank int, relevant boolean")
    r = S.metrics(hits, spark.createDataFrame([(1,), (2,)], "query_id int"), ["stage"]).first()
    assert (r.n_queries, r.hit1, r.hit3, r.mrr, r.precision_returned, r.precision_fixed) == (2, 0, 50, 0.25, 25, 10)


@pytest.mark.parametrize(
    ("text", "expected"),
    [("imple-\nmentation", "implementation"), ("zero-\ntrust", "zero-trust"), ("quux-\nblarg", "quux-\nblarg"), ("AES-\nmode", "AES-mode"), ("infor- mation", "information"), ("real- time", "real-time"), ("odd- pair", "odd- pair"), ("join-\ning and continu-\ned", "joining and continu-\ned")],
)
def test_hyphens(spark, text, expected):
    assert one(spark, C.repaired(F.col("t"))["text"], t=text) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("“a” — ‘b’–c d", "\"a\"  -  'b'-c d"), ("  � item", "  * item"), ("x = � y", "x = � y"), ("Option�Alpha", "Option Alpha"), ("a  \n\n\n\nb\n", "a\n\nb")],
)
def test_normalising(spark, text, expected):
    assert one(spark, C.normalised(F.col("t"))["text"], t=text) == expected


def test_cleaning_twice_changes_nothing_more(spark):
    text = "Intro imple-\nmentation  \n\n\n\n“x” �\n  � item\nOption�Alpha"
    once = one(spark, C.normalised(C.repaired(F.col("t"))["text"])["text"], t=text)
    assert one(spark, C.normalised(C.repaired(F.col("t"))["text"])["text"], t=once) == once


def test_running_lines(spark):
    pages = spark.createDataFrame([("d", k, f"Title of it\n\nbody {k} text\n{'iv' if k == 4 else 'End part'}\n") for k in range(5)] + [("e", 0, "Title of it\nyz"), ("e", 1, None)], "document_id string, page_number int, text string")
    cut = {(r.document_id, r.page_number): (r.text, r.header, r.footer) for r in C.without_running_lines(pages).collect()}
    assert cut[("d", 0)] == ("body 0 text", "Title of it", "End part") and cut[("d", 4)] == ("body 4 text", "Title of it", "iv")
    assert cut[("e", 0)] == ("Title of it\nyz", None, None) and cut[("e", 1)] == ("", None, None)


SENTENCES = st.lists(st.sampled_from(["Alpha beta gamma.", "One; two: three four.", "word " * 60, "x" * 300, "Short?"]), min_size=1, max_size=8).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(SENTENCES, min_size=1, max_size=8), st.sampled_from(["", "### Head\n\n"]))
def test_packing_keeps_the_limit_and_all_words(paragraphs, prefix):
    made = list(K.pack([(k, p) for k, p in enumerate(paragraphs)], prefix, 60, 10, K.estimate))
    words = {w for p in paragraphs for w in p.split()}
    assert words <= {w for _, _, t in made for w in t.split()}
    # Rounding down of two parts may add one token.
    assert all(K.estimate(t) <= 61 or max(map(len, t.split())) > 200 for _, _, t in made)
    assert all(t.startswith(prefix.strip()) and a <= b for a, b, t in made)


def test_overlap_is_the_end_of_the_chunk_before():
    first, second = "Aaaa bbbb cccc dddd. Eeee ffff.", "Gggg hhhh iiii jjjj kkkk llll mmmm nnnn oooo."
    made = [t for _, _, t in K.pack([(1, first), (2, second)], "", 14, 4, K.estimate)]
    assert made == [first, f"Eeee ffff.\n\n{second}"]


def test_legacy_packing():
    assert K.legacy_pack("a\n\nb\n\n" + "c" * 50, 5) == ["a\n\nb", "c" * 20, "c" * 20, "c" * 10]


def test_table_rows_are_kept_in_order():
    rows = [[str(k), "word " * 20] for k in range(40)]
    parts = T.table_parts(["no", "text"], rows, "Lines", "[Page 1]", 200)
    assert [(a, b) for a, b, _ in parts][0][0] == 0 and all(p[1] == q[0] for p, q in zip(parts, parts[1:], strict=False)) and parts[-1][1] == 40
    assert all(K.estimate(t) <= 200 and "| no | text |" in t for _, _, t in parts)
    assert [re.findall(r"^\| (\d+) \|", t, re.M) for _, _, t in parts] == [[str(k) for k in range(a, b)] for a, b, _ in parts]


def test_a_large_row_is_split_with_its_context():
    parts = T.table_parts(["id", "notes"], [["R1", "Example 1: " + "alpha " * 150 + "Example 2: " + "beta " * 150]], "T", "S", 300)
    assert len(parts) > 1 and all("| R1 |" in t for _, _, t in parts)


@pytest.mark.parametrize(
    ("cell", "units"),
    [("a\nb", ["a", "b"]), ("Example 1: x Example 2: y", ["Example 1: x", "Example 2: y"]), ("• x • y", ["• x", "• y"]), ("AB-1: x CD: y", ["A", "B", "-", "1: x", "C", "D: y"]), ("x; y; z", ["x;", "y;", "z"]), ("One. Two.", ["One.", "Two."]), ("a ... b ---", ["a ...", "b ---"]), ("one", ["one"])],
)
def test_cell_units(cell, units):
    assert T.cell_units(cell) == units


def test_grids(spark):
    grid = [["", "A", None], ["", "1", " "], ["x", "2"]]
    df = spark.createDataFrame([(grid,)], "g array<array<string>>").select(T.pruned(F.col("g")).alias("g")).select("g", T.header_of(F.col("g")).alias("h"))
    r = df.first()
    assert r.g == [["", "A"], ["", "1"], ["x", "2"]] and r.h.headers == ["Column_1", "A"] and not r.h.headerless


def test_garbled_texts(spark):
    cases = {"�" * 10 + "word " * 20: ["replacement"], "\x01" * 10 + "word " * 20: ["control"], "#" * 80: ["low_alnum"], "A1" * 40 + " word " * 10: ["long_token"], "7" * 70 + " word " * 10: [], "0x" + "ab" * 40 + " word " * 10: [], "short": []}
    for text, expected in cases.items():
        assert one(spark, Q.garbled(F.col("t")), t=text) == expected


def test_figures_and_sizes(spark):
    assert one(spark, Q.size_text(F.col("n")), n=1023) == "1023 B" and one(spark, Q.size_text(F.col("n")), n=1536) == "1.50 KB"
    assert one(spark, Q.category(F.col("t")), t="Incident Response and Cloud") == "incident_response"
    assert one(spark, Q.relevant(F.col("t")), t="Annual Report on risk") is False


def test_context_and_citations(spark):
    assert one(spark, X.citations(F.col("t")), t="[Source 1] [Source 9] [Source 1, Source 2]") == [1, 9]
    hits = spark.createDataFrame([(1, 2, None, "", "s", None, " t "), (1, 1, "d", "f", None, 0.5, "x")], "query_id int, rank int, document string, source string, section string, score double, text string")
    text = X.contexts(hits).first().context
    assert text.startswith("SOURCE 1\n\nDocument: d\nSource File: f\nSection: Unknown\nRRF Score: 0.500000\n\nContent:\nx\n\nSOURCE 2\n\nDocument: Unknown") and text.endswith("Content:\n t")


def test_checkpoints(spark):
    known = spark.createDataFrame([(k,) for k in range(4)], "k int")
    log = spark.createDataFrame([(0, "SUCCESS", 2), (0, "FAILED", 1), (1, "IN_PROGRESS", 1), (2, "SUCCESS", 1)], "k int, s string, t int")
    last = B.latest(log, "k", F.col("s"), F.col("t"))
    assert {r.status: r.n for r in B.rollup(last, known, "k").collect()} == {"SUCCESS": 2, "PENDING": 2}
    assert sorted(r.k for r in B.pending(known, last, known.where("k = 0"), "k").collect()) == [1, 2, 3]


def test_chunk_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps([{"id": "x", "content": "t", "metadata": {"p": "1"}}, {"id": "", "text": "no"}]))
    (tmp_path / "two.json").write_text(json.dumps({"chunks": [{"chunkId": "y", "chunk": "u"}, {"chunk_id": "z"}]}))
    (tmp_path / "bad.json").write_text("{oops")
    assert sorted((r.chunk_id, r.text) for r in R.chunk_files(spark, str(tmp_path)).collect()) == [("x", "t"), ("y", "u")]


def test_file_discovery(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "~$a.pdf", ".h.pdf", "c.txt"):
        (tmp_path / name).write_text(name)
    assert [r.path.rsplit("/", 1)[1] for r in R.files(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pdf"]
    assert len(R.files(spark, str(tmp_path), most=1).collect()) == 1


def test_streamed_documents(spark, tmp_path):
    schema = "doc_id bigint, text string"
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, "# Head\n\nbody one"), (2, "two")], schema).write.parquet(source)
    I.ingest(spark.readStream.schema(schema).parquet(source), sink, state).awaitTermination()
    spark.createDataFrame([(1, "# Head\n\nbody changed")], schema).write.mode("append").parquet(source)
    I.ingest(spark.readStream.schema(schema).parquet(source), sink, state).awaitTermination()
    assert {r.document_id: r.text for r in I.current(spark, sink).collect()} == {"1": "### Head\n\nbody changed", "2": "two"}


def test_streamed_memory_and_counts(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, question string, answer string"
    spark.createDataFrame([(1, t, f"q{t}", f"a{t}" if t else None) for t in range(9)], schema).write.parquet(str(tmp_path / "x"))
    query = I.live_memory(spark.readStream.schema(schema).parquet(str(tmp_path / "x"))).writeStream.format("memory").queryName("live").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.turn: r.n_history for r in spark.table("live").collect()} == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 6}
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 09:00:00", "a", 2.0)], "event_id int, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(str(tmp_path / "e"))
    query = I.event_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("counted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r.n, r.total) for r in spark.table("counted").orderBy("start").collect()][0] == (1, 1.0)


def test_chunks_hold_every_word_of_every_line(spark, tmp_path):
    from lexquarry.plans import chunking

    words = {k: [f"w{k}x{n}" for n in range(13 * 30)] for k in range(11)}
    rows = [(k, "\n".join(" ".join(w[i : i + 30]) for i in range(0, len(w), 30))) for k, w in words.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {k: set() for k in words}
    for r in chunking.chunks_packed(spark, str(tmp_path)).collect():
        held[int(r.document_id)] |= set(r.text.split())
    assert all(set(w) <= held[k] for k, w in words.items())
    assert {r.document_id: r.n_oversize for r in chunking.chunk_audit(spark, str(tmp_path)).collect()} == {str(k): 0 for k in words}


def test_exports_keep_pages_as_rows(spark):
    import hashlib

    rows = [("a", n, f"é{n} " * n) for n in range(1, 30)] + [("b", 3, None), ("b", 2, "x"), (None, 1, "no source"), ("c", 1, "")]
    divided = L.with_dividers(spark.createDataFrame(rows, "document_id string, page_number int, text string").repartition(5))
    assert divided.count() == len(rows)
    found = {r.document_id: (r.n_pages, r.n_chars, r.digest) for r in L.digests(divided).collect()}
    pages = {d: [f"--- PAGE {n} ---\n{t or ''}\n" for e, n, t in sorted(rows, key=lambda r: r[1]) if e == d] for d in ("a", "b", "c", None)}
    bits = lambda d: sum(int(hashlib.sha256(f"{n}:--- PAGE {n} ---\n{t or ''}\n".encode()).hexdigest()[:15], 16) for e, n, t in rows if e == d)
    assert found == {d: (len(p), len("\n".join(p)), str(bits(d))) for d, p in pages.items()}
    turned = L.digests(divided.withColumn("page_number", F.when(F.col("document_id") == "b", 5 - F.col("page_number")).otherwise(F.col("page_number"))))
    assert {r.document_id for r in turned.collect() if r.digest != found[r.document_id][2]} == {"b"}


def test_export_digests_are_of_whole_texts_in_order(spark):
    import hashlib

    import __spark_entry__

    rows = [("a", n, f"é{n} " * n) for n in range(1, 30)] + [("b", 3, None), ("b", 2, "x"), (None, 1, "no source"), ("c", 1, "")]
    divided = L.with_dividers(spark.createDataFrame(rows, "document_id string, page_number int, text string").repartition(5))
    found = {r.document_id: (r.n_pages, r.n_chars, r.text_sha256) for r in L.text_digests(divided).collect()}
    pages = {d: [f"--- PAGE {n} ---\n{t or ''}\n" for e, n, t in sorted(rows, key=lambda r: r[1]) if e == d] for d in ("a", "b", "c", None)}
    assert found == {d: (len(p), len("\n".join(p)), hashlib.sha256("\n".join(p).encode()).hexdigest()) for d, p in pages.items()}
    assert L.text_digests(divided.where("false")).count() == 0
    assert "sha256(t)" in __spark_entry__.oracle_sql()["raw_text_export"]  # of the joined text, not of pages


def test_pages_are_numbered_in_ranges(spark):
    rows = [(k * 7 % 1000, "hot" if k % 3 else None if k % 2 else "s", f"t{k}") for k in range(1000)] + [(1000, "one", None)]
    found = R.pages(spark.createDataFrame(rows, "doc_id bigint, source string, text string"))
    of = {}
    for d, s, t in sorted(rows, key=lambda r: r[0]):
        of.setdefault(s, []).append((d, t or ""))
    assert {(r.document_id, r.page_number, r.doc_id, r.text) for r in found.collect()} == {(s, n + 1, *x) for s, xs in of.items() for n, x in enumerate(xs)} and found.count() == 1001
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Window [" in x and "text" in x]
    assert R.pages(spark.createDataFrame([], "doc_id bigint, source string, text string")).count() == 0


def test_places_in_many_ranges(spark):
    rows = [(k % 70 if k < 100 else None, "g" if k % 3 else None, f"t{k}") for k in range(110)]
    df = spark.createDataFrame(rows, "id bigint, part string, text string").repartition(4)
    for within in ((), ("part",)):
        got = B.places(df, "id", within, range_keys=9).collect()
        of = {}
        for r in got:
            of.setdefault(r.part if within else 0, []).append((r["__at"], r.id if r.id is not None else -1))
        assert len(got) == len(rows)
        for found in of.values():
            assert [at for at, _ in sorted(found)] == list(range(len(found))) and [i for _, i in sorted(found)] == sorted(i for _, i in found)
