"""Assembly of documents and chunks, loaders, sinks, tokenizers, and the index behind lexical search."""

import json

import pytest
from pyspark.sql import functions as F

from lexquarry.functions import tokenizers as N
from lexquarry.operators import assembly as A
from lexquarry.operators import cleaning as C
from lexquarry.operators import context as X
from lexquarry.operators import literals as literals_of
from lexquarry.operators import quality as Q
from lexquarry.operators import search as S
from lexquarry.operators import state as B
from lexquarry.sources import sinks as K
from lexquarry.sources import tables as R

VOCABULARIES = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize(
    ("text", "expected", "kept"),
    [("use aes- gcm here", "use aes-gcm here", 0), ("use AES- CBC", "use AES-CBC", 0), ("aes-\nccm mode", "aes-ccm mode", 0), ("well- defined", "well-defined", 0), ("abc- xyz", "abc- xyz", 0), ("quux-\nblarg", "quux-\nblarg", 1)],
)
def test_protected_compounds(spark, text, expected, kept):
    r = spark.createDataFrame([(text,)], "t string").select(C.repaired(F.col("t")).alias("r")).first()["r"]
    assert (r.text, r.n_kept) == (expected, kept)


def test_warnings_and_categories(spark):
    rows = [([("B", "x"), ("A", None), ("B", "x"), (None, "y")], "ok", 1), (None, "a�", 2), ([], None, 3)]
    df = spark.createDataFrame(rows, "w array<struct<type:string,desc:string>>, t string, p int")
    assert [r.x for r in df.select(A.warnings(F.col("w"), F.col("t"), F.col("p")).alias("x")).collect()] == [["A", "B: x", "ENCODING_WARNING: y"], ["Contains \\ufffd on page 2"], []]
    cases = [("documents", "x"), (None, "root"), ("a", "root"), ("a", "b"), (None, "b"), ("root", "b")]
    found = spark.createDataFrame(cases, "c string, f string").select(A.root_category(F.col("c"), F.col("f")).alias("x")).collect()
    assert [r.x for r in found] == ["root", "root", "root", "a", "b", "root"]


def test_tables_in_texts(spark):
    df = spark.createDataFrame([("one |t| two |t| three", ["|t|", " ", None]), (None, ["|t|"]), ("plain", [])], "t string, m array<string>")
    assert [r.x for r in df.select(A.without_tables(F.col("t"), F.col("m")).alias("x")).collect()] == ["one  two  three", "", "plain"]
    boxed = [
        ("before OLDTABLE after", ["| new |"], [(7, 15)], "before \n\n| new |\n\n after"),
        ("abcdef", ["X", "Y"], [(4, 5), (1, 2)], "a\n\nX\n\ncd\n\nY\n\nf"),  # in order of their places
        ("abcdef", ["X"], [(1, 2), (4, 5)], "a\n\nX\n\ncdef"),  # no table is left for the second
        ("abcdef", ["X", "Y"], [(1, 99), (3, 3)], "abcdef"),  # beyond the text, and empty
        ("abcdef", ["X", "Y"], [(None, 3), (2, 3)], "ab\n\nY\n\ndef"),
        ("abc", ["X", "Y"], [], "abc\n\nX\n\nY"),
        ("abc", ["X"], None, "abc\n\nX"),
        ("abc", [], [(0, 1)], "abc"),
        (None, None, None, ""),
    ]
    df = spark.createDataFrame([b[:3] for b in boxed], "t string, m array<string>, b array<struct<start:int,end:int>>")
    assert [r.x for r in df.select(A.spliced(F.col("t"), F.col("m"), F.col("b")).alias("x")).collect()] == [b[3] for b in boxed]


def test_parser_chain(spark):
    df = spark.createDataFrame([("a", "b"), (None, "b"), (" ", None), (" ", "b")], "x string, y string")
    one = lambda name: F.struct(F.lit(name).alias("parser"), F.col(name).alias("text"))
    found = df.select(A.first_parsed(one("x"), one("y")).alias("p")).collect()
    assert [r.p and (r.p.parser, r.p.text) for r in found] == [("x", "a"), ("y", "b"), None, ("y", "b")]


def test_document_markdown(spark):
    pages = spark.createDataFrame([("d", 2, " two ", ["|t|"]), ("d", 1, None, []), ("e", 1, "x", ["|a|", "|b|"])], "document_id string, page_number int, text string, standalone array<string>")
    found = {r.document_id: r.markdown for r in A.document_markdown(pages).collect()}
    assert found == {"d": "# d\n\n## Page 1\n\n## Page 2\n\ntwo\n\n|t|", "e": "# e\n\n## Page 1\n\nx\n\n|a|\n\n|b|"}


def test_figures_and_all_chunks(spark):
    rows = [("d", 3, 1, "f", "img/a.png", "xref 9", "Figure 4: the flow\nAs Figure 4 shows, it flows."), ("d", 3, 2, "g", None, "Own", None)]
    figures = spark.createDataFrame(rows, "document_id string, page_number int, seq int, figure_id string, image_path string, caption string, page_text string")
    made = A.figure_chunks(figures, spark.createDataFrame([("img/a.png",), ("img/a.png",)], "path string"))
    found = {r.chunk_id: r for r in made.collect()}
    assert found["d_fig_00001"].caption_linked and not found["d_fig_00001"].missing and found["d_fig_00001"].section_heading == "Figure 4: the flow"
    assert found["d_fig_00002"].missing and found["d_fig_00002"].text == "### Figure: Own\nSource: [d Page 3]\nAsset:"
    text = spark.createDataFrame([("t1", "d", "x")], "chunk_id string, document_id string, text string")
    twins = spark.createDataFrame([("d", "z"), ("d", "e"), ("d", "z")], "document_id string, duplicate_of string")
    both = A.all_chunks(text, text.where("false"), made, twins)
    assert sorted((r.chunk_id, r.content_type, r.duplicate_of) for r in both.collect()) == [("d_fig_00001", "figure", ["e", "z"]), ("d_fig_00002", "figure", ["e", "z"]), ("t1", "text", ["e", "z"])]


def test_faults_stop_or_go_on(spark):
    df = spark.createDataFrame([(1,), (-1,)], "x int")
    fault = F.when(F.col("x") < 0, "negative")
    assert [r.fault for r in A.checked(df, fault, False).collect()] == [None, "negative"]
    with pytest.raises(Exception, match="negative"):
        A.checked(df, fault, True).collect()
    assert df.select(A.storage_estimate(F.lit(10)).alias("n")).first().n == 432967


def test_ids_and_expectations(spark):
    df = spark.createDataFrame([(None, "b"), ("a", None)], "x string, y string")
    assert [r.i for r in df.select(A.resolved_id(F.col("x"), F.col("y")).alias("i")).collect()] == ["b", "a"]
    with pytest.raises(Exception, match="id columns"):
        df.select(A.resolved_id(F.col("x")).alias("i")).collect()
    good = {"expected": 2, "pages": [1, 2], "ids": ["d", "d"], "raw": "--- PAGE 1 ---\na\n--- PAGE 2 ---\nb", "structured": "--- PAGE 1 ---\na\n--- PAGE 2 ---\nb", "cited": ["Page 1", "Page 2"], "figures": 0, "ragged": 0}
    bad = {"": {}, "page_count": {"expected": 3}, "not_consecutive": {"pages": [1, 3]}, "document_ids": {"ids": ["d", "e"]}, "dividers": {"raw": "no"}, "citations": {"cited": ["Page 1", "Page 9"]}, "figure_files": {"figures": 1}, "table_rows": {"ragged": None}, "text_ratio": {"structured": "x"}}
    rows = [tuple((good | change).values()) for change in bad.values()]
    df = spark.createDataFrame(rows, "expected int, pages array<int>, ids array<string>, raw string, structured string, cited array<string>, figures int, ragged int")
    checks = A.artifact_checks(*[F.col(c) for c in df.columns])
    assert [r.f for r in df.select(A.first_fault(checks).alias("f")).collect()] == list(bad)


def test_judges_and_preflight(spark):
    replies = ['Sure: {"a": 0.5, "b": "x"} ok', "{}", "none", None, '{"a": "12", "b": 3}']
    found = spark.createDataFrame([(r,) for r in replies], "r string").select(X.judged(F.col("r"), ["a", "b"]).alias("j")).collect()
    assert [(r.j.a, r.j.b) for r in found] == [(0.5, None), (None, None), (None, None), (None, None), (12.0, 3.0)]
    pages = spark.createDataFrame([(612.0, 792.0, 0, 10, 1), (600.0, 850.0, 90, 60, 1), (400.0, 792.0, 0, 10, 0)], "w double, h double, r int, t int, i int")
    assert [tuple(r.p) for r in pages.select(Q.preflight(*[F.col(c) for c in pages.columns]).alias("p")).collect()] == [(False, True, True), (True, True, False), (False, False, False)]


def test_structured_files(spark, tmp_path):
    at = tmp_path / "cat" / "doc1"
    at.mkdir(parents=True)
    (at / "doc1_structured.json").write_text(json.dumps({"document_id": "doc1", "category": "cat", "pages": [{"page_number": 1, "cleaned_text": "a", "tables": [{"table_id": "t", "headers": ["h"], "rows": [["1"]]}]}, {"page_number": 2}]}))
    (at / "other.json").write_text("{}")
    bad = tmp_path / "cat" / "doc2"
    bad.mkdir()
    (bad / "doc2_structured.json").write_text("{oops")
    found = R.structured_files(spark, str(tmp_path)).orderBy("page_number").collect()
    assert [(r.document_id, r.category, r.page_number, r.cleaned_text) for r in found] == [("doc1", "cat", 1, "a"), ("doc1", "cat", 2, None)]
    assert found[0].tables[0].rows == [["1"]] and R.structured_files(spark, str(tmp_path), ["doc2"]).count() == 0


def test_relevance_judgements(spark):
    values = ['{"q1": ["a", "b", "a"], "q2": {"relevant_chunks": ["c"]}}', "{}", None, "{oops"]
    found = R.qrels(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert sorted(tuple(r) for r in found) == [("q1", "a"), ("q1", "b"), ("q2", "c")]


def test_files_that_are_left_to_run(spark):
    files = spark.createDataFrame([("/a", 1, "x"), ("/b", 1, "x"), ("/c", 1, "y"), ("/d", 1, "z")], "path string, length int, sha256 string")
    found = R.to_run(files, spark.createDataFrame([("y",)], "sha256 string")).collect()
    assert sorted((r.path, r.n_peers, r.first_path) for r in found) == [("/a", 1, "/a"), ("/b", 1, "/a"), ("/d", 0, "/d")]


def test_duplicate_peers(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, "a"), (4, "b"), (5, None), (6, None)], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in Q.duplicate_peers(docs).collect()) == [(1, 2, 2, 2), (2, 2, 1, 3), (3, 2, 1, 1)]


def test_literal_counts(spark):
    docs = spark.createDataFrame([(1, "see  the long\nword here"), (1, "see the long word here"), (1, "see the long word here"), (2, None), (3, "a b")], "doc_id bigint, text string")
    literals = spark.createDataFrame([(1, "the long word"), (2, "a  b"), (3, "longish"), (4, "he long wo"), (5, None), (6, "see the longer word")], "item_id bigint, text string")
    assert {r.item_id: r.n_docs for r in literals_of.counts(docs, literals).collect()} == {1: 3, 2: 1, 3: 0, 4: 3, 5: 5, 6: 0}


# ---- sinks ----


def test_written_artifacts(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 2, [])], "category string, n int, tags array<string>")
    path = str(tmp_path / "out")
    K.write(df, path, by=["category"])
    assert spark.read.parquet(path).where("category = 'a'").first().n == 1
    with pytest.raises(Exception, match="exists"):
        K.write(df, path)
    K.write(df.where("n = 2"), path, overwrite=True)
    assert spark.read.parquet(path).count() == 1
    K.write(df, str(tmp_path / "csv"), "csv")
    assert sorted((r.category, r.tags) for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()) == [("a", "x;y"), ("b", None)]
    K.write(df, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_artifacts_by_category(spark, tmp_path):
    docs = spark.createDataFrame([("d", "x", "# d", "raw", [(1, "t")]), ("e", "y", "# e", "more", [(1, "t"), (2, "u")])], "document_id string, category string, markdown string, raw_text string, pages array<struct<page_number:int,text:string>>")
    K.write_artifacts(docs, str(tmp_path / "a"))
    assert {r.category: (r.n_documents, r.n_pages, r.n_chars) for r in spark.read.json(str(tmp_path / "a" / "manifest")).collect()} == {"x": (1, 1, 3), "y": (1, 2, 4)}
    assert spark.read.json(str(tmp_path / "a" / "structured")).where("category = 'y'").first().pages[1].text == "u"
    assert spark.read.parquet(str(tmp_path / "a" / "markdown")).count() == 2


def test_manifest_and_points(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 5), ("d", 7), ("e", 1)], "document_id string, token_count int")
    assert tuple(K.manifest(chunks).first()) == (2, 3, 13)
    path = str(tmp_path / "points")
    K.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "point_id int, v string"), path, 1)
    K.upsert(spark.createDataFrame([(2, "c")], "point_id int, v string"), path, 2)
    K.upsert(spark.createDataFrame([(2, "d")], "point_id int, v string"), path, 2)
    assert {r.point_id: r.v for r in K.points(spark, path).collect()} == {1: "a", 2: "d"}
    assert K.verify(K.points(spark, path), spark.createDataFrame([(1,), (3,)], "point_id int"), "point_id") == {"vectors": 2, "metadata": 2, "without_metadata": 1, "without_vector": 1}


def test_logs_and_runs(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id int, status string, at int")
    log = str(tmp_path / "log")
    K.add_statuses(make([(1, "FAILED", 1)]), log)
    K.add_statuses(make([(1, "SUCCESS", 2), (2, "FAILED", 1)]), log)
    assert {r.doc_id: r.status for r in B.latest(spark.read.parquet(log), "doc_id", F.col("status"), F.col("at")).collect()} == {1: "SUCCESS", 2: "FAILED"}
    path = str(tmp_path / "vectors")
    for n in (1, 2):
        K.add_embeddings(spark.createDataFrame([(n, [0.5])], "doc_id int, embedding array<double>"), path, "a")
    K.add_embeddings(spark.createDataFrame([(3, [0.5])], "doc_id int, embedding array<double>"), path, "b")
    assert sorted(r.doc_id for r in spark.read.parquet(path).collect()) == [2, 3]
    assert tuple(K.rolled_up(spark.createDataFrame([(1, 2, 3), (4, 5, 6)], "n_documents int, n_chunks int, n_tokens int")).first()) == (2, 5, 7, 9)


def test_parsers_in_turn(spark, tmp_path):
    for name, content in (("a", "one|two"), ("b", "?bad"), ("c", "blank")):
        (tmp_path / f"{name}.pdf").write_text(content)

    def first(content):
        if content.startswith(b"?"):
            raise OSError("broken")
        return [{"raw_text": t, "images": 1} for t in content.decode().split("|")] if content != b"blank" else [{"raw_text": " "}]

    def second(content):
        if content == b"blank":
            raise ValueError("no")
        return [{"raw_text": "rescued"}]

    found = R.parsed(spark, str(tmp_path), {"first": first, "second": second}).collect()
    assert sorted((r.path[-5:], r.parser or "", r.fault or "", r.page_number or 0, r.raw_text or "") for r in found) == [("a.pdf", "first", "", 1, "one"), ("a.pdf", "first", "", 2, "two"), ("b.pdf", "second", "", 1, "rescued"), ("c.pdf", "", "second: ValueError", 0, "")]


def test_generation_and_sources(spark):
    df = spark.createDataFrame([("Cats sleep. Dogs run fast! Dogs bark.", "Do dogs run?"), ("Nothing here.", "zzz"), (None, "x"), ("a b", None)], "c string, q string")
    assert [r.x for r in df.select(X.extractive(F.col("c"), F.col("q")).alias("x")).collect()] == ["Dogs run fast!", None, None, None]

    def provider():
        def say(prompt):
            if prompt == "bad":
                raise RuntimeError("limit")
            yield from ("to ", prompt)

        return say

    found = X.generated(spark.createDataFrame([("you",), ("bad",), (None,)], "prompt string"), provider).collect()
    assert [(r.answer, r.failed) for r in found] == [("to you", None), (None, "RuntimeError: limit"), (None, None)]
    hits = spark.createDataFrame([(1, 2, "b", None, ""), (1, 1, "a", "f", "s")], "query_id int, rank int, document string, source string, section string")
    assert X.source_lines(hits).first().shown == "[Source 1] a (f) - s\n[Source 2] b (Unknown) - Unknown"


# ---- tokenizers ----


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken"])
def test_tokenizers(spark, name):
    adapter = N.Adapter(VOCABULARIES.path(name))
    df = spark.createDataFrame([("Hello there, world",), ("",), (None,)], "t string")
    found = df.select(adapter.count(F.col("t")).alias("n"), adapter.truncate(F.col("t"), 2).alias("cut"), adapter.truncate(F.col("t"), 9).alias("whole")).collect()
    assert [(r.n, r.cut, r.whole) for r in found] == [(4, "Hello there", "Hello there, world"), (0, "", ""), (0, None, None)]


def test_tokenizer_by_estimate_and_unknown_kind(spark, tmp_path):
    df = spark.createDataFrame([("x" * 10,), ("a",), ("",), (None,)], "t string")
    assert [r.n for r in df.select(N.Adapter().count(F.col("t")).alias("n")).collect()] == [2, 1, 0, 0]
    (tmp_path / "v.bin").write_text("x")
    with pytest.raises(ValueError, match="bin"):
        N.Adapter(str(tmp_path / "v.bin"))


# ---- search ----


def test_one_index_serves_several_sets_of_queries(spark):
    docs = spark.createDataFrame([(1, "red fox runs"), (2, "blue fox"), (3, None), (4, "hen")], "doc_id bigint, text string")
    index = S.index_of(docs)
    assert index.average == 1.5 and {r.term: r.df for r in index.terms.collect()}["fox"] == 2
    for words, best in (("red", 1), ("hen", 4)):
        asked = spark.createDataFrame([(7, words)], "query_id bigint, text string")
        assert [r.doc_id for r in S.bm25(docs, asked, 3, index).orderBy("rank").collect()][0] == best


def test_hybrid_lists_are_fused(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta"), (3, "alpha beta"), *((k, f"other{k}") for k in range(4, 12))], "doc_id bigint, text string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(9, "beta")], "query_id bigint, text string")
    found = S.hybrid(docs, asked, vectors, spark.createDataFrame([(9, [1.0, 0.0])], "query_id bigint, embedding array<double>"), 2)
    assert {r.doc_id for r in found.collect()} == {1, 2, 3} and found.where("rank = 1").first().doc_id == 2


def test_encoding_and_deduplication(spark):
    texts = spark.createDataFrame([(1, "aa"), (2, None), (3, "abc")], "id int, text string")
    found = {r.id: r.embedding for r in S.encoded(texts, lambda: lambda some: [[len(t), 0.0] for t in some]).collect()}
    assert found == {1: [1.0, 0.0], 2: [0.0, 0.0], 3: [1.0, 0.0]}
    rows = spark.createDataFrame([("x", 1, "old", None), ("y", 2, "b", "s"), ("x", 3, "new", None)], "id string, at int, text string, note string")
    assert sorted((r.id, r.at, r.text) for r in S.deduplicated(rows, "id", "at").collect()) == [("x", 1, "new"), ("y", 2, "b")]
