"""The pipeline against brute force, stage by stage, on a small set of tables."""

import random

import pytest
from test_pairs import expected_classes
from test_texts import expected_base, expected_hits
from tokenizers import Tokenizer

import corpus_pipeline
from lexquarry.llm import quality
from lexquarry.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeéghis") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passages = [(k, text(25)) for k in range(4)]
    rows = [(k, text(rng.randint(20, 90))) for k in range(120)]
    rows += [(200 + k, rows[k][1] + (" more" if k % 2 else "")) for k in range(10)]
    rows += [(300 + k, f"{text(15)} {p} {text(15)}") for k, (_, p) in enumerate(passages)]
    rows += [(400 + k, f"{text(30)} token = {rng.randbytes(20).hex()} {text(10)}") for k in range(6)]
    junk = [(500 + k, " | ".join(text(40).split())) for k in range(60)]
    rows += [*junk, (900, None), (901, ""), (902, text(3000))]
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 500), 0) for i, _ in rows if i < 900]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(passages, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, passages


def test_stages_against_brute_force(spark, tables):
    path, rows, passages = tables
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "jaccard", "decontamination", "secrets", "bpe"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    model = quality.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    good = {r.doc_id for r in quality.classify(docs, model).where("predicted = 1").collect()}
    expected = [(i, t) for i, t in rows if i in good]
    assert {i for i, _ in expected if i is not None and i < 500} >= {i for i, t in rows if i < 500} and not {i for i, _ in expected} & set(range(500, 560))
    out = corpus_pipeline.STAGES[0][1](spark, docs, path)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in expected)

    keep = {i for i, _, c in expected_classes(expected) if i == c}
    expected = [(i, t) for i, t in expected if i in keep]
    out = corpus_pipeline.STAGES[1][1](spark, out, path)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in expected)

    clean = {i for i, _, hit, _ in expected_hits(expected, passages) if not hit}
    assert not clean & set(range(300, 304))
    expected = [(i, t) for i, t in expected if i in clean]
    out = corpus_pipeline.STAGES[2][1](spark, out, path)
    assert out.columns == columns and sorted(r.doc_id for r in out.collect()) == sorted(clean)

    def redacted(t):
        for start, _, end in sorted({(s, 0, e) for s, k, e in expected_base(t) if k == 0}, reverse=True):
            t = t[:start] + "[SECRET]" + t[end:]
        return t

    expected = {i: redacted(t) if t else t for i, t in expected}
    out = corpus_pipeline.STAGES[3][1](spark, out, path)
    assert out.columns == columns and {r.doc_id: r.text for r in out.collect()} == expected

    tokenizer = Tokenizer.from_file(TOKENIZER)
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(final) == set(expected)
    for i, t in expected.items():
        assert list(final[i].ids) == tokenizer.encode(t or "", add_special_tokens=False).ids and final[i].text == t


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_with_nulls_and_other_columns(spark, tables):
    path, _, _ = tables
    own = ["score", "predicted", "id", "th", "__id", "__th", "base", "tested", "spans", "found", "node", "sig", "__score"]
    rows = [(None, None, None, None, None), (1, None, None, None, None), (1, "Some text of good words here.", None, None, 3), (1, "Some text of good words here.", None, None, 3)]
    docs = spark.createDataFrame([(*r, *own) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in own))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert set(docs.columns) <= set(out.columns), name
        assert all(r[c] == c for r in out.collect() for c in own), name
