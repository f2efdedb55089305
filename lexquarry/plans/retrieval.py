"""Registered queries: retrieval, fusion, metrics, context and conversation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.operators import context as X
from lexquarry.operators import search as S
from lexquarry.sources.store import stored
from lexquarry.sources.tables import table


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def bm25_postings_stats(spark, sf):
    return S.term_stats(S.postings(_docs(spark, sf)))


def bm25_topk(spark, sf):
    found = S.bm25(_docs(spark, sf), _asked(spark, sf))
    return found.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The BM25 list, and a list by number of query words found, of one index."""
    index = S.index_of(_docs(spark, sf))
    weights = S.weights(index, _asked(spark, sf))
    return tuple(S.search(index, weights, orders=("score", "overlap")))


def _fused(spark, sf) -> DataFrame:
    return S.fuse(list(_lists(spark, sf)))


def rrf_fusion(spark, sf):
    return _fused(spark, sf).select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


def hybrid_weighted_rerank(spark, sf):
    best = S.weighted(_lists(spark, sf)[0], "overlap", "score")
    return best.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("hybrid", 6).alias("score"))


def rerank_overlap(spark, sf):
    best = S.rerank(_fused(spark, sf), _docs(spark, sf), _asked(spark, sf))
    return best.select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def context_blocks(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("document"), "source", F.col("lang").alias("section"), F.col("text"))
    best = _fused(spark, sf).where(F.col("rank") <= S.FINAL)
    made = X.contexts(best.join(docs, "doc_id"))
    return made.select("query_id", "n_sources", F.length("context").cast("long").alias("context_chars"), F.sha2("context", 256).alias("context_sha256"))


def answer_prompts(spark, sf):
    docs = _docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("document"), "source", F.col("lang").alias("section"), F.col("text"))
    best = S.bm25(_docs(spark, sf), _asked(spark, sf)).where(F.col("rank") <= S.FINAL)
    made = X.contexts(best.join(docs, "doc_id")).join(_asked(spark, sf), "query_id")
    return made.select("query_id", F.sha2(X.answer_prompt(F.col("context"), F.col("text")), 256).alias("prompt_sha256"))


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf, "embeddings")
    return vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def dense_topk(spark, sf):
    return S.dense(*_vectors(spark, sf)).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _hybrid(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Queries (vectors' ids divisible by 100 that are documents, with their text), and the dense, BM25 and fused lists."""
    vectors, vector_asked = _vectors(spark, sf)
    docs = _docs(spark, sf)
    asked = stored(docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text").join(vector_asked.select("query_id"), "query_id", "left_semi"), "asked-texts")
    asked_vectors = stored(vector_asked.join(asked.select("query_id"), "query_id", "left_semi"), "asked-vectors")
    lexical = stored(S.bm25(docs, asked), "lexical")
    near = stored(S.dense(vectors, asked_vectors).withColumnRenamed("vec_id", "doc_id"), "near")
    return asked, near, lexical, S.hybrid(docs, asked, vectors, asked_vectors, lexical=lexical, near=near)


def hybrid_retrieval(spark, sf):
    return _hybrid(spark, sf)[3].select("query_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 9).alias("score"))


def four_stage_metrics(spark, sf):
    """Dense, BM25, fused and reranked lists against labels: a document is relevant if its vector's label is the query's."""
    asked, near, lexical, fused = _hybrid(spark, sf)
    fused = stored(fused, "fused")
    stages = [near, lexical, fused, S.rerank(fused, _docs(spark, sf), asked)]
    hits = None
    for name, x in zip(("dense", "bm25", "rrf", "rerank"), stages, strict=True):
        part = x.select(F.lit(name).alias("stage"), "query_id", "doc_id", "rank")
        hits = part if hits is None else hits.union(part)
    labels = table(spark, sf, "embeddings").select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    judged = stored(hits, "staged").join(labels.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left").join(own, "query_id").withColumn("relevant", F.coalesce(F.col("label") == F.col("asked"), F.lit(False)))
    return S.metrics(judged, asked, ["stage"]).select("stage", "n_queries", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "hit5", "precision_returned", "precision_fixed", "mrr", "quality")])


def three_stage_comparison(spark, sf):
    """Vectors alone, reranked, and both weighted (0.8 and 0.2), five places each, with what each gains over vectors alone."""
    vectors, vector_asked = _vectors(spark, sf)
    docs = _docs(spark, sf)
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text").join(vector_asked.select("query_id"), "query_id", "left_semi")
    own_vectors = vector_asked.select("query_id", F.col("embedding").alias("embedding")).join(asked.select("query_id"), "query_id", "left_semi")
    near = stored(S.dense(vectors, own_vectors).withColumnRenamed("vec_id", "doc_id"), "near")
    again = stored(S.rerank(near, docs, asked, S.DEPTH), "reranked")
    both = near.select("query_id", "doc_id", F.col("score").alias("vector"), "rank").join(again.select("query_id", "doc_id", F.col("score").alias("reranker")), ["query_id", "doc_id"])
    stages = {"vector": near, "reranker": again, "hybrid": S.weighted(both, "vector", "reranker", (0.8, 0.2))}
    hits = reduce(DataFrame.union, (x.where(F.col("rank") <= S.FINAL).select(F.lit(name).alias("stage"), "query_id", "doc_id", "rank") for name, x in stages.items()))
    labels = vectors.select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    judged = hits.join(labels.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left").join(own, "query_id").withColumn("relevant", F.coalesce(F.col("label") == F.col("asked"), F.lit(False)))
    return S.compared(S.metrics(judged, asked, ["stage"]), "vector").select("stage", "n_queries", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "hit5", "precision_fixed", "mrr", "hit5_gain", "mrr_gain")], "best")


def chunk_dedupe(spark, sf):
    """Chunks of all documents under ids that repeat, in load order by doc_id."""
    made = _docs(spark, sf).select(F.concat_ws("-", "source", (F.col("n_chars") % 40).cast("string")).alias("chunk_id"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return S.deduplicated(made, "chunk_id", "doc_id").select("chunk_id", F.col("doc_id").alias("first_id"), "text_sha256")


def vector_normalise(spark, sf):
    """Lengths of all vectors before and after they are normalised."""
    length = lambda v: F.round(F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double")), F.lit(0.0), lambda acc, x: acc + x * x)), 9)
    return table(spark, sf, "embeddings").select("vec_id", F.round(length(F.col("embedding")), 6).alias("before"), length(S.normalised(F.col("embedding"))).alias("after"))


def _staged(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Hits of two stages (all dimensions; the first half of them) with relevance (equal labels), and the queries."""
    vectors, asked = _vectors(spark, sf)
    labels = vectors.select("vec_id", "label")
    own = vectors.select(F.col("vec_id").alias("query_id"), F.col("label").alias("asked"))
    stages = S.dense(vectors, asked).withColumn("stage", F.lit("full")).union(S.dense(vectors, asked, dims=32).withColumn("stage", F.lit("half")))
    return stages.join(labels, "vec_id").join(own, "query_id").withColumn("relevant", F.coalesce(F.col("label") == F.col("asked"), F.lit(False))), asked


def retrieval_metrics(spark, sf):
    hits, asked = _staged(spark, sf)
    return S.metrics(hits, asked, ["stage"]).select("stage", "n_queries", *[F.round(c, 6).alias(c) for c in ("hit1", "hit3", "hit5", "precision_returned", "precision_fixed", "mrr", "quality")])


def rerank_regression(spark, sf):
    first = _staged(spark, sf)[0].where("rank = 1")
    pair = first.groupBy("query_id").agg(F.max(F.when(F.col("stage") == "half", F.col("relevant"))).alias("before"), F.max(F.when(F.col("stage") == "full", F.col("relevant"))).alias("after"))
    outcome = F.when(F.col("before") & F.col("after"), "kept").when(F.col("before"), "regressed").when(F.col("after"), "improved").otherwise("missed")
    return pair.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n_queries"))


def similarity_summary(spark, sf):
    hits = S.dense(*_vectors(spark, sf))
    return hits.agg(F.count("*").alias("n_hits"), F.round(F.avg("score"), 6).alias("mean_score"), F.round(F.avg(F.when(F.col("rank") == 1, F.col("score"))), 6).alias("mean_first"))


def conversation_window(spark, sf):
    kept = X.memory(table(spark, sf, "conversations"))
    shown = F.array_join(F.transform("history", lambda x: F.concat(x["question"], F.lit("\n"), x["answer"], F.lit("\n"))), "")
    return kept.select("conv_id", "turn", F.size("history").cast("long").alias("n_history"), F.sha2(shown, 256).alias("history_sha256"))


def rewrite_prompts(spark, sf):
    kept = X.memory(table(spark, sf, "conversations"))
    return kept.select("conv_id", "turn", F.coalesce(F.sha2(X.rewrite_prompt(F.col("history"), F.col("question")), 256), F.lit("")).alias("prompt_sha256"))


def source_display(spark, sf):
    """The sources that answers to all benchmark items would list."""
    docs = _docs(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("document"), "source", F.col("lang").alias("section"))
    best = S.bm25(_docs(spark, sf), _asked(spark, sf)).where(F.col("rank") <= S.FINAL)
    return X.source_lines(best.join(docs, "doc_id"))


def stage_comparison(spark, sf):
    """Figures of the dense stages beside each other, and what the first half of the dimensions loses."""
    hits, asked = _staged(spark, sf)
    found = S.metrics(hits, asked, ["stage"])
    each = found.select("stage", F.explode(F.create_map(*[x for c in ("hit1", "hit3", "hit5", "mrr") for x in (F.lit(c), F.col(c))])).alias("figure", "value"))
    wide = each.groupBy("figure").pivot("stage", ["full", "half"]).agg(F.first("value"))
    return wide.select("figure", F.round("full", 6).alias("full"), F.round("half", 6).alias("half"), F.round(F.col("full") - F.col("half"), 6).alias("lost"))


def citation_accuracy(spark, sf):
    """Answers made from all documents: citations whose numbers follow from the id, some of them out of range."""
    first, second = (F.col("doc_id") % 7).cast("string"), (F.col("doc_id") % 3 + 1).cast("string")
    answer = F.concat(F.lit("See [Source "), first, F.lit("] and [Source "), second, F.lit("]. "), F.coalesce("text", F.lit("")))
    made = _docs(spark, sf).select("doc_id", answer.alias("answer"))
    return made.select("doc_id", F.size(X.citations(F.col("answer"))).cast("long").alias("n_citations"), F.round(X.citation_accuracy(F.col("answer"), F.lit(5)), 6).alias("accuracy"))


def judge_means(spark, sf):
    """Scores read from JSON in all events, as a judge returns them; missing ones stay out of means, and a success rate."""
    events = table(spark, sf, "events")
    parsed = events.select("event_type", F.from_json("props", "k double")["k"].alias("k"), (F.col("event_type") != "error").alias("success"))
    grounded = F.when(F.col("k") >= 10, F.col("k"))
    means = parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.avg(grounded).alias("grounded"), F.avg(F.when(grounded >= 70, 100.0).when(grounded.isNotNull(), 0.0)).alias("share"), F.avg(F.when(F.col("success"), 100.0).otherwise(0.0)).alias("success"))
    score = F.when(F.col("grounded").isNotNull(), (F.col("success") + F.col("share")) / 2)
    return means.select("event_type", "n", F.round("grounded", 6).alias("grounded"), F.round("share", 6).alias("share"), F.round(score, 6).alias("end_to_end"))


_TOKENS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z0-9]+'))"
_ASKED = "SELECT item_id AS query_id, text FROM benchmark"


def _matching(asked: str) -> str:
    return f"""
  w AS (SELECT doc_id, {_TOKENS} AS words FROM documents),
  size AS (SELECT count(*) AS n, avg(len(words)) AS avgdl FROM w),
  p AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(words) AS dl, unnest(words) AS term FROM w) GROUP BY term, doc_id),
  raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM p, size GROUP BY term, n),
  idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
  b AS (SELECT query_id, {_TOKENS} AS words FROM ({asked})),
  q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(words) AS term FROM b) GROUP BY query_id, term),
  hits AS (
    SELECT query_id, doc_id, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS overlap
    FROM p JOIN q USING (term) JOIN idf USING (term), size GROUP BY query_id, doc_id
  ),
  scored AS (
    SELECT query_id, doc_id, coalesce(score, 0) AS score, coalesce(overlap, 0) AS overlap
    FROM (SELECT query_id FROM b WHERE len(words) > 0) CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN hits USING (query_id, doc_id)
  ),
  bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored) WHERE rank <= 20),
  ov AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM hits) WHERE rank <= 20),
  both_lists AS (SELECT query_id, doc_id, 0 AS list, rank FROM bm25 UNION ALL SELECT query_id, doc_id, 1, rank FROM ov),
  fused_all AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM (SELECT query_id, doc_id, list, CAST(rank AS DOUBLE) AS rank FROM both_lists) GROUP BY query_id, doc_id),
  fused AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM fused_all) WHERE rank <= 20)
"""


_MATCHED = _matching(_ASKED)
_DENSE = """
  e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL),
  pairs AS (
    SELECT 'full' AS stage, a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
    UNION ALL
    SELECT 'half', a.vec_id, b.vec_id, round(list_cosine_similarity(a.v[1:32], b.v[1:32]), 9) FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
  ),
  ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stage, query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20),
  judged AS (SELECT ranked.*, coalesce(a.label = b.label, false) AS relevant FROM ranked JOIN e AS a ON a.vec_id = query_id JOIN e AS b ON b.vec_id = ranked.vec_id)
"""


def _block(score: str) -> str:
    return f"""regexp_replace('SOURCE ' || rank || chr(10) || chr(10) || 'Document: ' || doc_id || chr(10) || 'Source File: ' || coalesce(nullif(source, ''), 'Unknown') || chr(10)
      || 'Section: ' || coalesce(nullif(lang, ''), 'Unknown') || chr(10) || 'RRF Score: ' || printf('%.6f', {score}) || chr(10) || chr(10) || 'Content:' || chr(10) || coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"""


_EXCHANGES = """
  t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS said FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  x AS (SELECT conv_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN said END AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM t WHERE role = 'user'),
  h AS (SELECT a.conv_id, a.turn, a.question, count(b.answer) AS n, {shown} AS shown
    FROM x AS a LEFT JOIN x AS b ON a.conv_id = b.conv_id AND b.i BETWEEN a.i - 6 AND a.i - 1 AND b.answer IS NOT NULL GROUP BY a.conv_id, a.turn, a.question)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_HYBRID = f"""{_matching("SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)")}, {_DENSE},
  near AS (SELECT query_id, vec_id AS doc_id, rank FROM ranked WHERE stage = 'full' AND query_id IN (SELECT query_id FROM b)),
  two AS (SELECT query_id, doc_id, 0 AS list, rank FROM near UNION ALL SELECT query_id, doc_id, 1, rank FROM bm25),
  mixed_all AS (SELECT query_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(list * 1000 + rank) AS first FROM (SELECT query_id, doc_id, list, CAST(rank AS DOUBLE) AS rank FROM two) GROUP BY query_id, doc_id),
  mixed AS (SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first) AS rank FROM mixed_all) WHERE rank <= 20),
  again AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, before_rank) AS rank FROM (
    SELECT query_id, mixed.doc_id, mixed.rank AS before_rank, len(list_intersect(list_distinct(b.words), list_distinct(w.words))) / len(list_distinct(b.words)) AS s FROM mixed JOIN b USING (query_id) JOIN w ON w.doc_id = mixed.doc_id)),
  four AS (SELECT 'dense' AS stage, query_id, doc_id, rank FROM near UNION ALL SELECT 'bm25', query_id, doc_id, rank FROM bm25 UNION ALL SELECT 'rrf', query_id, doc_id, rank FROM mixed UNION ALL SELECT 'rerank', query_id, doc_id, rank FROM again WHERE rank <= 5),
  seen AS (SELECT four.*, coalesce(x.label = y.label, false) AS relevant FROM four JOIN e AS x ON x.vec_id = query_id LEFT JOIN e AS y ON y.vec_id = four.doc_id)"""

QUERIES = {f.__name__: f for f in (source_display, stage_comparison, three_stage_comparison, hybrid_retrieval, four_stage_metrics, chunk_dedupe, vector_normalise, bm25_postings_stats, bm25_topk, rrf_fusion, hybrid_weighted_rerank, rerank_overlap, context_blocks, answer_prompts, dense_topk, retrieval_metrics, rerank_regression, similarity_summary, conversation_window, rewrite_prompts, citation_accuracy, judge_means)}

SQL = {
    "bm25_postings_stats": f"WITH w AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY term",
    "hybrid_retrieval": f"WITH {_HYBRID} SELECT query_id, doc_id, rank, round(score, 9) AS score FROM mixed",
    "four_stage_metrics": f"""WITH {_HYBRID}, m AS (
      SELECT stage, query_id, max(CASE WHEN relevant AND rank <= 1 THEN 1.0 ELSE 0 END) AS hit1, max(CASE WHEN relevant AND rank <= 3 THEN 1.0 ELSE 0 END) AS hit3, max(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0 END) AS hit5,
        sum(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0 END) / count(*) FILTER (rank <= 5) AS pr, sum(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0 END) / 5 AS pf, coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0) AS rr
      FROM seen GROUP BY stage, query_id
    ), asked AS (SELECT count(*) AS n FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))
    SELECT stage, n AS n_queries, round(100 * sum(hit1) / n, 6) AS hit1, round(100 * sum(hit3) / n, 6) AS hit3, round(100 * sum(hit5) / n, 6) AS hit5, round(100 * sum(pr) / n, 6) AS precision_returned, round(100 * sum(pf) / n, 6) AS precision_fixed,
      round(sum(rr) / n, 6) AS mrr, round((100 * sum(hit5) / n + 100 * sum(rr) / n) / 2, 6) AS quality FROM m, asked GROUP BY stage, n""",
    "three_stage_comparison": f"""WITH {_HYBRID},
      nv AS (SELECT query_id, vec_id AS doc_id, score AS v, rank FROM ranked WHERE stage = 'full' AND query_id IN (SELECT doc_id FROM documents)),
      rr AS (SELECT query_id, nv.doc_id, v, nv.rank AS before_rank, len(list_intersect(list_distinct(b.words), list_distinct(w.words))) / len(list_distinct(b.words)) AS s FROM nv JOIN b USING (query_id) JOIN w ON w.doc_id = nv.doc_id),
      mm AS (SELECT *, min(v) OVER q AS vl, max(v) OVER q AS vh, min(s) OVER q AS sl, max(s) OVER q AS sh FROM rr WINDOW q AS (PARTITION BY query_id)),
      hy AS (SELECT query_id, doc_id, 0.8 * CASE WHEN vh = vl THEN 1.0 ELSE (v - vl) / (vh - vl) END + 0.2 * CASE WHEN sh = sl THEN 1.0 ELSE (s - sl) / (sh - sl) END AS h FROM mm),
      three AS (SELECT 'vector' AS stage, query_id, doc_id, rank FROM nv UNION ALL SELECT 'reranker', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, before_rank) FROM rr UNION ALL SELECT 'hybrid', query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(h, 9) DESC, doc_id) FROM hy),
      judged3 AS (SELECT three.*, coalesce(x.label = y.label, false) AS relevant FROM three JOIN e AS x ON x.vec_id = query_id LEFT JOIN e AS y ON y.vec_id = three.doc_id WHERE rank <= 5),
      m AS (SELECT stage, query_id, max(CASE WHEN relevant AND rank <= 1 THEN 1.0 ELSE 0 END) AS hit1, max(CASE WHEN relevant AND rank <= 3 THEN 1.0 ELSE 0 END) AS hit3, max(CASE WHEN relevant THEN 1.0 ELSE 0 END) AS hit5, sum(CASE WHEN relevant THEN 1.0 ELSE 0 END) / 5 AS pf, coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0) AS rr FROM judged3 GROUP BY stage, query_id),
      asked AS (SELECT count(*) AS n FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)),
      f AS (SELECT stage, n, 100 * sum(hit1) / n AS hit1, 100 * sum(hit3) / n AS hit3, 100 * sum(hit5) / n AS hit5, 100 * sum(pf) / n AS pf, sum(rr) / n AS mrr FROM m, asked GROUP BY stage, n),
      c AS (SELECT f.*, f.hit5 - z.hit5 AS hit5_gain, f.mrr - z.mrr AS mrr_gain, max(f.mrr) OVER () AS top_mrr FROM f, (SELECT hit5, mrr FROM f WHERE stage = 'vector') AS z)
      SELECT stage, n AS n_queries, round(hit1, 6) AS hit1, round(hit3, 6) AS hit3, round(hit5, 6) AS hit5, round(pf, 6) AS precision_fixed, round(mrr, 6) AS mrr, round(hit5_gain, 6) AS hit5_gain, round(mrr_gain, 6) AS mrr_gain, round(mrr, 9) = round(top_mrr, 9) AS best FROM c""",
    "chunk_dedupe": """WITH c AS (SELECT concat_ws('-', source, CAST(n_chars % 40 AS VARCHAR)) AS chunk_id, doc_id, sha256(coalesce(text, '')) AS h FROM documents)
      SELECT chunk_id, min(doc_id) AS first_id, arg_max(h, doc_id) AS text_sha256 FROM c GROUP BY chunk_id""",
    "vector_normalise": """WITH v AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings)
      SELECT vec_id, round(n, 6) AS before, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS DOUBLE) AS after FROM v""",
    "bm25_topk": f"WITH {_MATCHED} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm25",
    "rrf_fusion": f"WITH {_MATCHED} SELECT query_id, doc_id, rank, round(score, 9) AS score FROM fused",
    "hybrid_weighted_rerank": f"""WITH {_MATCHED}, m AS (
      SELECT *, min(overlap) OVER p AS ol, max(overlap) OVER p AS oh, min(score) OVER p AS sl, max(score) OVER p AS sh FROM bm25 WINDOW p AS (PARTITION BY query_id)
    ), s AS (
      SELECT query_id, doc_id, 0.4 * CASE WHEN oh = ol THEN 1.0 ELSE (overlap - ol) / (oh - ol) END + 0.6 * CASE WHEN sh = sl THEN 1.0 ELSE (score - sl) / (sh - sl) END AS score FROM m
    ) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
    "rerank_overlap": f"""WITH {_MATCHED}, s AS (
      SELECT query_id, fused.doc_id, fused.rank AS before_rank, len(list_intersect(list_distinct(b.words), list_distinct(w.words))) / len(list_distinct(b.words)) AS score
      FROM fused JOIN b USING (query_id) JOIN w ON w.doc_id = fused.doc_id
    ) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, before_rank) AS rank FROM s) WHERE rank <= 5""",
    "context_blocks": f"""WITH {_MATCHED}, c AS (SELECT query_id, rank, {_block("score")} AS block FROM fused JOIN documents USING (doc_id) WHERE rank <= 5),
      j AS (SELECT query_id, count(*) AS n_sources, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM c GROUP BY query_id)
      SELECT query_id, n_sources, length(context) AS context_chars, sha256(context) AS context_sha256 FROM j""",
    "answer_prompts": f"""WITH {_MATCHED}, c AS (SELECT query_id, rank, {_block("score")} AS block FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 5),
      j AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY rank) AS context FROM c GROUP BY query_id)
      SELECT query_id, sha256(replace(replace({_quoted(X.ANSWER_PROMPT)}, '{{context}}', context), '{{question}}', text)) AS prompt_sha256 FROM j JOIN benchmark ON item_id = query_id""",
    "source_display": f"""WITH {_MATCHED}, c AS (SELECT query_id, rank, '[Source ' || rank || '] ' || doc_id || ' (' || coalesce(nullif(source, ''), 'Unknown') || ') - ' || coalesce(nullif(lang, ''), 'Unknown') AS line FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 5)
      SELECT query_id, string_agg(line, chr(10) ORDER BY rank) AS shown FROM c GROUP BY query_id""",
    "stage_comparison": f"""WITH {_DENSE}, m AS (SELECT stage, query_id, max(CASE WHEN relevant AND rank <= 1 THEN 1.0 ELSE 0 END) AS hit1, max(CASE WHEN relevant AND rank <= 3 THEN 1.0 ELSE 0 END) AS hit3, max(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0 END) AS hit5, coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0) AS mrr FROM judged GROUP BY stage, query_id),
      q AS (SELECT count(*) AS n FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT stage, 100 * sum(hit1) / n AS hit1, 100 * sum(hit3) / n AS hit3, 100 * sum(hit5) / n AS hit5, sum(mrr) / n AS mrr FROM m, q GROUP BY stage, n),
      u AS (SELECT stage, 'hit1' AS figure, hit1 AS v FROM s UNION ALL SELECT stage, 'hit3', hit3 FROM s UNION ALL SELECT stage, 'hit5', hit5 FROM s UNION ALL SELECT stage, 'mrr', mrr FROM s),
      p AS (SELECT figure, max(v) FILTER (stage = 'full') AS f, max(v) FILTER (stage = 'half') AS h FROM u GROUP BY figure) SELECT figure, CAST(round(f, 6) AS DOUBLE) AS "full", CAST(round(h, 6) AS DOUBLE) AS half, CAST(round(f - h, 6) AS DOUBLE) AS lost FROM p""",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, vec_id, rank, round(score, 6) AS score FROM ranked WHERE stage = 'full'",
    "retrieval_metrics": f"""WITH {_DENSE}, m AS (
      SELECT stage, query_id, max(CASE WHEN relevant AND rank <= 1 THEN 1.0 ELSE 0 END) AS hit1, max(CASE WHEN relevant AND rank <= 3 THEN 1.0 ELSE 0 END) AS hit3, max(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0 END) AS hit5,
        sum(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0 END) / count(*) FILTER (rank <= 5) AS pr, sum(CASE WHEN relevant AND rank <= 5 THEN 1.0 ELSE 0 END) / 5 AS pf, coalesce(1.0 / min(CASE WHEN relevant THEN rank END), 0) AS rr
      FROM judged GROUP BY stage, query_id
    ) SELECT stage, count(*) AS n_queries, round(100 * avg(coalesce(hit1, 0)), 6) AS hit1, round(100 * avg(coalesce(hit3, 0)), 6) AS hit3, round(100 * avg(coalesce(hit5, 0)), 6) AS hit5, round(100 * avg(coalesce(pr, 0)), 6) AS precision_returned,
      round(100 * avg(coalesce(pf, 0)), 6) AS precision_fixed, round(avg(coalesce(rr, 0)), 6) AS mrr, round((100 * avg(coalesce(hit5, 0)) + 100 * avg(coalesce(rr, 0))) / 2, 6) AS quality
    FROM (SELECT vec_id AS query_id FROM e WHERE vec_id % 100 = 0) CROSS JOIN (SELECT DISTINCT stage FROM judged) LEFT JOIN m USING (stage, query_id) GROUP BY stage""",
    "rerank_regression": f"""WITH {_DENSE}, o AS (SELECT query_id, bool_or(relevant) FILTER (stage = 'half') AS b, bool_or(relevant) FILTER (stage = 'full') AS a FROM judged WHERE rank = 1 GROUP BY query_id)
      SELECT CASE WHEN b AND a THEN 'kept' WHEN b THEN 'regressed' WHEN a THEN 'improved' ELSE 'missed' END AS outcome, count(*) AS n_queries FROM o GROUP BY 1""",
    "similarity_summary": f"WITH {_DENSE} SELECT count(*) AS n_hits, round(avg(score), 6) AS mean_score, round(avg(score) FILTER (rank = 1), 6) AS mean_first FROM ranked WHERE stage = 'full'",
    "conversation_window": f"WITH {_EXCHANGES.format(shown="coalesce(string_agg(b.question || chr(10) || b.answer || chr(10), '' ORDER BY b.i), '')")} SELECT conv_id, turn, n AS n_history, sha256(shown) AS history_sha256 FROM h",
    "rewrite_prompts": f"""WITH {_EXCHANGES.format(shown="coalesce(string_agg('User: ' || b.question || chr(10) || 'Assistant: ' || b.answer || chr(10), '' ORDER BY b.i), '')")}
      SELECT conv_id, turn, CASE WHEN n > 0 THEN sha256(replace(replace({_quoted(X.REWRITE_PROMPT)}, '{{history}}', shown), '{{question}}', question)) ELSE '' END AS prompt_sha256 FROM h""",
    "citation_accuracy": """WITH a AS (SELECT doc_id, list_transform(regexp_extract_all('See [Source ' || (doc_id % 7) || '] and [Source ' || (doc_id % 3 + 1) || ']. ' || coalesce(text, ''), '\\[Source[ \\x{202F}]+(\\d+)\\]', 1), lambda x: CAST(x AS INT)) AS c FROM documents)
      SELECT doc_id, len(c) AS n_citations, round(CASE WHEN len(c) = 0 THEN 0.0 ELSE len(list_filter(c, lambda x: x BETWEEN 1 AND 5)) / len(c) END, 6) AS accuracy FROM a""",
    "judge_means": """WITH p AS (SELECT event_type, CASE WHEN CAST(json_extract(props, '$.k') AS DOUBLE) >= 10 THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS g, event_type <> 'error' AS ok FROM events),
      m AS (SELECT event_type, count(*) AS n, avg(g) AS grounded, avg(CASE WHEN g >= 70 THEN 100.0 WHEN g IS NOT NULL THEN 0.0 END) AS share, avg(CASE WHEN ok THEN 100.0 ELSE 0.0 END) AS success FROM p GROUP BY event_type)
      SELECT event_type, n, round(grounded, 6) AS grounded, round(share, 6) AS share, round(CASE WHEN grounded IS NOT NULL THEN (success + share) / 2 END, 6) AS end_to_end FROM m""",
}
