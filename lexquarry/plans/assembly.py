"""Registered queries: assembly of chunks and documents, loaders, issue records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators import assembly as A
from lexquarry.operators import chunking as K
from lexquarry.operators import cleaning as C
from lexquarry.operators import context as X
from lexquarry.operators import quality as Q
from lexquarry.plans.cleaning import _cut, _dirty, _dirty_sql, _hyphens, _normal
from lexquarry.sources.tables import embedded, pages, qrels, structured, table


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source", "lang", "n_chars")


def warning_lists(spark, sf):
    """Warnings of all documents, some given twice, some without a description, some for lost characters in the text."""
    k = F.col("doc_id")
    one = lambda kind, desc: F.struct(kind.alias("type"), desc.alias("desc"))
    none = F.lit(None).cast("string")
    given = F.when(k % 3 == 0, F.array(one(F.lit("B"), F.col("source")), one(F.lit("A"), F.col("lang")), one(F.lit("B"), F.col("source")))).when(k % 3 == 1, F.array(one(none, F.lit("x")), one(F.lit("C"), none)))
    text = F.when(k % 2 == 0, F.replace(F.col("text"), F.lit("e"), F.lit("\ufffd"))).otherwise(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.array_join(A.warnings(given, text, k), "|").alias("warnings"))


def category_folders(spark, sf):
    made = _docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 4 == 0, "documents").when(F.col("doc_id") % 4 == 1, F.col("lang")).alias("category"), F.when(F.col("doc_id") % 5 == 0, "root").otherwise(F.col("source")).alias("folder"))
    return made.select("doc_id", A.root_category(F.col("category"), F.col("folder")).alias("category"))


def stripped_tables(spark, sf):
    """All documents with a table's Markdown put into them once or twice, and taken out again."""
    md = F.concat(F.lit("| a |\n| --- |\n| "), F.col("doc_id").cast("string"), F.lit(" |"))
    text = F.concat("text", F.lit("\n\n"), md, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n\nbetween\n\n"), md)).otherwise(""), F.lit("\n\nend"))
    return _docs(spark, sf).select("doc_id", F.sha2(A.without_tables(text, F.array(md, F.lit(" "), F.lit("| none |"))), 256).alias("text_sha256"))


def spliced_tables(spark, sf):
    """Two tables in all texts: without boxes, in boxes in order and out of it, and with a box that goes beyond the text."""
    n = F.length("text")
    first, second = F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int")
    box = lambda a, z: F.struct(a.alias("start"), z.alias("end"))
    tail, k = box(second, n), F.col("doc_id") % 4
    boxes = F.when(k == 1, F.array(box(first, F.least(first + 7, second)), tail)).when(k == 2, F.array(tail, box(first, second))).when(k == 3, F.array(box(first, n + 1000), tail))
    return _docs(spark, sf).select("doc_id", F.sha2(A.spliced(F.col("text"), F.array(F.lit("| x |"), F.lit("| y |")), boxes), 256).alias("text_sha256"))


def parser_fallback(spark, sf):
    """Outputs of three parsers over all documents, of which one fails and one returns blanks now and then."""
    k = F.col("doc_id")
    out = lambda name, text: F.struct(F.lit(name).alias("parser"), text.alias("text"))
    chain = A.first_parsed(out("primary", F.when(k % 2 == 0, F.col("text"))), out("hybrid", F.when(k % 3 == 0, F.lit("  ")).otherwise(F.upper(F.replace(F.col("text"), F.lit("ß"), F.lit("ss"))))), out("block", F.concat(F.lit("> "), F.col("text"))))
    made = _docs(spark, sf).select("doc_id", chain.alias("p"))
    return made.select("doc_id", F.col("p.parser").alias("parser"), F.sha2(F.col("p.text"), 256).alias("text_sha256"))


def document_markdown(spark, sf):
    """Pages of documents of seven rows each as Markdown, some with a table of their own."""
    made = _docs(spark, sf).select(F.floor(F.col("doc_id") / 7).cast("string").alias("document_id"), (F.col("doc_id") % 7 + 1).cast("int").alias("page_number"), "text", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("| t |"))).otherwise(F.array().cast("array<string>")).alias("standalone"))
    return A.document_markdown(made).select("document_id", F.length("markdown").cast("long").alias("n_chars"), F.sha2("markdown", 256).alias("markdown_sha256"))


def _figures(spark, sf) -> DataFrame:
    k = F.col("doc_id")
    text = F.concat("text", F.when(k % 3 == 0, F.lit("\nFigure 2: the flow\nThe diagram helps.")).otherwise(""))
    made = _docs(spark, sf).select(k.cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.lit(1).alias("seq"), F.lit("f1").alias("figure_id"), F.concat(F.lit("img/"), k.cast("string"), F.lit(".png")).alias("image_path"), F.when(k % 4 == 0, "Own caption").when(k % 4 == 1, "Embedded image (xref 7)").otherwise("").alias("caption"), text.alias("page_text"))
    assets = _docs(spark, sf).where("doc_id % 5 <> 0").select(F.concat(F.lit("img/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))
    return A.figure_chunks(made, assets)


def figure_chunks(spark, sf):
    return _figures(spark, sf).select("chunk_id", "section_heading", "caption_linked", "missing", "token_count", F.sha2("text", 256).alias("text_sha256"))


def chunk_union(spark, sf):
    """Text, table and figure chunks of all documents together, with known duplicates, counted by kind."""
    docs = _docs(spark, sf)
    text = docs.select(F.format_string("%s_txt_%05d", F.col("doc_id").cast("string"), F.lit(1)).alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), "text", K.tokens(F.col("text")).alias("token_count"))
    tables = docs.where("doc_id % 2 = 0").select(F.format_string("%s_tbl_%05d_p%02d", F.col("doc_id").cast("string"), F.lit(1), F.lit(1)).alias("chunk_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("t1").alias("table_id"), F.lit("| a |").alias("text"), F.lit(1).cast("long").alias("token_count"))
    twins = docs.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("document_id"), (F.col("doc_id") + 1).cast("string").alias("duplicate_of"))
    both = A.all_chunks(text, tables, _figures(spark, sf), twins)
    return both.groupBy("content_type").agg(F.count("*").alias("n_chunks"), F.countDistinct("document_id").alias("n_documents"), F.sum("token_count").alias("n_tokens"), F.count("duplicate_of").alias("n_twins"), F.count("table_id").alias("n_tables"), F.count_if("missing").alias("n_missing"))


def issue_records(spark, sf):
    """Issues of all pages by kind, from cleaning pages whose texts were given marks to set right."""
    made = pages(table(spark, sf, "documents")).withColumn("text", F.concat(F.lit("Running title "), "document_id", F.lit("\n"), _dirty(F.col("text"))))
    return A.issue_records(C.cleaned(made)).groupBy("document_id", "issue_type", "severity").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n"))


def storage_estimates(spark, sf):
    return _docs(spark, sf).groupBy("source").agg(A.storage_estimate(F.count("*")).alias("n_bytes"))


def structured_documents(spark, sf):
    """Documents of five rows each written as JSON and read back page by page; the text stands in every page."""
    page = F.struct((F.col("doc_id") % 5 + 1).cast("int").alias("page_number"), F.col("text").alias("cleaned_text"), F.array(F.struct(F.lit("t").alias("table_id"), F.array("source").alias("headers"))).alias("tables"))
    made = _docs(spark, sf).groupBy(F.floor(F.col("doc_id") / 5).cast("string").alias("document_id")).agg(F.max("lang").alias("category"), F.array_sort(F.collect_list(page)).alias("pages"))
    read = structured(made.select(F.when(F.col("document_id") == "3", "{broken").otherwise(F.to_json(F.struct("document_id", "category", "pages"))).alias("value")))
    return read.select("document_id", "category", F.col("page_number").cast("long").alias("page_number"), F.sha2("cleaned_text", 256).alias("text_sha256"), F.get(F.col("tables")[0]["headers"], F.lit(0)).alias("header"))


def relevance_judgements(spark, sf):
    """Ground truth of all benchmark items in both shapes: a list, or an object with a list."""
    k = F.col("item_id")
    ids = F.array(k.cast("string"), (k + 1).cast("string"), k.cast("string"))
    made = table(spark, sf, "benchmark").select(F.when(k % 2 == 0, F.to_json(F.create_map(k.cast("string"), ids))).otherwise(F.to_json(F.create_map(k.cast("string"), F.struct(ids.alias("relevant_chunks"))))).alias("value"))
    return qrels(made)


def embedding_scan(spark, sf):
    """Vectors with the metadata of their document, by id; those that lack either are passed over."""
    meta = _docs(spark, sf).where("doc_id % 3 <> 1").select(F.col("doc_id").alias("vec_id"), "source", "lang")
    found = embedded(table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("dims")), meta, ["vec_id"])
    return found.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("dims").alias("n_values"), F.min("vec_id").alias("first_id"))


def artifact_audit(spark, sf):
    """The first expectation that artifacts made of all documents, three pages each, do not meet; some are made to fail by id."""
    k = F.col("doc_id")
    pages_ = F.when(k % 7 == 1, F.array(F.lit(1), F.lit(2))).when(k % 7 == 2, F.array(F.lit(1), F.lit(2), F.lit(4))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    raw = F.concat(F.lit("--- PAGE 1 ---\n"), F.translate("text", "-", "_"), F.lit("\n--- PAGE 2 ---\n"), F.when(k % 7 == 3, "").otherwise("--- PAGE 3 ---\n"), F.lit("end"))
    cited = F.transform(pages_, lambda p: F.concat(F.lit("[d Page "), F.when(k % 7 == 4, p + 1).otherwise(p).cast("string"), F.lit("]")))
    structured_ = F.when(k % 7 == 6, F.translate("text", "aeiounrst ", "")).otherwise(raw)
    checks = A.artifact_checks(F.lit(3), pages_, F.array(F.lit("d"), F.when(k % 11 == 5, "e").otherwise("d")), raw, structured_, cited, F.when(k % 7 == 5, 2).otherwise(0), F.when(k % 13 == 6, 1).otherwise(0))
    return _docs(spark, sf).select("doc_id", A.first_fault(checks).alias("fault"))


def resolved_ids(spark, sf):
    """Ids of all documents' chunks from three columns, of which the first is null for most."""
    k = F.col("doc_id")
    return _docs(spark, sf).select("doc_id", A.resolved_id(F.when(k % 3 == 0, F.concat(F.lit("c"), k.cast("string"))), F.when(k % 3 == 1, F.concat(F.lit("i"), k.cast("string"))), k.cast("string")).alias("id"))


def judge_scores(spark, sf):
    """Scores read from a judge's replies made of all events: JSON with words around it, of which one score is not there."""
    reply = F.concat(F.lit("Here you are:\n"), "props", F.lit("\nThat is all."))
    made = table(spark, sf, "events").select("event_type", X.judged(reply, ["k", "missing"]).alias("j"))
    return made.groupBy("event_type").agg(F.count("j.k").alias("n_scored"), F.round(F.avg("j.k"), 6).alias("mean"), F.count("j.missing").alias("n_missing_scored"))


def duplicate_peers(spark, sf):
    return Q.duplicate_peers(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (warning_lists, category_folders, stripped_tables, spliced_tables, parser_fallback, document_markdown, figure_chunks, chunk_union, issue_records, storage_estimates, structured_documents, relevance_judgements, embedding_scan, artifact_audit, resolved_ids, judge_scores, duplicate_peers)}

_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, source, lang, n_chars FROM documents)"
_F = r"""
  m AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'Figure 2: the flow' || chr(10) || 'The diagram helps.' ELSE '' END AS text, CASE doc_id % 4 WHEN 0 THEN 'Own caption' WHEN 1 THEN 'Embedded image (xref 7)' ELSE '' END AS raw FROM d),
  f AS (SELECT *, coalesce(nullif(regexp_extract(text, '(?i)(\*\*(?:Fig\.|Figure)\s*[0-9]+[.:][^*\n]+\*\*)', 1), ''), nullif(regexp_extract(text, '(?i)(?:^|\n)((?:Fig\.|Figure)\s*[0-9]+[.:][^\n]+)', 1), ''), nullif(regexp_extract(text, '(?i)(\*\*(?:Diagram|Chart)\s*[0-9]+[.:][^*\n]+\*\*)', 1), '')) AS found FROM m),
  c AS (SELECT doc_id, text, (raw = '' OR contains(raw, 'xref')) AND found IS NOT NULL AS linked, CASE WHEN (raw = '' OR contains(raw, 'xref')) AND found IS NOT NULL THEN trim(replace(found, '**', '')) WHEN raw <> '' THEN replace(raw, '**', '') ELSE 'Figure on Page 1' END AS caption FROM f),
  s AS (SELECT doc_id, caption, linked, regexp_extract(caption, '(?i)(?:Fig\.|Figure)\s*([0-9]+)', 1) AS n, list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ss FROM c),
  x AS (SELECT doc_id, caption, linked, coalesce(array_to_string(list_filter(ss, lambda x: x <> '' AND NOT contains(x, caption) AND ((n <> '' AND (contains(x, 'Figure ' || n) OR contains(x, 'Fig. ' || n))) OR contains(lower(x), 'figure') OR contains(lower(x), 'diagram') OR contains(lower(x), 'illustrates')))[1:2], ' '), '') AS said FROM s),
  figs AS (SELECT doc_id, doc_id || '_fig_00001' AS chunk_id, caption AS section_heading, linked AS caption_linked, doc_id % 5 = 0 AS missing, '### Figure: ' || caption || chr(10) || 'Source: [' || doc_id || ' Page 1]' || chr(10) || 'Asset: img/' || doc_id || '.png' || CASE WHEN said <> '' THEN chr(10) || 'Context: ' || said ELSE '' END AS text FROM x)
"""
_MD = "'| a |' || chr(10) || '| --- |' || chr(10) || '| ' || doc_id || ' |'"

SQL = {
    "warning_lists": f"""WITH {_D}, w AS (SELECT doc_id, list_concat(CASE doc_id % 3 WHEN 0 THEN [concat_ws(': ', 'B', source), concat_ws(': ', 'A', lang)] WHEN 1 THEN ['ENCODING_WARNING: x', 'C'] ELSE [] END, CASE WHEN (doc_id % 2 = 0 AND contains(text, 'e')) OR contains(text, chr(65533)) THEN ['Contains \\ufffd on page ' || doc_id] ELSE [] END) AS w FROM d)
      SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(w)), '|'), '') AS warnings FROM w""",
    "category_folders": f"WITH {_D} SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 THEN 'root' WHEN doc_id % 4 = 1 THEN coalesce(lang, source) ELSE source END AS category FROM d",
    "stripped_tables": f"WITH {_D} SELECT doc_id, sha256(replace(text || chr(10) || chr(10) || {_MD} || CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || 'between' || chr(10) || chr(10) || {_MD} ELSE '' END || chr(10) || chr(10) || 'end', {_MD}, '')) AS text_sha256 FROM d",
    "spliced_tables": f"""WITH {_D}, n AS (SELECT doc_id, text, doc_id % 4 AS k, length(text) AS n, length(text) // 3 AS a, 2 * length(text) // 3 AS b, chr(10) || chr(10) AS g FROM d),
      t AS (SELECT *, CASE WHEN b < n THEN left(text, b) || g || '| y |' || g ELSE text END AS one, CASE k WHEN 1 THEN least(a + 7, b) WHEN 2 THEN b ELSE n + 1000 END AS e FROM n)
      SELECT doc_id, sha256(CASE WHEN k = 0 THEN text || g || '| x |' || g || '| y |' WHEN a < e AND e <= length(one) THEN left(one, a) || g || '| x |' || g || substring(one, e + 1) ELSE one END) AS text_sha256 FROM t""",
    "parser_fallback": f"""WITH {_D}, p AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AS full_ FROM d)
      SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND full_ THEN 'primary' WHEN doc_id % 3 <> 0 AND full_ THEN 'hybrid' ELSE 'block' END AS parser, sha256(CASE WHEN doc_id % 2 = 0 AND full_ THEN text WHEN doc_id % 3 <> 0 AND full_ THEN upper(replace(text, 'ß', 'ss')) ELSE '> ' || text END) AS text_sha256 FROM p""",
    "document_markdown": f"""WITH {_D}, p AS (SELECT doc_id // 7 AS d, doc_id % 7 + 1 AS n, concat_ws(chr(10) || chr(10), '## Page ' || (doc_id % 7 + 1), nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ''), CASE WHEN doc_id % 2 = 0 THEN '| t |' END) AS b FROM d),
      m AS (SELECT CAST(d AS VARCHAR) AS document_id, '# ' || d || chr(10) || chr(10) || string_agg(b, chr(10) || chr(10) ORDER BY n) AS t FROM p GROUP BY d) SELECT document_id, length(t) AS n_chars, sha256(t) AS markdown_sha256 FROM m""",
    "figure_chunks": f"WITH {_D}, {_F} SELECT chunk_id, section_heading, caption_linked, missing, greatest(1, length(text) // 4) AS token_count, sha256(text) AS text_sha256 FROM figs",
    "chunk_union": f"""WITH {_D}, {_F}, u AS (SELECT 'text' AS content_type, doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS t, NULL AS tb, false AS missing FROM d UNION ALL SELECT 'table', doc_id, 1, 't1', false FROM d WHERE doc_id % 2 = 0 UNION ALL SELECT 'figure', doc_id, greatest(1, length(text) // 4), NULL, missing FROM figs)
      SELECT content_type, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents, CAST(sum(t) AS BIGINT) AS n_tokens, count(*) FILTER (doc_id % 10 = 0) AS n_twins, count(tb) AS n_tables, count(*) FILTER (missing) AS n_missing FROM u GROUP BY content_type""",
    "issue_records": f"""WITH raw AS (SELECT source AS document_id, doc_id, coalesce(text, '') AS text FROM documents), made AS (SELECT document_id, doc_id, 'Running title ' || document_id || chr(10) || {_dirty_sql("text")} AS text FROM raw), {_cut("made")}, {_hyphens("cut")}, {_normal("joined", "two")},
      i AS (SELECT document_id, 'RUNNING_HEADER_REMOVAL' AS issue_type, 'INFO' AS severity, CAST(header IS NOT NULL AS INT) AS n FROM normal UNION ALL SELECT document_id, 'FOOTER_REMOVAL', 'INFO', CAST(footer IS NOT NULL AS INT) FROM normal UNION ALL SELECT document_id, 'HYPHEN_REPAIR', 'INFO', n_joined FROM normal
        UNION ALL SELECT document_id, 'AMBIGUOUS_PRESERVED', 'WARNING', n_kept + n_warnings FROM normal UNION ALL SELECT document_id, 'ENCODING_TRANSFORM', 'INFO', n_transforms FROM normal)
      SELECT document_id, issue_type, severity, count(*) AS n_pages, CAST(sum(n) AS BIGINT) AS n FROM i WHERE n > 0 GROUP BY document_id, issue_type, severity""",
    "storage_estimates": "SELECT source, CAST(round(count(*) * 43296.7::DOUBLE) AS BIGINT) AS n_bytes FROM documents GROUP BY source",
    "structured_documents": f"WITH {_D}, g AS (SELECT doc_id // 5 AS d, max(lang) AS category FROM d GROUP BY 1) SELECT CAST(d AS VARCHAR) AS document_id, category, doc_id % 5 + 1 AS page_number, sha256(text) AS text_sha256, source AS header FROM d JOIN g ON d = doc_id // 5 WHERE d <> 3",
    "relevance_judgements": "SELECT DISTINCT CAST(item_id AS VARCHAR) AS query_id, CAST(item_id + k AS VARCHAR) AS chunk_id FROM benchmark, (SELECT unnest([0, 1]) AS k)",
    "embedding_scan": f"WITH {_D} SELECT source, lang, count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS n_values, min(vec_id) AS first_id FROM embeddings JOIN d ON doc_id = vec_id WHERE doc_id % 3 <> 1 GROUP BY source, lang",
    "artifact_audit": f"""WITH {_D}, r AS (SELECT doc_id, '--- PAGE 1 ---' || chr(10) || translate(text, '-', '_') || chr(10) || '--- PAGE 2 ---' || chr(10) || CASE WHEN doc_id % 7 = 3 THEN '' ELSE '--- PAGE 3 ---' || chr(10) END || 'end' AS raw, text FROM d)
      SELECT doc_id, CASE WHEN doc_id % 7 = 1 THEN 'page_count' WHEN doc_id % 7 = 2 THEN 'not_consecutive' WHEN doc_id % 11 = 5 THEN 'document_ids' WHEN doc_id % 7 = 3 THEN 'dividers' WHEN doc_id % 7 = 4 THEN 'citations' WHEN doc_id % 7 = 5 THEN 'figure_files' WHEN doc_id % 13 = 6 THEN 'table_rows'
        WHEN doc_id % 7 = 6 AND NOT length(translate(text, 'aeiounrst ', '')) / length(raw) BETWEEN 0.85 AND 1.30 THEN 'text_ratio' ELSE '' END AS fault FROM r""",
    "resolved_ids": "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'c' || doc_id WHEN 1 THEN 'i' || doc_id ELSE CAST(doc_id AS VARCHAR) END AS id FROM documents",
    "judge_scores": "WITH j AS (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) SELECT event_type, count(k) AS n_scored, round(avg(k), 6) AS mean, CAST(0 AS BIGINT) AS n_missing_scored FROM j GROUP BY event_type",
    "duplicate_peers": """WITH g AS (SELECT doc_id, count(*) OVER w AS n, min(doc_id) OVER w AS low, lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS nxt FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY text))
      SELECT doc_id, n - 1 AS n_peers, CASE WHEN doc_id <> low THEN low ELSE nxt END AS first_peer, coalesce(nxt, low) AS next_peer FROM g WHERE n > 1""",
}
