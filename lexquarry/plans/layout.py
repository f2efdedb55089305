"""Registered queries: layout blocks, assessments, exports, loaders and set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import strip
from lexquarry.operators import layout as L
from lexquarry.operators import quality as Q
from lexquarry.operators import state as B
from lexquarry.sources.tables import category_and_id, filled, pages, table


def _blocks(spark, sf) -> DataFrame:
    """The lines of all documents as blocks of a page each, placed by number; beside some lines stands a heading, an item or a blank block."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    kind = (F.col("doc_id") + F.col("i")) % 6
    beside = F.when(kind == 0, F.upper(F.replace(F.left("line", F.lit(40)), F.lit("ß"), F.lit("ss")))).when(kind == 1, F.concat(F.lit("3.1 "), F.left("line", F.lit(60)))).when(kind == 2, F.concat(F.lit("- "), "line")).when(kind == 3, "  ")
    left = (F.col("i") % 3 * 100).cast("double")
    both = F.explode(F.filter(F.array(F.struct((left - 50).alias("left"), beside.alias("text")), F.struct(left.alias("left"), F.col("line").alias("text"))), lambda x: x["text"].isNotNull()))
    return lines.select(F.col("doc_id").alias("page"), F.floor(F.col("i") / 3).cast("double").alias("top"), both.alias("b")).select("page", "b.left", "top", "b.text")


def block_order(spark, sf):
    return L.ordered_blocks(_blocks(spark, sf)).select("page", "block_id", F.col("reading_order").cast("long").alias("reading_order"), "kind", F.coalesce("level", F.lit(0)).cast("long").alias("level"), F.coalesce("section_title", F.lit("")).alias("section_title"))


def structured_text(spark, sf):
    return L.structured_text(L.ordered_blocks(_blocks(spark, sf))).select("page", F.sha2("text", 256).alias("text_sha256"))


def raw_text_export(spark, sf):
    return L.text_digests(L.with_dividers(pages(table(spark, sf, "documents"))))


def standalone_tables(spark, sf):
    """Tables of all documents, of which the text has one copy and a table may be listed twice."""
    md = F.concat(F.lit("| a |\n| "), (F.col("doc_id") % 10).cast("string"), F.lit(" |"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 2 == 0, md).otherwise(""))
    listed = F.when(F.col("doc_id") % 3 == 0, F.array(md, md)).otherwise(F.array(md))
    made = table(spark, sf, "documents").select("doc_id", L.standalone_tables(text, listed).alias("t"))
    return made.select("doc_id", F.size("t").cast("long").alias("n_standalone"))


def _assessed(spark, sf) -> DataFrame:
    found = pages(table(spark, sf, "documents"))
    raw = F.when(F.col("doc_id") % 17 == 0, "").when(F.col("doc_id") % 17 == 1, "A page with a few words.").otherwise(F.col("text"))
    structured = F.when(F.col("doc_id") % 17 == 0, " ").when(F.col("doc_id") % 17 == 2, F.translate("text", "aeiou ", "")).otherwise(F.col("text"))
    return found.select("document_id", "page_number", "doc_id", L.assessment(raw, structured, F.col("doc_id") % 3, F.when(F.col("doc_id") % 5 == 0, 2).otherwise(0), F.col("doc_id") % 11 == 3).alias("found"), F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("ocr_candidate"))).otherwise(F.array().cast("array<string>")).alias("existing"))


def page_assessment(spark, sf):
    return _assessed(spark, sf).select("doc_id", F.array_join("found", ",").alias("categories"))


def document_assessment(spark, sf):
    return L.document_assessment(_assessed(spark, sf))


def guarded_corrections(spark, sf):
    """A correction for the first page of each source, held back where the page is right already."""
    all_ = pages(table(spark, sf, "documents"))
    rules = all_.where("page_number = 1").select("document_id", "page_number", F.lit(" the ").alias("signature"), F.lit(" the ").alias("pattern"), F.lit(" THE ").alias("replacement"))
    return L.corrected(all_.drop("doc_id"), rules).groupBy("document_id").agg(F.count_if("applied").alias("n_applied"), F.sum(F.length("text")).cast("long").alias("n_chars"), F.sum(F.length("text") - F.length(F.replace(F.col("text"), F.lit(" THE "), F.lit("")))).cast("long").alias("changed"))


def conservation_audit(spark, sf):
    """Pages of all sources against a second version that lost some pages and texts."""
    before = pages(table(spark, sf, "documents")).drop("doc_id")
    source = F.substring("document_id", 4, 9).cast("int")
    after = before.where((source % 5 != 0) | (F.col("page_number") != 2)).where(source % 7 != 6).withColumn("text", F.when(source % 3 == 1, F.translate("text", "aeiou", "")).otherwise(F.col("text")))
    return L.conserved(before, after)


def chunk_aliases(spark, sf):
    """Ids and texts of all documents read through alias columns: the first that is neither null nor empty."""
    k = F.col("doc_id")
    made = table(spark, sf, "documents").select("doc_id", F.when(k % 3 == 0, k.cast("string")).otherwise("").alias("chunk_id"), F.when(k % 3 == 1, F.concat(F.lit("i"), k.cast("string"))).alias("id"), F.when(k % 6 == 2, F.concat(F.lit("c"), k.cast("string"))).alias("chunkId"))
    return made.select("doc_id", filled(F.col("chunk_id"), F.col("id"), F.col("chunkId")).alias("key")).where("key is not null")


def inventory_cache(spark, sf):
    """Pages of all documents: cached figures where there are some, computed ones else."""
    docs = table(spark, sf, "documents")
    cached = table(spark, sf, "labels").select("doc_id", (F.col("quality") * 1000).alias("cached")).groupBy("doc_id").agg(F.max("cached").alias("cached"))
    joined = docs.join(cached, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(F.col("cached"), F.length(strip(F.col("text")))).cast("long").alias("text_length"), F.col("cached").isNotNull().alias("from_cache"))


def pending_documents(spark, sf):
    """Documents that must run: those without a success in the log, or whose vector is missing."""
    docs = table(spark, sf, "documents").select("doc_id")
    status = F.when(F.col("event_type") == "purchase", "SUCCESS").otherwise("FAILED")
    log = B.latest(table(spark, sf, "events").withColumnRenamed("user_id", "doc_id"), "doc_id", status, F.col("ts"))
    return B.pending(docs, log, table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


def known_publications(spark, sf):
    """Pages whose number in the url is a document's id, with category and name from the url's path."""
    number = F.regexp_extract("url", "/([0-9]+)([?#]|$)", 1)
    category, name = category_and_id(F.regexp_replace("url", "[?#].*$", ""))
    found = table(spark, sf, "pages").select("page_id", F.try_to_number(number, F.lit("999999999")).cast("long").alias("doc_id"), category.alias("category"), name.alias("name"))
    return found.join(table(spark, sf, "documents").select("doc_id"), "doc_id", "left_semi").select("page_id", "category", "name")


_B = """
  l AS (SELECT doc_id AS page, i - 1 AS i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
  r AS (SELECT page, (i % 3) * 100 AS x, i // 3 AS y, line AS raw FROM l
    UNION ALL SELECT page, (i % 3) * 100 - 50, i // 3, CASE (page + i) % 6 WHEN 0 THEN upper(replace(left(line, 40), 'ß', 'ss')) WHEN 1 THEN '3.1 ' || left(line, 60) WHEN 2 THEN '- ' || line ELSE '  ' END FROM l WHERE (page + i) % 6 < 4),
  n AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY y, x, raw) AS reading_order, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS text FROM r),
  k AS (SELECT *, regexp_matches(text, '(?i)^(SECTION|[0-9]+(\\.[0-9]+)*|[A-Z]\\.[0-9]+)\\s+') AS sec, upper(text) = text AND lower(text) <> text AS caps FROM n WHERE text <> ''),
  b AS (SELECT page, 'p' || page || '_b' || reading_order AS block_id, reading_order, text, CASE WHEN (length(text) < 120 AND (caps OR sec)) OR (sec AND length(text) < 160) THEN 'heading' WHEN regexp_matches(text, '^([•\\-*]|[0-9]+\\.|\\([a-z0-9]+\\))\\s+') THEN 'list_item' ELSE 'paragraph' END AS kind,
    CASE WHEN (length(text) < 120 AND (caps OR sec)) OR (sec AND length(text) < 160) THEN CASE WHEN sec THEN 2 ELSE 3 END ELSE 0 END AS level FROM k)
"""
_P = "p AS (SELECT source AS document_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, coalesce(text, '') AS text FROM documents)"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_A = f"""{_P},
  v AS (SELECT document_id, doc_id, CASE doc_id % 17 WHEN 0 THEN '' WHEN 1 THEN 'A page with a few words.' ELSE text END AS raw, CASE doc_id % 17 WHEN 0 THEN ' ' WHEN 2 THEN translate(text, 'aeiou ', '') ELSE text END AS st FROM p),
  w AS (SELECT *, length({_STRIP.format("raw")}) AS a, length({_STRIP.format("st")}) AS s, replace({_STRIP.format("CASE WHEN raw <> '' THEN raw ELSE st END")}, '.', '') AS bare FROM v),
  c AS (SELECT document_id, doc_id, CASE WHEN a = 0 AND s = 0 THEN ['empty_page'] ELSE list_concat(list_concat(CASE WHEN a BETWEEN 1 AND 99 THEN ['low_text_page'] ELSE [] END, CASE WHEN a < 50 AND doc_id % 3 > 0 THEN ['ocr_candidate'] ELSE [] END),
    list_concat(list_concat(CASE WHEN length(bare) >= 50 AND length(regexp_replace(bare, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(bare) < 0.25 THEN ['garbled_text'] ELSE [] END, CASE WHEN doc_id % 5 = 0 THEN ['table_irregularity', 'table_irregularity'] ELSE [] END),
    list_concat(CASE WHEN doc_id % 11 = 3 THEN ['reading_order_warning'] ELSE [] END, CASE WHEN a > 200 AND s > 0 AND abs(a - s) / greatest(a, s) > 0.40 THEN ['representation_divergence'] ELSE [] END))) END AS found FROM w)
"""

QUERIES = {f.__name__: f for f in (block_order, structured_text, raw_text_export, standalone_tables, page_assessment, document_assessment, guarded_corrections, conservation_audit, chunk_aliases, inventory_cache, pending_documents, known_publications)}

SQL = {
    "block_order": f"WITH {_B} SELECT page, block_id, reading_order, kind, level, coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY page ORDER BY reading_order), '') AS section_title FROM b",
    "structured_text": f"WITH {_B} SELECT page, sha256(string_agg(CASE kind WHEN 'heading' THEN repeat('#', level) || ' ' || text WHEN 'list_item' THEN '- ' || text ELSE text END, chr(10) || chr(10) ORDER BY reading_order)) AS text_sha256 FROM b GROUP BY page",
    "raw_text_export": f"WITH {_P}, j AS (SELECT document_id, count(*) AS n_pages, string_agg('--- PAGE ' || page_number || ' ---' || chr(10) || text || chr(10), chr(10) ORDER BY page_number) AS t FROM p GROUP BY document_id) SELECT document_id, n_pages, length(t) AS n_chars, sha256(t) AS text_sha256 FROM j",
    "standalone_tables": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END - CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_standalone FROM documents",
    "page_assessment": f"WITH {_A} SELECT doc_id, coalesce(array_to_string(found, ','), '') AS categories FROM c",
    "document_assessment": f"""WITH {_A}, m AS (SELECT document_id, CASE WHEN doc_id % 4 = 0 THEN list_concat(['ocr_candidate'], list_filter(found, lambda x: x <> 'ocr_candidate')) ELSE found END AS f FROM c),
      g AS (SELECT document_id, count(*) AS n_pages, {", ".join(f"CAST(sum(len(list_filter(f, lambda x: x = '{k}'))) AS BIGINT) AS {n}" for k, n in (("empty_page", "n_empty"), ("ocr_candidate", "n_ocr"), ("garbled_text", "n_garbled"), ("table_irregularity", "n_table")))} FROM m GROUP BY document_id)
      SELECT *, concat_ws(',', CASE WHEN n_empty > 0 AND n_empty = n_pages THEN 'all_pages_empty' END, CASE WHEN n_ocr > 0 THEN 'document_has_ocr_candidates' END, CASE WHEN n_garbled > 0 THEN 'document_has_garbled_pages' END) AS warnings FROM g""",
    "guarded_corrections": f"WITH {_P}, a AS (SELECT document_id, page_number = 1 AND contains(text, ' the ') AND NOT contains(text, ' THE ') AS ok, text FROM p), b AS (SELECT document_id, ok, CASE WHEN ok THEN replace(text, ' the ', ' THE ') ELSE text END AS t FROM a) SELECT document_id, count(*) FILTER (ok) AS n_applied, CAST(sum(length(t)) AS BIGINT) AS n_chars, CAST(sum(length(t) - length(replace(t, ' THE ', ''))) AS BIGINT) AS changed FROM b GROUP BY document_id",
    "conservation_audit": f"""WITH {_P}, q AS (SELECT document_id, page_number, length(text) AS n, length(translate(text, 'aeiou', '')) AS bare, CAST(substring(document_id, 4) AS INT) AS s FROM p), b AS (SELECT document_id, count(*) AS n, sum(n) AS c FROM q GROUP BY document_id),
      a AS (SELECT document_id, count(*) AS n, max(page_number) - min(page_number) + 1 AS span, sum(CASE WHEN s % 3 = 1 THEN bare ELSE n END) AS c FROM q WHERE (s % 5 <> 0 OR page_number <> 2) AND s % 7 <> 6 GROUP BY document_id)
      SELECT document_id, CASE WHEN a.n IS NULL THEN 'missing' WHEN a.n <> b.n THEN 'page_count' WHEN span <> a.n THEN 'not_consecutive' WHEN a.c / greatest(b.c, 1) BETWEEN 0.85 AND 1.30 THEN '' ELSE 'text_ratio' END AS fault FROM b LEFT JOIN a USING (document_id)""",
    "chunk_aliases": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 THEN 'i' || doc_id ELSE 'c' || doc_id END AS key FROM documents WHERE doc_id % 3 < 2 OR doc_id % 6 = 2",
    "inventory_cache": f"SELECT d.doc_id, coalesce(max(quality) * 1000, any_value(length({_STRIP.format("coalesce(text, '')")}))) AS text_length, max(quality) IS NOT NULL AS from_cache FROM documents AS d LEFT JOIN labels USING (doc_id) GROUP BY d.doc_id",
    "pending_documents": """WITH l AS (SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type = 'purchase' DESC) AS k FROM events) WHERE k = 1)
      SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT user_id FROM l WHERE event_type = 'purchase' AND user_id IN (SELECT vec_id FROM embeddings))""",
    "known_publications": r"WITH f AS (SELECT page_id, TRY_CAST(regexp_extract(url, '/([0-9]+)([?#]|$)', 1) AS BIGINT) AS doc_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') AS p FROM pages) SELECT page_id, p[-2] AS category, regexp_replace(p[-1], '\.[^.]*$', '') AS name FROM f WHERE doc_id IN (SELECT doc_id FROM documents)",
}
