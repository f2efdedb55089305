"""Registered queries: quality, inventory, duplicates, collection filters, layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexquarry.functions.text import strip
from lexquarry.operators import classes, literals
from lexquarry.operators import quality as Q
from lexquarry.sources.tables import manifest_inventory, table


def _flags(spark, sf):
    """Flags of all documents as pages of their sources; the number of images follows from the id."""
    found = table(spark, sf, "documents").withColumn("f", Q.page_flags(F.col("text"), F.col("doc_id") % 3))
    return found.select(F.col("source").alias("document_id"), "doc_id", "f.*")


def page_quality_flags(spark, sf):
    return _flags(spark, sf).select("doc_id", "text_length", "n_words", "is_empty", "is_low_text", "is_scanned", F.array_join("reasons", ",").alias("reasons"))


def garbled_reasons(spark, sf):
    """Signs of garbling in documents into which, by id, replacement characters, control characters, marks or long tokens are put."""
    text = F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 7
    made = F.when(kind == 0, F.replace(text, F.lit("e"), F.lit("�"))).when(kind == 1, F.replace(text, F.lit(" "), F.lit("\x01"))).when(kind == 2, F.regexp_replace(text, "[a-z]", "#")).when(kind == 3, F.concat(F.repeat(F.lit("Qx7"), 30), F.lit(" "), text)).when(kind == 4, F.concat(F.repeat(F.lit("12"), 40), F.lit(" "), text)).when(kind == 5, F.concat(F.repeat(F.lit("abc-de_"), 20), F.lit("x "), text)).otherwise(text)
    return table(spark, sf, "documents").select("doc_id", F.array_join(Q.garbled(made), ",").alias("reasons"))


def doc_inventory_rollup(spark, sf):
    return Q.inventory(_flags(spark, sf))


def corpus_summary(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.agg(F.count("*").alias("n_docs"), F.countDistinct("source").alias("n_sources"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"), F.countDistinct(F.sha2("text", 256)).alias("n_texts"), F.count_if(strip(F.col("text")) == "").alias("n_empty"))


def category_rollup(spark, sf):
    """Documents and characters by language, and in total."""
    return table(spark, sf, "documents").rollup("lang").agg(F.grouping("lang").cast("long").alias("is_total"), F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("n_chars")).withColumn("lang", F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.coalesce("lang", F.lit("")))).select("lang", "is_total", "n_docs", "n_chars")


def size_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.size_text(F.octet_length(F.coalesce("text", F.lit("")))).alias("size_text"))


def exact_duplicates(spark, sf):
    return Q.exact_groups(table(spark, sf, "documents"))


def near_duplicates_jaccard(spark, sf):
    return Q.near_pairs(table(spark, sf, "documents"))


def repeated_paragraphs(spark, sf):
    return Q.repeated_lines(table(spark, sf, "documents"))


def entity_preservation(spark, sf):
    """Entities put into all documents, before and after white space is collapsed."""
    text = F.concat(F.coalesce("text", F.lit("")), F.format_string("\nAC-%d(1)  CVE-2024-%05d https://a.example/%d SHA-256 Table %d", F.col("doc_id") % 20, F.col("doc_id") % 99999, F.col("doc_id"), F.col("doc_id") % 9))
    each = table(spark, sf, "documents").select("source", Q.entities(text).alias("before"), Q.entities(F.regexp_replace(text, r"[ \t]+", " ")).alias("after"))
    return each.groupBy("source").agg(*[F.sum(f"{side}.{k}").alias(f"{side}_{k}") for side in ("before", "after") for k in Q.ENTITIES])


def embedding_validation(spark, sf):
    """Vectors against documents by id: missing on either side, dimensions, element type, totals."""
    return Q.embedding_report(table(spark, sf, "documents"), table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id"))


def near_duplicate_classes(spark, sf):
    """Classes that near duplicates make, with the number of links of each text."""
    return classes.classes(Q.near_pairs(table(spark, sf, "documents"))).select(F.col("node").alias("doc_id"), "class_id", "n_links")


def repeated_tables(spark, sf):
    """All documents as tables, a line a row, cut in two cells at the first blank; rows are turned round and written in capitals by turns."""
    k, lines = F.col("doc_id"), F.split(F.coalesce("text", F.lit("")), "\n")
    cells = F.transform(lines, lambda x: F.array(F.substring_index(x, " ", 1), F.substring(x, F.length(F.substring_index(x, " ", 1)) + 1, F.length(x))))
    rows = F.when(k % 2 == 0, F.reverse(cells)).when(k % 3 == 0, F.transform(cells, lambda r: F.transform(r, lambda c: F.concat(F.lit("  "), c, F.lit("\t"))))).otherwise(cells)
    made = table(spark, sf, "documents").select(k.alias("table_id"), F.array(F.when(k % 5 == 0, F.upper("lang")).otherwise(F.col("lang")), F.lit("Text")).alias("headers"), rows.alias("rows"))
    return classes.repeated_tables(made)


def literal_conservation(spark, sf):
    """In how many documents each benchmark text stands whole, runs of white space being one space."""
    return literals.counts(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def cleaning_inventory(spark, sf):
    """Documents of folders of 50, each with a manifest as JSON, of which every fifth is cut off and every seventh missing; a hundredth is the pilot."""
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(F.floor(k / 50).alias("folder"), k.cast("string").alias("document_id"), F.col("lang").alias("category"), F.floor(F.col("n_chars") / 2000).alias("n_pages"), F.col("n_chars").alias("size"), k)
    none = F.lit(None).cast("long")
    entry = F.struct(F.when(k % 4 != 0, F.col("category")).alias("category"), F.when(k % 2 == 0, F.concat(F.lit("in/"), "document_id")).alias("relative_path"), F.when(k % 3 == 0, F.col("n_pages")).otherwise(none).alias("expected_pages"), F.when(k % 3 == 1, F.col("n_pages") + 1).otherwise(none).alias("actual_pages"), F.col("size").alias("file_size_bytes"), F.when(k % 6 == 0, F.array("document_id", F.lit("x"))).alias("duplicate_of"))
    whole = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("document_id", entry.alias("e")))).alias("documents")))
    manifests = d.groupBy("folder").agg(whole.alias("value")).where("folder % 7 <> 3").withColumn("value", F.when(F.col("folder") % 5 == 2, F.left("value", F.lit(40))).otherwise(F.col("value")))
    found = manifest_inventory(manifests, d, d.where("doc_id % 100 = 0"))
    return found.select("folder", "document_id", "category", "relative_path", "expected_pages", "file_size_bytes", F.size("duplicate_of").cast("long").alias("n_duplicates"), "from_manifest")


def ocr_routing(spark, sf):
    routed = _flags(spark, sf).select(Q.ocr_route(F.col("text_length"), F.col("doc_id") % 3, F.col("doc_id") % 2 == 0).alias("outcome"))
    return routed.groupBy("outcome").agg(F.count("*").alias("n_pages"))


def preflight_flags(spark, sf):
    """Page geometry from all parts: rotation, sizes within 20 points of Letter or A4, and candidates for OCR."""
    k = F.col("p_partkey")
    flags = Q.preflight((k * 7 % 90 + 560).cast("double"), (k * 11 % 120 + 750).cast("double"), F.when(k % 10 == 0, 90).otherwise(0), F.col("p_size") * 3, k % 3)
    made = table(spark, sf, "part").select("p_brand", flags.alias("f"))
    return made.groupBy("p_brand").agg(F.count("*").alias("n_pages"), F.count_if("f.rotated").alias("n_rotated"), F.count_if(~F.col("f.standard")).alias("n_odd_size"), F.count_if("f.ocr_candidate").alias("n_ocr"))


def table_issues(spark, sf):
    """Tables made of all orders' lines: cells left empty or cut by quantity."""
    cell = F.when(F.col("l_quantity") > 12, F.lit("")).otherwise(F.col("l_returnflag"))
    row = F.when(F.col("l_quantity") > 45, F.array(cell)).otherwise(F.array(cell, F.when(F.col("l_quantity") > 20, "").otherwise(F.col("l_linestatus")), F.when(F.col("l_quantity") > 15, " ").otherwise("x")))
    made = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("rows"), F.count_if(F.col("l_quantity") > 5).alias("n"))
    headers = F.when(F.col("l_orderkey") % 5 == 0, F.array(F.lit(""), F.lit(" "), F.lit(""))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    return made.select("l_orderkey", F.array_join(Q.table_issues(headers, F.col("rows"), F.col("n"), F.lit(3)), ",").alias("issues"))


def _blocks(spark, sf):
    """Layout blocks made of all lines of orders: a page per order."""
    kind = F.when(F.col("l_linenumber") % 4 == 3, "list_item").otherwise("paragraph")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity", "l_tax")).alias("reading_order"), kind.alias("kind"), F.round(F.col("l_tax") * 1000, 1).alias("left"), (F.col("l_quantity") * 14).alias("top"), (F.col("l_quantity") * 14 + 12).alias("bottom"))


def reading_order_anomaly(spark, sf):
    return Q.order_anomalies(_blocks(spark, sf)).select("page", "block", F.round("jump", 1).alias("jump"))


def table_overlap_anti(spark, sf):
    """Blocks of all pages outside the page's table region (five points of tolerance)."""
    regions = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 40).cast("double").alias("t_left"), (F.col("o_orderkey") % 300).cast("double").alias("t_top"), (F.col("o_orderkey") % 300 + 250).cast("double").alias("t_bottom"))
    blocks = _blocks(spark, sf).withColumnRenamed("page", "p")
    inside = (F.col("p") == F.col("page")) & (F.col("left") >= F.col("t_left") - 5) & (F.col("top") >= F.col("t_top") - 5) & (F.col("bottom") <= F.col("t_bottom") + 5)
    return blocks.join(regions, inside, "left_anti").select(F.col("p").alias("page"), "reading_order", "kind")


def figure_filter(spark, sf):
    """Decisions over figure assets made of all parts."""
    k = F.col("p_partkey")
    decided = Q.figure_decision(F.when(k % 13 != 0, F.col("p_size") * 97), k * 37 % 700, k * 61 % 500, (k % 90).cast("double"), k % 23)
    return table(spark, sf, "part").select("p_partkey", decided.alias("d")).select("p_partkey", F.col("d.keep").alias("keep"), F.col("d.reason").alias("reason"))


def page_links(spark, sf):
    made = table(spark, sf, "pages").select("page_id", Q.links(F.coalesce("html", F.lit(""))).alias("a"), Q.first_with(F.coalesce("html", F.lit("")), "th").alias("first"))
    return made.select("page_id", F.size("a").cast("long").alias("n_links"), F.sha2(F.array_join(F.transform("a", lambda x: F.concat(x["href"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("links_sha256"), F.coalesce("first", F.lit("")).alias("first_th"))


def publication_index(spark, sf):
    return Q.publications(table(spark, sf, "pages"), "/t", "/(t[a-z]+)").select("url", "number", "title")


def _titled(spark, sf):
    """Titles of all pages; by page id a word or two of the lexicon comes first."""
    title = F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>(.*?)</title>", 1)
    terms = F.array(*[F.lit(k) for ks in Q.CATEGORIES.values() for k in ks], F.lit("Annual Report"), F.lit("none"))
    pick = lambda n: F.element_at(terms, (F.pmod(F.col("page_id") * n, F.size(terms)) + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", F.concat(F.initcap(pick(7)), F.lit(" and "), pick(13), F.lit(": "), title).alias("title"))


def classify_titles(spark, sf):
    return _titled(spark, sf).select("page_id", Q.category(F.col("title")).alias("category"), Q.relevant(F.col("title")).alias("relevant"))


def first_relevant(spark, sf):
    """The first hundred relevant pages; the limit is the report's own."""
    return _titled(spark, sf).where(Q.relevant(F.col("title"))).orderBy("page_id").limit(100).select("page_id")


_STRIP = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"
_BODY = _STRIP.format("text")
_GARBLED = r"""CASE WHEN length(b) < 50 THEN '' ELSE concat_ws(',',
  CASE WHEN (length(b) - length(replace(b, chr(65533), ''))) / length(b) > 0.05 THEN 'replacement' END,
  CASE WHEN length(regexp_replace(b, '[^\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) / length(b) > 0.03 THEN 'control' END,
  CASE WHEN length(replace(b, '.', '')) >= 50 AND length(regexp_replace(replace(b, '.', ''), '[^\p{L}\p{N}]', '', 'g')) / length(replace(b, '.', '')) < 0.25 THEN 'low_alnum' END,
  CASE WHEN len(list_filter(string_split_regex(b, '\s+'), lambda w: NOT contains(w, '://') AND NOT starts_with(w, 'www.') AND length(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')) > 60
    AND NOT CASE WHEN regexp_full_match(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g'), '\p{Nd}+') THEN true
      WHEN regexp_matches(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g'), '^0[xX].') THEN regexp_full_match(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g'), '0[xX][0-9a-fA-F]+')
      ELSE regexp_full_match(trim(w, '()[]{}''"<>,;`'), '[a-zA-Z0-9_\-./?=&%:]+') AND len(list_filter(string_split_regex(trim(w, '()[]{}''"<>,;`'), '[-_/.:?=&%]+'), lambda p: p <> '')) > 1
        AND len(list_filter(string_split_regex(trim(w, '()[]{}''"<>,;`'), '[-_/.:?=&%]+'), lambda p: length(p) > 35)) = 0 END)) > 0 THEN 'long_token' END) END"""
_FLAGS = f"""
  b AS (SELECT source AS document_id, doc_id, {_BODY} AS b FROM documents),
  f AS (SELECT document_id, doc_id, length(b) AS text_length, len(list_filter(string_split_regex(b, '\\s+'), lambda w: w <> '')) AS n_words, length(b) = 0 AS is_empty,
    length(b) > 0 AND length(b) < 100 AS is_low_text, length(b) < 50 AND doc_id % 3 >= 1 AS is_scanned, {_GARBLED} <> '' AS is_garbled FROM b)
"""
_LINKS = r"""
  a AS (SELECT page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(coalesce(html, ''), '(?is)<a\s[^>]*?href\s*=\s*["''][^"'']*["''][^>]*>.*?</a>'), 1) AS i FROM pages),
  l AS (SELECT page_id, url, i, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href, regexp_replace(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM a)
"""
_BLOCKS = "blocks AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_tax) AS reading_order, CASE WHEN l_linenumber % 4 = 3 THEN 'list_item' ELSE 'paragraph' END AS kind, round(l_tax * 1000, 1) AS \"left\", l_quantity * 14 AS top, l_quantity * 14 + 12 AS bottom FROM lineitem)"
_TERMS = [k for ks in Q.CATEGORIES.values() for k in ks] + ["Annual Report", "none"]
_LIST = "[" + ", ".join(f"'{k}'" for k in _TERMS) + "]"
_SCORES = ", ".join(f"({' + '.join(f"CAST(contains(low, '{k}') AS INT)" for k in ks)}) AS c{i}" for i, ks in enumerate(Q.CATEGORIES.values()))
_ALL = "greatest(" + ", ".join(f"c{i}" for i in range(len(Q.CATEGORIES))) + ")"
_TITLES = f"""
  t AS (SELECT page_id, ({_LIST})[(page_id * 7) % {len(_TERMS)} + 1] AS x, ({_LIST})[(page_id * 13) % {len(_TERMS)} + 1] AS y, regexp_extract(coalesce(html, ''), '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
  s AS (SELECT page_id, low, {_SCORES} FROM (SELECT page_id, lower(x || ' and ' || y || ': ' || title) AS low FROM t)),
  c AS (SELECT page_id, CASE WHEN {_ALL} = 0 THEN '{Q.OTHER_CATEGORY}' {' '.join(f"WHEN c{i} = {_ALL} THEN '{c}'" for i, c in enumerate(Q.CATEGORIES))} END AS category, {_ALL} > 0 AND NOT contains(low, 'annual report') AND NOT contains(low, 'fiscal year') AS relevant FROM s)
"""
_PUT = "coalesce(text, '') || chr(10) || 'AC-' || (doc_id % 20) || '(1)  CVE-2024-' || lpad(CAST(doc_id % 99999 AS VARCHAR), 5, '0') || ' https://a.example/' || doc_id || ' SHA-256 Table ' || (doc_id % 9)"
_COUNT = ", ".join(f"CAST(sum(len(regexp_extract_all({side}, '{p}'))) AS BIGINT) AS {name}_{k}" for name, side in (("before", "x"), ("after", "y")) for k, p in Q.ENTITIES.items())

QUERIES = {f.__name__: f for f in (page_quality_flags, garbled_reasons, doc_inventory_rollup, corpus_summary, category_rollup, size_labels, exact_duplicates, near_duplicates_jaccard, near_duplicate_classes, repeated_tables, repeated_paragraphs, entity_preservation, embedding_validation, literal_conservation, cleaning_inventory, ocr_routing, preflight_flags, table_issues, reading_order_anomaly, table_overlap_anti, figure_filter, page_links, publication_index, classify_titles, first_relevant)}

SQL = {
    "page_quality_flags": f"WITH {_FLAGS} SELECT doc_id, text_length, n_words, is_empty, is_low_text, is_scanned, concat_ws(',', CASE WHEN is_empty THEN 'empty' END, CASE WHEN is_low_text THEN 'low_text' END, CASE WHEN is_scanned THEN 'suspected_scan' END, CASE WHEN is_garbled THEN 'garbled' END) AS reasons FROM f",
    "garbled_reasons": f"""WITH m AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN replace(t, 'e', chr(65533)) WHEN 1 THEN replace(t, ' ', chr(1)) WHEN 2 THEN regexp_replace(t, '[a-z]', '#', 'g') WHEN 3 THEN repeat('Qx7', 30) || ' ' || t WHEN 4 THEN repeat('12', 40) || ' ' || t
      WHEN 5 THEN repeat('abc-de_', 20) || 'x ' || t ELSE t END AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)), b AS (SELECT doc_id, {_BODY} AS b FROM m) SELECT doc_id, {_GARBLED} AS reasons FROM b""",
    "doc_inventory_rollup": f"""WITH {_FLAGS}, g AS (SELECT document_id, count(*) AS n_pages, CAST(sum(text_length) AS BIGINT) AS text_length, CAST(sum(n_words) AS BIGINT) AS n_words, count(*) FILTER (is_empty) AS n_empty, count(*) FILTER (is_low_text) AS n_low_text, count(*) FILTER (is_scanned) AS n_scanned, count(*) FILTER (is_garbled) AS n_garbled FROM f GROUP BY document_id)
      SELECT *, concat_ws(',', CASE WHEN n_empty > 0 THEN 'empty_pages' END, CASE WHEN n_garbled > 0 THEN 'garbled_pages' END, CASE WHEN n_low_text > 0 THEN 'low_text_pages' END, CASE WHEN n_scanned > 0 THEN 'scanned_pages' END) AS reasons,
      CASE WHEN n_empty = n_pages THEN 'empty' WHEN n_scanned > 0 OR n_garbled > 0 THEN 'inspect' WHEN n_empty > 0 OR n_low_text > 0 THEN 'review' ELSE 'ready' END AS status FROM g""",
    "corpus_summary": f"SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS n_chars, count(DISTINCT text) AS n_texts, count(*) FILTER ({_BODY} = '') AS n_empty FROM documents",
    "category_rollup": "SELECT CASE WHEN grouping(lang) = 1 THEN 'TOTAL' ELSE coalesce(lang, '') END AS lang, CAST(grouping(lang) AS BIGINT) AS is_total, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY ROLLUP (lang)",
    "size_labels": "SELECT doc_id, CASE WHEN s < 1024 THEN s || ' B' WHEN s < 1048576 THEN printf('%.2f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.2f MB', s / 1048576.0) ELSE printf('%.2f GB', s / 1073741824.0) END AS size_text FROM (SELECT doc_id, strlen(coalesce(text, '')) AS s FROM documents)",
    "exact_duplicates": "SELECT sha256(text) AS sha256, count(*) AS n_docs, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "cleaning_inventory": """WITH d AS (SELECT doc_id // 50 AS folder, doc_id AS k, CAST(doc_id AS VARCHAR) AS document_id, lang, n_chars // 2000 AS p, n_chars, doc_id // 50 % 7 <> 3 AND doc_id // 50 % 5 <> 2 AS m FROM documents WHERE doc_id % 100 <> 0)
      SELECT folder, document_id, CASE WHEN m THEN coalesce(CASE WHEN k % 4 <> 0 THEN lang END, 'root') ELSE lang END AS category, CASE WHEN m AND k % 2 = 0 THEN 'in/' || k ELSE 'documents/' || k || '.pdf' END AS relative_path,
        CASE WHEN NOT m OR k % 3 = 0 THEN coalesce(p, 0) WHEN k % 3 = 1 THEN coalesce(p + 1, 0) ELSE 0 END AS expected_pages, CASE WHEN m THEN coalesce(n_chars, 0) ELSE n_chars END AS file_size_bytes, CAST(CASE WHEN m AND k % 6 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_duplicates, m AS from_manifest FROM d""",
    "near_duplicate_classes": r"""WITH RECURSIVE o AS (SELECT min(doc_id) AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
      s AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS g FROM o, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
      p AS (SELECT a.id AS u, b.id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
      l AS (SELECT u, v FROM p JOIN n AS x ON x.id = u JOIN n AS y ON y.id = v WHERE c * 100 >= 85 * (x.n + y.n - c)),
      e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l), r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
      SELECT r.u AS doc_id, least(r.u, min(r.v)) AS class_id, any_value(k) AS n_links FROM r JOIN (SELECT u, count(*) AS k FROM e GROUP BY u) AS c ON c.u = r.u GROUP BY r.u""",
    "repeated_tables": r"""WITH d AS (SELECT doc_id, lang, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
      r AS (SELECT doc_id, lang, list_sort(list_transform(ls, lambda x: lower(trim(regexp_replace(split_part(x, ' ', 1), '\s+', ' ', 'g'))) || chr(31) || lower(trim(regexp_replace(substring(x, length(split_part(x, ' ', 1)) + 1), '\s+', ' ', 'g'))))) AS rows FROM d),
      g AS (SELECT doc_id, count(*) OVER w AS n_tables, min(doc_id) OVER w AS class_id FROM r WINDOW w AS (PARTITION BY coalesce(lower(lang), ''), rows)) SELECT doc_id AS table_id, class_id, n_tables FROM g WHERE n_tables > 1""",
    "near_duplicates_jaccard": r"""WITH o AS (SELECT min(doc_id) AS id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL GROUP BY text),
      s AS (SELECT DISTINCT id, array_to_string(w[i : i + 4], ' ') AS g FROM o, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0), n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
      p AS (SELECT a.id AS u, b.id AS v, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
      SELECT u, v FROM p JOIN n AS x ON x.id = u JOIN n AS y ON y.id = v WHERE c * 100 >= 85 * (x.n + y.n - c)""",
    "repeated_paragraphs": f"WITH l AS (SELECT doc_id, {_STRIP.format('line')} AS line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)) SELECT line, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM l WHERE line <> '' GROUP BY line HAVING count(*) >= 3",
    "entity_preservation": f"WITH p AS (SELECT source, {_PUT} AS x FROM documents), q AS (SELECT source, x, regexp_replace(x, '[ \\t]+', ' ', 'g') AS y FROM p) SELECT source, {_COUNT} FROM q GROUP BY source",
    "embedding_validation": "SELECT count(*) AS n_vectors, count(DISTINCT len(embedding)) AS n_dims, max(len(embedding)) AS dim, lower(replace(any_value(typeof(embedding)), '[]', '')) AS element, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)) AS n_without_vector, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS n_without_document FROM embeddings",
    "literal_conservation": r"WITH l AS (SELECT item_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS x FROM benchmark), d AS (SELECT trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS y FROM documents) SELECT item_id, count(y) AS n_docs FROM l LEFT JOIN d ON contains(y, x) GROUP BY item_id",
    "ocr_routing": f"WITH {_FLAGS} SELECT CASE WHEN NOT (text_length < 50 AND doc_id % 3 >= 1) THEN 'not_needed' WHEN doc_id % 2 = 0 THEN 'routed' ELSE 'engine_unavailable' END AS outcome, count(*) AS n_pages FROM f GROUP BY 1",
    "preflight_flags": "WITH p AS (SELECT p_brand, p_partkey % 10 = 0 AS r, p_size * 3 < 50 AND p_partkey % 3 >= 1 AS o, p_partkey * 7 % 90 + 560 AS w, p_partkey * 11 % 120 + 750 AS h FROM part) SELECT p_brand, count(*) AS n_pages, count(*) FILTER (r) AS n_rotated, count(*) FILTER (NOT ((abs(w - 612) <= 20 AND abs(h - 792) <= 20) OR (abs(w - 595) <= 20 AND abs(h - 842) <= 20))) AS n_odd_size, count(*) FILTER (o) AS n_ocr FROM p GROUP BY p_brand",
    "table_issues": """WITH c AS (SELECT l_orderkey, l_quantity AS q, CASE WHEN l_quantity > 45 THEN 1 ELSE 3 END AS width, CASE WHEN l_quantity > 12 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 45 THEN 0 ELSE CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END + CASE WHEN l_quantity > 15 THEN 1 ELSE 0 END END AS blank FROM lineitem),
      g AS (SELECT l_orderkey, count(*) FILTER (q > 5) AS n, max(width <> 3) AS ragged, sum(blank) / sum(width) > 0.70 AS sparse FROM c GROUP BY l_orderkey)
      SELECT l_orderkey, CASE WHEN n = 0 THEN 'no_rows' ELSE concat_ws(',', CASE WHEN ragged THEN 'ragged' END, CASE WHEN sparse THEN 'sparse' END, CASE WHEN l_orderkey % 5 = 0 THEN 'no_headers' END) END AS issues FROM g""",
    "reading_order_anomaly": f"""WITH {_BLOCKS}, s AS (SELECT page, reading_order, "left", bottom, lag("left") OVER w AS bl, lag(top) OVER w AS bt, count(*) OVER (PARTITION BY page) AS n FROM blocks WHERE kind IN ('paragraph', 'heading') WINDOW w AS (PARTITION BY page ORDER BY reading_order))
      SELECT page, min(reading_order) AS block, round(arg_min(bt - bottom, reading_order), 1) AS jump FROM s WHERE n >= 3 AND abs("left" - bl) < 30 AND bottom < bt - 80 GROUP BY page""",
    "table_overlap_anti": f"""WITH {_BLOCKS} SELECT page, reading_order, kind FROM blocks WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = page AND "left" >= o_orderkey % 40 - 5 AND top >= o_orderkey % 300 - 5 AND bottom <= o_orderkey % 300 + 250 + 5)""",
    "figure_filter": """WITH f AS (SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN p_size * 97 END AS size, p_partkey * 37 % 700 AS w, p_partkey * 61 % 500 AS h, p_partkey % 90 AS l, p_partkey % 23 AS c FROM part),
      a AS (SELECT *, CASE WHEN least(w, h) > 0 THEN round(greatest(w, h) / least(w, h), 2) ELSE 999 END AS aspect FROM f),
      r AS (SELECT p_partkey, CASE WHEN size IS NULL THEN 'file_missing_or_unreadable' WHEN c <= 1 THEN 'solid_color_mask_zero_variance' WHEN l < 30 AND aspect > 8 THEN 'decorative_margin_bar' WHEN aspect > 8 THEN 'extreme_aspect_ratio_hairline'
        WHEN w < 40 OR h < 40 THEN CASE WHEN c >= 8 THEN 'preserved_small_security_symbol' ELSE 'sub_dimension_decorative_icon' END WHEN size < 1000 THEN CASE WHEN c >= 8 THEN 'preserved_small_rich_symbol' ELSE 'file_size_under_1000_bytes' END ELSE 'retained_genuine_visual_diagram' END AS reason FROM a)
      SELECT p_partkey, reason LIKE 'preserved%' OR reason LIKE 'retained%' AS keep, reason FROM r""",
    "page_links": f"WITH {_LINKS}, g AS (SELECT page_id, count(*) AS n, string_agg(href || chr(10) || text || chr(10), '' ORDER BY i) AS s, min(i) FILTER (contains(lower(href), 'th')) AS k FROM l GROUP BY page_id) SELECT p.page_id, coalesce(n, 0) AS n_links, sha256(coalesce(s, '')) AS links_sha256, coalesce(l.href, '') AS first_th FROM pages AS p LEFT JOIN g USING (page_id) LEFT JOIN l ON l.page_id = g.page_id AND l.i = g.k",
    "publication_index": f"""WITH {_LINKS}, f AS (SELECT CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(url, '^(https?://[^/]+)', 1) || href END AS url, regexp_extract(href, '/(t[a-z]+)', 1) AS number, text AS title, page_id, i FROM l WHERE contains(href, '/t') AND regexp_matches(href, '/(t[a-z]+)'))
      SELECT url, number, title FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id DESC, i DESC) AS k FROM f) WHERE k = 1""",
    "classify_titles": f"WITH {_TITLES} SELECT page_id, category, relevant FROM c",
    "first_relevant": f"WITH {_TITLES} SELECT page_id FROM c WHERE relevant ORDER BY page_id LIMIT 100",
}
