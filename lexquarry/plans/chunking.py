"""Registered queries: segments, sections, chunks, tables, figures, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.operators import chunking as K
from lexquarry.operators import state as B
from lexquarry.operators import tables as T
from lexquarry.sources.tables import table

#: Line kinds by (doc_id + line) % 11 that become headings or bare numbers.
MARKED = {0: "# ", 3: "## ", 5: "### ", 7: "2.1 Aa", 8: "APPENDIX A "}


def _pages(spark, sf) -> DataFrame:
    """Pages of all documents, one each: every line is a whole paragraph, and headings or numbers stand before lines of some kinds."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    kind = (F.col("doc_id").cast("int") % 11 + F.col("i")) % 11
    before = F.when(kind == 9, "13\n\n").otherwise("")
    for k, mark in MARKED.items():
        before = F.when(kind == k, F.concat(F.lit(mark), F.left("line", F.lit(30)), F.lit("\n\n"))).otherwise(before)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.concat(before, "line").alias("t")))), lambda x: x["t"]), "\n\n")
    return lines.groupBy("doc_id").agg(joined.alias("text")).select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text")


def segments_headings(spark, sf):
    found = K.segments(_pages(spark, sf))
    return found.select("document_id", F.col("seq").cast("long").alias("seq"), "is_heading", F.coalesce("level", F.lit(0)).cast("long").alias("level"), "section_heading", "section_path", F.length("text").cast("long").alias("n_chars"))


def section_groups(spark, sf):
    found = K.groups(K.segments(_pages(spark, sf)))
    return _grouped(found)


def _grouped(found: DataFrame) -> DataFrame:
    each = found.groupBy("document_id", "group_no", "group_heading").agg(F.count("*").alias("n_segments"), F.count_if("is_heading").alias("n_headings"), F.min("seq").cast("long").alias("first_seq"), F.min_by("section_path", "seq").alias("section_path"))
    return each.drop("group_no")


def _chunks(spark, sf) -> DataFrame:
    return K.chunks(K.groups(K.segments(_pages(spark, sf))))


def chunks_packed(spark, sf):
    return _chunks(spark, sf)


def chunk_audit(spark, sf):
    return K.audit(_chunks(spark, sf))


def token_stats(spark, sf):
    return K.token_stats(_chunks(spark, sf))


def token_estimates(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null")
    return docs.select("doc_id", K.tokens(F.col("text")).alias("n_tokens"), F.sha2(K.cut_to(F.col("text"), 100), 256).alias("cut_sha256"))


def _numbered(spark, sf) -> DataFrame:
    """All documents with legacy headings before some lines."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\n(T[a-z]+ [a-z]+)", "\n3.2 $1\n\n"), "\nO", "\nappendix B2 O")
    return table(spark, sf, "documents").select("doc_id", text.alias("text"))


def legacy_sections(spark, sf):
    found = K.legacy_sections(_numbered(spark, sf))
    return found.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "section", F.sha2("text", 256).alias("text_sha256"))


def legacy_chunks(spark, sf):
    return K.legacy_chunks(K.legacy_sections(_numbered(spark, sf)))


def fixed_slices(spark, sf):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")
    made = table(spark, sf, "documents").select("doc_id", K.slices(words, 100).alias("s"))
    return made.select("doc_id", F.size("s").cast("long").alias("n_slices"), F.sha2(F.array_join("s", "\n"), 256).alias("slices_sha256"))


def _grids(spark, sf) -> DataFrame:
    """A grid of each order's lines: a first row of names or numbers, an empty column, ragged rows."""
    cells = F.array(F.col("l_linenumber").cast("string"), F.lit(" "), F.concat(F.lit(" "), "l_returnflag", F.lit("  x ")), F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).otherwise(F.lit("")))
    row = F.when(F.col("l_quantity") > 45, F.slice(cells, 1, 3)).otherwise(cells)
    body = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", row.alias("row")))), lambda x: x["row"]).alias("body"))
    top = F.when(F.col("l_orderkey") % 3 == 0, F.array(F.lit("1"), F.lit(""), F.lit("22"), F.lit(""))).otherwise(F.array(F.lit("No"), F.lit(""), F.lit("Flag"), F.lit("")))
    return body.select("l_orderkey", F.concat(F.array(top), "body").alias("grid"))


def table_markdown(spark, sf):
    made = _grids(spark, sf).select("l_orderkey", T.pruned(F.col("grid")).alias("g")).select("l_orderkey", T.header_of(F.col("g")).alias("h"))
    return made.select("l_orderkey", F.col("h.headerless").alias("headerless"), F.size("h.headers").cast("long").alias("n_cols"), F.sha2(T.markdown(F.col("h.headers"), F.col("h.rows")), 256).alias("markdown_sha256"))


def _tables(spark, sf) -> DataFrame:
    """Tables made of all orders: a customer is a document, its orders are tables on pages that mostly follow each other."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    seq = F.row_number().over(w)
    headers = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("Item No"), F.lit("Price"))).when(F.col("o_orderkey") % 7 == 0, F.array(F.lit("Item"), F.lit("Price"), F.lit("Total"))).otherwise(F.array(F.lit("item_no"), F.lit("price")))
    caption = F.when(F.col("o_orderkey") % 4 == 0, "Orders (continued)").when(F.col("o_orderkey") % 4 == 1, "Orders").otherwise("")
    return table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("document_id"), seq.alias("seq"), (seq + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)).alias("page_number"), F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("table_id"), headers.alias("headers"), caption.alias("caption"), (F.col("o_orderkey") % 300).cast("double").alias("top"))


def table_continuation(spark, sf):
    return T.continuations(_tables(spark, sf)).select("document_id", F.col("seq").cast("long").alias("seq"), "continues", "parent_id", F.coalesce("continuation_of", F.lit("")).alias("continuation_of"), "full_caption")


def table_chunks(spark, sf):
    """Row chunks of one table per supplier: its lines, with a long remark now and then."""
    row = F.array(F.col("l_orderkey").cast("string"), F.col("l_returnflag"), F.when(F.col("l_partkey") % 50 == 0, F.repeat(F.lit("Checked by hand; kept. "), 120)).otherwise("ok"))
    made = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", row.alias("r")))), lambda x: x["r"]).alias("rows"))
    tables = made.select(F.col("l_suppkey").cast("string").alias("document_id"), F.lit(1).alias("seq"), F.lit("lines").alias("table_id"), F.array(F.lit("order"), F.lit("flag"), F.lit("remark")).alias("headers"), "rows", F.lit("Lines").alias("caption"), F.lit("[Page 1]").alias("label"))
    return T.table_chunks(tables)


def figure_captions(spark, sf):
    """Captions and contexts of a figure on each document, whose text is given a caption line and sentences about it."""
    n = (F.col("doc_id") % 9 + 1).cast("string")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n**Figure "), n, F.lit(": the flow** As Figure "), n, F.lit(" shows, it flows. The diagram helps. Another figure follows."))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\nFig. "), n, F.lit(". Steps taken\nIt illustrates them. No more."))).otherwise(""))
    raw = F.when(F.col("doc_id") % 4 == 0, "**Own caption**").when(F.col("doc_id") % 4 == 1, "Embedded image (xref 7)").otherwise("")
    made = table(spark, sf, "documents").select("doc_id", text.alias("text"), T.caption(raw, text, F.lit(1)).alias("c"))
    return made.select("doc_id", F.col("c.caption").alias("caption"), F.col("c.linked").alias("linked"), F.sha2(T.figure_context(F.col("c.caption"), F.col("text")), 256).alias("context_sha256"))


def batch_slices(spark, sf):
    return B.batches(table(spark, sf, "documents").select("doc_id"), [16, 16, 16, 15, 17]).groupBy("batch_no").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def checkpoint_status(spark, sf):
    """Statuses of users from all events as a status log, rolled up over all customers."""
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "purchase", "SUCCESS").when(F.col("event_type") == "click", "IN_PROGRESS").otherwise("PENDING")
    last = B.latest(table(spark, sf, "events"), "user_id", status, F.col("ts"))
    return B.rollup(last, table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), "user_id")


_H = r"""
  lines AS (SELECT doc_id, i - 1 AS i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS t(i)),
  made AS (SELECT doc_id, 2 * i AS i, CASE (doc_id % 11 + i) % 11 WHEN 0 THEN '# ' || left(line, 30) WHEN 3 THEN '## ' || left(line, 30) WHEN 5 THEN '### ' || left(line, 30) WHEN 7 THEN '2.1 Aa' || left(line, 30) WHEN 8 THEN 'APPENDIX A ' || left(line, 30) WHEN 9 THEN '13' END AS raw FROM lines WHERE (doc_id % 11 + i) % 11 IN (0, 3, 5, 7, 8, 9)
    UNION ALL SELECT doc_id, 2 * i + 1, line FROM lines),
  s0 AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text FROM made),
  s1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '^#+', ''), '^\s+|\s+$', '', 'g'), '^[*_ \t]+|[*_ \t]+$', '', 'g') AS clean, regexp_replace(regexp_replace(text, '^#+', ''), '^\s+|\s+$', '', 'g') AS content FROM s0 WHERE text <> '' AND NOT regexp_full_match(regexp_replace(regexp_replace(text, '^#+', ''), '^[*_ \t]+|[*_ \t]+$', '', 'g'), '[0-9]{1,4}')),
  s2 AS (SELECT *, regexp_extract(text, '^([0-9]+(?:\.[0-9]+)+|[0-9]+\.)\s+([A-Z][^\n]+)$', 1) AS number, regexp_replace(regexp_extract(text, '^([0-9]+(?:\.[0-9]+)+|[0-9]+\.)\s+([A-Z][^\n]+)$', 2), '\s+$', '') AS title FROM s1),
  s3 AS (SELECT *, CASE WHEN length(text) > 200 THEN NULL WHEN starts_with(text, '#') THEN CASE WHEN clean = '' OR regexp_full_match(clean, '[0-9]+') THEN NULL ELSE least(4, length(regexp_extract(text, '^(#+)', 1))) END
    WHEN regexp_matches(text, '(?i)^APPENDIX\s+[A-Z0-9]+') OR regexp_matches(text, '(?i)^CHAPTER\s+([A-Z]+|[0-9]+)') THEN 1 WHEN regexp_full_match(text, '[A-Z]{2}-[0-9]+(\([0-9]+\))?\s+[A-Z\s]+') THEN 2
    WHEN number <> '' AND length(title) <= 120 AND NOT regexp_matches(title, '[.;:,]$') AND coalesce(TRY_CAST(regexp_extract(number, '^([0-9]+)\.$', 1) AS BIGINT), 0) <= 25 THEN least(3, greatest(1, length(number) - length(replace(number, '.', '')))) END AS level FROM s2),
  s4 AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) AS seq, CASE WHEN level IS NOT NULL AND starts_with(text, '#') THEN content ELSE text END AS text, level IS NOT NULL AS is_heading, level FROM s3),
  s5 AS (SELECT *, sum(CASE WHEN level = 1 THEN 1 ELSE 0 END) OVER w AS island, coalesce(last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER w, 'Introduction') AS section_heading FROM s4 WINDOW w AS (PARTITION BY document_id ORDER BY seq)),
  s6 AS (SELECT *, last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS one, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER w AS two, max(CASE WHEN level = 2 THEN seq END) OVER w AS two_at, last_value(CASE WHEN level >= 3 THEN text END IGNORE NULLS) OVER w AS deep, max(CASE WHEN level >= 3 THEN seq END) OVER w AS deep_at,
    first_value(CASE WHEN level >= 3 THEN text END IGNORE NULLS) OVER w AS first, min(CASE WHEN level >= 3 THEN seq END) OVER w AS first_at FROM s5 WINDOW w AS (PARTITION BY document_id, island ORDER BY seq)),
  segs AS (SELECT document_id, seq, text, is_heading, level, section_heading, concat_ws(' > ', coalesce(one, 'Introduction'), coalesce(two, first), CASE WHEN (two_at IS NOT NULL AND deep_at > two_at) OR (two_at IS NULL AND deep_at > first_at) THEN deep END) AS section_path FROM s6)
"""
_G = _H + """,
  g1 AS (SELECT *, CASE WHEN is_heading AND NOT lag(is_heading, 1, true) OVER (PARTITION BY document_id ORDER BY seq) THEN 1 ELSE 0 END AS opens FROM segs),
  g2 AS (SELECT *, sum(opens) OVER (PARTITION BY document_id ORDER BY seq) AS g FROM g1),
  g3 AS (SELECT *, count(*) FILTER (NOT is_heading) OVER (PARTITION BY document_id, g) AS body, max(g) OVER (PARTITION BY document_id) AS top_g, min(g) OVER (PARTITION BY document_id) AS low_g FROM g2),
  g4 AS (SELECT *, CASE WHEN g = top_g AND body = 0 AND g > low_g THEN g - 1 ELSE g END AS n FROM g3),
  g5 AS (SELECT *, count(*) FILTER (NOT is_heading) OVER (PARTITION BY document_id, n ORDER BY seq) AS before FROM g4)
"""

_L = r"""
  d AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n(T[a-z]+ [a-z]+)', chr(10) || '3.2 \1' || chr(10) || chr(10), 'g'), '\nO', chr(10) || 'appendix B2 O', 'g'), chr(10)) AS ls FROM documents),
  ln AS (SELECT doc_id, i, ls[i] AS line, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS s FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
  h AS (SELECT *, CASE WHEN regexp_matches(s, '^([0-9]+(?:\.[0-9]+){0,4})\s+(.+)$') AND length(s) <= 150 THEN regexp_extract(s, '^([0-9]+(?:\.[0-9]+){0,4})\s+(.+)$', 1) || ' ' || regexp_extract(s, '^([0-9]+(?:\.[0-9]+){0,4})\s+(.+)$', 2) WHEN regexp_matches(s, '(?i)^APPENDIX\s+[A-Z0-9]+') THEN s END AS h FROM ln),
  m AS (SELECT *, count(h) OVER w AS island, coalesce(last_value(h IGNORE NULLS) OVER w, 'Introduction') AS section FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  g AS (SELECT doc_id, island, section, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS text FROM m WHERE h IS NULL GROUP BY doc_id, island, section),
  sections AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS section_no, section, text FROM g)
"""

QUERIES = {f.__name__: f for f in (segments_headings, section_groups, chunks_packed, chunk_audit, token_stats, token_estimates, legacy_sections, legacy_chunks, fixed_slices, table_markdown, table_continuation, table_chunks, figure_captions, batch_slices, checkpoint_status)}


def _count(x: str) -> str:
    return f"(CASE WHEN length({x}) = 0 THEN 0 ELSE greatest(1, length({x}) // 4) END)"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _split(marked: str) -> str:
    """The stripped parts between marks that aren't empty."""
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {_trim('s')}), lambda s: s <> '')"


def _sentences(x: str) -> str:
    return _split(rf"""regexp_replace({x}, '([.!?])\s+([A-Z0-9("\[''])', '\1' || chr(1) || '\2', 'g')""")


def _tail(x: str) -> str:
    """The last sentences that together have at most OVERLAP_TOKENS tokens."""
    fits = f"list_sum(list_transform(ss[i:], lambda s: {_count('s')})) <= {K.OVERLAP_TOKENS}"
    kept = f"list_transform([list_min(list_filter(range(1, len(ss) + 1), lambda i: {fits}))], lambda k: CASE WHEN k IS NULL THEN '' ELSE array_to_string(ss[k:], ' ') || chr(10) || chr(10) END)[1]"
    return f"list_transform([{_sentences(x)}], lambda ss: {kept})[1]"


_STRIPPED = _trim("prefix || carry || {}")
#: Paragraphs beyond a chunk are cut into sentences, clauses and words, which runs of one kind put together again; then a fold over a section's pieces.
_C = (
    _G
    + rf""",
  sec AS (SELECT document_id, n, coalesce(string_agg('### ' || text || chr(10) || chr(10), '' ORDER BY seq) FILTER (is_heading), '') AS prefix, arg_min(section_path, seq) AS section_path, coalesce(arg_max(text, seq) FILTER (is_heading AND before = 0), arg_min(section_heading, seq)) AS section_heading FROM g5 GROUP BY document_id, n),
  para AS (SELECT g5.document_id, g5.n, seq, text, prefix, greatest({K.LEAST_BODY}, {K.CHUNK_TOKENS} - {_count("prefix")}) AS room FROM g5 JOIN sec ON sec.document_id = g5.document_id AND sec.n = g5.n WHERE NOT is_heading),
  l0 AS (SELECT * EXCLUDE (ss), ss[a] AS x FROM (SELECT * EXCLUDE (text, prefix), {_sentences("text")} AS ss FROM para WHERE {_count("text")} > room), unnest(range(1, len(ss) + 1)) AS t(a)),
  l1 AS (SELECT * EXCLUDE (ss), ss[b] AS x FROM (SELECT * EXCLUDE (x), {_split(r"regexp_replace(x, '([;:])\s+', '' || chr(1), 'g')")} AS ss FROM l0 WHERE {_count("x")} > room), unnest(range(1, len(ss) + 1)) AS t(b)),
  l2 AS (SELECT * EXCLUDE (ss), ss[c] AS x FROM (SELECT * EXCLUDE (x), {_split(r"regexp_replace(x, '\s+', chr(1), 'g')")} AS ss FROM l1 WHERE {_count("x")} > room), unnest(range(1, len(ss) + 1)) AS t(c)),
  leaf AS (SELECT document_id, n, seq, room, a, 0 AS b, 0 AS c, '' AS parent, x FROM l0 WHERE {_count("x")} <= room UNION ALL SELECT document_id, n, seq, room, a, b, 0, '1.' || a, x FROM l1 WHERE {_count("x")} <= room UNION ALL SELECT document_id, n, seq, room, a, b, c, '2.' || a || '.' || b, x FROM l2),
  opened AS (SELECT *, CASE WHEN parent IS DISTINCT FROM lag(parent) OVER (PARTITION BY document_id, seq ORDER BY a, b, c) THEN 1 ELSE 0 END AS opens FROM leaf),
  placed AS (SELECT *, sum(opens) OVER (PARTITION BY document_id, seq ORDER BY a, b, c) AS run FROM opened),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id, seq, run ORDER BY a, b, c) AS k FROM placed),
  greedy AS (
    SELECT document_id, seq, run, k, length(x) AS size, 1 AS part FROM ranked WHERE k = 1
    UNION ALL
    SELECT r.document_id, r.seq, r.run, r.k, CASE WHEN (size + 1 + length(x)) // 4 > room THEN length(x) ELSE size + 1 + length(x) END, CASE WHEN (size + 1 + length(x)) // 4 > room THEN part + 1 ELSE part END
    FROM greedy JOIN ranked AS r ON r.document_id = greedy.document_id AND r.seq = greedy.seq AND r.run = greedy.run AND r.k = greedy.k + 1),
  parts AS (SELECT r.document_id, n, r.seq, r.run, part, string_agg(x, ' ' ORDER BY r.k) AS x FROM ranked AS r JOIN greedy AS g ON r.document_id = g.document_id AND r.seq = g.seq AND r.run = g.run AND r.k = g.k GROUP BY ALL),
  unit AS (SELECT document_id, n, seq, 0 AS run, 0 AS part, text AS x, false AS alone FROM para WHERE {_count("text")} <= room UNION ALL SELECT document_id, n, seq, run, part, x, true FROM parts),
  units AS (SELECT *, row_number() OVER (PARTITION BY document_id, n ORDER BY seq, run, part) AS u FROM unit),
  fold AS (
    SELECT document_id, n, prefix, CAST(0 AS BIGINT) AS u, '' AS held, '' AS carry, CAST([] AS VARCHAR[]) AS made FROM sec
    UNION ALL
    SELECT document_id, n, prefix, u, CASE WHEN alone THEN '' WHEN full_ THEN x ELSE joined END, CASE WHEN alone THEN {_tail("x")} WHEN full_ THEN {_tail("held")} ELSE carry END,
      list_concat(CASE WHEN held <> '' AND (alone OR full_) THEN list_append(made, closed) ELSE made END, CASE WHEN alone THEN [{_trim("prefix || x")}] ELSE [] END)
    FROM (SELECT *, {_count(_STRIPPED.format("joined"))} > {K.CHUNK_TOKENS} AND held <> '' AS full_, CASE WHEN {_count(_STRIPPED.format("held"))} <= {K.CHUNK_TOKENS} THEN {_STRIPPED.format("held")} ELSE {_trim("prefix || held")} END AS closed
      FROM (SELECT f.*  EXCLUDE (u), y.u, x, alone, CASE WHEN held = '' THEN x ELSE held || chr(10) || chr(10) || x END AS joined FROM fold AS f JOIN units AS y ON y.document_id = f.document_id AND y.n = f.n AND y.u = f.u + 1) AS z) AS q),
  last_ AS (SELECT document_id, n, arg_max(prefix, u) AS prefix, arg_max(held, u) AS held, arg_max(carry, u) AS carry, arg_max(made, u) AS made, max(u) AS u FROM fold GROUP BY document_id, n),
  whole AS (SELECT document_id, n, CASE WHEN u = 0 THEN [{_trim("prefix")}] WHEN held <> '' THEN list_append(made, CASE WHEN {_count(_STRIPPED.format("held"))} <= {K.CHUNK_TOKENS} THEN {_STRIPPED.format("held")} ELSE {_trim("prefix || held")} END) ELSE made END AS made FROM last_),
  packed AS (SELECT document_id, n, k, made[k] AS text FROM whole, unnest(range(1, len(made) + 1)) AS t(k)),
  chunks AS (SELECT document_id || '_txt_' || lpad(CAST(row_number() OVER (PARTITION BY document_id ORDER BY n, k) AS VARCHAR), 5, '0') AS chunk_id, document_id, 1 AS page_start, 1 AS page_end, '[' || document_id || ' Page 1]' AS citation_label, section_path, section_heading, text, CAST({_count("text")} AS INT) AS token_count, CAST(length(text) AS INT) AS char_count, CASE WHEN text <> '' THEN sha256(text) ELSE '' END AS content_hash FROM packed JOIN sec USING (document_id, n))
"""
)

SQL = {
    "table_chunks": f"""WITH RECURSIVE o AS (SELECT l_suppkey AS d, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag, l_partkey % 50 = 0 DESC) - 1 AS i, CAST(l_orderkey AS VARCHAR) AS a, l_returnflag AS f, l_partkey % 50 = 0 AS remarked FROM lineitem),
      u AS (SELECT list_concat(['Checked by hand;'], list_transform(range(119), lambda k: 'kept. Checked by hand;'), ['kept.']) AS units),
      r AS (SELECT d, i, '| ' || a || ' | ' || f || ' | ' AS lead, remarked, '| ' || a || ' | ' || f || ' | ' || CASE WHEN remarked THEN array_to_string(units, ' ') ELSE 'ok' END || ' |' AS line FROM o, u),
      z AS (SELECT *, length('### Table: Lines (Part 99 of 99)' || chr(10) || 'Source: [Page 1]' || chr(10) || chr(10) || '| order | flag | remark |' || chr(10) || '| :--- | :--- | :--- |') AS base, count(*) OVER (PARTITION BY d) AS n, sum(length(line) + 1) OVER (PARTITION BY d) AS body FROM r),
      y AS (SELECT *, (base - length(' (Part 99 of 99)') + body) // 4 <= {K.TABLE_TOKENS} AS fits, (base + 1 + length(line)) // 4 > {K.TABLE_TOKENS} AS big FROM z),
      fold AS (
        SELECT d, CAST(-1 AS BIGINT) AS i, 0 AS run, CAST(0 AS BIGINT) AS size FROM y WHERE i = 0
        UNION ALL
        SELECT y.d, y.i, CASE WHEN fits THEN 1 WHEN big OR size = 0 OR (base + size + 1 + length(line)) // 4 > {K.TABLE_TOKENS} THEN run + 1 ELSE run END, CASE WHEN big THEN 0 WHEN size = 0 OR (base + size + 1 + length(line)) // 4 > {K.TABLE_TOKENS} THEN 1 + length(line) ELSE size + 1 + length(line) END
        FROM fold JOIN y ON y.d = fold.d AND y.i = fold.i + 1),
      x AS (SELECT y.d, y.i, run, fits, h, CASE WHEN big THEN lead || array_to_string(CASE WHEN h = 1 THEN units[1:61] ELSE units[62:] END, ' ') || ' |' ELSE line END AS line FROM y JOIN fold ON fold.d = y.d AND fold.i = y.i, u, (SELECT unnest([1, 2]) AS h) WHERE big OR h = 1),
      g AS (SELECT d, run, h, bool_and(fits) AS fits, min(i) AS first_, max(i) + 1 AS end_, string_agg(line, chr(10) ORDER BY i) AS body FROM x GROUP BY d, run, h),
      k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY run, h) AS k, count(*) OVER (PARTITION BY d) AS m FROM g),
      t AS (SELECT *, '### Table: Lines' || CASE WHEN fits THEN '' ELSE ' (Part ' || k || ' of ' || m || ')' END || chr(10) || 'Source: [Page 1]' || chr(10) || chr(10) || '| order | flag | remark |' || chr(10) || '| :--- | :--- | :--- |' || chr(10) || body AS text FROM k)
      SELECT d || '_tbl_00001_p' || lpad(CAST(k AS VARCHAR), CAST(greatest(2, length(CAST(k AS VARCHAR))) AS INT), '0') AS chunk_id, 'lines' AS table_id, CAST(k AS INT) AS part_index, CAST(m AS INT) AS total_parts, CAST(first_ AS INT) AS row_start, CAST(end_ AS INT) AS row_end, text, CAST(greatest(1, length(text) // 4) AS INT) AS token_count FROM t""",
    "chunks_packed": f"WITH RECURSIVE {_C} SELECT * FROM chunks",
    "chunk_audit": rf"WITH RECURSIVE {_C} SELECT document_id, count(*) AS n_chunks, count(*) FILTER ({_trim('text')} = '') AS n_empty, count(*) FILTER (token_count = 0) AS n_no_tokens, count(*) FILTER (page_start > page_end) AS n_inverted, count(*) FILTER (token_count > {K.CHUNK_TOKENS}) AS n_oversize FROM chunks GROUP BY document_id",
    "token_stats": f"WITH RECURSIVE {_C} SELECT count(*) AS n_chunks, min(token_count) AS least, round_even(median(token_count), 1) AS median, round_even(avg(token_count), 1) AS mean, max(token_count) AS most FROM chunks",
    "segments_headings": f"WITH {_H} SELECT document_id, seq, is_heading, coalesce(level, 0) AS level, section_heading, section_path, length(text) AS n_chars FROM segs",
    "section_groups": f"WITH {_G} SELECT document_id, coalesce(arg_max(text, seq) FILTER (is_heading AND before = 0), arg_min(section_heading, seq)) AS group_heading, count(*) AS n_segments, count(*) FILTER (is_heading) AS n_headings, min(seq) AS first_seq, arg_min(section_path, seq) AS section_path FROM g5 GROUP BY document_id, n",
    "token_estimates": "SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, length(text) // 4) END AS n_tokens, sha256(CASE WHEN length(text) <= 400 THEN text WHEN NOT contains(left(text, 400), ' ') THEN left(text, 400) ELSE left(text, 400 - strpos(reverse(left(text, 400)), ' ')) END) AS cut_sha256 FROM documents WHERE text IS NOT NULL",
    "legacy_sections": f"WITH {_L} SELECT doc_id, section_no, section, sha256(text) AS text_sha256 FROM sections",
    "legacy_chunks": rf"""WITH RECURSIVE {_L},
      p AS (SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY k) AS i, x FROM (
        SELECT doc_id, section_no, k, regexp_replace(ps[k], '^\s+|\s+$', '', 'g') AS x FROM (SELECT *, string_split_regex(text, '\n\s*\n') AS ps FROM sections), unnest(range(1, len(ps) + 1)) AS t(k)) WHERE x <> ''),
      st AS (
        SELECT doc_id, section_no, CAST(0 AS BIGINT) AS i, '' AS held, CAST([] AS VARCHAR[]) AS made FROM sections
        UNION ALL
        SELECT doc_id, section_no, i, CASE WHEN fits THEN joined WHEN length(x) // 4 > 600 THEN '' ELSE x END,
          CASE WHEN fits THEN made ELSE list_concat(list_concat(made, CASE WHEN held <> '' THEN [held] ELSE [] END), CASE WHEN length(x) // 4 > 600 THEN list_transform(range(0, length(x), 2400), lambda k: substring(x, k + 1, 2400)) ELSE [] END) END
        FROM (SELECT p.doc_id, p.section_no, p.i, held, made, x, CASE WHEN held = '' THEN x ELSE held || chr(10) || chr(10) || x END AS joined, length(CASE WHEN held = '' THEN x ELSE held || chr(10) || chr(10) || x END) // 4 <= 600 AS fits
          FROM st JOIN p ON p.doc_id = st.doc_id AND p.section_no = st.section_no AND p.i = st.i + 1)
      ),
      l AS (SELECT doc_id, section_no, arg_max(CASE WHEN held <> '' THEN list_append(made, held) ELSE made END, i) AS made FROM st GROUP BY doc_id, section_no),
      u AS (SELECT doc_id, section_no, k, made[k] AS text FROM l, unnest(range(1, len(made) + 1)) AS t(k))
      SELECT doc_id || '_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section_no, k) AS VARCHAR), 5, '0') AS chunk_id, doc_id, section, u.text, CAST(greatest(1, length(u.text) // 4) AS INT) AS token_count FROM u JOIN sections USING (doc_id, section_no)""",
    "fixed_slices": r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS w FROM documents), s AS (SELECT doc_id, list_transform(range(1, len(w) + 1, 100), lambda i: array_to_string(w[i : i + 99], ' ')) AS s FROM w)
      SELECT doc_id, len(s) AS n_slices, sha256(coalesce(array_to_string(s, chr(10)), '')) AS slices_sha256 FROM s""",
    "table_markdown": r"""WITH r AS (SELECT l_orderkey, CASE WHEN l_quantity > 25 AND l_quantity <= 45 THEN l_linestatus ELSE '' END AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_returnflag, l_linestatus) AS i, CAST(l_linenumber AS VARCHAR) AS a, l_returnflag || ' x' AS c FROM lineitem),
      g AS (SELECT l_orderkey, max(d) <> '' AS four, l_orderkey % 3 = 0 AS bare FROM r GROUP BY l_orderkey),
      t AS (SELECT l_orderkey, four, bare, string_agg('| ' || a || ' | ' || c || CASE WHEN four THEN ' | ' || d ELSE '' END || ' |', chr(10) ORDER BY i) AS body FROM r JOIN g USING (l_orderkey) GROUP BY l_orderkey, four, bare)
      SELECT l_orderkey, bare AS headerless, CASE WHEN four THEN 3 ELSE 2 END AS n_cols, sha256(CASE WHEN bare THEN '| Column_1 | Column_2' || CASE WHEN four THEN ' | Column_3' ELSE '' END ELSE '| No | Flag' || CASE WHEN four THEN ' | Column_3' ELSE '' END END || ' |' || chr(10) || '| --- | ---' || CASE WHEN four THEN ' | ---' ELSE '' END || ' |' || chr(10)
        || CASE WHEN bare THEN '| 1 | 22' || CASE WHEN four THEN ' | ' ELSE '' END || ' |' || chr(10) ELSE '' END || body) AS markdown_sha256 FROM t""",
    "table_continuation": """WITH o AS (SELECT o_custkey, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS seq FROM orders),
      t AS (SELECT CAST(o_custkey AS VARCHAR) AS document_id, seq, seq + CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END AS page, 't' || k AS table_id, CASE WHEN k % 5 = 0 THEN 2 WHEN k % 7 = 0 THEN 3 ELSE 2 END AS width, CASE k % 4 WHEN 0 THEN 'Orders (continued)' WHEN 1 THEN 'Orders' ELSE '' END AS caption FROM o),
      f AS (SELECT *, coalesce(page = lag(page) OVER w + 1 AND width = lag(width) OVER w, false) AS continues, lag(table_id) OVER w AS bi FROM t WINDOW w AS (PARTITION BY document_id ORDER BY seq)),
      c AS (SELECT *, sum(CASE WHEN continues THEN 0 ELSE 1 END) OVER (PARTITION BY document_id ORDER BY seq) AS chain, CASE WHEN NOT continues THEN coalesce(nullif(caption, ''), 'Table on Page ' || page) WHEN caption = 'Orders' THEN caption END AS named FROM f)
      SELECT document_id, seq, continues, first_value(table_id) OVER w AS parent_id, CASE WHEN continues THEN bi ELSE '' END AS continuation_of, last_value(named IGNORE NULLS) OVER w AS full_caption FROM c WINDOW w AS (PARTITION BY document_id, chain ORDER BY seq)""",
    "figure_captions": r"""WITH m AS (SELECT doc_id, CAST(doc_id % 9 + 1 AS VARCHAR) AS n, coalesce(text, '') AS t FROM documents),
      p AS (SELECT doc_id, t || CASE doc_id % 3 WHEN 0 THEN chr(10) || '**Figure ' || n || ': the flow** As Figure ' || n || ' shows, it flows. The diagram helps. Another figure follows.' WHEN 1 THEN chr(10) || 'Fig. ' || n || '. Steps taken' || chr(10) || 'It illustrates them. No more.' ELSE '' END AS text,
        CASE doc_id % 4 WHEN 0 THEN '**Own caption**' WHEN 1 THEN 'Embedded image (xref 7)' ELSE '' END AS raw FROM m),
      f AS (SELECT *, coalesce(nullif(regexp_extract(text, '(?i)(\*\*(?:Fig\.|Figure)\s*[0-9]+[.:][^*\n]+\*\*)', 1), ''), nullif(regexp_extract(text, '(?i)(?:^|\n)((?:Fig\.|Figure)\s*[0-9]+[.:][^\n]+)', 1), ''), nullif(regexp_extract(text, '(?i)(\*\*(?:Diagram|Chart)\s*[0-9]+[.:][^*\n]+\*\*)', 1), '')) AS found FROM p),
      c AS (SELECT doc_id, text, (raw = '' OR contains(raw, 'xref')) AND found IS NOT NULL AS linked, CASE WHEN (raw = '' OR contains(raw, 'xref')) AND found IS NOT NULL THEN trim(replace(found, '**', '')) WHEN raw <> '' THEN replace(raw, '**', '') ELSE 'Figure on Page 1' END AS caption FROM f),
      s AS (SELECT doc_id, caption, linked, regexp_extract(caption, '(?i)(?:Fig\.|Figure)\s*([0-9]+)', 1) AS n, list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS ss FROM c)
      SELECT doc_id, caption, linked, sha256(coalesce(array_to_string(list_filter(ss, lambda x: x <> '' AND NOT contains(x, caption) AND ((n <> '' AND (contains(x, 'Figure ' || n) OR contains(x, 'Fig. ' || n))) OR contains(lower(x), 'figure') OR contains(lower(x), 'diagram') OR contains(lower(x), 'illustrates')))[1:2], ' '), '')) AS context_sha256 FROM s""",
    "batch_slices": "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents) SELECT CASE WHEN p < 16 THEN 1 WHEN p < 32 THEN 2 WHEN p < 48 THEN 3 WHEN p < 63 THEN 4 WHEN p < 80 THEN 5 ELSE 6 + (p - 80) // 17 END AS batch_no, count(*) AS n_docs, min(doc_id) AS first_id, max(doc_id) AS last_id FROM o GROUP BY 1",
    "checkpoint_status": """WITH e AS (SELECT user_id, ts, CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'purchase' THEN 'SUCCESS' WHEN 'click' THEN 'IN_PROGRESS' ELSE 'PENDING' END AS status FROM events),
      l AS (SELECT user_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, status DESC) AS k FROM e) WHERE k = 1)
      SELECT CASE WHEN status IS NULL OR status = 'IN_PROGRESS' THEN 'PENDING' ELSE status END AS status, count(*) AS n FROM (SELECT DISTINCT c_custkey AS user_id FROM customer) FULL JOIN l USING (user_id) GROUP BY 1""",
}
