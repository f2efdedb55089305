"""Registered queries: cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexquarry.operators import cleaning as C
from lexquarry.sources.tables import pages, table

LICENSES = [("APACHE", "licensed under the apache"), ("COPYRIGHT", "copyright|all rights reserved"), ("WARRANTY", "without warrant(y|ies)"), ("PERMISSION", "permission is hereby granted")]


def _paged(spark, sf) -> DataFrame:
    """The page model with a running header, and a page number or a textual footer by turns."""
    found = pages(table(spark, sf, "documents"))
    foot = F.when(F.col("page_number") % 2 == 0, F.concat(F.lit("End of "), "document_id")).otherwise(F.concat(F.lit("Page "), F.col("page_number").cast("string")))
    return found.withColumn("text", F.concat(F.lit("Running title "), "document_id", F.lit("\n"), "text", F.lit("\n"), foot))


def _hyphened(text):
    """A text in which words are broken before 'tion' and 'ing', and some compounds are spaced."""
    broken = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z]{3})tion", "$1-\ntion"), "([a-z]{3})ing ", "$1-  ing ")
    return F.replace(F.replace(broken, F.lit(" that "), F.lit(" zero- trust ")), F.lit(" with "), F.lit(" infor- mation "))


def _dirty(text):
    """Text with typographic marks, hard spaces, and lost characters as bullets, in formulas and inside words."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\nT", "\n� T"), (" and ", "�"), (" or ", " = � "), (". ", ".\u00a0"), (" the ", " “the” "), (" de ", " — de "), (" en ", "  \n\n\n\nen ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def header_footer_discovery(spark, sf):
    headers, footers = C.running_lines(_paged(spark, sf))
    return headers.select("document_id", F.lit("header").alias("kind"), F.col("header").alias("line")).union(footers.select("document_id", F.lit("footer"), "footer"))


def header_footer_strip(spark, sf):
    cut = C.without_running_lines(_paged(spark, sf))
    return cut.select("doc_id", F.coalesce("header", F.lit("")).alias("header"), F.coalesce("footer", F.lit("")).alias("footer"), F.sha2("text", 256).alias("text_sha256"))


def hyphen_repair(spark, sf):
    made = table(spark, sf, "documents").select("doc_id", _hyphened(F.col("text")).alias("t")).select("doc_id", C.repaired(F.col("t")).alias("r"))
    return made.select("doc_id", F.col("r.n_joined").alias("n_joined"), F.col("r.n_kept").alias("n_kept"), F.sha2("r.text", 256).alias("text_sha256"))


def typography_normalise(spark, sf):
    made = table(spark, sf, "documents").select("doc_id", _dirty(F.col("text")).alias("t")).select("doc_id", C.normalised(F.col("t")).alias("r"))
    return made.select("doc_id", F.col("r.n_transforms").alias("n_transforms"), F.col("r.n_warnings").alias("n_warnings"), F.sha2("r.text", 256).alias("text_sha256"))


def boilerplate_tags(spark, sf):
    return C.boilerplate(table(spark, sf, "documents"), LICENSES)


def cleaning_summary(spark, sf):
    made = _paged(spark, sf).withColumn("text", F.concat(F.lit("\n"), _hyphened(F.col("text")), F.lit("\n\n")))
    return C.summary(C.cleaned(made))


def cleaning_cohorts(spark, sf):
    """The summary of all documents by cohorts, which their names' lengths and last letters make; one letter has none."""
    made = _paged(spark, sf).withColumn("text", F.concat(F.lit("\n"), _hyphened(F.col("text")), F.lit("\n\n")))
    last = F.right("document_id", F.lit(1))
    members = table(spark, sf, "documents").select(F.col("source").alias("document_id")).distinct().where(F.col("document_id").isNotNull())
    return C.cohorts(C.summary(C.cleaned(made)), members.where(last != "7").withColumn("cohort", F.concat(F.length("document_id").cast("string"), F.when(last < "5", "low").otherwise("high"))))


_WORDS = "[" + ", ".join(f"'{w}'" for w in C.JOINED_WORDS) + "]"
_HYPHENATED = "[" + ", ".join(f"'{w}'" for w in C.HYPHENATED) + "]"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FEEDS = r"regexp_replace(coalesce({}, ''), '\r\n|[\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g')"


def _hyphened_sql(text: str) -> str:
    return rf"replace(replace(regexp_replace(regexp_replace(coalesce({text}, ''), '([a-z]{{3}})tion', '\1-' || chr(10) || 'tion', 'g'), '([a-z]{{3}})ing ', '\1-  ing ', 'g'), ' that ', ' zero- trust '), ' with ', ' infor- mation ')"


def _dirty_sql(text: str) -> str:
    out = f"coalesce({text}, '')"
    for a, b in (("chr(10) || 'T'", "chr(10) || chr(65533) || ' T'"), ("' and '", "chr(65533)"), ("' or '", "' = ' || chr(65533) || ' '"), ("'. '", "'.' || chr(160)"), ("' the '", "' “the” '"), ("' de '", "' — de '"), ("' en '", "'  ' || repeat(chr(10), 4) || 'en '")):
        out = f"replace({out}, {a}, {b})"
    return out


_PAGED = """
  raw AS (SELECT source AS document_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_number, coalesce(text, '') AS text FROM documents),
  paged AS (SELECT document_id, doc_id, page_number, 'Running title ' || document_id || chr(10) || text || chr(10) || CASE WHEN page_number % 2 = 0 THEN 'End of ' || document_id ELSE 'Page ' || page_number END AS text FROM raw)
"""


def _cut(source: str) -> str:
    """CTEs that find and take away running lines of a relation (document_id, doc_id, text)."""
    return rf"""
  fed AS (SELECT document_id, doc_id, length(coalesce(text, '')) AS original, {_FEEDS.format("text")} AS text FROM {source}),
  e1 AS (SELECT *, regexp_extract(text, '^((?:[^\S\n]*\n)*)', 1) AS lead FROM fed),
  e2 AS (SELECT *, split_part(substring(text, length(lead) + 1), chr(10), 1) AS raw_first, regexp_replace(text, '\s+$', '') AS body FROM e1),
  e3 AS (SELECT *, {_STRIP.format("raw_first")} AS first, CASE WHEN contains({_STRIP.format("body")}, chr(10)) THEN {_STRIP.format("string_split(body, chr(10))[-1]")} END AS last FROM e2),
  size AS (SELECT document_id, count(*) AS n FROM e3 GROUP BY document_id),
  headers AS (SELECT document_id, first AS header FROM e3 JOIN size USING (document_id) WHERE first <> '' GROUP BY document_id, first, n HAVING (count(*) >= 4 OR (count(*) >= 3 AND count(*) / n >= 0.15)) AND length(first) >= 4 AND NOT regexp_matches(first, '{C.HEADING}')),
  footers AS (SELECT document_id, last AS footer FROM e3 WHERE last IS NOT NULL GROUP BY document_id, last HAVING count(*) >= 4 AND length(last) >= 4 AND NOT regexp_matches(last, '{C.PAGE_NUMBER}')),
  c1 AS (SELECT e3.document_id, doc_id, original, header, CASE WHEN header IS NULL THEN text ELSE lead || substring(text, length(lead) + length(raw_first) + 1) END AS text FROM e3 LEFT JOIN headers ON headers.document_id = e3.document_id AND header = first),
  c2 AS (SELECT *, regexp_replace(text, '\s+$', '') AS body FROM c1),
  c3 AS (SELECT *, string_split(body, chr(10))[-1] AS raw_last FROM c2),
  c4 AS (SELECT *, {_STRIP.format("raw_last")} AS last FROM c3),
  c5 AS (SELECT c4.*, regexp_matches(last, '{C.PAGE_NUMBER}') OR footer IS NOT NULL AS gone FROM c4 LEFT JOIN footers ON footers.document_id = c4.document_id AND footer = last),
  cut AS (SELECT document_id, doc_id, original, header, CASE WHEN gone THEN last END AS footer, regexp_replace(CASE WHEN gone THEN left(body, length(body) - length(raw_last)) || substring(text, length(body) + 1) ELSE text END, '^\n+|\n+$', '', 'g') AS text FROM c5)"""


_A, _B = "regexp_extract(x, '^([a-zA-Z]+)-', 1)", "regexp_extract(x, '([a-zA-Z]+)$', 1)"
_PROTECTED = f"(list_contains({_HYPHENATED}, lower({_A} || '-' || {_B})) OR regexp_full_match({_A}, '[A-Z]+') OR regexp_full_match({_B}, '[A-Z]+'))"
_SOFT = f"(NOT {_PROTECTED} AND (list_contains({_WORDS}, lower({_A} || {_B})) OR regexp_matches(lower({_A} || {_B}), '{C.SUFFIXES}')))"


#: Letters beyond ASCII, as far as the given texts go.
_LETTERS = r"\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{370}-\x{1fff}\x{3041}-\x{9fff}\x{ac00}-\x{d7a3}"


def _hyphens(source: str) -> str:
    """CTEs that repair hyphens of a relation with text; the last one, joined, has n_joined and n_kept too."""
    build = lambda text, pattern, f: f"list_reduce(list_transform(list_zip(string_split_regex({text}, '{pattern}'), regexp_extract_all({text}, '{pattern}')), lambda z: z[1] || coalesce({f}, '')), lambda p, q: p || q)"
    # a word border is one of ASCII here: letters beyond it get marks that count as letters on both sides, which go again
    marked, plain = rf"regexp_replace(text, '([{_LETTERS}])', '_' || chr(1) || '\1' || chr(1) || '_', 'g')", lambda x: f"replace(replace({x}, '_' || chr(1), ''), chr(1) || '_', '')"
    return rf"""
  h0 AS (SELECT *, {marked} AS m FROM {source}),
  h1 AS (SELECT *, regexp_extract_all(m, '{C.BROKEN_LINE}') AS hits FROM h0),
  h2 AS (SELECT * EXCLUDE (hits, m), len(list_filter(hits, lambda x: {_SOFT})) AS soft, len(list_filter(hits, lambda x: NOT {_SOFT} AND NOT {_PROTECTED})) AS n_kept, {build("m", C.BROKEN_LINE, f"list_transform([z[2]], lambda x: CASE WHEN {_SOFT} THEN {_A} || {_B} ELSE x END)[1]")} AS one FROM h1),
  h3 AS (SELECT *, regexp_extract_all(one, '{C.BROKEN_SPACE}') AS hits FROM h2),
  joined AS (SELECT * EXCLUDE (hits, soft), soft + len(list_filter(hits, lambda x: NOT {_PROTECTED} AND list_contains({_WORDS}, lower({_A} || {_B})))) AS n_joined,
    {plain(build("one", C.BROKEN_SPACE, f"list_transform([z[2]], lambda x: CASE WHEN {_PROTECTED} THEN {_A} || '-' || {_B} WHEN list_contains({_WORDS}, lower({_A} || {_B})) THEN {_A} || {_B} ELSE x END)[1]"))} AS two FROM h3)"""


_LOST = "�"
_LINE = rf"CASE WHEN NOT contains(x, '{_LOST}') THEN x WHEN regexp_matches(x, '^(\s*){_LOST}\s+(.*)$') THEN regexp_replace(x, '^(\s*){_LOST}\s+(.*)$', '\1* \2') WHEN regexp_matches(x, '{C.MATHS}') THEN x WHEN regexp_matches(x, '([A-Za-z]){_LOST}([A-Za-z])') THEN regexp_replace(x, '([A-Za-z]){_LOST}([A-Za-z])', '\1 \2', 'g') ELSE x END"


def _normal(source: str, text: str) -> str:
    """CTEs that normalise a text of a relation; the last one, normal, has final, n_transforms and n_warnings too."""
    plain, kinds = f"replace({text}, chr(160), ' ')", [f"CAST(contains({text}, chr(160)) AS INT)"]
    for x, y in C.TYPOGRAPHY:
        plain = f"replace({plain}, '{x}', '{y.replace(chr(39), chr(39) * 2)}')"
        kinds.append(f"CAST(contains({text}, '{x}') AS INT)")
    return rf"""
  n1 AS (SELECT *, {plain} AS plain, {" + ".join(kinds)} AS kinds FROM {source}),
  n2 AS (SELECT *, list_filter(string_split(plain, chr(10)), lambda x: contains(x, '{_LOST}')) AS lost, array_to_string(list_transform(string_split(plain, chr(10)), lambda x: {_LINE}), chr(10)) AS lined FROM n1),
  n3 AS (SELECT *, len(list_filter(lost, lambda x: {_LINE} <> x)) AS fixed, regexp_replace(regexp_replace(lined, '[^\S\n]+\n', chr(10), 'g'), '[^\S\n]+$', '') AS trimmed FROM n2),
  n4 AS (SELECT *, regexp_replace(trimmed, '\n{{3,}}', chr(10) || chr(10), 'g') AS collapsed FROM n3),
  normal AS (SELECT *, regexp_replace(collapsed, '^\n+|\n+$', '', 'g') AS final, kinds + fixed + CAST(length(collapsed) < length(trimmed) AS INT) AS n_transforms, len(lost) - fixed AS n_warnings FROM n4)"""


QUERIES = {f.__name__: f for f in (header_footer_discovery, header_footer_strip, hyphen_repair, typography_normalise, boilerplate_tags, cleaning_summary, cleaning_cohorts)}

SQL = {
    "header_footer_discovery": f"WITH {_PAGED}, {_cut('paged')} SELECT document_id, 'header' AS kind, header AS line FROM headers UNION ALL SELECT document_id, 'footer', footer FROM footers",
    "header_footer_strip": f"WITH {_PAGED}, {_cut('paged')} SELECT doc_id, coalesce(header, '') AS header, coalesce(footer, '') AS footer, sha256(text) AS text_sha256 FROM cut",
    "hyphen_repair": f"WITH s AS (SELECT doc_id, {_hyphened_sql('text')} AS text FROM documents), {_hyphens('s')} SELECT doc_id, n_joined, n_kept, sha256(two) AS text_sha256 FROM joined",
    "typography_normalise": f"WITH s AS (SELECT doc_id, {_dirty_sql('text')} AS text FROM documents), {_normal('s', 'text')} SELECT doc_id, n_transforms, n_warnings, sha256(final) AS text_sha256 FROM normal",
    "boilerplate_tags": f"""WITH p AS (SELECT doc_id, {_STRIP.format("p")} AS p FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10) || chr(10))) AS p FROM documents)), t AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(p, '(?i){pattern}') THEN '{name}'" for name, pattern in LICENSES)} END AS tag FROM p WHERE length(p) >= 60)
      SELECT doc_id, tag, replace(left(p, 120), chr(10), ' ') AS snippet, length(p) AS n_chars FROM t WHERE tag IS NOT NULL""",
    "cleaning_cohorts": f"""WITH {_PAGED}, made AS (SELECT document_id, doc_id, chr(10) || {_hyphened_sql("text")} || chr(10) || chr(10) AS text FROM paged), {_cut("made")}, {_hyphens("cut")}, {_normal("joined", "two")},
      g AS (SELECT document_id, count(*) AS n_pages, count(header) AS n_headers, count(footer) AS n_footers, CAST(sum(n_joined) AS BIGINT) AS n_joined, CAST(sum(n_kept + n_warnings) AS BIGINT) AS n_warnings, CAST(sum(n_transforms) AS BIGINT) AS n_transforms, CAST(sum(original) AS BIGINT) AS original_chars, CAST(sum(length(final)) AS BIGINT) AS cleaned_chars FROM normal GROUP BY document_id),
      s AS (SELECT *, round((cleaned_chars - original_chars) / greatest(original_chars, 1) * 100, 4) AS pct FROM g),
      t AS (SELECT *, CASE WHEN document_id IS NULL OR right(document_id, 1) = '7' THEN 'none' ELSE length(document_id) || CASE WHEN right(document_id, 1) < '5' THEN 'low' ELSE 'high' END END AS cohort FROM s),
      u AS (SELECT cohort, count(*) AS n_documents, CAST(sum(n_pages) AS BIGINT) AS n_pages, CAST(sum(n_headers) AS BIGINT) AS n_headers, CAST(sum(n_footers) AS BIGINT) AS n_footers, CAST(sum(n_joined) AS BIGINT) AS n_joined, CAST(sum(n_warnings) AS BIGINT) AS n_warnings, CAST(sum(n_transforms) AS BIGINT) AS n_transforms,
        CAST(sum(original_chars) AS BIGINT) AS original_chars, CAST(sum(cleaned_chars) AS BIGINT) AS cleaned_chars, count(*) FILTER (cleaned_chars > original_chars) AS n_grown, first(document_id ORDER BY abs(pct) DESC, document_id) AS most_changed FROM t GROUP BY cohort)
      SELECT *, round((cleaned_chars - original_chars) / greatest(original_chars, 1) * 100, 4) AS pct_change FROM u""",
    "cleaning_summary": f"""WITH {_PAGED}, made AS (SELECT document_id, doc_id, chr(10) || {_hyphened_sql("text")} || chr(10) || chr(10) AS text FROM paged), {_cut("made")}, {_hyphens("cut")}, {_normal("joined", "two")},
      g AS (SELECT document_id, count(*) AS n_pages, count(header) AS n_headers, count(footer) AS n_footers, CAST(sum(n_joined) AS BIGINT) AS n_joined, CAST(sum(n_kept + n_warnings) AS BIGINT) AS n_warnings, CAST(sum(n_transforms) AS BIGINT) AS n_transforms, CAST(sum(original) AS BIGINT) AS original_chars, CAST(sum(length(final)) AS BIGINT) AS cleaned_chars FROM normal GROUP BY document_id)
      SELECT *, round((cleaned_chars - original_chars) / greatest(original_chars, 1) * 100, 4) AS pct_change FROM g""",
}
