"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexquarry.llm import bpe, chat, counts, decontaminate, jaccard, langid, neardup, periods, quality, repeats, secrets, urlrules, whitening
from lexquarry.llm.common import bounded_batches, held_out, scratch, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Tokenizer versions that op10_counts maintains, each with its vocabulary file.
VERSIONS = {"word_bpe_49k/1": TOKENIZER, "byte_bpe_50k/1": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: All pairs of equal label; components by repeated minima over links.
OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), low AS (
  SELECT u, min(v) AS low FROM reach GROUP BY u
), n AS (
  SELECT u, count(*) AS n FROM links GROUP BY u
)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(low.low, vec_id)) AS component_id, vec_id <= coalesce(low.low, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN low ON low.u = vec_id
"""

OWN_CONVERSATION = """
SELECT -1L AS conv_id, 0L AS turn, 'user' AS role, '</s>[INST] ok [/INST]' AS text
UNION ALL SELECT -1L, 1L, 'assistant', '</s>[INST] ok [/INST]'
"""


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(spark.sql(OWN_CONVERSATION))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))
    read = chat.expand(turns).groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", loss.alias("text")))).alias("losses"),
        F.count_if("trained").alias("n_examples"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    read = read.select("conv_id", chat.read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"), "n_examples", "formatted_chars")
    written = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    24 + length(role) + length(text)
      + length(role) - length(replace(role, '<', '')) + length(role) - length(replace(role, '[', '')) + length(role) - length(replace(role, chr(10), ''))
      + length(text) - length(replace(text, '<', '')) + length(text) - length(replace(text, '[', '')) AS m
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, sum(m) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o
)
SELECT conv_id, max(n) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM p GROUP BY conv_id
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS t(i) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM bw) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(i)
), h AS (
  SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, s)
), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + n)) AS t(j) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""


def op4_bpe(spark: SparkSession, sf_dir: str, tokenizer: str = TOKENIZER) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_documents(docs, tokenizer, keep=["doc_id"])
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return cut.select("doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Texts as hexadecimal, cut into overlapping pieces and these into strings of 50 bytes; a string goes if a smaller document has it.
OP5_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), p AS (
  SELECT doc_id, k, substring(h, 2000 * k + 1, 2098) AS piece FROM d, unnest(range(0, (n + 999) // 1000)) AS t(k)
), s AS (
  SELECT doc_id, 1000 * k + j AS i, substring(piece, 2 * j + 1, 100) AS x FROM p, unnest(range(0, greatest(least(1000, length(piece) // 2 - 49), 0))) AS t(j)
), low AS (
  SELECT x, min(doc_id) AS first FROM s GROUP BY x HAVING min(doc_id) <> max(doc_id)
), r AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT DISTINCT doc_id, i FROM s JOIN low USING (x) WHERE first < doc_id)
), g AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM r
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, g
), gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM spans
  UNION ALL SELECT doc_id, coalesce(max(spans.z), 0), any_value(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed FROM spans GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dictionaries = langid.train(docs)
    return langid.identify_documents(docs.select("doc_id", "text"), dictionaries).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS both_have FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM p JOIN n AS x ON x.doc_id = u JOIN n AS y ON y.doc_id = v WHERE 100 * both_have >= 90 * (x.n + y.n - both_have)
), reach AS (
  SELECT u, v FROM links UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), low AS (
  SELECT u, min(v) AS low FROM reach GROUP BY u
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON u = doc_id
"""


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


def _matches_sql(name: str, kind: int, pattern: str, test: str) -> str:
    """CTEs: the places of a pattern's matches, which split() leaves between them; test is one of hit."""
    return f"""
  {name}0 AS (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits FROM d),
  {name}1 AS (SELECT doc_id, hits[k] AS hit, CAST(sum(length(gaps[k]) + length(hits[k])) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS z FROM {name}0, unnest(range(1, len(hits) + 1)) AS t(k)),
  {name} AS (SELECT doc_id, {kind} AS kind, z - length(hit) AS a, z, hit FROM {name}1 WHERE {test})"""


def _by_encoding_sql(values: dict[str, object]) -> str:
    return "CASE encoding " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


def _tail_sql(z: str) -> str:
    """The same approximation of 1 - Phi(z) as the operator's."""
    t = f"(1 / (1 + 0.2316419 * least(abs({z}), 37)))"
    tail = f"(exp(-least(abs({z}), 37) * least(abs({z}), 37) / 2) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


_QUOTED_ASSIGN = secrets.ASSIGN.replace("'", "''")
_BIN = f"least({secrets.TOP_BIN}, greatest(0, floor(-log10(greatest(p / (bits / mean), 1e-300)) * {secrets.BINS_A_DECADE})))"
_CHANGES = {e: secrets._class_changes(a) for e, a in secrets.ALPHABETS.items()}
#: Fixed patterns, then the battery over tokens outside their spans, and the weighted step-up rule by encoding.
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {_matches_sql("m0", 0, _QUOTED_ASSIGN, f"length(regexp_extract(hit, '{_QUOTED_ASSIGN}', 2)) >= 12")}, {_matches_sql("m1", 1, secrets.ACCESS, "length(hit) >= 18")}, {_matches_sql("m2", 2, secrets.HEX, "true")},
  base AS (SELECT doc_id, kind, a, z FROM m0 UNION ALL SELECT doc_id, kind, a, z FROM m1 UNION ALL SELECT doc_id, kind, a, z FROM m2), {_matches_sql("m3", 3, secrets.TOKEN, "regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')")},
  c0 AS (SELECT doc_id, a, z, regexp_replace(hit, '=+$', '') AS raw FROM m3 WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = m3.doc_id AND base.a <= m3.a AND base.z >= m3.z)),
  c1 AS (SELECT *, regexp_full_match(raw, '[0-9a-z]*') OR regexp_full_match(raw, '[0-9A-Z]*') AS one FROM c0),
  c2 AS (SELECT doc_id, a, z, CASE WHEN one THEN lower(raw) ELSE translate(raw, '-_', '+/') END AS s, CASE WHEN one AND regexp_full_match(lower(raw), '[0-9a-f]*') THEN 'hex' WHEN one AND regexp_full_match(lower(raw), '[a-z2-7]*') THEN 'base32' WHEN one THEN 'base36' WHEN regexp_full_match(raw, '[0-9A-Za-z]*') THEN 'base62' ELSE 'base64' END AS encoding FROM c1),
  c3 AS (SELECT *, {_by_encoding_sql(secrets.ALPHABETS)} AS alphabet, CAST(length(s) AS DOUBLE) AS n, CAST({_by_encoding_sql({e: len(a) for e, a in secrets.ALPHABETS.items()})} AS DOUBLE) AS k, CAST({_by_encoding_sql({e: x[0] for e, x in _CHANGES.items()})} AS DOUBLE) AS q, CAST({_by_encoding_sql({e: x[1] for e, x in _CHANGES.items()})} AS DOUBLE) AS w FROM c2 WHERE length(s) >= coalesce({_by_encoding_sql(secrets.LEAST)}, 20)),
  c4 AS (SELECT *, list_sum(list_transform(string_split(alphabet, ''), lambda x: power(length(s) - length(replace(s, x, '')), 2))) AS squares, list_transform(string_split(s, ''), lambda x: strpos(alphabet, x) - 1 - (k - 1) / 2) AS v,
    string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '0', 'g'), '[+/]', '-', 'g'), '') AS y FROM c3),
  c5 AS (SELECT *, greatest(k / n * squares - n, 0) / (k - 1) AS ratio, list_sum(list_transform(range(2, len(y) + 1), lambda i: CASE WHEN y[i] <> y[i - 1] THEN 1 ELSE 0 END)) AS changes, list_sum(list_transform(range(2, len(v) + 1), lambda i: v[i] * v[i - 1])) / ((k * k - 1) / 12) AS product FROM c4),
  c6 AS (SELECT *, (power(ratio, 1.0 / 3) - (1 - 2 / (9 * (k - 1)))) / sqrt(2 / (9 * (k - 1))) AS z1, abs((changes - (n - 1) * q) / sqrt((n - 1) * q * (1 - q) + 2 * (n - 2) * (w - q * q))) AS z2, abs(product / sqrt(n - 1)) AS z3 FROM c5),
  c7 AS (SELECT doc_id, a, z, encoding, n * log2(k) AS bits, -ln(greatest({_tail_sql("z1")}, 1e-100)) - ln(greatest(2 * {_tail_sql("z2")}, 1e-100)) - ln(greatest(2 * {_tail_sql("z3")}, 1e-100)) AS e FROM c6),
  c8 AS (SELECT *, least(1, exp(-e) * (1 + e + e * e / 2)) AS p, avg(bits) OVER (PARTITION BY encoding) AS mean, count(*) OVER (PARTITION BY encoding) AS m FROM c7),
  c9 AS (SELECT *, {_BIN} AS bin FROM c8), reached AS (SELECT *, count(*) OVER (PARTITION BY encoding ORDER BY bin DESC) AS r FROM c9),
  lowest AS (SELECT encoding, min(bin) FILTER (power(10, -bin / {secrets.BINS_A_DECADE}) * m <= 0.05 * r) AS low FROM reached GROUP BY encoding),
  spans AS (SELECT * FROM base UNION ALL SELECT doc_id, 3, a, z FROM c9 JOIN lowest USING (encoding) WHERE low IS NULL OR bin < low),
  listed AS (SELECT doc_id, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || a || ':' || z AS x, a, z, kind FROM spans),
  g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(x, ',' ORDER BY a, kind, z) FILTER (kind < 3) AS base, string_agg(x, ',' ORDER BY a, kind, z) AS spans FROM listed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""


def op10_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after inserts, revisions and the withdrawal of toxic documents."""
    rollup = counts.Rollup(spark, scratch(spark, "counts"))
    withdrawn = table(spark, sf_dir, "labels").where("toxic = 1")
    return counts.maintained(rollup, table(spark, sf_dir, "documents"), withdrawn, VERSIONS, public_tokenizers.PATTERN)


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and the words of each text; with a crc32 of the id that 10 divides, the words from a place on repeat a few."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    n, g = F.size("words"), F.col("g")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    made = docs.select("doc_id", words.alias("words"), h.alias("h"), F.floor(h / 10).alias("g"))
    made = made.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return made.select("doc_id", F.array_join(F.when((F.col("h") % 10 == 0) & (n > 0), again).otherwise(F.col("words")), " ").alias("text"))


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.collapse(repeating(table(spark, sf_dir, "documents"))).withColumn("best", periods.strongest(F.col("runs")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: By powers of two w: where a stretch of w words comes again after w/2 < q <= w words for the first time, in consecutive places,
#: lies a run of smallest period q (a stretch as long as the period can't come earlier).
OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), c AS (
  SELECT *, len(w) AS n, CAST(doc_id AS VARCHAR) AS s FROM t
), crc AS (
  SELECT s, 1 AS i, CAST(4294967295 AS BIGINT) AS r FROM (SELECT DISTINCT s FROM c WHERE s IS NOT NULL)
  UNION ALL
  SELECT s, i + 1, list_reduce(list_prepend(xor(r, ascii(s[i])), range(8)), lambda x, y: xor(x >> 1, (x & 1) * 3988292384)) FROM crc WHERE i <= length(s)
), h AS (
  SELECT s, xor(r, 4294967295) AS h FROM crc WHERE i = length(s) + 1
), m AS (
  SELECT k, doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS f FROM c LEFT JOIN h USING (s)
), d AS (
  SELECT k, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // f) END]) END AS w FROM m
), x AS (
  SELECT k, n, i, w[i + 1] AS x FROM d, unnest(range(0, n)) AS u(i)
), g AS (
  SELECT k, n, i, 1 AS w, hash(x) AS h FROM x
  UNION ALL
  SELECT k, n, i, w, h FROM (SELECT k, n, i, 2 * w AS w, hash(h, lead(h, w) OVER (PARTITION BY k ORDER BY i)) AS h FROM g WHERE n >= 3 * (w + 1)) AS y WHERE i + w <= n
), again AS (
  SELECT k, w, i, lead(i) OVER (PARTITION BY k, w, h ORDER BY i) - i AS q FROM g
), near AS (
  SELECT k, w, i, q, i - row_number() OVER (PARTITION BY k, w, q ORDER BY i) AS island FROM again WHERE q <= w AND 2 * q > w
), runs AS (
  SELECT k, min(i) AS start, max(i) + w + q - min(i) AS length, q AS period FROM near GROUP BY k, w, q, island HAVING max(i) + w + q - min(i) >= greatest(24, 3 * q)
), per AS (
  SELECT k, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY k
), best AS (
  SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY k ORDER BY length / period DESC, start, period) = 1
), gone AS (
  SELECT DISTINCT k, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT k, string_agg(x, ' ' ORDER BY i) AS s FROM x ANTI JOIN gone USING (k, i) GROUP BY k
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(per.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (k) LEFT JOIN best USING (k) LEFT JOIN kept USING (k)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors)
    error = whitening.identity_error(vectors, model) if model else None
    return whitening.whiten(vectors, model).withColumn("identity_error", F.lit(error).cast("double"))


#: The rules of op13_urls: host, path, verdict.
URL_RULES = "VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS rules(host, path, verdict)"


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {URL_RULES}")
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


OP13_SQL = f"""
WITH u AS (
  SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS s FROM pages
), p AS (
  SELECT k, page_id, translate(regexp_extract(s, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(s, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), f AS (
  SELECT k, r.host || r.path AS rule, verdict FROM p JOIN (FROM ({URL_RULES.split(" AS rules")[0]}) AS v(host, path, verdict)) AS r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
), best AS (
  SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC) = 1
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (k)
"""


def _application(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, in a session whose Arrow batches are bounded."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neardup": _application(op1_neardup),
    "op2_chat": _application(op2_chat),
    "op3_decontamination": _application(op3_decontamination),
    "op4_bpe": _application(op4_bpe),
    "op5_repeats": _application(op5_repeats),
    "op6_quality": _application(op6_quality),
    "op7_langid": _application(op7_langid),
    "op8_jaccard": _application(op8_jaccard),
    "op9_secrets": _application(op9_secrets),
    "op10_counts": _application(op10_counts),
    "op11_periods": _application(op11_periods),
    "op12_whitening": _application(op12_whitening),
    "op13_urls": _application(op13_urls),
}

SQL: dict[str, str] = {
    "op1_neardup": OP1_SQL,
    "op2_chat": OP2_SQL,
    "op3_decontamination": OP3_SQL,
    "op5_repeats": OP5_SQL,
    "op8_jaccard": OP8_SQL,
    "op9_secrets": OP9_SQL,
    "op11_periods": OP11_SQL,
    "op13_urls": OP13_SQL,
}
