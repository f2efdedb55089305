"""Conservative page cleaning: running headers and footers, hyphens, encoding, boilerplate tags.

The steps hold in this order: header and footer, hyphens, encoding and white space, tags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.functions.text import WHITE, let, strip, white

#: Frequencies, patterns, words and suffixes.
HEADER_PAGES, HEADER_FEW, HEADER_SHARE, FOOTER_PAGES, SHORTEST = 4, 3, 0.15, 4, 4
PAGE_NUMBER = white(r"(?i)^(page\s+)?([0-9]+|[ivxlcdm]+|[0-9]+-[0-9]+)$")
HEADING = white(r"^(#+|[0-9]+(\.[0-9]+)*\s+[A-Z]|[A-Z][A-Za-z0-9\s]{2,}:)")
BROKEN_LINE, BROKEN_SPACE = white(r"\b[a-zA-Z]{3,}-\s*\n\s*[a-zA-Z]{3,}\b"), white(r"\b[a-zA-Z]{3,}-\s+[a-zA-Z]{3,}\b")
SUFFIXES = "(tion|tions|ment|ments|ity|ities|able|ing|ed)$"
JOINED_WORDS = [
    "authentication", "authorization", "implementation", "organization", "organizational", "management", "cryptographic",
    "cryptography", "cryptosystem", "vulnerability", "vulnerabilities", "continuous", "monitoring", "recommendation", "recommendations", "operational",
    "interoperability", "infrastructure", "configuration", "capabilities", "information", "verification", "identification", "responsibilities",
    "considerations", "assurance", "establishment", "environment", "environments", "administrator", "administrators", "transmission", "protection",
    "assessment", "assessments", "requirement", "requirements", "architecture", "architectures", "guidelines", "publication", "publications",
    "reproducibility", "classification", "confidentiality", "integrity", "availability", "specification", "specifications", "accreditation",
    "certification", "compliance",
]
HYPHENATED = [
    "aes-256", "aes-192", "aes-128", "aes-gcm", "aes-ccm", "aes-cbc", "sha-1", "sha-224", "sha-256", "sha-384", "sha-512", "sha-3", "hmac-sha-256", "rsa-2048", "rsa-4096", "ecdsa-p256", "ecdsa-p384",
    "zero-trust", "cross-site", "role-based", "attribute-based", "public-key", "private-key", "pair-wise", "high-performance", "supply-chain", "third-party", "real-time", "cloud-native", "machine-readable", "well-defined",
    "end-to-end", "fips-140-3", "sp-800-53", "sp-800-39", "sp-800-116", "sp-800-152", "sp-800-186",
]
TYPOGRAPHY = [("“", '"'), ("”", '"'), ("‘", "'"), ("’", "'"), ("—", " - "), ("–", "-")]
LOST = "�"
MATHS = white(r"[+\-=*/<>|()]\s*") + LOST + "|" + LOST + white(r"\s*[a-zA-Z]([^\p{L}\p{N}_]|$)")
BOILERPLATE_CHARS, SNIPPET_CHARS = 60, 120


#: The same without backtracking into a word, and with borders that know all letters; the other pattern language of the SQL lacks both.
BROKEN_LINE_ONCE, BROKEN_SPACE_ONCE = (r"(?<![\p{L}\p{N}_])" + p.removeprefix(r"\b").removesuffix(r"\b").replace("{3,}-", "{3,}+-") + r"(?![\p{L}\p{N}_])" for p in (BROKEN_LINE, BROKEN_SPACE))


def line_feeds(text: Column) -> Column:
    """All line breaks as line feeds; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", "\n")


def _ends(pages: DataFrame) -> DataFrame:
    """pages with __lead, __first, __after: blank lines, the first line that isn't blank, and the rest; and __body, __last: the text
    without white space at its end, and its last line. A column of its own each, so that none is worked out twice."""
    found = pages.withColumn("__lead", F.regexp_extract("text", white(r"^((?:[^\S\n]*\n)*)"), 1)).withColumn("__after", F.expr("substring(text, length(__lead) + 1)"))
    found = found.withColumn("__first", F.substring_index("__after", "\n", 1)).withColumn("__after", F.expr("substring(__after, length(__first) + 1)"))
    return _last(found)


def _last(pages: DataFrame) -> DataFrame:
    found = pages.withColumn("__body", F.rtrim(F.col("text"), F.lit(WHITE)))
    return found.withColumn("__last", F.substring_index("__body", "\n", -1))


def running_lines(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(document_id, header) and (document_id, footer) that recur in pages (document_id, text).

    Counts are combined before the shuffle, so one document may hold any share of the pages.
    """
    found = _ends(pages.select("document_id", line_feeds(F.col("text")).alias("text")))
    lines = found.select("document_id", strip(F.col("__first")).alias("first"), F.when(F.ltrim(F.col("__body"), F.lit(WHITE)).contains("\n"), strip(F.col("__last"))).alias("last"))
    # One pass over the texts: a row for each page's two lines, a null one for the page itself.
    kinds = {"page": F.lit(""), "header": F.col("first"), "footer": F.col("last")}
    each = lines.select("document_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("line")) for k, c in kinds.items()])).alias("x")).select("document_id", "x.*")
    counted = each.where("line is not null").groupBy("document_id", "kind", "line").count()
    size = counted.where("kind = 'page'").select("document_id", F.col("count").alias("n_pages"))
    tops = counted.where("kind = 'header' and line <> ''").join(size, "document_id")
    often = (F.col("count") >= HEADER_PAGES) | ((F.col("count") >= HEADER_FEW) & (F.col("count") / F.col("n_pages") >= HEADER_SHARE))
    headers = tops.where(often & (F.length("line") >= SHORTEST) & ~F.col("line").rlike(HEADING)).select("document_id", F.col("line").alias("header"))
    ends = counted.where((F.col("kind") == "footer") & (F.col("count") >= FOOTER_PAGES) & (F.length("line") >= SHORTEST) & ~F.col("line").rlike(PAGE_NUMBER))
    return headers, ends.select("document_id", F.col("line").alias("footer"))


def without_running_lines(pages: DataFrame) -> DataFrame:
    """pages with text without running headers and footers, and the lines taken away (header, footer; null if none)."""
    headers, footers = running_lines(pages)
    split = _ends(pages.withColumn("text", line_feeds(F.col("text")))).withColumn("__top", strip(F.col("__first")))
    tops = headers.select(F.col("document_id").alias("__hd"), "header")
    headed = split.join(tops, (F.col("document_id") == F.col("__hd")) & (F.col("__top") == F.col("header")), "left")
    headed = _last(headed.withColumn("text", F.when(F.col("header").isNull(), F.col("text")).otherwise(F.concat("__lead", "__after"))))
    ended = headed.withColumn("__end", strip(F.col("__last")))
    ended = ended.join(footers.withColumnRenamed("document_id", "__doc"), (F.col("document_id") == F.col("__doc")) & (F.col("__end") == F.col("footer")), "left")
    gone = F.col("__end").rlike(PAGE_NUMBER) | F.col("footer").isNotNull()
    kept = F.concat(F.expr("left(__body, length(__body) - length(__last))"), F.expr("substring(text, length(__body) + 1)"))
    cut = ended.withColumn("__gone", gone).withColumn("text", F.btrim(F.when(F.col("__gone"), kept).otherwise(F.col("text")), F.lit("\n"))).withColumn("footer", F.when(F.col("__gone"), F.col("__end")))
    return cut.select(*pages.columns, "header", "footer")


def _rebuilt(text: Column, pattern: str, f) -> Column:
    """struct (text, hits): the text with f(match) for each match, and the matches."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    put = lambda h: F.struct(F.array_join(F.zip_with(F.split(text, pattern, -1), h, lambda gap, hit: F.concat(gap, F.when(hit.isNull(), "").otherwise(f(hit)))), "").alias("text"), h.alias("hits"))
    return F.when(text.rlike(pattern), let(hits, put)).otherwise(F.struct(text.alias("text"), F.array().cast("array<string>").alias("hits")))


def _parts(hit: Column) -> tuple[Column, Column]:
    return F.regexp_extract(hit, "^([a-zA-Z]+)-", 1), F.regexp_extract(hit, "([a-zA-Z]+)$", 1)


def protected(a: Column, b: Column) -> Column:
    """Whether a hyphen between two words of letters is meant: a known compound, or a word in capitals."""
    return F.lower(F.concat(a, F.lit("-"), b)).isin(*HYPHENATED) | a.rlike("^[A-Z]+$") | b.rlike("^[A-Z]+$")


def _soft(hit: Column) -> Column:
    a, b = _parts(hit)
    joined = F.lower(F.concat(a, b))
    return ~protected(a, b) & (joined.isin(*JOINED_WORDS) | joined.rlike(SUFFIXES))


def repaired(text: Column) -> Column:
    """struct (text, n_joined, n_kept): words broken at line ends joined where they are surely one, spaced hyphens closed."""
    bare = lambda hit: F.concat(*_parts(hit))
    known = lambda hit: F.lower(bare(hit)).isin(*JOINED_WORDS)

    def spaced(hit: Column) -> Column:
        return F.when(protected(*_parts(hit)), F.concat_ws("-", *_parts(hit))).when(known(hit), bare(hit)).otherwise(hit)

    def both(first: Column, second: Column) -> Column:
        joined = F.size(F.filter(first["hits"], _soft)) + F.size(F.filter(second["hits"], lambda hit: ~protected(*_parts(hit)) & known(hit)))
        open_ = F.size(F.filter(first["hits"], lambda hit: ~_soft(hit) & ~protected(*_parts(hit))))
        return F.struct(second["text"].alias("text"), joined.cast("long").alias("n_joined"), open_.cast("long").alias("n_kept"))

    lines = _rebuilt(text, BROKEN_LINE_ONCE, lambda hit: F.when(_soft(hit), bare(hit)).otherwise(hit))
    return let(lines, lambda first: let(_rebuilt(first["text"], BROKEN_SPACE_ONCE, spaced), lambda second: both(first, second)))


def _line(line: Column) -> Column:
    """A line with a lost character resolved: a bullet, or a separator inside a word; kept in formulas and else."""
    bullet = white(r"^(\s*)") + LOST + white(r"\s+(.*)$")
    inside = "([A-Za-z])" + LOST + "([A-Za-z])"
    return F.when(~line.contains(LOST), line).when(line.rlike(bullet), F.regexp_replace(line, bullet, "$1* $2")).when(line.rlike(MATHS), line).when(line.rlike(inside), F.regexp_replace(line, inside, "$1 $2")).otherwise(line)


def normalised(text: Column) -> Column:
    """struct (text, n_transforms, n_warnings): typography, lost characters and white space set right.

    A kind of typography counts once a text, a line with a lost character once for that line.
    """
    kinds = [F.when(text.contains(x), 1).otherwise(0) for x in ["\u00a0", *(x for x, _ in TYPOGRAPHY)]]
    plain = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    for x, y in TYPOGRAPHY:
        plain = F.replace(plain, F.lit(x), F.lit(y))

    def lines(plain: Column) -> Column:
        """struct (text, n_lost, n_fixed)."""
        fixed = lambda x: F.struct(x.contains(LOST).alias("lost"), (_line(x) != x).alias("fixed"), _line(x).alias("text"))
        put = lambda each: F.struct(F.array_join(F.transform(each, lambda x: x["text"]), "\n").alias("text"), F.size(F.filter(each, lambda x: x["lost"])).alias("n_lost"), F.size(F.filter(each, lambda x: x["fixed"])).alias("n_fixed"))
        return F.when(plain.contains(LOST), let(F.transform(F.split(plain, "\n", -1), fixed), put)).otherwise(F.struct(plain.alias("text"), F.lit(0).alias("n_lost"), F.lit(0).alias("n_fixed")))

    def spaced(x: Column) -> Column:
        """The lines' struct with trimmed and collapsed text."""
        trimmed = F.when(x["text"].rlike(white(r"[^\S\n](\n|$)")), F.regexp_replace(x["text"], white(r"[^\S\n]++(?=\n|$)"), "")).otherwise(x["text"])
        return let(trimmed, lambda t: let(F.when(t.contains("\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t), lambda c: done(x, t, c)))

    def done(x: Column, trimmed: Column, collapsed: Column) -> Column:
        total = sum(kinds, F.lit(0)) + x["n_fixed"] + F.when(F.length(collapsed) < F.length(trimmed), 1).otherwise(0)
        return F.struct(F.btrim(collapsed, F.lit("\n")).alias("text"), total.cast("long").alias("n_transforms"), (x["n_lost"] - x["n_fixed"]).cast("long").alias("n_warnings"))

    return let(plain, lambda p: let(lines(p), spaced))


def boilerplate(docs: DataFrame, patterns: list[tuple[str, str]], between: str = "\n\n") -> DataFrame:
    """doc_id, tag, snippet, n_chars: paragraphs of 60 or more characters by the first of patterns (tag, pattern) that they hold."""
    paragraphs = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), between)).alias("p")).select("doc_id", strip(F.col("p")).alias("p")).where(F.length("p") >= BOILERPLATE_CHARS)
    tag = F.coalesce(*[F.when(F.col("p").rlike("(?i)" + pattern), name) for name, pattern in patterns])
    tagged = paragraphs.withColumn("tag", tag).where("tag is not null")
    return tagged.select("doc_id", "tag", F.replace(F.left("p", F.lit(SNIPPET_CHARS)), F.lit("\n"), F.lit(" ")).alias("snippet"), F.length("p").cast("long").alias("n_chars"))


def cleaned(pages: DataFrame) -> DataFrame:
    """pages (document_id, page_number, text) cleaned: cleaned_text and cleaning (struct of what was done)."""
    cut = without_running_lines(pages.withColumn("__original", F.length(F.coalesce("text", F.lit("")))))
    joined = cut.withColumn("__r", repaired(F.col("text")))
    fixed = joined.withColumn("__n", normalised(F.col("__r.text")))
    done = F.struct(F.col("header"), F.col("footer"), F.col("__r.n_joined").alias("n_joined"), (F.col("__r.n_kept") + F.col("__n.n_warnings")).alias("n_warnings"), F.col("__n.n_transforms").alias("n_transforms"), F.col("__original").alias("original_chars"), F.length("__n.text").alias("cleaned_chars"))
    return fixed.withColumn("cleaning", done).withColumn("cleaned_text", F.col("__n.text")).drop("__r", "__n", "__original", "header", "footer")


def summary(pages: DataFrame) -> DataFrame:
    """Documents from cleaned pages: sums and the change in per cent."""
    c = lambda name: F.col(f"cleaning.{name}")
    found = pages.groupBy("document_id").agg(
        F.count("*").alias("n_pages"), F.count(c("header")).alias("n_headers"), F.count(c("footer")).alias("n_footers"), F.sum(c("n_joined")).alias("n_joined"), F.sum(c("n_warnings")).alias("n_warnings"),
        F.sum(c("n_transforms")).alias("n_transforms"), F.sum(c("original_chars")).cast("long").alias("original_chars"), F.sum(c("cleaned_chars")).cast("long").alias("cleaned_chars"),
    )
    return found.withColumn("pct_change", F.round((F.col("cleaned_chars") - F.col("original_chars")) / F.greatest("original_chars", F.lit(1)) * 100, 4))


def cohorts(documents: DataFrame, members: DataFrame) -> DataFrame:
    """cohort, n_documents, sums and change in per cent of summary()'s documents by cohort (document_id, cohort), how many grew, and the one that changed most.

    Documents of no cohort are one of their own, named 'none'.
    """
    named = documents.join(members.select("document_id", "cohort"), "document_id", "left").withColumn("cohort", F.coalesce("cohort", F.lit("none")))
    sums = ("n_pages", "n_headers", "n_footers", "n_joined", "n_warnings", "n_transforms", "original_chars", "cleaned_chars")
    found = named.groupBy("cohort").agg(F.count("*").alias("n_documents"), *(F.sum(c).alias(c) for c in sums), F.count_if(F.col("cleaned_chars") > F.col("original_chars")).alias("n_grown"), F.min_by("document_id", F.struct(-F.abs("pct_change"), "document_id")).alias("most_changed"))
    return found.withColumn("pct_change", F.round((F.col("cleaned_chars") - F.col("original_chars")) / F.greatest("original_chars", F.lit(1)) * 100, 4))
