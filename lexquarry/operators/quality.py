"""Page and document quality, inventory, duplicates and collection filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.html import links
from lexquarry.functions.text import let, strip, white, words
from lexquarry.operators.near import near_pairs as near_pairs  # near duplicates

#: Thresholds.
LOW_TEXT, OCR_TEXT, OCR_IMAGES = 100, 50, 1
REPLACED, CONTROL, ALNUM, LONG_TOKEN, PART = 0.05, 0.03, 0.25, 60, 35

#: Keywords of each category, in the order that decides ties.
CATEGORIES = {
    "incident_response": ["incident response", "incident", "digital forensics", "forensic", "cyber incident"],
    "identity_access": ["identity", "access control", "authentication", "authorization", "credential", "password", "privileged access", "attribute based access", "identity management"],
    "vulnerability_management": ["vulnerability", "vulnerabilities", "weakness", "patch", "software assurance", "security testing", "penetration testing"],
    "cloud_application_security": ["cloud", "cloud-native", "cloud native", "application security", "api security", "api protection", "container", "microservices", "service mesh", "software security"],
    "risk_management": ["risk", "risk management", "cybersecurity framework", "csf", "security assessment", "security controls", "privacy"],
    "supply_chain_security": ["supply chain", "cybersecurity supply chain", "third party", "supplier", "software supply chain"],
    "zero_trust_network_security": ["zero trust", "network security", "network", "firewall", "remote access", "telework", "network architecture"],
    "threats_malware": ["malware", "threat", "threats", "attack", "adversarial", "ransomware", "phishing", "botnet"],
    "cryptography_security": ["cryptography", "cryptographic", "encryption", "key management", "digital signature", "hash", "cryptographic algorithm"],
    "ai_security": ["artificial intelligence", "machine learning", "generative ai", "ai security", "adversarial machine learning", "machine learning security"],
}
OTHER_CATEGORY, EXCLUDED = "general_cybersecurity", ["annual report", "fiscal year"]


def page_flags(text: Column, images: Column) -> Column:
    """struct of a page's figures and flags; reasons are listed in a fixed order."""

    def flags(body: Column) -> Column:
        size = F.length(body)
        low, empty = (size > 0) & (size < LOW_TEXT), size == 0
        scanned = (size < OCR_TEXT) & (images >= OCR_IMAGES)
        reasons = F.array_compact(F.array(F.when(empty, "empty"), F.when(low, "low_text"), F.when(scanned, "suspected_scan"), F.when(F.size(_signs(body)) > 0, "garbled")))
        return F.struct(size.cast("long").alias("text_length"), F.regexp_count(body, F.lit(white(r"(?:[!-~]++|\S)++"))).cast("long").alias("n_words"), empty.alias("is_empty"), low.alias("is_low_text"), scanned.alias("is_scanned"), reasons.alias("reasons"))

    return let(strip(text), flags)


def exempt(word: Column, core: Column) -> Column:
    """Whether a long token is no sign of garbling: digits only, a hex constant, or a slug of short parts."""
    digits = core.rlike(r"^\p{Nd}+$")
    hexadecimal = core.rlike("^0[xX].")
    clean = F.btrim(word, F.lit("()[]{}'\"<>,;`"))
    parts = F.filter(F.split(clean, r"[-_/.:?=&%]+"), lambda p: p != "")
    slug = clean.rlike(r"^[a-zA-Z0-9_\-./?=&%:]+$") & (F.size(parts) > 1) & F.forall(parts, lambda p: F.length(p) <= PART)
    return F.when(digits, True).when(hexadecimal, core.rlike("^0[xX][0-9a-fA-F]+$")).otherwise(slug)


def _signs(body: Column) -> Column:
    """Signs of garbling of a stripped text. Each pattern runs over the text once, and matches what is rare in sound text."""
    size, bare = F.length(body), F.replace(body, F.lit("."), F.lit(""))
    replaced = body.contains("\ufffd") & ((size - F.length(F.replace(body, F.lit("\ufffd"), F.lit("")))) / size > REPLACED)
    controls = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
    control = body.rlike(controls) & ((size - F.length(F.regexp_replace(body, controls + "+", ""))) / size > CONTROL)
    # A text whose every window of four characters has a letter or digit is dense enough; the others are counted.
    thin = bare.rlike(r"[^\p{L}\p{N}]{4}|^[^\p{L}\p{N}]{2}|[^\p{L}\p{N}]{2}$")
    sparse = thin & (F.length(bare) >= 50) & (F.length(F.regexp_replace(bare, r"[^\p{L}\p{N}]+", "")) / F.length(bare) < ALNUM)
    core = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")
    odd = lambda w: ~w.contains("://") & ~w.startswith("www.") & (F.length(w) > LONG_TOKEN) & (F.length(core(w)) > LONG_TOKEN) & ~exempt(w, core(w))
    long_ = body.rlike(rf"[^\t-\r\x1c-\x20]{{{LONG_TOKEN + 1}}}") & F.exists(words(body), odd)  # no long token hides between other white space
    signs = F.array_compact(F.array(F.when(replaced, "replacement"), F.when(control, "control"), F.when(sparse, "low_alnum"), F.when(long_, "long_token")))
    return F.when(size >= 50, signs).otherwise(F.array().cast("array<string>"))


def garbled(text: Column) -> Column:
    """Names of the signs of garbled text, for texts of 50 or more characters."""
    return let(strip(text), _signs)


def inventory(flags: DataFrame) -> DataFrame:
    """Documents from page flags (document_id, text_length, n_words, is_empty, is_low_text, is_scanned, reasons): sums, reasons, status."""
    found = flags.groupBy("document_id").agg(
        F.count("*").alias("n_pages"), F.sum("text_length").alias("text_length"), F.sum("n_words").alias("n_words"), F.count_if("is_empty").alias("n_empty"), F.count_if("is_low_text").alias("n_low_text"), F.count_if("is_scanned").alias("n_scanned"), F.count_if(F.array_contains("reasons", "garbled")).alias("n_garbled")
    )
    reasons = F.array_join(F.array_compact(F.array(F.when(F.col("n_empty") > 0, "empty_pages"), F.when(F.col("n_garbled") > 0, "garbled_pages"), F.when(F.col("n_low_text") > 0, "low_text_pages"), F.when(F.col("n_scanned") > 0, "scanned_pages"))), ",")
    status = F.when(F.col("n_empty") == F.col("n_pages"), "empty").when((F.col("n_scanned") > 0) | (F.col("n_garbled") > 0), "inspect").when((F.col("n_empty") > 0) | (F.col("n_low_text") > 0), "review").otherwise("ready")
    return found.withColumn("reasons", reasons).withColumn("status", status)


def size_text(size: Column) -> Column:
    """Bytes in the largest unit that leaves a number of one or more, with two decimals; whole bytes below 1024."""
    kb, mb, gb = 1024.0, 1024.0**2, 1024.0**3
    shown = lambda x, unit: F.format_string(f"%.2f {unit}", F.bround(x, 2))
    return F.when(size < kb, F.format_string("%d B", size)).when(size < mb, shown(size / kb, "KB")).when(size < gb, shown(size / mb, "MB")).otherwise(shown(size / gb, "GB"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """sha256, n_docs, first_id, last_id of texts that several rows share. Counted with map-side combine, so a hot text needs no one task."""
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n_docs > 1 and sha256 is not null")


def duplicate_peers(docs: DataFrame) -> DataFrame:
    """doc_id, n_peers, first_peer, next_peer: for each row whose text others share, the peer that comes first and the next one in scan order.

    Peers are rows of the same digest, so the whole list of a group follows its order; no group is gathered in one row.
    """
    digest = docs.select("doc_id", F.sha2("text", 256).alias("sha256")).where("sha256 is not null")
    group = digest.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")).where("n > 1")
    ring = digest.join(group, "sha256").withColumn("next_peer", F.lead("doc_id").over(Window.partitionBy("sha256").orderBy("doc_id")))
    return ring.select("doc_id", (F.col("n") - 1).alias("n_peers"), F.when(F.col("doc_id") != F.col("low"), F.col("low")).otherwise(F.col("next_peer")).alias("first_peer"), F.coalesce("next_peer", "low").alias("next_peer"))


def repeated_lines(docs: DataFrame, least: int = 3) -> DataFrame:
    """line, n, n_docs: stripped non-empty lines that stand in least or more places."""
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line")).select("doc_id", strip(F.col("line")).alias("line")).where("line <> ''")
    per_doc = lines.groupBy("line", "doc_id").count()
    return per_doc.groupBy("line").agg(F.sum("count").alias("n"), F.count("*").alias("n_docs")).where(F.col("n") >= least)


#: Entities whose numbers must survive cleaning.
ENTITIES = {"controls": r"[A-Z]{2}-[0-9]+(\([0-9]+\))?", "cves": r"CVE-[0-9]{4}-[0-9]{4,7}", "urls": white(r"https?://[^\s)\]>]+"), "algorithms": r"(AES|SHA|RSA|ECDSA|HMAC|TLS)[-0-9]*", "tables": r"Table [0-9]+", "figures": r"Figure [0-9]+"}


def entities(text: Column) -> Column:
    """struct of the number of entities of each kind."""
    return F.struct(*[F.regexp_count(text, F.lit(p)).cast("long").alias(k) for k, p in ENTITIES.items()])


def category_scores(title: Column) -> Column:
    """array of (score, place, category): keywords of each category that stand in the title as substrings."""
    low = F.lower(F.coalesce(title, F.lit("")))
    lists = F.array(*[F.struct(F.lit(-i).alias("place"), F.lit(c).alias("category"), F.array(*map(F.lit, ks)).alias("keywords")) for i, (c, ks) in enumerate(CATEGORIES.items())])
    return F.transform(lists, lambda x: F.struct(F.size(F.filter(x["keywords"], lambda k: F.contains(low, k))).alias("score"), x["place"].alias("place"), x["category"].alias("category")))


def category(title: Column) -> Column:
    """The category with most keywords in the title; the first one wins ties, without any it is OTHER_CATEGORY."""
    best = F.array_max(category_scores(title))
    return F.when(best["score"] == 0, OTHER_CATEGORY).otherwise(best["category"])


def relevant(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    excluded = F.lit(False)
    for k in EXCLUDED:
        excluded = excluded | low.contains(k)
    return ~excluded & (F.array_max(category_scores(title))["score"] > 0)


def absolute(base: Column, href: Column) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(base, href))


def first_with(html: Column, part: str) -> Column:
    """The href of the first link that has part in it, case aside; null without one."""
    return F.get(F.filter(links(html), lambda a: F.contains(F.lower(a["href"]), F.lit(part))), F.lit(0))["href"]


def publications(pages: DataFrame, series: str, number: str) -> DataFrame:
    """url, number, title of links of pages (page_id, url, html) whose href has series in it and a number; the last of equal urls stays."""
    base = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    found = pages.select("page_id", base.alias("base"), F.posexplode(links(F.col("html"))).alias("at", "a"))
    found = found.where(F.col("a.href").contains(series) & F.col("a.href").rlike(number))
    each = found.select(absolute(F.col("base"), F.col("a.href")).alias("url"), F.regexp_extract("a.href", number, 1).alias("number"), F.col("a.text").alias("title"), "page_id", "at")
    return each.groupBy("url").agg(F.max_by("number", F.struct("page_id", "at")).alias("number"), F.max_by("title", F.struct("page_id", "at")).alias("title"))


def table_issues(headers: Column, rows: Column, rows_count: Column, cols_count: Column) -> Column:
    """Names of structural faults of a table: no rows (then nothing else), ragged, over 70 % empty cells, no headers."""
    cells = F.flatten(rows)
    ragged = F.exists(rows, lambda r: F.size(r) != cols_count)
    empty = F.size(F.filter(cells, lambda c: strip(c) == ""))
    sparse = (F.size(cells) > 0) & (empty / F.size(cells) > 0.70)
    bare = (F.size(headers) <= 0) | F.forall(headers, lambda h: strip(h) == "")
    return F.when(rows_count == 0, F.array(F.lit("no_rows"))).otherwise(F.array_compact(F.array(F.when(ragged, "ragged"), F.when(sparse, "sparse"), F.when(bare, "no_headers"))))


def order_anomalies(blocks: DataFrame) -> DataFrame:
    """page, block, jump: the first paragraph or heading of a page that stands in its predecessor's column more than 80 points above it.

    blocks (page, reading_order, kind, left, top, bottom); pages of fewer than three such blocks have none.
    """
    w = Window.partitionBy("page").orderBy("reading_order")
    seen = blocks.where(F.col("kind").isin("paragraph", "heading"))
    seen = seen.select("page", "reading_order", "bottom", "left", F.lag("left").over(w).alias("before_left"), F.lag("top").over(w).alias("before_top"), F.count("*").over(Window.partitionBy("page")).alias("n"))
    odd = seen.where((F.col("n") >= 3) & (F.abs(F.col("left") - F.col("before_left")) < 30) & (F.col("bottom") < F.col("before_top") - 80))
    return odd.groupBy("page").agg(F.min("reading_order").alias("block"), F.min_by(F.col("before_top") - F.col("bottom"), "reading_order").alias("jump"))


def figure_decision(size: Column, width: Column, height: Column, left: Column, colors: Column) -> Column:
    """struct (keep, reason) of a figure asset; a null size is a missing file. Rules hold in this order."""
    small, large = F.least(width, height), F.greatest(width, height)
    aspect = F.when(small > 0, F.round(large / small, 2)).otherwise(999.0)
    rich = colors >= 8
    ladder = [
        (size.isNull(), False, "file_missing_or_unreadable"),
        (colors <= 1, False, "solid_color_mask_zero_variance"),
        ((left < 30) & (aspect > 8.0), False, "decorative_margin_bar"),
        (aspect > 8.0, False, "extreme_aspect_ratio_hairline"),
        (((width < 40) | (height < 40)) & rich, True, "preserved_small_security_symbol"),
        ((width < 40) | (height < 40), False, "sub_dimension_decorative_icon"),
        ((size < 1000) & rich, True, "preserved_small_rich_symbol"),
        (size < 1000, False, "file_size_under_1000_bytes"),
    ]
    out = F.struct(F.lit(True).alias("keep"), F.lit("retained_genuine_visual_diagram").alias("reason"))
    for test, keep, reason in reversed(ladder):
        out = F.when(test, F.struct(F.lit(keep).alias("keep"), F.lit(reason).alias("reason"))).otherwise(out)
    return out


#: Page sizes in points, and how far a page may be off.
PAPER, PAPER_MARGIN = {"letter": (612, 792), "a4": (595, 842)}, 20


def preflight(width: Column, height: Column, rotation: Column, text_length: Column, images: Column) -> Column:
    """struct (rotated, standard, ocr_candidate) of a page before it is parsed."""
    near = F.lit(False)
    for w, h in PAPER.values():
        near = near | ((F.abs(width - w) <= PAPER_MARGIN) & (F.abs(height - h) <= PAPER_MARGIN))
    return F.struct((rotation != 0).alias("rotated"), near.alias("standard"), ((text_length < OCR_TEXT) & (images >= OCR_IMAGES)).alias("ocr_candidate"))


def embedding_report(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row for vectors (doc_id, embedding) against docs (doc_id): how many, dimensions, element type, and ids that one side lacks."""
    no_vector, no_doc = docs.select("doc_id").join(vectors.select("doc_id"), "doc_id", "left_anti"), vectors.select("doc_id").join(docs.select("doc_id"), "doc_id", "left_anti")
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    counts = vectors.agg(F.count("*").alias("n_vectors"), F.countDistinct(F.size("embedding")).alias("n_dims"), F.max(F.size("embedding")).cast("long").alias("dim"), F.lit(element).alias("element"))
    return counts.crossJoin(no_vector.agg(F.count("*").alias("n_without_vector"))).crossJoin(no_doc.agg(F.count("*").alias("n_without_document")))


def ocr_route(text_length: Column, images: Column, enabled: Column) -> Column:
    """What becomes of a page: no candidate, candidate without an engine, or sent to one."""
    return F.when(~((text_length < OCR_TEXT) & (images >= OCR_IMAGES)), "not_needed").when(enabled, "routed").otherwise("engine_unavailable")
