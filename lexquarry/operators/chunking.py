"""Segments, headings, sections, and the packing of text, tables and figures into chunks.

Headings, paths and groups are expressions and windows over a document's segments. Packing is a fold whose
state is the text held so far, so it runs as one function per document; a document's segments are its
bound.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.functions.text import strip, white

#: Budgets in tokens, and limits of heading detection.
CHUNK_TOKENS, OVERLAP_TOKENS, TABLE_TOKENS, LEGACY_TOKENS, LEAST_BODY, ROW_TOKENS = 500, 50, 500, 600, 20, 480
HEADING_CHARS, TITLE_CHARS, TOP_SECTION = 200, 120, 25
INTRODUCTION = "Introduction"
CHUNKS = "chunk_id string, document_id string, page_start int, page_end int, citation_label string, section_path string, section_heading string, text string, token_count int, char_count int, content_hash string"
LEGACY_CHUNKS = "chunk_id string, doc_id bigint, section string, text string, token_count int"
ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


def estimate(text: str) -> int:
    """Tokens by characters: a quarter of them, one at least; none for an empty text."""
    return max(1, len(text) // 4) if text else 0


def tokens(text: Column) -> Column:
    """The same as a column."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def cut_to(text: Column, limit: int) -> Column:
    """The text cut at its last space within limit estimated tokens."""
    head = F.left(text, F.lit(4 * limit))
    at = F.length(head) - F.locate(" ", F.reverse(head))
    return F.when(F.length(text) <= 4 * limit, text).when(F.locate(" ", F.reverse(head)) == 0, head).otherwise(F.left(head, at))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"^[*_ \t]+|[*_ \t]+$", "")


def heading(text: Column) -> Column:
    """struct (heading, level) of a paragraph; both null if it is none."""
    s = strip(text)
    marks = F.length(F.regexp_extract(s, "^(#+)", 1))
    content = strip(F.regexp_replace(s, "^#+", ""))
    number = F.regexp_extract(s, white(r"^([0-9]+(?:\.[0-9]+)+|[0-9]+\.)\s+([A-Z][^\n]+)$"), 1)
    title = strip(F.regexp_extract(s, white(r"^([0-9]+(?:\.[0-9]+)+|[0-9]+\.)\s+([A-Z][^\n]+)$"), 2))
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    top = F.try_to_number(F.regexp_extract(number, r"^([0-9]+)\.$", 1), F.lit("999999999"))
    numbered = (number != "") & (F.length(title) <= TITLE_CHARS) & ~title.rlike("[.;:,]$") & (top.isNull() | (top <= TOP_SECTION))
    none = F.struct(F.lit(None).cast("string").alias("heading"), F.lit(None).cast("int").alias("level"))
    found = lambda h, level: F.struct(h.alias("heading"), level.cast("int").alias("level"))
    marked = F.when((_bare(content) == "") | _bare(content).rlike("^[0-9]+$"), none).otherwise(found(content, F.least(F.lit(4), marks)))
    return (
        F.when((s == "") | (F.length(s) > HEADING_CHARS), none)
        .when(s.startswith("#"), marked)
        .when(s.rlike(white(r"(?i)^APPENDIX\s+[A-Z0-9]+")) | s.rlike(white(r"(?i)^CHAPTER\s+([A-Z]+|[0-9]+)")), found(s, F.lit(1)))
        .when(s.rlike(white(r"^[A-Z]{2}-[0-9]+(\([0-9]+\))?\s+[A-Z\s]+$")), found(s, F.lit(2)))
        .when(numbered, found(s, F.least(F.lit(3), F.greatest(F.lit(1), dots))))
        .otherwise(none)
    )


def segments(pages: DataFrame, between: str = "\n\n") -> DataFrame:
    """document_id, seq, page_number, text, is_heading, level, section_heading, section_path of pages (document_id, page_number, text).

    Paragraphs that are a number of at most four digits are left out. The path holds, after the level-one heading, the last
    level-two heading (or else the first deeper one), then the last deeper heading below it.
    """
    parts = pages.select("document_id", "page_number", F.posexplode(F.split(F.coalesce("text", F.lit("")), between)).alias("pos", "raw")).withColumn("text", strip(F.col("raw"))).where("text <> ''")
    parts = parts.where(~_bare(F.regexp_replace("text", "^#+", "")).rlike("^[0-9]{1,4}$")).withColumn("h", heading(F.col("text")))
    order = Window.partitionBy("document_id").orderBy("page_number", "pos")
    found = parts.select("document_id", "page_number", F.row_number().over(order).alias("seq"), F.coalesce("h.heading", "text").alias("text"), F.col("h.level").isNotNull().alias("is_heading"), F.col("h.level").alias("level"))
    w = Window.partitionBy("document_id").orderBy("seq")
    marked = found.withColumn("island", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w)).withColumn("section_heading", F.coalesce(F.last(F.when(F.col("is_heading"), F.col("text")), True).over(w), F.lit(INTRODUCTION)))
    i = Window.partitionBy("document_id", "island").orderBy("seq")
    at = lambda test: F.when(test, F.struct("seq", "text"))
    marked = marked.withColumns({"one": F.last(at(F.col("level") == 1), True).over(i), "two": F.last(at(F.col("level") == 2), True).over(i), "deep": F.last(at(F.col("level") >= 3), True).over(i), "first": F.first(at(F.col("level") >= 3), True).over(i)})
    second = F.coalesce("two.text", "first.text")
    third = F.when(F.col("two").isNotNull() & (F.col("deep.seq") > F.col("two.seq")) | F.col("two").isNull() & (F.col("deep.seq") > F.col("first.seq")), F.col("deep.text"))
    path = F.concat_ws(" > ", F.coalesce("one.text", F.lit(INTRODUCTION)), second, third)
    return marked.select("document_id", "seq", "page_number", "text", "is_heading", "level", "section_heading", path.alias("section_path"))


def groups(segs: DataFrame) -> DataFrame:
    """segs with group_no and group_heading: a heading after body text opens a group; headings without body at the end join the last one."""
    w = Window.partitionBy("document_id").orderBy("seq")
    whole = Window.partitionBy("document_id")
    opened = segs.withColumn("g", F.sum(F.when(F.col("is_heading") & ~F.lag("is_heading", 1, True).over(w), 1).otherwise(0)).over(w))
    body = F.count_if(~F.col("is_heading")).over(Window.partitionBy("document_id", "g"))
    last = F.max("g").over(whole)
    merged = opened.withColumn("group_no", F.when((F.col("g") == last) & (body == 0) & (F.col("g") > F.min("g").over(whole)), F.col("g") - 1).otherwise(F.col("g")))
    in_group = Window.partitionBy("document_id", "group_no").orderBy("seq")
    lead = F.sum(F.when(F.col("is_heading"), 0).otherwise(1)).over(in_group)
    run = merged.withColumn("body_before", lead)
    everywhere = Window.partitionBy("document_id", "group_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    title = F.coalesce(F.last(F.when(F.col("is_heading") & (F.col("body_before") == 0), F.col("text")), True).over(everywhere), F.first("section_heading").over(everywhere))
    return run.withColumn("group_heading", title).drop("g", "body_before")


# ---- folds over one document ----

SENTENCE = re.compile(r"""(?<=[.!?])\s+(?=[A-Z0-9(\["'])""")
CLAUSE = re.compile(r"(?<=[;:])\s+")
FINER: list[Callable[[str], list[str]]] = [SENTENCE.split, CLAUSE.split, str.split]


def spread(text: str, limit: int, count: Callable[[str], int], level: int = 0) -> Iterator[str]:
    """Parts of at most limit tokens: sentences, and where one is too long its clauses, then its words. One word stays whole."""
    held = ""
    for piece in filter(None, map(str.strip, FINER[level](text))):
        if level + 1 < len(FINER) and count(piece) > limit:
            if held:
                yield held
            held = ""
            yield from spread(piece, limit, count, level + 1)
        elif held and count(f"{held} {piece}") > limit:
            yield held
            held = piece
        else:
            held = f"{held} {piece}" if held else piece
    if held:
        yield held


def tail(text: str, limit: int, count: Callable[[str], int]) -> str:
    """The last sentences that together have at most limit tokens, with a blank line after them."""
    kept: list[str] = []
    left = limit
    for piece in reversed([s for s in map(str.strip, SENTENCE.split(text)) if s]):
        left -= count(piece)
        if left < 0:
            break
        kept.insert(0, piece)
    return " ".join(kept) + "\n\n" if kept else ""


def pack(body: list[tuple[int, str]], prefix: str, limit: int, overlap: int, count: Callable[[str], int]) -> Iterator[tuple[int, int, str]]:
    """(first page, last page, text) of a section's chunks, each with the section's headings and the end of the one before.

    The overlap is left out where it would break the limit, and from parts of paragraphs that fill chunks alone.
    """
    room = max(LEAST_BODY, limit - count(prefix))
    held: list[tuple[int, str]] = []
    carry = ""

    def text_of(parts: list[tuple[int, str]], lead: str) -> str:
        return (prefix + lead + "\n\n".join(t for _, t in parts)).strip()

    def closed() -> tuple[int, int, str]:
        nonlocal carry, held
        lead = carry if count(text_of(held, carry)) <= limit else ""
        out = (min(p for p, _ in held), max(p for p, _ in held), text_of(held, lead))
        carry = tail("\n\n".join(t for _, t in held), overlap, count)
        held = []
        return out

    for page, paragraph in body:
        if count(paragraph) > room:
            if held:
                yield closed()
            for part in spread(paragraph, room, count):
                yield page, page, (prefix + part).strip()
                carry = tail(part, overlap, count)
            continue
        if held and count(text_of([*held, (page, paragraph)], carry)) > limit:
            yield closed()
        held.append((page, paragraph))
    if held:
        yield closed()


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [c.split() for c in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], ARROW_TYPES[kind]) for k, (name, kind) in enumerate(fields)})


def chunks(grouped: DataFrame, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] = estimate) -> DataFrame:
    """CHUNKS of grouped segments, numbered through each document."""

    def packed(document: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for _, members in groupby(document.sort_by("seq").to_pylist(), itemgetter("group_no")):
            section = list(members)
            first = section[0]
            prefix = "".join(f"### {s['text']}\n\n" for s in section if s["is_heading"])
            body = [(s["page_number"], s["text"]) for s in section if not s["is_heading"]]
            made = pack(body, prefix, limit, overlap, count) if body else [(first["page_number"], first["page_number"], prefix.strip())]
            for start, end, text in made:
                doc = first["document_id"]
                label = f"[{doc} Page {start}]" if start == end else f"[{doc} Pages {start}-{end}]"
                rows.append((f"{doc}_txt_{len(rows) + 1:05d}", doc, start, end, label, first["section_path"], first["group_heading"], text, count(text), len(text), hashlib.sha256(text.encode()).hexdigest() if text else ""))
        return _table(rows, CHUNKS)

    needed = ["document_id", "seq", "group_no", "page_number", "text", "is_heading", "section_path", "group_heading"]
    return grouped.select(*needed).groupBy("document_id").applyInArrow(packed, CHUNKS)


def audit(made: DataFrame, limit: int = CHUNK_TOKENS) -> DataFrame:
    """Faults of chunks by document: empty text, no tokens, pages the wrong way round, over the limit."""
    return made.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.count_if(strip(F.col("text")) == "").alias("n_empty"), F.count_if(F.col("token_count") == 0).alias("n_no_tokens"), F.count_if(F.col("page_start") > F.col("page_end")).alias("n_inverted"), F.count_if(F.col("token_count") > limit).alias("n_oversize"))


def token_stats(made: DataFrame) -> DataFrame:
    """One row: number of chunks, and least, median, mean and greatest token count."""
    return made.agg(F.count("*").alias("n_chunks"), F.min("token_count").alias("least"), F.bround(F.percentile("token_count", F.lit(0.5)), 1).alias("median"), F.bround(F.avg("token_count"), 1).alias("mean"), F.max("token_count").alias("most"))


# ---- the older generation ----


def legacy_heading(line: Column) -> Column:
    """A numbered line of at most 150 characters with up to five levels, or an appendix; null if it is none."""
    s = strip(line)
    pattern = white(r"^([0-9]+(?:\.[0-9]+){0,4})\s+(.+)$")
    numbered = F.concat_ws(" ", F.regexp_extract(s, pattern, 1), strip(F.regexp_extract(s, pattern, 2)))
    return F.when(s.rlike(pattern) & (F.length(s) <= 150), numbered).when(s.rlike(white(r"(?i)^APPENDIX\s+[A-Z0-9]+")), s)


def legacy_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section_no, section, text: the lines between headings, which themselves are left out; headings without lines are lost."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).withColumn("h", legacy_heading(F.col("line")))
    w = Window.partitionBy("doc_id").orderBy("pos")
    marked = lines.withColumn("island", F.count("h").over(w)).withColumn("section", F.coalesce(F.last("h", True).over(w), F.lit(INTRODUCTION))).where("h is null")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    found = marked.groupBy("doc_id", "island", "section").agg(strip(joined).alias("text"))
    return found.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("island")).alias("section_no"), "section", "text")


def legacy_pack(text: str, limit: int = LEGACY_TOKENS, count: Callable[[str], int] = estimate) -> list[str]:
    """Paragraphs joined up to limit tokens; a longer one is cut into slices of four characters a token."""
    out: list[str] = []
    held = ""
    for p in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        joined = f"{held}\n\n{p}" if held else p
        if count(joined) <= limit:
            held = joined
            continue
        if held:
            out.append(held)
        slices = [p[i : i + 4 * limit] for i in range(0, len(p), 4 * limit)] if count(p) > limit else []
        out += slices
        held = "" if slices else p
    return [*out, held] if held else out


def legacy_chunks(sections: DataFrame, limit: int = LEGACY_TOKENS) -> DataFrame:
    """chunk_id ({doc}_{00001}), doc_id, section, text, token_count of legacy sections."""

    def packed(document: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        for r in document.sort_by("section_no").to_pylist():
            for text in legacy_pack(r["text"], limit):
                rows.append((f"{r['doc_id']}_{len(rows) + 1:05d}", r["doc_id"], r["section"], text, estimate(text)))
        return _table(rows, LEGACY_CHUNKS)

    return sections.groupBy("doc_id").applyInArrow(packed, LEGACY_CHUNKS)


def slices(words: Column, size: int) -> Column:
    """Runs of size words of an array, joined by spaces."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
