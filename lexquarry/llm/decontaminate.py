"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (term, document, position) for every word of the training documents that is
a word of the benchmark, and one end posting per document, whose position is its number of words. Each
window of a benchmark item is looked up by its two rarest terms: their postings, moved back by the term's place
in the item, must agree on where the item would begin (its diagonal). Diagonals that a window's rarest terms
agree on are compared word by word with the document, and runs of equal words give the exact matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lexquarry.llm import common as C

#: Fixed value: what separates words, once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The term of end postings; no word can be equal to it.
END = "\x00"
RARE = 2


def words(text: Column) -> Column:
    return F.array_remove(F.split(C.lower_ascii(text), BETWEEN), "")


def items_of(benchmark: DataFrame, window: int) -> DataFrame:
    """One row per distinct word sequence: seq (its key), item_ids, words, n."""
    rows = benchmark.where(F.col("item_id").isNotNull()).select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    same = rows.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    key = F.concat_ws(":", F.element_at("item_ids", 1), F.xxhash64("words"))
    return same.select(key.alias("seq"), "item_ids", "words", F.size("words").alias("n"))


def postings(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The stored index: term (hash), doc_id, th (hash of the text), pos."""
    vocabulary = items.select(F.explode(F.concat("words", F.array(F.lit(END)))).alias("w")).select(F.xxhash64("w").alias("term")).distinct()
    end_only = docs.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("term"))
    vocabulary = vocabulary.union(end_only).distinct()
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "w"))
    each = each.select(F.xxhash64("w").alias("term"), "doc_id", "th", "pos")
    return C.stored(each.join(C.small_or_not(vocabulary), "term"), "postings")


def anchors(items: DataFrame, index: DataFrame, window: int) -> DataFrame:
    """items with windows: for each window the places (a, b) of its rarest terms, b null for a one-word window."""
    often = index.groupBy("term").count()
    terms = items.select("seq", "n", F.posexplode("words").alias("off", "w")).select("seq", "n", "off", F.xxhash64("w").alias("term"))
    counted = terms.join(often, "term", "left").select("seq", "n", "off", F.coalesce("count", F.lit(0)).alias("often"))
    ahead = Window.partitionBy("seq").orderBy("off").rowsBetween(0, window - 1)
    rarest = F.slice(F.array_sort(F.collect_list(F.struct("often", "off")).over(ahead)), 1, RARE)
    whole = counted.withColumn("rarest", rarest).where(F.col("off") <= F.greatest(F.col("n") - window, F.lit(0)))
    # A window with a term that no document has cannot occur.
    pair = F.struct(F.col("rarest")[0]["off"].alias("a"), F.get("rarest", F.lit(1))["off"].alias("b"))
    found = whole.where(F.col("rarest")[0]["often"] > 0).groupBy("seq").agg(F.collect_set(pair).alias("windows"))
    return items.join(found, "seq")


def matches(docs: DataFrame, items: DataFrame, index: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """Matches (doc_id, th, seq, start, end, kind); start and end are word places of the document, end exclusive.

    kind 'phrase': a maximal run of words equal to consecutive words of the item, a window long at least (all
    of the item, if that is shorter). With slop > 0 also kind 'proximity': the rarest terms of a window
    stand in the document at distances that differ from the item's by at most slop words.
    """
    known = C.stored(anchors(items, index, window), "anchors")
    places = F.array_distinct(F.filter(F.flatten(F.transform("windows", lambda w: F.array(w["a"], w["b"]))), lambda x: x.isNotNull()))
    wanted = known.select("seq", F.explode(F.transform(places, lambda o: F.struct(o.alias("off"), F.xxhash64(F.get("words", o)).alias("term")))).alias("x")).select("seq", "x.off", "x.term")
    hits = index.join(C.small_or_not(wanted, 200_000), "term").select("seq", "doc_id", "th", (F.col("pos") - F.col("off")).alias("diagonal"), "off")
    small = C.light_or_not(known, F.length(F.concat_ws(" ", "words")) + 24 * F.size("words") + 32 * F.size("windows") + 100)
    both = F.exists("windows", lambda w: F.array_contains("offs", w["a"]) & (w["b"].isNull() | F.array_contains("offs", w["b"])))
    agreed = hits.groupBy("seq", "doc_id", "th", "diagonal").agg(F.collect_set("off").alias("offs")).join(small, "seq").where(both)
    per_doc = agreed.groupBy("doc_id", "th").agg(F.collect_list(F.struct("seq", "diagonal", "n")).alias("tries"))
    per_doc = C.light_or_not(C.stored(per_doc, "tries"), 64 * F.size("tries") + 100).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "tries")
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    joined = read.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")))
    split = joined.select("doc_id", "th", "tries", words(F.col("text")).alias("words"))
    cut = lambda t: F.struct(t["seq"].alias("seq"), t["diagonal"].alias("diagonal"), F.slice("words", F.greatest(t["diagonal"], F.lit(0)) + 1, t["n"] + F.least(t["diagonal"], F.lit(0))).alias("here"))
    cuts = split.select("doc_id", "th", F.explode(F.transform("tries", cut)).alias("c")).select("doc_id", "th", "c.*")
    beside = cuts.join(small.select("seq", "n", F.col("words").alias("item")), "seq")
    there = F.slice("item", 1 - F.least(F.col("diagonal"), F.lit(0)), F.size("here"))
    same = F.array_join(F.zip_with("here", there, lambda a, b: F.when(a == b, "1").otherwise("0")), "")
    marked = beside.select("doc_id", "th", "seq", "n", F.greatest(F.col("diagonal"), F.lit(0)).cast("long").alias("at"), same.alias("same"))
    long_runs = C.spans(F.col("same"), f"1{{{window},}}")
    short = F.when(F.col("same") == F.repeat(F.lit("1"), F.col("n")), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"), F.col("same").alias("hit")))).otherwise(F.expr(C.NO_SPANS))
    runs = marked.select("doc_id", "th", "seq", "at", F.explode(F.when(F.col("n") >= window, long_runs).otherwise(short)).alias("r"))
    exact = runs.select("doc_id", "th", "seq", (F.col("at") + F.col("r.start")).alias("start"), (F.col("at") + F.col("r.end")).alias("end"), F.lit("phrase").alias("kind")).distinct()
    if not slop:
        return exact
    # Diagonals at most slop apart share one of two overlapping cells.
    cell = F.floor(F.col("diagonal") / slop)
    cells = hits.select("seq", "doc_id", "th", "off", (F.col("diagonal") + F.col("off")).alias("pos"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    seen = cells.groupBy("seq", "doc_id", "th", "cell").agg(F.collect_set(F.struct("off", "pos")).alias("seen")).join(small, "seq")
    near = lambda w: F.transform(F.filter("seen", lambda x: x["off"] == w["a"]), lambda x: F.struct(x["pos"].alias("p"), F.filter("seen", lambda y: (y["off"] == w["b"]) & (F.abs((y["pos"] - y["off"]) - (x["pos"] - x["off"])) <= slop)).alias("q")))
    pairs = seen.select("doc_id", "th", "seq", F.explode(F.flatten(F.transform(F.filter("windows", lambda w: w["b"].isNotNull()), near))).alias("x")).select("doc_id", "th", "seq", "x.p", F.explode("x.q").alias("y"))
    return exact.union(pairs.select("doc_id", "th", "seq", F.least("p", "y.pos").cast("long"), (F.greatest("p", "y.pos") + 1).cast("long"), F.lit("proximity")).distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, th (hash of the text), n_words, n_hit, item_ids (sorted as strings) for each row of docs.

    A window is window consecutive words of an item; an item of fewer words, but not none, is one window. Every word
    of a document inside an occurrence of a window is hit once. Items without a word or with a null id
    are passed over; item ids with equal words are all listed. Null and empty texts have no words. Rows that
    repeat an id are each judged on their own text; repeated rows are repeated. Other columns are
    not read. Without documents there are no rows; without items nothing is hit.
    """
    docs = docs.select("doc_id", "text")
    items = C.stored(items_of(benchmark.select("item_id", "text"), window), "items")
    index = postings(docs, items)
    found = matches(docs, items, index, window).join(C.light_or_not(items.select("seq", "item_ids"), 16 * F.size("item_ids") + 100), "seq")
    by_doc = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.transform("item_ids", lambda i: i.cast("string")))))).alias("item_ids"))

    def add(state: Column, r: Column) -> Column:
        fresh = F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(state["upto"], r["start"]))
        return F.struct(F.greatest(state["upto"], r["end"]).alias("upto"), (state["total"] + fresh).alias("total"))

    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("total"))
    hit = by_doc.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.aggregate("runs", zero, add, lambda s: s["total"]).alias("n_hit"), "item_ids")
    ends = index.where(F.col("term") == F.xxhash64(F.lit(END))).select("doc_id", "th", F.col("pos").cast("long").alias("n_words"))
    joined = ends.join(C.light_or_not(C.stored(hit, "hit"), 32 * F.size("item_ids") + 100), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
    return joined.select("doc_id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", F.expr("cast(array() as array<string>)")).alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of docs, all columns, that hold no window of the benchmark."""
    i, th = C.fresh(docs, "id", "th")
    found = contamination(docs, benchmark, window).where("n_hit > 0").select(F.col("doc_id").alias(i), F.col("th").alias(th)).distinct()
    found = C.small_or_not(C.stored(found, "contaminated"))
    return docs.join(found, docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(th)), "left_anti")
