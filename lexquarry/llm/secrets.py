"""Secret scan: fixed patterns, and a battery of randomness tests over long tokens.

A token of 20 or more characters with a letter and a digit is a candidate unless a fixed pattern covers it. Its
encoding (hex, base32, one case with digits, base62, base64) is inferred from its characters, and three tests ask whether it
could be uniform draws from that alphabet: chi-squared of the symbol counts, runs of character classes (digits, capitals,
small letters, marks), and lag-one serial correlation. Fisher's method combines their p-values.

Within each encoding, a Benjamini-Hochberg threshold over the combined p-values of all candidates of all documents decides
which candidates are structured (identifiers, paths, repeated signs); its weights follow a token's bits, its length times
the bits of its alphabet, as longer tokens show structure better. The candidates that stay are secrets. So the share of
random tokens among those that are set aside is bounded by q. Counts are gathered by bins of the weighted p-value, each
taken at its upper end, so that the bound holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexquarry.llm import common as C

#: The three patterns, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ["assign", "access", "hex", "random"]

DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets by encoding; tokens of one case are folded to lower case, '-' and '_' to '+' and '/'.
ALPHABETS = {"hex": DIGITS + "abcdef", "base32": LOWER + "234567", "base36": DIGITS + LOWER, "base62": DIGITS + LOWER.upper() + LOWER, "base64": DIGITS + LOWER.upper() + LOWER + "+/"}
#: Characters of a token that one case's larger alphabets need before ordinary words stand out; other alphabets take all tokens.
LEAST = {"base32": 22, "base36": 22}
BINS_A_DECADE, TOP_BIN = 20, 2000


def _class_changes(alphabet: str) -> tuple[float, float]:
    """Of uniform draws, the probability q that two neighbours differ in class, and that a draw differs from both its neighbours."""
    shares = [sum(f(c) for c in alphabet) / len(alphabet) for f in (str.isdigit, str.isupper, str.islower, lambda c: not c.isalnum())]
    return 1 - sum(p * p for p in shares), sum(p * (1 - p) ** 2 for p in shares)


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z) by the published rational approximation (Abramowitz and Stegun 26.2.17; fixed values)."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _candidates(text: Column, base: Column) -> Column:
    """array of (start, end, encoding, p, bits) for each candidate token outside the base spans; p is that of the battery."""
    outside = lambda c: ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"]))
    found = F.filter(C.spans(text, TOKEN), lambda c: c["hit"].rlike("[0-9]") & c["hit"].rlike("[A-Za-z]") & outside(c))

    def encoding(c: Column) -> Column:
        s = F.regexp_replace(c["hit"], "=+$", "")
        lower = F.lower(s)
        one_case = s.rlike("^[0-9a-z]*$") | s.rlike("^[0-9A-Z]*$")
        name = F.when(one_case & lower.rlike("^[0-9a-f]*$"), "hex").when(one_case & lower.rlike("^[a-z2-7]*$"), "base32").when(one_case, "base36").when(s.rlike("^[0-9A-Za-z]*$"), "base62").otherwise("base64")
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), F.when(one_case, lower).otherwise(F.translate(s, "-_", "+/")).alias("s"), name.alias("encoding"))

    def by_encoding(name: Column, values: dict[str, object]) -> Column:
        out = F.lit(None)
        for key, value in values.items():
            out = F.when(name == key, F.lit(value)).otherwise(out)
        return out

    def values(c: Column) -> Column:
        alphabet = by_encoding(c["encoding"], ALPHABETS)
        signs = lambda x: F.regexp_extract_all(x, F.lit("."), F.lit(0))
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c["s"], "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[+/]", "-")
        squares = F.aggregate(signs(alphabet), F.lit(0.0), lambda acc, x: acc + F.pow((F.length(c["s"]) - F.length(F.replace(c["s"], x, F.lit("")))).cast("double"), F.lit(2.0)))
        return F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), F.length(c["s"]).cast("double").alias("n"), F.length(alphabet).cast("double").alias("k"),
            squares.alias("squares"), F.transform(signs(c["s"]), lambda x: F.instr(alphabet, x).cast("double") - 1).alias("v"), signs(classes).alias("classes"),
        )

    def neighbours(array: Column, n: Column, f) -> Column:
        m = n.cast("int") - 1
        return F.aggregate(F.zip_with(F.slice(array, F.lit(1), m), F.slice(array, F.lit(2), m), f), F.lit(0.0), lambda acc, x: acc + x)

    def sums(c: Column) -> Column:
        k, mid = c["k"], (c["k"] - 1) / 2
        changes = neighbours(c["classes"], c["n"], lambda a, b: F.when(a != b, 1.0).otherwise(0.0))
        product = neighbours(c["v"], c["n"], lambda a, b: (a - mid) * (b - mid))
        return F.struct(*[c[x].alias(x) for x in ("start", "end", "encoding", "n", "k")], (k / c["n"] * c["squares"] - c["n"]).alias("chi"), changes.alias("changes"), (product / ((k * k - 1) / 12)).alias("product"))

    def tests(c: Column) -> Column:
        df, m = c["k"] - 1, c["n"] - 1
        z_chi = (F.pow(F.greatest(c["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        q = by_encoding(c["encoding"], {e: _class_changes(a)[0] for e, a in ALPHABETS.items()})
        both = by_encoding(c["encoding"], {e: _class_changes(a)[1] for e, a in ALPHABETS.items()})
        z_runs = (c["changes"] - m * q) / F.sqrt(m * q * (1 - q) + 2 * (m - 1) * (both - q * q))
        z_serial = c["product"] / F.sqrt(m)
        p = F.array(_upper_tail(z_chi), 2 * _upper_tail(F.abs(z_runs)), 2 * _upper_tail(F.abs(z_serial)))
        evidence = F.aggregate(p, F.lit(0.0), lambda acc, x: acc - F.log(F.greatest(x, F.lit(1e-100))))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), evidence.alias("evidence"), (c["n"] * F.log2(c["k"])).alias("bits"))

    def combined(c: Column) -> Column:
        e = c["evidence"]  # Fisher: twice the evidence is chi-squared with six degrees of freedom
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["encoding"].alias("encoding"), F.least(F.lit(1.0), F.exp(-e) * (1 + e + e * e / 2)).alias("p"), c["bits"].alias("bits"))

    out = F.filter(F.transform(found, encoding), lambda c: F.length(c["s"]) >= F.coalesce(by_encoding(c["encoding"], LEAST), F.lit(20)))
    return F.transform(F.transform(F.transform(F.transform(out, values), sums), tests), combined)


def _base(text: Column, kind: str) -> Column:
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}[kind]
    found = C.spans(text, pattern)
    if kind == "assign":
        found = F.filter(found, lambda c: F.length(F.regexp_extract(c["hit"], ASSIGN, 2)) >= 12)
    if kind == "access":
        found = F.filter(found, lambda c: F.length(c["hit"]) >= 18)
    return F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), c["end"].alias("end")))


def inspected(docs: DataFrame, base: str, candidates: str, text: str = "text") -> DataFrame:
    """docs with columns of those names: spans by the fixed patterns (start, kind, end), and tested tokens."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.withColumn(base, F.array_sort(F.concat(*[_base(body, kind) for kind in KINDS[:3]])))
    return found.withColumn(candidates, _candidates(body, F.col(base)))


def _bin(p: Column, weight: Column) -> Column:
    return F.least(F.lit(TOP_BIN), F.greatest(F.lit(0), F.floor(-F.log10(F.greatest(p / weight, F.lit(1e-300))) * BINS_A_DECADE))).cast("int")


def threshold(candidates: DataFrame, q: float = 0.05) -> dict[str, tuple[float, int]]:
    """By encoding, (mean bits, lowest bin that is structured) over a table of the candidates of all rows in one array column.

    A row for each encoding reaches the driver. Where nothing is structured the bin is beyond the top.
    """
    (column,) = candidates.columns
    each = candidates.select(F.explode(column).alias("c")).select("c.*")
    # Exact: weights need the mean first, so equal candidates are counted once, then binned.
    cells = each.groupBy("encoding", "p", "bits").count()
    family = cells.groupBy("encoding").agg(F.sum("count").alias("m"), (F.sum(F.col("count") * F.col("bits")) / F.sum("count")).alias("mean"))
    bins = cells.join(F.broadcast(family), "encoding").groupBy("encoding", "m", "mean", _bin(F.col("p"), F.col("bits") / F.col("mean")).alias("bin")).agg(F.sum("count").alias("n"))
    reached = F.sum("n").over(Window.partitionBy("encoding").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))  # TOP_BIN + 1 rows at most
    ok = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE) * F.col("m") <= q * F.col("reached")
    lowest = bins.withColumn("reached", reached).groupBy("encoding").agg(F.first("mean").alias("mean"), F.min(F.when(ok, F.col("bin"))).alias("lowest"))
    return {r["encoding"]: (r["mean"], TOP_BIN + 1 if r["lowest"] is None else r["lowest"]) for r in lowest.collect()}


def decided(base: Column, candidates: Column, limits: dict[str, tuple[float, int]]) -> Column:
    """Base spans and the candidates that are not structured, sorted by start, then kind."""

    def is_secret(c: Column) -> Column:
        out = F.lit(True)  # an encoding without limits has no candidates
        for name, (mean, lowest) in limits.items():
            out = F.when(c["encoding"] == name, _bin(c["p"], c["bits"] / mean) < lowest).otherwise(out)
        return out

    added = F.transform(F.filter(candidates, is_secret), lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return F.array_sort(F.concat(base, added))


def scan(docs: DataFrame, q: float = 0.05, keep_text: bool = False) -> DataFrame:
    """docs' other columns than text with base and spans (replaced if docs has them): arrays of (start, kind, end), kind an index of KINDS.

    Places are code points of the whole text, end exclusive. Every row is scanned and kept, repeated
    rows too; null counts as empty; an empty table gives an empty table. The tested rows are stored once in the shared
    folder, without texts unless keep_text.
    """
    docs = docs.drop("base", "spans")
    (tested,) = C.fresh(docs, "tested")
    found = inspected(docs, "base", tested)
    found = C.stored(found if keep_text else found.drop("text"), "secrets")
    return found.withColumn("spans", decided(F.col("base"), F.col(tested), threshold(found.select(tested), q))).drop(tested)


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, or run of overlapping ones, replaced by a mark. Null stays null."""

    def kept(upto: Column) -> Column:
        before = F.transform(spans, lambda s, i: F.struct(F.when(i == 0, 0).otherwise(F.get(upto, i - 1)).cast("long").alias("start"), s["start"].alias("end")))
        last = F.struct(F.element_at(upto, -1).alias("start"), F.length(text).cast("long").alias("end"))
        return F.concat(F.filter(before, lambda r: r["end"] >= r["start"]), F.array(last))

    upto = C.running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, F.array_join(C.cuts(text, C.let(upto, kept)), mark)).otherwise(text)


def redacted(docs: DataFrame, q: float = 0.05, mark: str = "[SECRET]") -> DataFrame:
    """docs, all rows and columns, with secrets in text replaced by a mark; n_chars, where there is one, follows the text.

    The threshold is taken over all rows first; then each text is scanned again and rewritten.
    """
    base, tested, spans = C.fresh(docs, "base", "tested", "spans")
    limits = threshold(inspected(docs.select("text"), "base", "tested").select("tested"), q)
    found = inspected(docs, base, tested).withColumn(spans, decided(F.col(base), F.col(tested), limits))
    out = found.withColumn("text", redact(F.col("text"), F.col(spans), mark))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select([F.col(f"`{c}`") for c in docs.columns])
