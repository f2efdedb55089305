"""URL filters by hashed host-suffix and path-prefix expressions.

A rule names a host, which it fits with all subdomains, and the start of a path; the two are its expression. A URL is expanded into
its host suffixes, no longer than a rule's host, with the starts of its path that have the shape of a
rule's path. Both sides meet on 32 bits of the expression's SHA-256; then whole digests are compared, and of the rules
that fit the longest wins.

URLs that no rule can tell apart are one site: they have the same host suffix and path as far as any rule looks. Sites are counted
before anything is shuffled, judged once, and joined back where the pages lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexquarry.llm import common as C

#: Hexadecimal digits of a digest that the join uses.
PREFIX_DIGITS = 8


def _behind_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first :// up to a slash, question mark, number sign or the end, A-Z in lower case; empty without ://."""
    return C.lower_ascii(F.regexp_extract(_behind_scheme(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, number sign or the end; empty without ://."""
    return F.regexp_extract(_behind_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def _suffix(labels: Column, n: Column) -> Column:
    """The last n labels, or all if there are fewer."""
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.translate(path, "/", ""))


def _folders(path: Column, depth: Column) -> Column:
    """The path up to and with its slash number depth; '' for 0."""
    return F.when(depth > 0, F.concat(F.array_join(F.slice(F.split(path, "/"), F.lit(1), depth), "/"), F.lit("/"))).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def compiled(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) as (host, labels, depth, tail, digest, prefix, rule, verdict), one row a host and path.

    depth is the number of slashes of the path, tail the number of characters after the last one. Rules with a null or
    empty host, or a null verdict, are left out; a null path counts as empty; A-Z in hosts are lowered. Of repeated rules
    with different verdicts block stands, or else the last in order.
    """
    r = rules.where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull())
    r = r.select(C.lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("block"), "verdict"))["verdict"].alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return r.select(
        "host",
        F.size(_labels(F.col("host"))).alias("labels"),
        _slashes(F.col("path")).alias("depth"),
        F.length(F.element_at(F.split("path", "/"), -1)).alias("tail"),
        digest.alias("digest"),
        F.left(digest, F.lit(PREFIX_DIGITS)).alias("prefix"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )


def expressions(host: Column, path: Column, labels: int, shapes: list[tuple[int, int]]) -> Column:
    """Digests of all host suffixes of up to so many labels with all path prefixes of the given shapes (slashes, characters after the last one)."""
    shape = F.array(*(F.struct(F.lit(d).alias("depth"), F.lit(t).alias("tail")) for d, t in shapes))
    fits = F.filter(shape, lambda s: s["depth"] <= _slashes(path))
    ends = F.filter(F.transform(fits, lambda s: F.length(_folders(path, s["depth"])) + s["tail"]), lambda n: n <= F.length(path))
    prefixes = F.array_distinct(F.transform(ends, lambda n: F.left(path, n)))
    suffixes = C.let(_labels(host), lambda ls: F.transform(F.sequence(F.lit(1), F.least(F.size(ls), F.lit(labels))), lambda k: _suffix(ls, k)))
    return C.let(prefixes, lambda ps: F.flatten(F.transform(suffixes, lambda h: F.transform(ps, lambda p: _digest(h, p)))))


def _verdicts(sites: DataFrame, known: DataFrame, labels: int, shapes: list[tuple[int, int]]) -> DataFrame:
    """(site, rule, verdict) of the sites that a rule fits."""
    asked = sites.select("site", F.explode(expressions(F.col("site.host"), F.col("site.path"), labels, shapes)).alias("asked")).withColumn("prefix", F.left("asked", F.lit(PREFIX_DIGITS)))
    light = C.light_or_not(known, F.length("rule") + F.length("host") + 200)
    if light is not known:
        met = asked.join(light, "prefix")
    else:  # a prefix that very many sites ask for stays where they are
        counts = asked.groupBy("prefix").agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n")).first()[0] or 0
        groups = known.groupBy("prefix").agg(F.collect_list(F.struct("digest", "host", "rule", "verdict")).alias("of")).join(counts, "prefix")
        met = C.spread_join(asked, groups, "prefix", total).select("site", "asked", F.inline("of"))
    fits = met.where(F.col("asked") == F.col("digest"))
    best = F.max(F.struct(F.length("rule").alias("characters"), F.length("host").alias("of_host"), "rule", "verdict")).alias("best")
    return fits.groupBy("site").agg(best).select("site", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict of their URLs; columns of those names are replaced.

    A rule fits a URL whose host is the rule's or ends with a dot and the rule's, and whose path starts with the rule's. The rule
    with most characters wins, and of equally long ones that with the longer host. Where none fits, rule is null and the
    verdict is default. Null URLs, and those without ://, have an empty host and path, which no rule fits. All rows are kept;
    without rules all have the default.

    The driver sees the rules' greatest number of labels and the distinct shapes of their paths (slashes, characters
    after the last one), never a URL. Hosts and paths are cut only where no rule looks.
    """
    known = C.stored(compiled(rules), "url-rules")
    shapes = sorted((r["depth"], r["tail"]) for r in known.select("depth", "tail").distinct().collect())
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    site, address, rule, verdict = C.fresh(pages, "site", "address", "rule", "verdict")
    rows = pages.withColumn(address, F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))).select(*kept, address)
    host, path = F.col(address)["host"], F.col(address)["path"]
    if not shapes:
        return rows.select(*kept, host.alias("host"), path.alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = known.agg(F.max("labels")).first()[0]
    folders = _folders(path, F.least(_slashes(path), F.lit(max(d for d, _ in shapes))))
    rows = rows.withColumn(site, F.struct(_suffix(_labels(host), F.lit(labels)).alias("host"), F.left(path, F.length(folders) + max(t for _, t in shapes)).alias("path")))
    sites = C.stored(rows.groupBy(F.col(site).alias("site")).agg(F.count("*").alias("n")), "url-sites")
    judged = C.stored(_verdicts(sites, known, labels, shapes), "url-verdicts")
    named = judged.select(F.col("site").alias(site), F.col("rule").alias(rule), F.col("verdict").alias(verdict))
    light = C.light_or_not(named, F.length(F.col(site)["host"]) + F.length(F.col(site)["path"]) + F.length(rule) + 100)
    if light is not named:
        joined = rows.join(light, site, "left")
    else:  # each site goes back by its number of rows: hot ones stay where they are
        counted = sites.select(F.col("site").alias(site), "n").join(named, site, "left")
        joined = C.spread_join(rows.select(*(F.col(c).alias(f"row_{k}") for k, c in enumerate(rows.columns)), F.col(site).alias("key")), counted.withColumnRenamed(site, "key"), "key", sites.agg(F.sum("n")).first()[0] or 0)
        joined = joined.select(*(F.col(f"row_{k}").alias(c) for k, c in enumerate(rows.columns)), rule, verdict)
    return joined.select(*kept, host.alias("host"), path.alias("path"), F.col(rule).alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
