"""URL filters: fixed rules first, then the labelled purity of path templates.

A page's path becomes a template: digits in a segment become ``#``; under each host, level by
level, sibling branches whose labelled bad rates don't differ from their pool's by more than ``Z``
standard errors are merged into ``*``; one that differs stays apart. Of a node with more than
``MAX_CHILDREN`` different segments, those with few pages each are a pool of their own, into whose
``*`` those without labels go too; the others are merged among themselves, into ``*+``. Segments below
``MAX_DEPTH`` become ``**``, except branches that differ in their labelled rates, at whatever depth. A template's bad rate is smoothed towards its host's, and that
towards the rate of all pages; a template is rejected when the smoothed rate reaches ``LIMIT``.

All steps after the first aggregate work on distinct (host, shape) pairs, so a host with a third
of the pages costs no more than its number of shapes; pages get their shape's verdict, and their label, by joins that spread
the keys of many pages. Column expressions and SQL aggregates only.

Defined results: a null url, or one without ``://``, has empty host and path and is allowed unless
its template is rejected; pages without labels take their host's rate; repeated rows each get a
verdict; of rules of one length the first in order wins; a url of any length is one row; an empty table gives an empty table; other columns aren't read.
"""

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, joined_with_groups, stored

MAX_DEPTH = 6
MAX_CHILDREN = 20
#: A child of a node with many that has this many pages, or more, isn't pooled with the smaller ones.
PAGES_PER_CHILD = 50
Z = 1.96
#: Pages that the prior of a rate counts as.
SMOOTHING = 10.0
LIMIT = 0.5
#: Rules that become one column expression; a longer list is joined as a table.
MAX_RULES = 1000
RULE = "rule string, verdict string"


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``, verdict) that fits the host or a parent domain and the path; and its verdict.

    A rule without a slash is for all paths of its domain, an empty one for the empty host; null rules fit nothing; of rules
    given twice with different verdicts the alphabetically first counts.
    """
    cases = []
    for rule, verdict in sorted((r for r in rules if r[0] is not None), key=lambda r: (-len(r[0]), *r)):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        cases.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not cases:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    found = F.coalesce(*cases)
    return found["rule"], found["verdict"]


def ruled(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (host, path and more) with rule and fixed (its verdict): ``rules`` (rule, verdict) as a table, joined by domain with the different hosts.

    A host carries the rules of its own and its parent domains on, the longest first, of which the path takes the first that fits; the
    same rules fit as in ``matching_rule``.
    """
    parts = F.split("host", "[.]")
    domains = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = rows.select("host").distinct().withColumn("domain", F.explode(domains))
    slash = F.instr("rule", "/")
    domain = F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule"))
    prefix = F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise("")
    cut = rules.where("rule IS NOT NULL").select("rule", F.col("verdict").alias("fixed"), domain.alias("domain"), prefix.alias("prefix"))
    order = F.struct((-F.length("rule")).alias("order"), "rule", "prefix", "fixed")
    of = hosts.join(cut, "domain").groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("rules"))
    first = F.get(F.filter("rules", lambda r: F.col("path").startswith(r["prefix"])), F.lit(0))
    return rows.join(of, "host", "left").withColumn("_first", first).select(*rows.columns, F.col("_first.rule").alias("rule"), F.col("_first.fixed").alias("fixed"))


def _shape(path: Column) -> Column:
    """The path's segments with # for digits."""
    return F.filter(F.split(F.regexp_replace(path, "[0-9]+", "#"), "/"), lambda s: s != "")


def _mixed(tree: DataFrame, level: int) -> tuple[DataFrame, int | None]:
    """The nodes with several shapes and both labels below ``level``, and the first level from there on at which one of them parts."""
    nodes = tree.where(F.size("shape") > level).groupBy("host", "template").agg(F.count(F.lit(1)).alias("shapes"), F.sum("labelled").alias("n"), F.sum("bad").alias("b"), F.min("shape").alias("lo"), F.max("shape").alias("hi"))
    nodes = nodes.where((F.col("shapes") > 1) & (F.col("b") > 0) & (F.col("b") < F.col("n")))
    common = F.array_position(F.zip_with("lo", "hi", lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1
    first = nodes.agg(F.min(common)).first()[0]
    return nodes.select("host", "template"), None if first is None else max(level, first)


def templates(pages: DataFrame) -> DataFrame:
    """The tree of ``pages`` (host, shape, bad): host, shape, template, pages, labelled, bad, rate."""
    tree = pages.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    with Scratch(pages.sparkSession) as kept:
        return stored(_rated(_merged(kept.stored(tree.withColumn("template", F.lit(""))), kept)))


def _merged(tree: DataFrame, kept: Scratch) -> DataFrame:
    """``tree`` with each shape's template."""
    level = 0
    while True:
        below, nodes = level >= MAX_DEPTH, tree
        if level == MAX_DEPTH:
            tree = tree.withColumn("template", F.when(F.size("shape") > MAX_DEPTH, F.concat("template", F.lit("/**"))).otherwise(F.col("template")))
        if below:
            mixed, level = _mixed(tree, level)
            if level is None:
                break
            nodes = tree.join(mixed, ["host", "template"], "left_semi")
        segment = F.get("shape", F.lit(level))
        kids = nodes.where(segment.isNotNull()).groupBy("host", "template", segment.alias("segment")).agg(F.sum("pages").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        thin = F.col("pages") < PAGES_PER_CHILD
        sums = {"branches": F.lit(1), "all": F.col("labelled"), "all_bad": F.col("bad")}
        pool = kids.groupBy("host", "template").agg(*(F.sum(x).alias(n) for n, x in sums.items()), *(F.sum(F.when(thin, x).otherwise(0)).alias(f"thin_{n}") for n, x in sums.items()))
        both = kids.join(pool, ["host", "template"])
        many = F.col("branches") > MAX_CHILDREN
        branches, labelled, bad = (F.when(many & thin, F.col(f"thin_{n}")).when(many, F.col(n) - F.col(f"thin_{n}")).otherwise(F.col(n)) for n in sums)
        rate = (bad + 1) / (labelled + 2)
        error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("labelled"), F.lit(1)))
        alike = F.abs(F.col("bad") / F.greatest(F.col("labelled"), F.lit(1)) - rate) <= Z * error
        merged = (many & thin & (F.col("labelled") == 0)) | ((branches > 1) & (F.col("labelled") > 0) & alike)
        wild = F.when(merged & many & ~thin, "*+").when(merged, "**" if below else "*")
        if below:  # only branches known to differ are kept
            wild = wild.when((F.col("labelled") == 0) | (F.col("branches") == 1), "**")
        named = both.select("host", "template", "segment", wild.otherwise(F.col("segment")).alias("name"))
        tree = tree.withColumn("segment", segment).join(named, ["host", "template", "segment"], "left")
        tree = tree.withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name"))).drop("segment", "name")
        tree = kept.stored(tree)  # the next level reads it twice
        level += 1
    return tree


def _rated(tree: DataFrame) -> DataFrame:
    """``tree`` with the smoothed bad rates of its templates."""
    total = tree.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("n")).select((F.coalesce("b", F.lit(0.0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("prior"))
    hosts = tree.groupBy("host").agg(F.sum("bad").alias("h_bad"), F.sum("labelled").alias("h_labelled")).join(F.broadcast(total))  # one row
    hosts = hosts.select("host", ((F.col("h_bad") + SMOOTHING * F.col("prior")) / (F.col("h_labelled") + SMOOTHING)).alias("h_rate"))
    of = tree.groupBy("host", "template").agg(F.sum("bad").alias("t_bad"), F.sum("labelled").alias("t_labelled")).join(hosts, "host")
    of = of.select("host", "template", ((F.col("t_bad") + SMOOTHING * F.col("h_rate")) / (F.col("t_labelled") + SMOOTHING)).alias("rate"))
    return tree.join(of, ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, limit: float = LIMIT) -> DataFrame:
    """``pages`` (page_id, url, bad: 1, 0 or null) as page_id, host, path, rule, verdict, template, rate.

    ``rules`` (``host/path``, verdict): a list, or a table with columns rule and verdict.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), _shape(path).alias("shape"), "bad")
    tree = templates(rows.select("host", "shape", "bad")).select("host", "shape", "pages", "template", "rate")
    if isinstance(rules, list) and len(rules) > MAX_RULES:
        rules = pages.sparkSession.createDataFrame(rules, RULE)
    if isinstance(rules, list):
        rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
        rows = rows.withColumns({"rule": rule, "fixed": verdict})
    else:
        rows = ruled(rows, rules)
    own = F.when(F.col("rate") >= limit, "block").otherwise("allow")
    return joined_with_groups(rows, tree, ["host", "shape"], "pages").select("page_id", "host", "path", "rule", F.coalesce("fixed", own).alias("verdict"), "template", "rate")


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with ``bad`` from ``labels`` (doc_id, quality, toxic), by the document number in the path."""
    bad = labels.groupBy("doc_id").agg(F.max(((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")).alias("bad"))
    number = F.expr("try_cast(regexp_extract(_path, '/([0-9]+)', 1) AS bigint)")
    unnumbered = -1 - F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 40))  # no document's number: they are spread, and find no label
    rows = pages.select("page_id", "url", path_of(F.col("url")).alias("_path")).select("page_id", "url", F.coalesce(number, unnumbered).alias("doc_id"))
    numbers = rows.where("doc_id >= 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")).join(bad, "doc_id", "left")
    return joined_with_groups(rows, stored(numbers), ["doc_id"], "pages", "left").select("page_id", "url", "bad")
