"""URL filter: rules first, then a tree of path templates for each host.

Rules allow or block a host with all its subdomains, for paths that begin with the rule's; the longest wins.
What they decide labels the tree. A path's segments are nodes below each other. Digits and long hexadecimal numbers
become wildcards by their form; a node with more than ``LITERALS`` different children is variable, and all of
them become one wildcard. Among the children of any other node, those merge with the node's largest that are
statistically similar to it: their children are spread alike (a total variation of at most ``SPREAD``) and their
shares of blocked pages differ by no more than two standard errors; without labelled pages, only with a branch that
has none either. A template, that is host and merged path, is rejected if the smoothed share of its labelled pages
that are blocked is ``REJECT`` or more; ``PRIOR`` is the share of the ``PRIOR_WEIGHT`` pages that every template is
given beforehand, so one without labelled pages is allowed.

Cases: NULL urls, and urls without ``://``, have an empty host and path. An empty path fits no rule, as rules' paths
begin with a slash. Repeated rows are judged each, and each counts. Paths of any depth are taken whole. Only page_id
and url are looked at. In an empty table nothing is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.shared import cut, table

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
LITERALS = 20
SPREAD = 0.2
PRIOR, PRIOR_WEIGHT = 0.25, 4.0
REJECT = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z in lower case, and the path of a url."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and what it decides; NULL if none fits."""
    rule = decision = F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, path = text.partition("/")
        fits = ((F.col("host") == own) | F.col("host").endswith(f".{own}")) & F.col("path").startswith(slash + path)
        rule, decision = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(decision)
    return rule, decision


def shape(segment: Column) -> Column:
    """A segment with numbers as wildcards."""
    # hexadecimal with a digit and a letter; looked for where such a run begins, so the time is linear
    run = r"(?i)(?<![0-9a-f-])(?=[a-f-]*+[0-9])(?=[0-9-]*+[a-f])[0-9a-f-]{12,}+"
    by_hex = F.regexp_replace(segment, run, "{h}")
    return F.regexp_replace(by_hex, r"[0-9]+", "{n}")


def templates(paths: DataFrame) -> DataFrame:
    """The template of each distinct host and path, from ``paths`` (host, path, pages, labelled, blocked).

    The rows hold counts of pages. A node is known by a hash of its host and of the shapes above it.
    """
    shapes = F.transform(F.split("path", "/"), shape)
    nodes = F.transform(
        F.aggregate(
            "shapes",
            F.array(F.xxhash64("host")),
            lambda above, s: F.concat(above, F.array(F.xxhash64(F.element_at(above, -1), s))),
        ),
        lambda node: node,
    )
    spread = paths.withColumn("shapes", shapes).withColumn("nodes", nodes)
    at = F.posexplode(F.arrays_zip("nodes", "shapes", F.expr("slice(shapes, 2, size(shapes))").alias("below")))
    steps = spread.select("host", "path", "pages", "labelled", "blocked", at.alias("place", "step"))
    steps = cut(steps.filter("step.shapes is not null").select("*", "step.nodes", "step.shapes", "step.below").drop("step"))

    sums = [F.sum(c).alias(c) for c in ("pages", "labelled", "blocked")]
    child = steps.groupBy("nodes", "shapes").agg(*sums)
    counted = child.groupBy("nodes").agg((F.count("*") > LITERALS).alias("variable"))
    # below a child: shares of its children, or of one wildcard if they are many
    below = steps.groupBy("nodes", "shapes", F.coalesce("below", F.lit("/")).alias("below")).agg(F.sum("pages").alias("pages"))
    many = below.groupBy("nodes", "shapes").agg((F.count("*") > LITERALS).alias("many"))
    below = below.join(many, ["nodes", "shapes"])
    below = below.groupBy("nodes", "shapes", F.when(F.col("many"), F.lit("*")).otherwise(F.col("below")).alias("below"))
    below = below.agg(F.sum("pages").alias("pages"))
    entry = F.struct(F.col("below").alias("key"), F.col("pages").cast("double").alias("value"))
    below = below.groupBy("nodes", "shapes").agg(F.map_from_entries(F.collect_list(entry)).alias("spread"))  # <= LITERALS

    literal = child.join(counted.filter("not variable").select("nodes"), "nodes").join(below, ["nodes", "shapes"])
    facts = F.struct("pages", F.col("shapes").alias("name"), "labelled", "blocked", "spread")
    ranked = literal.withColumn("facts", facts)
    # at most LITERALS rows for each node
    largest = Window.partitionBy("nodes").orderBy(F.desc("pages"), "shapes")
    ranked = ranked.withColumn("large", F.first("facts").over(largest))
    token = F.when(similar(F.col("facts"), F.col("large")), F.col("large.name")).otherwise(F.col("shapes"))
    named = ranked.select("nodes", "shapes", token.alias("token"))
    variable = child.join(counted.filter("variable").select("nodes"), "nodes").select("nodes", "shapes", F.lit("*").alias("token"))

    joined = steps.select("host", "path", "place", "nodes", "shapes").join(named.union(variable), ["nodes", "shapes"])
    ordered = F.array_sort(F.collect_list(F.struct("place", "token")))  # the segments of one path
    joined = joined.groupBy("host", "path").agg(ordered.alias("found"))
    return joined.select("host", "path", F.array_join(F.col("found.token"), "/").alias("template"))


def similar(one: Column, two: Column) -> Column:
    """Whether two branches spread alike and have like shares of blocked pages."""
    keys = F.array_union(F.map_keys(one["spread"]), F.map_keys(two["spread"]))

    def share(branch: Column, key: Column) -> Column:
        return F.coalesce(branch["spread"][key], F.lit(0.0)) / branch["pages"]

    apart = F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.abs(share(one, k) - share(two, k))) / 2
    n, m = one["labelled"], two["labelled"]
    pooled = (one["blocked"] + two["blocked"] + 1) / (n + m + 2)
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(n, F.lit(1)) + 1 / F.greatest(m, F.lit(1))))
    gap = F.abs(one["blocked"] / F.greatest(n, F.lit(1)) - two["blocked"] / F.greatest(m, F.lit(1)))
    both = (n > 0) & (m > 0) & (gap <= 2 * error)
    return (apart <= SPREAD) & (both | ((n == 0) & (m == 0)))


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each row of ``pages`` (page_id, url)."""
    host, path = host_and_path(F.col("url"))
    rule, decision = fitting_rule(rules)
    urls = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    ruled = urls.select("page_id", host.alias("host"), path.alias("path"))
    ruled = ruled.select("*", rule.alias("rule"), decision.alias("decision"))
    counts = [
        F.count("*").alias("pages"),
        F.count("decision").alias("labelled"),
        F.count_if(F.col("decision") == "block").alias("blocked"),
    ]
    paths = cut(ruled.groupBy("host", "path").agg(*counts))
    named = paths.join(templates(paths), ["host", "path"])
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    purity = (F.col("blocked") + PRIOR_WEIGHT * PRIOR) / (F.col("labelled") + PRIOR_WEIGHT)
    pure = named.groupBy("host", "template").agg(*sums).select("host", "template", purity.alias("purity"))
    found = named.select("host", "path", "template").join(pure, ["host", "template"])
    verdict = F.coalesce("decision", F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow")))
    return ruled.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return judged(table(spark, sf_dir, "pages"))
