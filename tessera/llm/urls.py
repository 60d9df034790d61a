"""URL filtering by host rules and a path-template tree.

Every url is split into host and path. Rules ``(host suffix, path prefix)`` decide
first; the longest that fits wins. The urls that a rule decides are the labels of
the method for the rest:

1. Generalise. Per host, a path's segments become a template of the same length: segments
   of digits, hex strings, dates, long mixed tokens and file names with such stems become
   ``*``. So do the segments below a parent that show more than ``spread`` times the square
   root of the parent's urls in different values: names of a fixed set stay few as urls
   grow, variable ones don't. This is repeated until no parent is left that does.
2. Merge. Siblings in the tree of a host's templates are alike when their blocked share
   differs from their parent's by no more than ``z`` standard errors, or they have no
   labels. Those alike are one branch, those above one and those below one, each with the
   pooled counts and with their subtrees laid over each other.
3. Smooth. A branch's purity is its blocked share, smoothed by ``strength`` pseudo-counts
   of its parent's purity. A host's tree starts from what the same template shows on all
   hosts, that tree from the share of all labels.
4. Reject. A url is blocked when its template's purity is at least ``threshold`` and
   labelled urls support it: some on its host, or some of its template on any host. The
   share of all labels alone blocks nothing.

The tree is walked level by level to the full depth of the paths, as long as a node has
labels and more than one template. Counts are pre-aggregated before each shuffle, and
aggregates are written before they are joined, so that joins on a large host can be
split. Only DataFrame expressions are used; parents are told apart by 64-bit hashes.

Defined results: a null url, or one without ``://``, has an empty host and path; an
empty host belongs to no rule and has a tree of its own; repeated rows are each
judged and count each; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized, only

#: ``(verdict, host suffix, path prefix)``
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VARIABLE = r"^(?:[0-9]+|[0-9a-f]{8,}|[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?|(?=[^/]*[0-9])(?=[^/]*[A-Za-z])[A-Za-z0-9_-]{10,})(\.[a-z0-9]{1,5})?$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text (like ``net/``) and the verdict of the longest rule that fits, or nulls."""

    def fits(suffix: str, prefix: str) -> Column:
        return ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(prefix))

    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    text = F.coalesce(*[F.when(fits(s, p), F.lit(s + p)) for _, s, p in ordered])
    verdict = F.coalesce(*[F.when(fits(s, p), F.lit(v)) for v, s, p in ordered])
    return text, verdict


def judge(
    pages: DataFrame, rules=RULES, spread: float = 3.0, z: float = 2.0, strength: float = 20.0, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``(id, host, path, rule, verdict, template, purity, support)`` of every row.

    ``purity`` is the smoothed blocked share of the url's template, also where a rule
    decides; ``support`` is how many labelled urls are on its host or, if more, of its
    template or the longest part of it that has any.
    """
    host, path = split_url(F.col("url"))
    split = only(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    raw = F.filter(F.split("path", "/"), lambda s: s != "")
    general = F.transform(raw, lambda s: F.when(s.rlike(_VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, _VARIABLE, 1))).otherwise(s))
    urls = split.select("id", "host", "path", rule.alias("rule"), said.alias("said"), general.alias("t"))
    counts = (F.count(F.lit(1)).alias("n"), F.count("said").alias("labelled"), F.count_if(F.col("said") == "block").alias("blocked"))
    leaves = materialized(urls.groupBy("host", "t").agg(*counts), "leaves").withColumn("g", F.col("t"))
    leaves = materialized(_generalised(leaves, spread), "general")
    judged = materialized(_judged(leaves, z, strength), "judged")
    out = urls.join(judged, ["host", "t"], "left")
    verdict = F.coalesce("said", F.when((F.col("support") > 0) & (F.col("purity") >= threshold), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity", "support")


def _generalised(leaves: DataFrame, spread: float) -> DataFrame:
    """Make the segments below a parent wildcards where their values are too many for a fixed set."""
    while True:
        numbered = F.transform(F.col("g"), lambda s, k: F.struct((k + 1).alias("k"), F.xxhash64(F.slice("g", 1, k), k).alias("parent"), s.alias("s")))
        places = leaves.select("host", "t", "n", F.explode(numbered).alias("x")).select("host", "t", "n", "x.*")
        values = places.groupBy("host", "parent", "s").agg(F.sum("n").alias("n"))
        known = values.groupBy("host", "parent").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
        wide = materialized(known.where(F.col("c") > spread * F.sqrt("n")).select("host", "parent"), "wide")
        if wide.isEmpty():
            return leaves
        stars = places.join(wide, ["host", "parent"], "left_semi").groupBy("host", "t").agg(F.collect_set("k").alias("stars"))
        starred = F.transform(F.col("g"), lambda s, k: F.when(F.array_contains("stars", k + 1), F.lit("*")).otherwise(s))
        joined = leaves.join(materialized(stars, "stars"), ["host", "t"], "left")
        leaves = materialized(joined.select("host", "t", "n", "labelled", "blocked", F.when(F.col("stars").isNotNull(), starred).otherwise(F.col("g")).alias("g")), "general")


def _judged(leaves: DataFrame, z: float, strength: float) -> DataFrame:
    """``(host, t, template, purity, support)`` from the tree of all hosts, then each host's own."""
    counts = (F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    total = leaves.agg(*counts).first()
    prior = ((total["blocked"] or 0) + 1.0) / ((total["labelled"] or 0) + 2.0)
    shared = leaves.groupBy("g").agg(*counts).select(F.lit("").alias("host"), "g", "labelled", "blocked", F.lit(prior).alias("purity"), F.lit(0).cast("bigint").alias("support"))
    shared = _walked(materialized(shared, "shared"), z, strength).select("g", "purity", "support")
    own = materialized(leaves.groupBy("host", "g").agg(*counts), "own").join(shared, "g")
    hosts = materialized(own.groupBy("host").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b")), "hosts")
    smooth = (F.col("b") + strength * F.col("purity")) / (F.col("l") + strength)
    rooted = own.join(hosts, "host").select("host", "g", "labelled", "blocked", smooth.alias("purity"), F.greatest("support", "l").alias("support"))
    found = _walked(materialized(rooted, "rooted"), z, strength)
    return leaves.join(found, ["host", "g"]).select("host", "t", F.concat_ws("/", "g").alias("template"), "purity", "support")


def _walked(leaves: DataFrame, z: float, strength: float) -> DataFrame:
    """Smooth ``purity`` of ``(host, g, labelled, blocked, purity, support)`` along the merged branches of each host's tree."""
    names = leaves.columns
    done, active, level = [], leaves.withColumn("branch", F.lit(0).cast("bigint")), 0
    while True:
        level += 1
        done.append(active.where(F.size("g") < level).select(*names))
        below = active.where(F.size("g") >= level).withColumn("s", F.element_at("g", level))
        own = below.groupBy("host", "branch", "s").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count(F.lit(1)).alias("m"))
        own = materialized(own, "siblings")
        if own.isEmpty():
            break
        pool = materialized(own.groupBy("host", "branch").agg(F.sum("l").alias("pl"), F.sum("b").alias("pb")), "pool")
        rate = F.col("pb") / F.greatest("pl", F.lit(1))
        off = F.col("b") / F.greatest("l", F.lit(1)) - rate
        error = F.sqrt(rate * (1 - rate) / F.greatest("l", F.lit(1)))
        side = F.when((F.col("l") == 0) | (F.abs(off) <= z * error + 1e-12), 0).otherwise(F.signum(off).cast("int"))
        sided = materialized(own.join(pool, ["host", "branch"]).select("host", "branch", "s", "l", "m", "b", side.alias("side")), "sides")
        merged = materialized(sided.groupBy("host", "branch", "side").agg(F.sum("l").alias("ml"), F.sum("b").alias("mb"), F.sum("m").alias("mm")), "merged")
        known = materialized(sided.join(merged, ["host", "branch", "side"]).select("host", "branch", "s", "side", "l", "ml", "mb", "mm"), "branches")
        smooth = (F.col("mb") + strength * F.col("purity")) / (F.col("ml") + strength)
        joined = below.join(known, ["host", "branch", "s"]).select(
            "host", "g", "labelled", "blocked", smooth.alias("purity"), F.greatest("support", "l").alias("support"), F.xxhash64("branch", "side", F.lit(level)).alias("branch"), "ml", "mm"
        )
        joined = materialized(joined, "level")
        # without labels nothing changes further down, and one template alone has no other counts there
        ends = (F.col("ml") == 0) | (F.col("mm") == 1)
        done.append(joined.where(ends).select(*names))
        active = joined.where(~ends).drop("ml", "mm")
    return materialized(reduce(DataFrame.union, done), "walked")


def digests(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 6).alias("purity"), "support")
