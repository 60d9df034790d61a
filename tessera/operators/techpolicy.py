"""Technology policies: what a policy text forbids, allows and bounds by version, and which solutions it meets.

A policy's lines are read once to an index of its own: forbidden phrases, each with what is
reported for it, and version bounds of products as sorted lists of ``(product, key, label)``, where keys
are four numbers that compare in order. A solution is read to its text in plain tokens and its
mentions of product versions. A pair of solution and policy then needs one join and no row
for each phrase or mention.

Defined results: null texts forbid and mention nothing; lines are cut at line ends and semicolons;
a line that both forbids and allows forbids; a solution or policy whose id is null joins nothing;
repeated pairs are judged once; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import version_key

#: Words that forbid and allow: fixed values.
FORBIDDING = ("forbid", "forbidden", "must not", "shall not", "deprecated", "not recommended", "запрещ", "нельзя", "не допуска", "не рекоменду")
ALLOWING = ("allow", "allowed", "approved", "recommended", "разреш", "допуска", "рекоменд")
#: Products, how they are written, and how a version follows: fixed values.
PRODUCTS = {
    "ubuntu": (r"ubuntu", r"(\d+(?:\.\d+)*)(?:\s+lts)?"),
    "debian": (r"debian", r"(\d+(?:\.\d+)*)"),
    "centos": (r"centos", r"(\d+(?:\.\d+)*)"),
    "rhel": (r"rhel", r"(\d+(?:\.\d+)*)"),
    "red hat": (r"red\s+hat(?:\s+enterprise\s+linux)?", r"(\d+(?:\.\d+)*)"),
    "oracle linux": (r"oracle\s+linux", r"(\d+(?:\.\d+)*)"),
    "rocky linux": (r"rocky\s+linux", r"(\d+(?:\.\d+)*)"),
    "alma linux": (r"alma\s*linux", r"(\d+(?:\.\d+)*)"),
    "windows server": (r"windows\s+server", r"(\d{4})(?:\s+r2)?"),
    "postgres": (r"postgres(?:ql)?", r"(\d+(?:\.\d+)*)"),
    "java": (r"java", r"(\d+)"),
}
BELOW = r"(?:<|ниже|меньше|старее|до|below|less\s+than|lower\s+than|older\s+than|earlier\s+than|before)\s+(\d+(?:\.\d+)*)"
#: Words that are no part of a phrase: fixed values.
STOPWORDS = ("status", "статус", "разрешено", "запрещено", "forbidden", "allowed", "must", "shall", "not", "не", "для", "всех", "серверов", "требуется", "установка")
#: Words that don't show that a solution follows a standard: fixed values.
EMPTY_WORDS = ("and", "the", "for", "with", "без", "или")


def plain(text: Column) -> Column:
    """Lower-case tokens of letters, digits and ``.+#``; a dot stays beside a digit."""
    low = F.translate(F.lower(F.coalesce(text, F.lit(""))), "ё—–|", "е   ")
    kept = F.regexp_replace(F.regexp_replace(low, r"[^a-zа-я0-9.+#]+", " "), r"(?<!\d)\.(?!\d)", " ")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def _any_of(low: Column, markers: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(low, F.lit(m))
    return found


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?U)\b{pattern}\b"), F.lit(group))


def phrases(text: Column) -> Column:
    """Products with their versions, as they are written in plain text."""
    return F.array_distinct(F.concat(*[_all(text, rf"(?:{name})\s+(?:{version})", 0) for name, version in PRODUCTS.values()]))


def mentions(text: Column) -> Column:
    """``(product, key, label, phrase)`` of the versions mentioned in plain text, by product."""

    def of(product: str, name: str, version: str) -> Column:
        both = F.arrays_zip(_all(text, rf"(?:{name})\s+(?:{version})", 1).alias("label"), _all(text, rf"(?:{name})\s+(?:{version})", 0).alias("phrase"))
        return F.transform(both, lambda m: F.struct(F.lit(product).alias("product"), version_key(m["label"]).alias("key"), m["label"].alias("label"), m["phrase"].alias("phrase")))

    return F.concat(*[of(p, *x) for p, x in PRODUCTS.items()])


def products(text: Column) -> Column:
    named = [F.when(text.rlike(rf"(?U)\b{name}\b"), F.lit(p)) for p, (name, _) in PRODUCTS.items()]
    return F.filter(F.array(*named), lambda p: p.isNotNull())


def _near_marker(line: Column, low: Column) -> Column:
    """Up to six words before and after the first forbidding marker."""
    places = F.array(*[F.nullif(F.instr(low, m), F.lit(0)) for m in FORBIDDING])
    at = F.array_min(places)
    words = lambda part: F.filter(F.split(plain(part), " "), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    before, after = words(F.substring(line, F.lit(1), at - 1)), words(F.substring(line, at, F.char_length(line)))
    sides = F.array(F.slice(before, F.greatest(F.lit(1), F.size(before) - 5), F.lit(6)), F.slice(after, 1, 6))
    enough = F.filter(sides, lambda s: (F.size(s) >= 2) | F.exists(s, lambda w: w.rlike(r"\d")))
    return F.transform(enough, lambda s: F.array_join(s, " "))


def policy_index(policies: DataFrame, id_col: str = "policy", text_col: str = "text") -> DataFrame:
    """``(policy, forbidden, below)``: phrases as ``(phrase, hit)`` and bounds as ``(product, key, label)``, sorted.

    A forbidden phrase is reported with the lowest allowed version above it, if the
    policy has one.
    """
    lines = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\n\r;]+"), lambda x: F.trim(x) != "")
    # only lines that say something leave the text, each with the line before, which names the product where a forbidding line doesn't
    marker = "|".join(FORBIDDING + ALLOWING)
    both = F.arrays_zip(F.col("lines").alias("line"), F.concat(F.array(F.lit("")), F.col("lines")).alias("before"))
    said = F.filter(both, lambda x: F.regexp_like(F.translate(F.lower(x["line"]), "ё", "е"), F.lit(marker)))
    rows = policies.select(F.col(id_col).alias("policy"), lines.alias("lines")).select("policy", F.explode(said).alias("x"))
    rows = rows.select("policy", "x.line", F.coalesce("x.before", F.lit("")).alias("before"), F.translate(F.lower("x.line"), "ё", "е").alias("low"))
    rows = rows.withColumns({"forbids": _any_of(F.col("low"), FORBIDDING), "allows": _any_of(F.col("low"), ALLOWING)})
    rows = rows.withColumns({"text": plain(F.col("line")), "earlier": plain(F.col("before"))})
    own, named = phrases(F.col("text")), products(F.col("text"))
    told = F.concat(F.when(F.size(own) > 0, own).otherwise(phrases(F.col("earlier"))), _near_marker(F.col("line"), F.col("low")))
    told = F.filter(told, lambda p: (p != "") & ~p.isin(*STOPWORDS))
    bound = F.flatten(F.transform(F.when(F.size(named) > 0, named).otherwise(products(F.col("earlier"))), lambda p: F.transform(F.regexp_extract_all("text", F.lit(BELOW), F.lit(1)), lambda v: F.struct(p.alias("product"), version_key(v).alias("key"), v.alias("label")))))
    allowed = F.transform(mentions(F.col("text")), lambda m: F.struct(m["product"].alias("product"), m["key"].alias("key"), m["label"].alias("label")))
    # null, which isn't gathered, where a line says nothing of the kind: an empty list of the same expression would be worked out
    kept = rows.select("policy", F.when(F.col("forbids"), told).alias("told"), F.when(F.col("forbids"), bound).alias("bound"), F.when(~F.col("forbids"), allowed).alias("allowed"))
    gathered = kept.groupBy("policy").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("told", "bound", "allowed")])

    def hit(phrase: Column) -> Column:
        # the lists are sorted, so the first allowed version above a mention is the lowest
        above = F.transform(mentions(phrase), lambda m: F.get(F.filter("allowed", lambda a: (a["product"] == m["product"]) & (m["key"] < a["key"])), F.lit(0))["label"])
        floor = F.get(F.filter(above, lambda v: v.isNotNull()), F.lit(0))
        return F.struct(phrase.alias("phrase"), F.when(floor.isNotNull(), F.concat(phrase, F.lit(" < "), floor)).otherwise(phrase).alias("hit"))

    said = gathered.select("policy", F.transform("told", hit).alias("forbidden"), F.col("bound").alias("below"))
    empty = [F.coalesce(c, F.from_json(F.lit("[]"), said.schema[c].dataType.simpleString())).alias(c) for c in ("forbidden", "below")]
    return policies.select(F.col(id_col).alias("policy")).distinct().join(said, "policy", "left").select("policy", *empty)


def conflicts(solutions: DataFrame, policies: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(solution, policy, hits, aligned, status)`` of each distinct pair of ``(solution, text)`` and ``(policy, text)``.

    ``status`` is failed if anything forbidden is used, passed if a word of the solution occurs in
    the policy, warning otherwise.
    """
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[a-z0-9_\-\.]{3,}"), F.lit(0)), lambda w: ~w.isin(*EMPTY_WORDS)))
    used = solutions.select("solution", plain(F.col("text")).alias("plain"), words.alias("words")).withColumn("mentions", mentions(F.col("plain")))
    # only policies that a pair names are parsed: the others judge nothing
    policies = policies.join(pairs.select("policy").distinct(), "policy", "left_semi")
    index = policy_index(policies).join(policies.select("policy", F.lower(F.coalesce("text", F.lit(""))).alias("standard")), "policy")
    both = pairs.select("solution", "policy").distinct().join(used, "solution").join(index, "policy")
    padded = F.concat(F.lit(" "), "plain", F.lit(" "))
    direct = F.transform(F.filter("forbidden", lambda p: F.contains(padded, F.concat(F.lit(" "), p["phrase"], F.lit(" ")))), lambda p: p["hit"])
    older = F.flatten(F.transform("mentions", lambda m: F.transform(F.filter("below", lambda b: (b["product"] == m["product"]) & (m["key"] < b["key"])), lambda b: F.concat(m["phrase"], F.lit(" < "), b["label"]))))
    hits = F.array_sort(F.array_distinct(F.concat(direct, older)))
    aligned = F.exists("words", lambda w: F.contains(F.col("standard"), w))
    out = both.select("solution", "policy", hits.alias("hits"), aligned.alias("aligned"))
    return out.withColumn("status", F.when(F.size("hits") > 0, "failed").when(F.col("aligned"), "passed").otherwise("warning"))
