"""Rules on a described solution that need its components, integrations, sections and task.

Tables, each with the solution's key:
``components`` (component_id, name, description, layer, external, and technology_stack if known), ``integrations``
(from_id, to_id, protocol), ``sections`` (section, text, sort_order), ``statements``
(text) and ``tasks`` (text). Fragments meet their solution's distinct names in blocks, tokens meet on
the token: no row of a pair is made, and only flags are aggregated, never texts.

Defined results: null and empty names, texts and ids match nothing; repeated rows count
as often as they stand there for duplicate names and once elsewhere; where no component of a
solution has an id, its integrations can't dangle; a solution without components has no
row of layers and is consistent unless claims contradict; one without sections has no order;
empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say two layers are connected: fixed values.
BUSINESS_TO_APPLICATION = (
    "support", "supports", "supported", "implement", "implements", "realize", "realizes", "handle", "handles", "orchestr", "use", "uses", "using", "through", "via", "mapped", "backed", "automate", "drives",
    "поддерж", "реализ", "использ", "через", "обеспеч", "автоматиз", "оркестр", "обрабаты",
)
APPLICATION_TO_TECHNOLOGY = (
    "host", "hosts", "hosted", "run on", "runs on", "deploy", "deployed", "execution", "runtime", "storage", "container", "node", "cluster", "kubernetes", "database", "redis", "postgres", "infra", "platform",
    "размещ", "запуска", "исполня", "хост", "кластер", "контейнер", "база данных",
)
#: Claims that facts can contradict, and online protocols: fixed values.
NO_INTEGRATIONS = ("без интегра",)
NO_API = ("без api", "api не требуется", "api не нужен")
ONLY_INTERNAL = ("без внешн", "только внутрен")
ONLY_BATCH = ("только batch", "только пакет", "только оффлайн")
ONLINE = ("http", "rest", "grpc", "websocket", "api")
#: Tokens that every solution has, and that connect nothing: fixed values.
DOMAIN_STOPWORDS = (
    "business", "application", "technology", "service", "system", "process", "component", "role", "office", "node", "runtime", "cluster", "platform", "module", "adapter", "gateway", "layer", "api",
    "данных", "данные", "сервис", "система", "процесс", "компонент", "платформа", "кластер", "узел",
)
#: Task words that trace nothing, and how many of the others are looked for: fixed values.
TASK_STOPWORDS = ("which", "that", "with", "from", "this", "для", "надо", "нужно", "будет", "система")
TASK_TOKENS = 24
#: About so many distinct names of a solution are looked for in a fragment at once.
NAMES = 512


def any_in(text: Column, words: Sequence[str]) -> Column:
    """The text holds one of the words; false for null."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False)), F.lit(False))


def domain_tokens(text: Column, stopwords: Sequence[str] = DOMAIN_STOPWORDS) -> Column:
    """The sorted distinct tokens of four and more letters, digits, dashes; without outer dashes and stop words."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-zа-я0-9_\-]{4,}"), 0), lambda t: F.trim(t, F.lit("_-")))
    return F.array_sort(F.array_distinct(F.filter(found, lambda t: (t != "") & ~t.isin(*stopwords))))


def _edges(layers: DataFrame, integrations: DataFrame, key: str) -> DataFrame:
    ends = layers.where("component_id IS NOT NULL").select(key, "component_id", "layer").distinct()
    near, far = ends.select(key, F.col("component_id").alias("from_id"), F.col("layer").alias("a")), ends.select(key, F.col("component_id").alias("to_id"), F.col("layer").alias("b"))
    return integrations.select(key, "from_id", "to_id").distinct().join(near, [key, "from_id"]).join(far, [key, "to_id"]).where("a <> b").select(key, F.lit("edge").alias("kind"))


def _overlaps(layers: DataFrame, stopwords: Sequence[str], key: str) -> DataFrame:
    said = [c for c in ("name", "description", "technology_stack") if c in layers.columns]
    tokens = layers.select(key, "layer", F.explode(domain_tokens(F.concat_ws(" ", *said), stopwords)).alias("token"))
    return tokens.groupBy(key, "token").agg(F.min("layer").alias("a"), F.max("layer").alias("b")).where("a <> b").select(key, F.lit("overlap").alias("kind"))


def _relations(layers: DataFrame, sections: DataFrame, patterns: Sequence[str], left: str, right: str, key: str) -> DataFrame:
    """A fragment with a pattern and a name of each layer.

    A fragment is shuffled once, to the blocks of its solution's distinct names; only those that find
    one layer in a block, where there are several, meet again.
    """
    raw = sections.select(key, F.explode(F.split(F.lower("text"), r"[\n.;:!?]+")).alias("raw"))
    some = raw.select(key, F.trim(F.regexp_replace("raw", r"\s+", " ")).alias("fragment")).where(any_in(F.col("fragment"), patterns)).where("fragment <> ''")
    names = layers.select(key, F.lower(F.trim("name")).alias("n"), "layer").where("n <> ''").distinct()
    blocks = names.withColumn("blocks", F.ceil(F.count(F.lit(1)).over(Window.partitionBy(key)) / NAMES).cast("int"))
    blocks = blocks.groupBy(key, "blocks", F.pmod(F.xxhash64("n"), F.col("blocks")).alias("block")).agg(*[F.collect_list(F.when(F.col("layer") == x, F.col("n"))).alias(f"names_{k}") for k, x in (("a", left), ("b", right))])
    found = lambda k: F.exists(f"names_{k}", lambda n: F.contains("fragment", n)).alias(k)
    hits = some.join(blocks, key).select(key, "blocks", "fragment", found("a"), found("b"))
    split = hits.where("blocks > 1 AND a <> b").groupBy(key, "fragment").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    both = hits.where("a AND b").select(key).union(split.where("a AND b").select(key))
    return both.select(key, F.lit("relation").alias("kind"))


def layer_links(components: DataFrame, integrations: DataFrame, sections: DataFrame, left: str, right: str, patterns: Sequence[str], missing: str = "warning", stopwords: Sequence[str] = DOMAIN_STOPWORDS, key: str = "solution_id") -> DataFrame:
    """``(key, left_n, right_n, relation, edge, overlap, status)``: how two layers of each solution are connected.

    relation: a fragment of either layer's section has a pattern and names of both; edge:
    an integration in either direction; overlap: a shared token of names, descriptions and technology.
    ``missing`` is the status where the right layer has no components.
    """
    layers = components.where(F.col("layer").isin(left, right))
    kinds = _edges(layers, integrations, key).union(_overlaps(layers, stopwords, key)).union(_relations(layers, sections.where(F.col("section").isin(left, right)), patterns, left, right, key))
    flags = kinds.groupBy(key).agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in ("relation", "edge", "overlap")])
    sizes = components.groupBy(key).agg(F.count_if(F.col("layer") == left).alias("left_n"), F.count_if(F.col("layer") == right).alias("right_n"))
    rows = sizes.join(flags, key, "left").fillna(False, ["relation", "edge", "overlap"])
    status = F.when(F.col("left_n") == 0, "not_applicable").when(F.col("right_n") == 0, missing).when(F.col("relation") | F.col("edge") | F.col("overlap"), "passed").otherwise("warning")
    return rows.withColumn("status", status)


def consistency(components: DataFrame, integrations: DataFrame, sections: DataFrame, statements: DataFrame, no_integrations=NO_INTEGRATIONS, no_api=NO_API, only_internal=ONLY_INTERNAL, only_batch=ONLY_BATCH, online=ONLINE, key: str = "solution_id") -> DataFrame:
    """``(key, duplicates, dangling, contradictions, status)`` of each solution of any of the tables.

    dangling: integrations with an end that is no component, of solutions whose components have ids. contradictions: kinds of
    claims in the statements, or in the sections of a solution without any, that the
    facts contradict.
    """
    named = components.groupBy(key, "name").agg(F.count(F.lit(1)).alias("n"), F.bool_or("external").alias("external"))
    own = named.groupBy(key).agg(F.sum(F.col("n") - 1).alias("duplicates"), F.coalesce(F.bool_or("external"), F.lit(False)).alias("external"))
    ids = components.where("component_id IS NOT NULL").select(key, "component_id").distinct()
    ends = [ids.select(key, F.col("component_id").alias(end), F.lit(True).alias(f"has_{end}")) for end in ("from_id", "to_id")]
    known = integrations.join(ends[0], [key, "from_id"], "left").join(ends[1], [key, "to_id"], "left")
    known = known.join(ids.select(key, F.lit(True).alias("ids")).distinct(), key, "left")
    loose = F.col("ids").isNotNull() & (F.col("has_from_id").isNull() | F.col("has_to_id").isNull())
    joints = known.groupBy(key).agg(F.count(F.lit(1)).alias("joints"), F.count_if(loose).alias("dangling"), F.bool_or(any_in(F.lower("protocol"), online)).alias("online"))
    claims = {"no_joints": no_integrations, "no_api": no_api, "internal": only_internal, "batch": only_batch}
    said = [F.bool_or(any_in(F.lower("text"), words)).alias(c) for c, words in claims.items()]
    stated = statements.groupBy(key).agg(*said)
    written = sections.groupBy(key).agg(F.bool_or(any_in(F.lower("text"), ["api"])).alias("api"), *[s.alias(f"text_{c}") for s, c in zip(said, claims, strict=True)])
    every = reduce(lambda a, b: a.union(b), [t.select(key) for t in (components, integrations, sections, statements)]).where(F.col(key).isNotNull()).distinct()
    rows = every.join(own, key, "left").join(joints, key, "left").join(stated, key, "left").join(written, key, "left")
    claimed = {c: F.coalesce(c, f"text_{c}", F.lit(False)) for c in claims}
    have = F.coalesce("joints", F.lit(0)) > 0
    against = [claimed["no_joints"] & have, claimed["no_api"] & F.coalesce("api", F.lit(False)), claimed["internal"] & (F.coalesce("external", F.lit(False)) | have), claimed["batch"] & F.coalesce("online", F.lit(False))]
    counted = rows.select(key, F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("dangling", F.lit(0)).alias("dangling"), reduce(lambda a, b: a + b, [x.cast("int") for x in against]).alias("contradictions"))
    return counted.withColumn("status", F.when(F.expr("duplicates + dangling + contradictions = 0"), "passed").otherwise("failed"))


def section_order(sections: DataFrame, required: Sequence[str], key: str = "solution_id") -> DataFrame:
    """``(key, missing, observed, in_order)``: required sections that a solution lacks, and the order of those it has.

    A section that repeats counts where it comes first; ties in ``sort_order`` go by the
    section's name, null ``sort_order`` first.
    """
    codes = F.array(*map(F.lit, required))
    first = sections.groupBy(key, "section").agg(F.min("sort_order").alias("at"))
    wanted = F.when(F.col("section").isin(*required), F.struct("at", "section"))
    # at most one entry for each required section
    rows = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(wanted)), lambda x: x["section"]).alias("observed"))
    expected = F.filter(codes, lambda c: F.array_contains("observed", c))
    return rows.select(key, F.array_except(codes, "observed").alias("missing"), "observed", (F.col("observed") == expected).alias("in_order"))


def task_trace(tasks: DataFrame, components: DataFrame, sections: DataFrame, key: str = "solution_id") -> DataFrame:
    """``(key, tokens, names, texts, status)``: how many component names and sections hold a token of the task.

    The first ``TASK_TOKENS`` tokens in order count; of several tasks of one key the least text.
    """
    one = tasks.groupBy(key).agg(F.min("text").alias("text"))
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-zа-я0-9_\-]{4,}"), 0)))
    wanted = F.slice(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda t: ~t.isin(*TASK_STOPWORDS)), 1, TASK_TOKENS)
    traced = one.select(key, wanted.alias("wanted"))
    hit = lambda c: F.exists("wanted", lambda t: F.coalesce(F.contains(F.lower(c), t), F.lit(False)))
    names = components.select(key, "name").distinct().join(traced, key).where(hit("name")).groupBy(key).agg(F.count(F.lit(1)).alias("names"))
    texts = sections.select(key, "text").join(traced, key).where(hit("text")).groupBy(key).agg(F.count(F.lit(1)).alias("texts"))
    rows = traced.join(names, key, "left").join(texts, key, "left").fillna(0, ["names", "texts"])
    return rows.select(key, F.size("wanted").alias("tokens"), "names", "texts", F.when(F.expr("names + texts > 0"), "passed").otherwise("warning").alias("status"))
