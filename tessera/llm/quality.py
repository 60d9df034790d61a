"""Document quality by hierarchical empirical Bayes.

A document's own evidence is the sum of log-likelihood ratios of its features, in bins.
Labelled documents are counted by bin; a bin is judged with its neighbours at both sides, as far
as it takes to hold ``ENOUGH`` of them, so that a bin that few labels or none fell into says what those
around it say. The features are shares of symbol words, repeated neighbours and
letters, length, and the mean log-odds of its different words. A word's log-odds are those of
the word, of its shape and of its last three characters, hashed to ``SLOTS`` slots whose counts
in good and poor documents are grouped sums over one half of the labels (a bounded sample of
at most ``sample`` documents, those of smallest hash). The other half's documents say what
the mean is worth, so no label is used for both.

A site's evidence is what its documents show: labelled documents by their label, others by
their own posterior. Each host's share of good documents is shrunk towards the global share,
and each path's towards its host's, as Beta posteriors whose strength is estimated from the
spread between sites. A sparse site thus has nearly its parent's share. The score joins both:
logit(path) - logit(global) + logit(document). The table ``documents`` has no paths; there
the host is ``source`` and the level below it ``lang``.

Everything that is counted is a grouped aggregate; two numbers reach the driver for each
level, a table of bins and one of slots, both of fixed size.

Defined results: null and empty texts have the features of no words; a null host or
path is a site of its own; a label that is null is not used, of several labels of an id the
best counts; with no labels every score is the global prior of one half; rows that share an id
are each scored; ties of the sample's hash are broken by id; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

import operator
import re
from array import array
from collections.abc import Iterator
from math import fsum, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Cache, hold
from .common import materialized, only

FEATURES = ("symbols", "repeats", "letters", "length", "words")
#: Words of no worth that every document is taken to have.
SHRINK = 10
#: Slots of hashed words, shapes and word ends.
SLOTS = 1 << 18
#: Bins of a share.
BINS = 20
#: The first and last bin of each feature.
RANGES = {"symbols": (0, BINS), "repeats": (0, BINS), "letters": (0, BINS), "length": (0, 32), "words": (-BINS, BINS)}
#: Labelled documents that a bin and its neighbours hold at least, if there are so many.
ENOUGH = 5
_SYMBOLS = re.compile(r"[#$%&*|!~^<>=+\\]{2,}|\|")
_LETTERS = re.compile(r"[^\W\d_]+")


#: Letters and digits to the signs of a shape, up to the Cyrillic block.
_SIGNS = {c: "A" if chr(c).isupper() else "a" if chr(c).isalpha() else "0" for c in range(0x530) if chr(c).isalnum()}
_RUN = re.compile(r"(.)\1+", re.S)
_shapes = Cache(lambda signs: crc32(b"s" + _RUN.sub(r"\1", signs).encode()) % SLOTS)



def _begin() -> None:
    """A task's caches; a function, as a task's own functions would take the cache along as a value."""
    hold(_shapes)


def slots(word: str) -> tuple[int, int, int]:
    """The slots of a word, its shape (with runs of one sign as one) and its last 3 characters."""
    return crc32(word.encode()) % SLOTS, _shapes[word.translate(_SIGNS)], crc32(b"e" + word[-3:].encode()) % SLOTS


def features(text: str | None, table: array | None = None) -> tuple[int, int, int, int, int | None]:
    """Bins of a whole text's features; ``table`` has the log-odds of each slot."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, None)
    symbols = min(1.0, len(_SYMBOLS.findall(text)) / n)
    repeats = sum(map(operator.eq, words, words[1:])) / n
    # the share of letters leaves out symbol runs, which have a feature of their own
    rest = "".join(_SYMBOLS.sub("", text).split())
    letters = sum(map(len, _LETTERS.findall(rest))) / len(rest) if rest else 0.0
    worth = None
    different = set(words) if table is not None else ()
    if different:
        # the mean of few words is drawn to zero; fsum: in any order
        worth = fsum(table[a] + table[b] + table[c] for a, b, c in map(slots, different)) / 3 / (len(different) + SHRINK)
    return (int(symbols * BINS), int(repeats * BINS), int(letters * BINS), n.bit_length(), None if worth is None else max(-BINS, min(BINS, round(worth * BINS / 2))))


def _known(labels: DataFrame) -> DataFrame:
    known = only(labels, id="doc_id", good="quality").where("good is not null and id is not null")
    return known.groupBy("id").agg((F.max("good") > 0).cast("int").alias("good"))


def _first_half(id_col: str = "id") -> Column:
    return F.pmod(F.xxhash64(F.lit("half"), id_col), F.lit(2)) == 0


def learn_words(docs: DataFrame, known: DataFrame, sample: int, id_col: str, text_col: str) -> np.ndarray | None:
    """Log-odds of each slot, from the first half of the labels; None if a class is missing."""
    # at most ``sample`` ids: small enough to be sent to all tasks
    chosen = known.where(_first_half()).orderBy(F.xxhash64("id"), "id").limit(sample)
    train = only(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id").select("text", "good")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS + 1), np.int64)
        _begin()
        for batch in batches:
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
                found = sorted({k for w in set((text or "").split()) for k in slots(w)})
                total[good, found] += 1
                total[good, SLOTS] += 1
        at = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[1, at], pa.int64()), pa.array(total[0, at], pa.int64())], ["slot", "g", "b"])

    counted = train.mapInArrow(count, "slot int, g bigint, b bigint").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    table = np.zeros((2, SLOTS + 1))
    found = counted.toArrow()  # one row a slot at most
    table[:, found["slot"].to_numpy()] = found["g"].to_numpy(), found["b"].to_numpy()
    good, bad = table[:, SLOTS]
    if not good or not bad:
        return None
    g, b = table[:, :SLOTS]
    return (np.log((g + 1) / (good + 2)) - np.log((b + 1) / (bad + 2))) * ((g + b) > 0)


def _marked(docs: DataFrame, worth: np.ndarray | None, id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    source = only(docs, id=id_col, text=text_col, host=host_col, path=path_col).withColumn("k", F.xxhash64("text"))
    table = None if worth is None else array("f", worth.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin()
        for batch in batches:
            found = list(zip(*(features(t, table) for t in batch.column("text").to_pylist()), strict=True)) or [()] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "k", "host", "path")), *(pa.array(f, pa.int32()) for f in found)], ["id", "k", "host", "path", *FEATURES])

    kind = source.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{f} int" for f in FEATURES)
    return source.withColumn("host", F.col("host").cast("string")).withColumn("path", F.col("path").cast("string")).mapInArrow(run, f"id {kind}, k bigint, host string, path string, {columns}")


def _evidence(labelled: DataFrame, smoothing: float) -> tuple[Column, float]:
    """The logit of a document by its features, and the prior share of good ones.

    The worth of ``words`` is counted on the second half of the labels only.
    """
    bins = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("bin")) for f in FEATURES])).alias("x")
    used = labelled.where("good is not null").select("id", "good", bins).where((F.col("x.f") != "words") | F.col("x.bin").isNotNull() & ~_first_half())
    counted = used.groupBy("x.f", "x.bin").agg(F.sum("good").alias("g"), F.count(F.lit(1)).alias("n")).collect()
    counts = {f: np.zeros((2, hi - lo + 1)) for f, (lo, hi) in RANGES.items()}
    for r in counted:
        counts[r["f"]][:, min(r["bin"], RANGES[r["f"]][1]) - RANGES[r["f"]][0]] += r["g"], r["n"] - r["g"]
    good, bad = counts[FEATURES[0]].sum(axis=1)
    prior = (good + 1) / (good + bad + 2)
    total = F.lit(log(prior / (1 - prior)))
    for f, (lo, hi) in RANGES.items():
        total_of = counts[f].sum(axis=1)
        if not total_of.any():
            continue
        ratios = []
        for b in range(hi - lo + 1):
            reach = next((r for r in range(hi - lo + 1) if counts[f][:, max(0, b - r) : b + r + 1].sum() >= ENOUGH), hi - lo)
            share = (counts[f][:, max(0, b - reach) : b + reach + 1].sum(axis=1) + smoothing) / (total_of + 2 * smoothing)
            ratios.append(log(share[0] / share[1]))
        # a feature without a value says nothing
        at = F.when(F.col(f).isNotNull(), F.least(F.col(f), F.lit(hi)) - lo)
        total = total + F.coalesce(F.get(F.lit(ratios), at), F.lit(0.0))
    return total, prior


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, mean: Column, least: float = 2.0, most: float = 10_000.0) -> float:
    """Pseudo-counts of a level's Beta prior by moments: the spread of sites beyond what their sizes explain."""
    rate, n = F.col("p") / F.col("n"), F.col("n")
    row = sites.agg(
        F.sum(n * (rate - mean) ** 2).alias("between"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("sites"), F.sum(n * mean * (1 - mean)).alias("within"), F.sum(n * n).alias("nn")
    ).first()
    if not row["n"] or row["sites"] < 2:
        return most
    noise = row["within"] / row["n"]
    spread = (row["between"] - row["sites"] * noise) / max(1e-9, row["n"] - row["nn"] / row["n"])
    return most if spread <= 0 else min(most, max(least, noise / spread - 1))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    smoothing: float = 0.5,
    sample: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
) -> DataFrame:
    """``(id, k, evidence, host_share, path_share, score, keep)`` of every row; ``k`` is the hash of its text.

    ``evidence`` is the document's own posterior. A site's share leaves the document
    itself out. A document is rejected below ``threshold``: losing a good one is worse than
    keeping a poor one.
    """
    known = materialized(_known(labels), "known")
    marked = materialized(_marked(docs, learn_words(docs, known, sample, id_col, text_col), id_col, text_col, host_col, path_col), "features")
    # rows without an id have no label: they stay out of the join
    named = marked.where("id is not null").join(known, "id", "left")
    labelled = materialized(named.unionByName(marked.where("id is null").withColumn("good", F.lit(None).cast("int"))), "labelled")
    logit, prior = _evidence(labelled, smoothing)
    own = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit))))
    scored = materialized(labelled.select("id", "k", "host", "path", own.alias("own"), F.coalesce(F.col("good").cast("double"), own).alias("p")), "evidence")
    sums = [F.sum("p").alias("p"), F.count(F.lit(1)).alias("n")]
    whole = scored.agg(*sums).first()
    share = min(1 - 1e-6, max(1e-6, whole["p"] / whole["n"])) if whole["n"] else prior
    paths = materialized(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = materialized(paths.groupBy("host").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "hosts")
    s = _strength(hosts, F.lit(share))
    above = hosts.select(F.col("host").alias("h"), F.col("p").alias("hp"), F.col("n").alias("hn"), ((s * share + F.col("p")) / (s + F.col("n"))).alias("host_mean"))
    sites = materialized(paths.join(above, F.col("host").eqNullSafe(F.col("h"))).drop("h"), "sites")
    t = _strength(sites, F.col("host_mean"))
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("q"), F.col("p").alias("pp"), F.col("n").alias("pn"), "hp", "hn")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("q")))
    host_share = (s * share + F.col("hp") - F.col("p")) / (s + F.col("hn") - 1)
    path_share = (t * F.col("host_share") + F.col("pp") - F.col("p")) / (t + F.col("pn") - 1)
    out = joined.withColumn("host_share", host_share).withColumn("path_share", path_share)
    site = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("path_share")))
    total = _logit(site) - log(share / (1 - share)) + _logit(F.col("own"))
    score = 1 / (1 + F.exp(-total))
    return out.select(F.col("id").alias(id_col), "k", F.col("own").alias("evidence"), "host_share", "path_share", score.alias("score"), (score >= threshold).alias("keep"))


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = classify(docs, labels)
    return found.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "host_share", "path_share", "score")], "keep")
