"""Toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult, threat, target (the one who is addressed), negation
and reporting verb. Each class has a transducer, a table of weighted arcs ``(state, class)
-> (state, factors)`` that remembers for a few words what went before; ``compose`` makes
their product. The product reads a clause from the left, and that of target and reported
speech from the right as well (a bimachine), so that these count on both sides ("idiot, he said").
A contracted "n't" is the word "not"; a sign before a closing quote ends no clause. At an insult, and
at a threat with a target near, the arcs emit the factors that hold there: target,
negation, reported speech.

The weights are log-linear: a match has the logistic sum of the weight of its own arc, the
insult's or the threat's, and those of its factors. A document's score joins its matches as
1 - (1 - base) product(1 - match), so a stem that clean texts use once by chance weighs less
than one they never use. The weights have Gaussian priors (``PRIORS``) and are fitted to whole
documents by expectation maximisation; a combination that training never showed backs off to
its arc and factors. Negation and reported speech never raise a match, a target never lowers
one. A word outside of a match scores nothing.

The insults are learned from labelled documents: word stems that toxic documents use after
different words significantly more often than their share explains (binomial test, false
discovery rate ``fdr``), with at least ``purity`` of the uses there when both classes weigh
alike. A stem counts once for each word before it, so a passage that is copied a thousand
times counts once. Documents to learn from are at most ``sample`` labelled ones, those of smallest hash; nothing else is bounded. The other
classes are short fixed word lists, parameters of the grammar.

Every whole text is scored where it lies.

Defined results: a null, empty or wordless text has the score of a text without a match; a
label that is null is not used, of several labels of an id the highest counts; ties of the
sample's hash are broken by id; repeated rows are each scored; with no labels at all the
lexicon is empty and the score without a match zero; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import exp, lgamma, log, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Cache
from .common import materialized, only

NONE, INSULT, THREAT, TARGET, NEGATION, REPORT = CLASSES = range(6)
#: Word lists of the grammar: fixed values in English, German, French and Spanish.
THREATS = frozenset("kill murder shoot stab strangle töten umbringen erschießen tuer égorger matar asesinar".split())
TARGETS = frozenset("you your yours yourself du dich dir dein deine ihr euch tu toi vous votre usted ustedes tú vosotros".split())
NEGATIONS = frozenset("not no never neither nor none nobody cannot nicht nichts nie kein keine keinen keinem keiner niemals ne pas jamais aucun aucune nunca jamás ni ningún ninguna".split())
REPORTS = frozenset("said says wrote quoted called sagte schrieb nannte disait écrivait appelé dijo escribió llamó".split())
#: How many words a target, a negation and a reporting verb reach.
REACH = {TARGET: 5, NEGATION: 5, REPORT: 12}
#: Prior means of the weights of the factors target, negation, reported speech, and of an arc.
PRIORS, ARC = (0.5, -2.0, -1.5), 2.0
#: Factors as bits of a match; a threat's kind is a bit as well.
REPORTED, NEGATED, ADDRESSED, THREATENED = 1, 2, 4, 8
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n]+(?![\"”»’'.!?;:\n])")
CONTRACTED = re.compile(r"n['’]t\b")
#: Shortest and longest stem in letters.
STEM = (3, 12)

Transducer = dict[tuple, tuple]


def scope(kind: int, factor: int, reach: int) -> Transducer:
    """Emits ``factor`` at every word within ``reach`` words after one of its class; states count down."""
    arcs = {}
    for state in range(reach + 1):
        for c in CLASSES:
            after = reach if c == kind else max(0, state - 1)
            arcs[state, c] = after, factor if after else 0
    return arcs


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The product: both read the same classes, their factors are joined."""
    return {((p, q), c): ((x, y), f | g) for (p, c), (x, f) in a.items() for (q, d), (y, g) in b.items() if c == d}


def numbered(t: Transducer) -> list[list[tuple[int, int]]]:
    """Arcs by number of state and class; the start, where nothing is remembered, is state 0."""
    order = {s: n for n, s in enumerate(sorted({s for s, _ in t}, key=str))}
    table = [[(0, 0)] * len(CLASSES) for _ in order]
    for (s, c), (x, f) in t.items():
        table[order[s]][c] = order[x], f
    return table


_BEHIND = scope(TARGET, ADDRESSED, REACH[TARGET])
FORWARD = numbered(compose(compose(_BEHIND, scope(NEGATION, NEGATED, REACH[NEGATION])), scope(REPORT, REPORTED, REACH[REPORT])))
BACKWARD = numbered(compose(_BEHIND, scope(REPORT, REPORTED, REACH[REPORT])))


def matches(kinds: list[int]) -> Iterator[tuple[int, int]]:
    """``(position, factors)`` of each insult, and of each threat with a target near, in a clause's word classes."""
    marks, state = [], 0
    for kind in kinds:
        state, factors = FORWARD[state][kind]
        marks.append(factors)
    state = 0
    for at in range(len(kinds) - 1, -1, -1):
        state, factors = BACKWARD[state][kinds[at]]
        factors |= marks[at]
        if kinds[at] == INSULT:
            yield at, factors
        elif kinds[at] == THREAT and factors & ADDRESSED:
            yield at, factors | THREATENED


def _inputs(factors: int) -> tuple[int, ...]:
    """Which factors a match has."""
    return (int(factors & ADDRESSED > 0), int(factors & NEGATED > 0), int(factors & REPORTED > 0))


@dataclass
class Grammar:
    """The weights of the arcs of stems and threats and of the factors; ``base`` is the score without a match."""

    stems: dict[str, float] = field(default_factory=dict)
    threat: float = ARC
    weights: tuple[float, ...] = PRIORS
    base: float = 0.0

    def stem(self, word: str) -> str | None:
        return next((word[:n] for n in range(STEM[0], min(STEM[1], len(word)) + 1) if word[:n] in self.stems), None)

    def kind(self, word: str) -> tuple[int, str | None]:
        """A word's class and stem."""
        stem = self.stem(word)
        if stem is not None:
            return INSULT, stem
        return (THREAT if word in THREATS else TARGET if word in TARGETS else NEGATION if word in NEGATIONS else REPORT if word in REPORTS else NONE), None

    def cache(self) -> Cache:
        return Cache(self.kind)

    def matched(self, text: str | None, kinds: Cache) -> list[tuple[int, str | None]]:
        """``(factors, stem)`` of each match of a whole text; a threat has no stem."""
        text = CONTRACTED.sub(" not", (text or "").lower())
        if {INSULT, THREAT}.isdisjoint(kinds[w][0] for w in WORD.findall(text)):
            return []
        found = []
        for clause in CLAUSE.split(text):
            words = [kinds[w] for w in WORD.findall(clause)]
            found += [(factors, words[at][1]) for at, factors in matches([k for k, _ in words])]
        return found

    def match(self, factors: int, stem: str | None) -> float:
        """The probability that a match is toxic."""
        arc = self.threat if stem is None else self.stems[stem]
        return 1 / (1 + exp(-arc - sum(w * x for w, x in zip(self.weights, _inputs(factors), strict=True))))

    def score(self, found: list[tuple[int, str | None]]) -> float:
        return 1 - (1 - self.base) * prod(1 - self.match(*m) for m in found)


def fitted(grammar: Grammar, found: list[tuple[int, list[tuple[int, str | None, int]]]], rounds: int = 60, spread: float = 1.0, spread_arc: float = 4.0) -> Grammar:
    """The grammar with the weights that best explain ``(toxic, [(factors, stem, times)])`` of documents with matches."""
    arcs = {s: k for k, s in enumerate([None, *grammar.stems])}
    flat = [(d, arcs[stem], _inputs(f), n) for d, (_, ms) in enumerate(found) for f, stem, n in ms]
    if not flat:
        return grammar
    doc, arc = (np.array([m[k] for m in flat]) for k in (0, 1))
    x, n = np.array([m[2] for m in flat], float), np.array([m[3] for m in flat], float)
    toxic = np.array([t for t, _ in found], float)
    size = len(arcs)
    mean = np.concatenate([np.full(size, ARC), PRIORS])
    scale = np.concatenate([np.full(size, spread_arc), np.full(len(PRIORS), spread)])
    w = mean.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[arc] + x @ w[size:], -30, 30)))
        clean = (1 - grammar.base) * np.exp(np.bincount(doc, n * np.log1p(-np.minimum(p, 1 - 1e-12)), len(toxic)))
        share = toxic[doc] * p / np.maximum(1 - clean[doc], 1e-12)  # how surely the match is what made the document toxic
        for _ in range(3):
            p = 1 / (1 + np.exp(-np.clip(w[arc] + x @ w[size:], -30, 30)))
            slope, bend = n * (np.minimum(share, 1) - p), n * p * (1 - p)
            g = np.concatenate([np.bincount(arc, slope, size), x.T @ slope]) - (w - mean) / scale
            # the arcs meet only in the factors: their block is diagonal, so the step is solved in the factors alone
            own = np.bincount(arc, bend, size) + 1 / scale[:size]
            cross = np.stack([np.bincount(arc, bend * x[:, k], size) for k in range(x.shape[1])], 1)
            corner = (x.T * bend) @ x + np.diag(1 / scale[size:]) - cross.T @ (cross / own[:, None])
            step = np.linalg.solve(corner, g[size:] - cross.T @ (g[:size] / own))
            w = w + np.clip(np.concatenate([(g[:size] - cross @ step) / own, step]), -2, 2)
            # negation and reported speech never raise a match, a target never lowers it
            w[size:] = np.clip(w[size:], (0.0, -np.inf, -np.inf), (np.inf, -0.1, -0.1))
    return Grammar({s: float(w[arcs[s]]) for s in grammar.stems}, float(w[0]), tuple(float(v) for v in w[size:]), grammar.base)


def held_out(id_col: str = "doc_id"):
    """Whether an id's labels are kept from learning."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``(text, toxic)`` of at most ``sample`` labelled documents that aren't held out."""
    known = only(labels, id="doc_id", toxic="toxic").where("toxic is not null and id is not null").where(~held_out("id"))
    chosen = known.groupBy("id").agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    # at most ``sample`` ids and flags: small enough to be sent to all tasks
    return only(docs, id="doc_id", text="text").join(F.broadcast(chosen), "id").select("text", "toxic")


def _tail(t: int, n: int, p: float) -> float:
    """The log probability of ``t`` or more of ``n`` at rate ``p``, by its largest term and a geometric bound."""
    term = lgamma(n + 1) - lgamma(t + 1) - lgamma(n - t + 1) + t * log(p) + (n - t) * log(1 - p)
    ratio = (n - t) / (t + 1) * p / (1 - p)
    return min(0.0, term - log(max(1e-9, 1 - ratio))) if ratio < 1 else 0.0


def _lexicon(counts: dict[str, tuple[int, int]], tests: int, share: float, fdr: float, purity: float) -> dict[str, float]:
    """Stems whose surplus is significant, as long as their uses allow, with the prior weight of an arc."""
    ratio = share / (1 - share)
    ranked = sorted((_tail(t, t + c, share), s) for s, (t, c) in counts.items() if t >= purity * (t + ratio * c))
    passed = max((k for k, (p, _) in enumerate(ranked, 1) if p <= log(fdr * k / tests)), default=0)
    support = {s: counts[s] for _, s in ranked[:passed]}
    longer: dict[str, list[str]] = {}
    for s in support:
        longer.setdefault(s[:-1], []).append(s)
    stems = {}
    for first in support:
        if any(first[:n] in support for n in range(STEM[0], len(first))):
            continue
        stem = first
        while same := [s for s in longer.get(stem, ()) if support[s][0] >= 0.95 * support[stem][0]]:
            stem = max(same, key=lambda s: (support[s][0], s))
        stems[stem] = ARC
    return stems


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000, fdr: float = 0.05, purity: float = 0.97) -> Grammar:
    """Fit the lexicon, then the weights of kinds and factors."""
    train = materialized(_training(docs, labels, sample), "training")
    classes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not classes.get(1) or not classes.get(0):
        return Grammar()

    def uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 256) for b in batches for k in range(0, len(b), 256)):
            rows: dict[tuple[str, str, int], None] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                words = WORD.findall((text or "").lower())
                rows |= dict.fromkeys((w, v, toxic) for v, w in zip(["", *words], words))  # noqa: B905
            word, before, toxic = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(before, pa.string()), pa.array(toxic, pa.int32())], ["word", "before", "toxic"])

    words = train.mapInArrow(uses, "word string, before string, toxic int").distinct()
    counts = words.groupBy("word").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = materialized(counts, "words")
    totals = counts.agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    share = max(1e-6, min(1 - 1e-6, (totals["t"] or 0) / max(1, (totals["t"] or 0) + (totals["c"] or 0))))
    prefixes = counts.select(F.explode(F.transform(F.sequence(F.lit(STEM[0]), F.least(F.lit(STEM[1]), F.char_length("word"))), lambda n: F.substring("word", F.lit(1), n))).alias("stem"), "t", "c")
    stems = materialized(prefixes.groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where("t > 0"), "stems")
    # what reaches the driver are pure stems of the bounded sample
    tests = stems.where("t + c > 1").count()
    pure = F.col("t") >= purity * (F.col("t") + share / (1 - share) * F.col("c"))
    some = stems.where(pure & (F.col("t") >= 2)).collect()
    grammar = Grammar(_lexicon({r["stem"]: (r["t"], r["c"]) for r in some}, max(1, tests), share, fdr, purity))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = grammar.cache()
        for batch in batches:
            rows = [[(f, s or "", n) for (f, s), n in Counter(grammar.matched(t, kinds)).items()] for t in batch.column("text").to_pylist()]
            columns = [pa.array([[m[k] for m in ms] for ms in rows], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.string(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *columns], ["toxic", "factors", "stems", "times"])

    seen = materialized(train.mapInArrow(found, "toxic int, factors array<int>, stems array<string>, times array<bigint>"), "matches")
    without = seen.where("size(factors) = 0").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    rate = classes[1] / (classes[0] + classes[1])
    grammar.base = ((without["t"] or 0) + 2 * rate) / (without["n"] + 2)
    # at most ``sample`` rows
    rows = seen.where("size(factors) > 0").orderBy("toxic", "factors", "stems", "times").collect()
    return fitted(grammar, [(r["toxic"], [(f, s or None, n) for f, s, n in zip(r["factors"], r["stems"], r["times"], strict=True)]) for r in rows])


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, matches)`` of every whole text; ``matches`` is how many clauses' patterns matched."""
    source = only(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = grammar.cache()
        for batch in batches:
            found = [grammar.matched(t, kinds) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(map(grammar.score, found), pa.float64()), pa.array(map(len, found), pa.int64())], ["id", "score", "matches"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, score double, matches bigint").withColumnRenamed("id", id_col)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted, matches)``, learned from the labels that aren't held out."""
    found = score(docs, learn(docs, labels, **options))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "matches")
