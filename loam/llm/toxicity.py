"""Toxicity by a weighted finite-state pattern grammar.

Words are mapped to an alphabet of classes (insult, violence, target, negation, reported speech, intent). Transducers over it have arcs
with an input class, an output class, a weight and a next state; weights of a path multiply, and paths that read the same clause add up.

* The lexicon reads words. A word of weight w comes out as its class, of weight 1, or as a *marked* one, of weight w.
* The insult transducer passes clauses in which one insult is marked; the threat transducer those in which one violent verb
  is marked that follows a word of intent. Their union proposes the matches of a clause, one per path.
* The target transducer raises a match with a target near it, before or after. The negation and reported-speech transducers lower it.

Composition makes one transducer of them, once (``Grammar.machine``). A clause's weight is the sum over its paths; lone words outside a pattern
score nothing. The document's score is a logistic function of its clauses' weights, fitted on the training fold.

The insult lexicon is learned from the labels: smoothed log odds of words between toxic and clean
training documents, over a bounded sample of labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_rows

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n\"“”«»]")
TARGET = frozenset("you your yours yourself u ur he him his she her they them their tu toi vous ton votre du dich dir euch sie ihr ihn usted ustedes te ti tus vosotros él ella".split())
NEGATION = frozenset("not no never neither nor isn't aren't wasn't don't doesn't didn't can't cannot won't without nicht kein keine nie niemals pas jamais aucun sans nunca ningún ninguna sin".split())
REPORTED = frozenset("said says say told tells wrote writes quoted quotes reported claims claimed alleged called disait dit écrit sagte sagt schrieb dijo dice escribió".split())
THREAT = frozenset("kill hurt destroy shoot stab burn strangle tuer töten umbringen matar".split())
INTENT = frozenset("will gonna shall i'll going want werde will vais voy".split())
_CLASS_OF = {w: c for c, words in ((6, INTENT), (5, REPORTED), (4, NEGATION), (3, TARGET)) for w in words}
SEED = {w: 3.0 for w in "idiot moron stupid loser scum trash pathetic disgusting worthless clown imbecile".split()}

OTHER, INSULT, THREATS, AIM, NEG, SAID, WANT = CLASSES = range(7)
MARKED = {INSULT: 7, THREATS: 8}
SYMBOLS = (*CLASSES, *MARKED.values())
REACH = 4  # tokens that a negation, an intent or a target stays in force


class Transducer:
    """arcs: state -> symbol -> [(output, weight, next state)]; states can be any hashable values. A path begins in ``start`` and may end in ``final``."""

    def __init__(self, start, final: set, arcs: dict):
        self.start, self.final, self.arcs = start, final, arcs

    def weight(self, symbols: list[list[tuple[int, float]]]) -> float:
        """Sum of the weights of all paths that read the sequence; each place has its symbols with weights of their own."""
        now = {self.start: 1.0}
        for place in symbols:
            then: dict = {}
            for state, w in now.items():
                arcs = self.arcs.get(state, {})
                for symbol, own in place:
                    for _, more, to in arcs.get(symbol, ()):
                        then[to] = then.get(to, 0.0) + w * own * more
            now = then
        return sum(w for state, w in now.items() if state in self.final)


def machine_of(start, step, symbols=SYMBOLS, ends=lambda state: True) -> Transducer:
    """The transducer of all states that ``step(state, symbol)`` reaches; step gives (output, weight, next state), or None for no arc."""
    arcs: dict = {}
    todo = [start]
    while todo:
        state = todo.pop()
        if state in arcs:
            continue
        arcs[state] = {}
        for symbol in symbols:
            if (arc := step(state, symbol)) is not None:
                arcs[state][symbol] = [arc]
                todo.append(arc[2])
    return Transducer(start, {state for state in arcs if ends(state)}, arcs)


def union(a: Transducer, b: Transducer) -> Transducer:
    """Paths of either."""
    arcs: dict = {}
    for name, t in (("a", a), ("b", b)):
        for state, by in t.arcs.items():
            arcs[name, state] = {s: [(o, w, (name, to)) for o, w, to in out] for s, out in by.items()}
    both = arcs["start"] = {}
    for name, t in (("a", a), ("b", b)):
        for s, out in arcs[name, t.start].items():
            both.setdefault(s, []).extend(out)
    final = {(n, f) for n, t in (("a", a), ("b", b)) for f in t.final} | ({"start"} if a.start in a.final or b.start in b.final else set())
    return Transducer("start", final, arcs)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What b makes of a's output, with both weights; states that lead to no end are left out, the others numbered."""
    start = (a.start, b.start)
    arcs: dict = {}
    todo = [start]
    while todo:
        here = todo.pop()
        if here in arcs:
            continue
        arcs[here] = {}
        for s, out in a.arcs.get(here[0], {}).items():
            for o, w, to in out:
                for o2, w2, to2 in b.arcs.get(here[1], {}).get(o, ()):
                    arcs[here].setdefault(s, []).append((o2, w * w2, (to, to2)))
                    todo.append((to, to2))
    final = {x for x in arcs if x[0] in a.final and x[1] in b.final}
    back: dict = {}
    for x, by in arcs.items():
        for out in by.values():
            for _, _, to in out:
                back.setdefault(to, set()).add(x)
    useful, todo = set(), list(final)
    while todo:
        x = todo.pop()
        if x not in useful:
            useful.add(x)
            todo += back.get(x, ())
    number = {x: i for i, x in enumerate([x for x in arcs if x in useful or x == start])}
    kept = {number[x]: {s: k for s, out in arcs[x].items() if (k := [(o, w, number[to]) for o, w, to in out if to in useful])} for x in number}
    return Transducer(number[start], {number[x] for x in final}, kept)


def _plain(symbol: int) -> int:
    return {7: INSULT, 8: THREATS}.get(symbol, symbol)


def insults() -> Transducer:
    """Clauses with one marked insult."""
    return machine_of(0, lambda done, s: (s, 1.0, 1) if s == MARKED[INSULT] and not done else None if s > 6 else (s, 1.0, done), ends=bool)


def threats() -> Transducer:
    """Clauses with one marked violent verb within reach of a word of intent before it. States: tokens for which the intent is in force, or -1 after the mark."""

    def step(left, s):
        if s == MARKED[THREATS]:
            return (s, 1.0, -1) if left > 0 else None
        if s > 6:
            return None
        return (s, 1.0, -1 if left < 0 else REACH if s == WANT else max(0, left - 1))

    return machine_of(0, step, ends=lambda state: state < 0)


def targets(raised: float) -> Transducer:
    """The mark's weight is raised once if a target is within reach before or after. States: (tokens in force, mark seen)."""

    def step(state, s):
        left, seen = state
        if s > 6:
            return (s, raised, (0, True)) if left > 0 else (s, 1.0, (REACH, True))
        if seen:
            return (s, raised, (0, True)) if s == AIM and left > 0 else (s, 1.0, (max(0, left - 1), True))
        return (s, 1.0, (REACH if s == AIM else max(0, left - 1), False))

    return machine_of((0, False), step)


def negations(lowered: float) -> Transducer:
    """A mark within reach of a negation before it is lowered."""

    def step(left, s):
        if s > 6:
            return (s, lowered if left > 0 else 1.0, -1)
        return (s, 1.0, -1 if left < 0 else REACH if s == NEG else max(0, left - 1))

    return machine_of(0, step)


def reports(lowered: float) -> Transducer:
    """A mark after a word of reported speech, anywhere before it in the clause, is lowered."""
    return machine_of(0, lambda said, s: (s, lowered if said == 1 else 1.0, -1) if s > 6 else (s, 1.0, 1 if s == SAID and said == 0 else said))


@lru_cache(maxsize=8)
def composed(aimed: float, negated: float, reported: float) -> Transducer:
    proposed = union(insults(), threats())
    return compose(compose(compose(proposed, targets(aimed)), negations(negated)), reports(reported))


@dataclass
class Grammar:
    """lexicon: insult word -> weight. coefficients: of the document features, the intercept first."""

    lexicon: dict[str, float] = field(default_factory=lambda: dict(SEED))
    coefficients: tuple[float, ...] = (-3.0, 2.0, 1.0, 0.5)
    aimed: float = 1.25
    negated: float = 0.35
    reported: float = 0.6
    threat: float = 4.0

    @property
    def machine(self) -> Transducer:
        return composed(self.aimed, self.negated, self.reported)

    def symbols(self, token: str) -> list[tuple[int, float]]:
        """The lexicon's arcs for a word."""
        if token in self.lexicon:
            return [(INSULT, 1.0), (MARKED[INSULT], self.lexicon[token])]
        if token in THREAT:
            return [(THREATS, 1.0), (MARKED[THREATS], self.threat)]
        return [(_CLASS_OF.get(token, OTHER), 1.0)]

    def clause(self, tokens: list[str], quoted: bool = False) -> float:
        """Weight of all that the grammar matches in one clause (without its end mark). A quoted clause counts as reported."""
        return self.machine.weight([[(SAID, 1.0)]] * quoted + [self.symbols(t) for t in tokens])

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Greatest clause weight, log of the summed weights, matched clauses (log): over the whole text."""
        if not text:
            return 0.0, 0.0, 0.0
        tokens = WORD.findall(text.lower())
        lexicon = self.lexicon
        if not any(t in lexicon or t in THREAT for t in tokens):
            return 0.0, 0.0, 0.0
        best = summed = 0.0
        matched = 0
        begin, quoted = 0, False
        tokens.append("\n")
        for i, t in enumerate(tokens):
            if len(t) == 1 and not t.isalnum():
                part = tokens[begin:i]
                if part and any(x in lexicon or x in THREAT for x in part):
                    w = self.clause(part, quoted)
                    best, summed, matched = max(best, w), summed + w, matched + (w > 0)
                begin = i + 1
                if t in "\"“”«»":
                    quoted = not quoted
                elif t == "\n":
                    quoted = False
        return best / 4, math.log1p(summed), math.log1p(matched)

    def score(self, text: str | None) -> float:
        c = self.coefficients
        z = c[0] + sum(a * b for a, b in zip(c[1:], self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows outside the held-out fold, those of least hash.

    Labels that are null, or that name no document, aren't used; a document labelled twice counts
    as its greatest label. Only the ids are sorted (a top-n), and they are broadcast: 24 bytes each.
    """
    chosen = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def _word_counts(batches):
    for texts, toxic in text_rows(batches, "text", "toxic"):
        yes, no = Counter(), Counter()
        for text, label in zip(texts, toxic):
            (yes if label else no).update({t for t in WORD.findall(text.lower()) if len(t) > 2})
            (yes if label else no)[""] += 1
        words = list(yes.keys() | no.keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([yes[w] for w in words], pa.int64()), pa.array([no[w] for w in words], pa.int64())], ["word", "yes", "no"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least: int = 3) -> Grammar:
    """Learn the lexicon, then the logistic coefficients, from a bounded sample of the training fold.

    The lexicon is as large as the sample's texts make it: words of at least ``least`` toxic documents whose odds are sure. Without any usable label the seed lexicon and the default coefficients are kept.
    """
    rows = training_rows(docs, labels, sample)
    counts = rows.mapInArrow(_word_counts, "word string, yes long, no long").groupBy("word").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    # words of one class alone can't say much below ``least`` documents; only toxic-leaning ones are kept
    total = counts.where("word = ''").first()
    grammar = Grammar()
    if total is None or not total.yes or not total.no:
        return grammar
    odds = F.log((F.col("yes") + 0.1) / (total.yes + 1.0)) - F.log((F.col("no") + 0.1) / (total.no + 1.0))
    learned = counts.where((F.col("word") != "") & (F.col("yes") >= least)).select("word", "yes", "no", odds.alias("odds"))
    # a word counts if its odds stay above e**2 when its clean documents get two standard errors more
    sure = F.log((F.col("yes") + 0.1) / (total.yes + 1.0)) - F.log((F.col("no") + 0.5 + 2 * F.sqrt(F.col("no") + 0.5)) / (total.no + 1.0)) > 1.5
    for r in learned.where(sure & (F.col("odds") > 2)).orderBy(F.desc("odds"), "word").collect():
        grammar.lexicon[r.word] = min(4.0, r.odds / 2)
    shared = grammar

    def measure(batches):
        for texts, toxic in text_rows(batches, "text", "toxic"):
            got = [shared.features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([*(pa.array([g[i] for g in got], pa.float64()) for i in range(3)), pa.array(toxic, pa.int32())], ["f0", "f1", "f2", "y"])

    # equal feature rows are counted together; the sample bounds what comes to the driver
    seen = rows.mapInArrow(measure, "f0 double, f1 double, f2 double, y int").groupBy("f0", "f1", "f2", "y").count().collect()
    seen.sort()
    grammar.coefficients = _logistic(np.array([s[:3] for s in seen]), np.array([s[3] for s in seen], float), np.array([s[4] for s in seen], float))
    return grammar


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method with a ridge on all but the intercept."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """(doc_id, score) of every row; a null or empty text gets the score of a text without matches.

    Repeated ids give repeated rows, a null id stays null; other columns are ignored.
    """

    def run(batches):
        for ids, texts in text_rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([grammar.score(t) for t in texts], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def reject_toxic(docs: DataFrame, grammar: Grammar, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns kept, in one pass without a shuffle."""
    schema = docs.schema

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                keep = [grammar.score(t) < threshold for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                if any(keep):
                    yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
