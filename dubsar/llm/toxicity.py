"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads words as class symbols: insult, threat, target, negation,
report, other; a word of several classes has several readings. Insult readings and
their weights are learned from labelled rows, the function words of the other classes
are fixed. One transducer each for insult, threat, target, negation and reported speech
runs over the symbols and puts a factor on what insults and threats weigh: a target up
to some words before or after strengthens, a negation just before weakens, a reporting
verb weakens all that follows it in the clause. The five are composed once into one
machine of explicit states and weighted arcs; it guesses that a target follows and dies
where none does. Clauses are cut at sentence ends; a clause weighs what its best path
through the composed machine weighs. A document's evidence is the sum over its clauses,
and a two-parameter logistic fit turns evidence into a score.

Learning: of the labelled rows whose crc32(doc_id) mod 5 is not 0, at most
MAX_TRAIN_ROWS, those of smallest hash. Feature counts (words and word beginnings of
PREFIX characters, once per document) are summed per task, then by a shuffle; of the
features that LEAST_SEEN toxic rows hold, the MAX_ARCS most frequent become readings.
All are parameters of the fit. Labels, language, source and ids never enter a score.

Defined results: null text is empty and scores like any text without evidence;
with no usable labels the fixed seed arcs score alone; an empty table gives an
empty result; repeated rows score alike; of clashing labels of one document all
count; very long texts are read whole, and evidence beyond SATURATION changes a score
no more; other columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dubsar.llm.shared import small_batches

MAX_TRAIN_ROWS = 20_000
MAX_ARCS = 5_000
LEAST_SEEN = 5
PREFIX = range(3, 9)
HELD_OUT_OF = 5
SATURATION = 40.0
EDGES = "\"'`.,;:!?()[]{}<>*#$%&|_-+=/\\~^@“”‘’«»¿¡…"

# Function words of the grammar, in the corpus's four languages.
THREAT = ["kill", "destroy", "hurt", "beat", "töten", "vernichten", "tuer", "détruire", "matar", "destruir"]
TARGET = ["you", "your", "he", "she", "they", "this", "du", "ihr", "sie", "dieser", "tu", "vous", "il", "elle", "usted", "él", "ella", "ese"]
NEGATION = ["not", "no", "never", "nicht", "kein", "nie", "ne", "pas", "jamais", "nunca", "jamás"]
REPORT = ["said", "says", "quoted", "wrote", "claimed", "sagte", "schrieb", "dit", "écrit", "dijo", "escribió"]
#: Insult arcs when nothing has been learned.
SEED = {"idiot": 3.0, "moron": 3.0, "stupid": 3.0, "scum": 3.0, "pathetic": 3.0, "worthless": 3.0, "loser": 3.0}
CLAUSE = re.compile(r"[.!?;\n]+")


def held_out(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % HELD_OUT_OF == 0


def features(text: str) -> set[str]:
    """Words ("word$") and word beginnings of a text, each once."""
    out: set[str] = set()
    for w in set(text.lower().split()):
        if w := w.strip(EDGES):
            out.add(w + "$")
            out.update(w[:k] for k in PREFIX if k <= len(w))
    return out


INSULT, THREATEN, AIM, NEGATE, SAY, OTHER = SYMBOLS = "ITGNRO"
WEIGHED = (INSULT, THREATEN)
THREAT_WEIGHT = 0.5
#: Words before and after a match in which a target counts; words after a negation that it covers.
AIM_BEFORE, AIM_AFTER, NEGATED = 4, 2, 2
AIMED, DENIED, REPORTED = 1.25, 0.6, 0.7


class Transducer:
    """States from 0; arcs (state, symbol) -> [(next state, factor on what the symbol weighs)]; final states."""

    def __init__(self, arcs: dict[tuple, list[tuple]], final: set, start=0) -> None:
        self.arcs, self.final, self.start = arcs, final, start

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols at once; factors multiply. Only reachable states are made."""
        start = (self.start, other.start)
        arcs: dict[tuple, list[tuple]] = {}
        todo, seen = [start], {start}
        while todo:
            a, b = state = todo.pop()
            for x in SYMBOLS:
                both = [((p, q), f * g) for p, f in self.arcs.get((a, x), ()) for q, g in other.arcs.get((b, x), ())]
                if both:
                    arcs[state, x] = both
                for to, _ in both:
                    if to not in seen:
                        seen.add(to)
                        todo.append(to)
        return Transducer(arcs, {s for s in seen if s[0] in self.final and s[1] in other.final}, start)

    def numbered(self) -> Transducer:
        """The same with numbers for states."""
        number: dict = {self.start: 0}
        of = lambda s: number.setdefault(s, len(number))
        arcs = {(of(s), x): [(of(t), f) for t, f in out] for (s, x), out in self.arcs.items()}
        return Transducer(arcs, {of(s) for s in self.final})


def matcher(symbol: str) -> Transducer:
    """Insult or threat: state 1 once the symbol has been read."""
    return Transducer({(s, x): [(1 if x == symbol else s, 1.0)] for s in (0, 1) for x in SYMBOLS}, {0, 1})


def target() -> Transducer:
    """State k > 0: a target was read and counts for k more words; state -k: one must come within k words."""
    arcs: dict[tuple, list[tuple]] = {}
    for s in range(-AIM_AFTER, AIM_BEFORE + 1):
        for x in SYMBOLS:
            after = max(s - 1, 0) if s >= 0 else s + 1
            if x == AIM:
                out = [(AIM_BEFORE, 1.0)]
            elif x in WEIGHED:
                out = [(after, AIMED if s else 1.0)]
                if s == 0:
                    out.append((-AIM_AFTER, AIMED))
            else:
                out = [(after, 1.0)]
            arcs[s, x] = [(t, f) for t, f in out if not (s < 0 and t == 0)]
    return Transducer(arcs, set(range(AIM_BEFORE + 1)))


def negation() -> Transducer:
    """State k: that many words are still covered by a negation."""
    return Transducer({(s, x): [(NEGATED if x == NEGATE else max(s - 1, 0), DENIED if s and x in WEIGHED else 1.0)] for s in range(NEGATED + 1) for x in SYMBOLS}, set(range(NEGATED + 1)))


def reported() -> Transducer:
    """State 1: a reporting verb has been read."""
    return Transducer({(s, x): [(1 if x == SAY else s, REPORTED if s and x in WEIGHED else 1.0)] for s in (0, 1) for x in SYMBOLS}, {0, 1})


def machines() -> list[Transducer]:
    return [matcher(INSULT), matcher(THREATEN), target(), negation(), reported()]


def composed() -> Transducer:
    first, *rest = machines()
    for m in rest:
        first = first.compose(m)
    return first.numbered()


class Grammar:
    """The composed machine with its lexical readings. arcs: feature -> weight of the insult reading."""

    def __init__(self, arcs: dict[str, float], slope: float = 1.0, bias: float = -3.0) -> None:
        self.whole = {a[:-1]: w for a, w in arcs.items() if a.endswith("$")}
        self.begin = {a: w for a, w in arcs.items() if not a.endswith("$")}
        self.lengths = sorted({len(a) for a in self.begin})
        self.starts = {a[:3] for a in (*self.whole, *self.begin, *THREAT)}
        self.classes: dict[str, list[tuple[str, float]]] = {}
        for words, reading in ((THREAT, (THREATEN, THREAT_WEIGHT)), (TARGET, (AIM, 0.0)), (NEGATION, (NEGATE, 0.0)), (REPORT, (SAY, 0.0))):
            for w in words:
                self.classes.setdefault(w, []).append(reading)
        machine = composed()
        self.arcs, self.final = machine.arcs, machine.final
        self.slope, self.bias = slope, bias

    def insult(self, word: str) -> float:
        """The heaviest arc that accepts a word."""
        best = self.whole.get(word, 0.0)
        for k in self.lengths:
            if k > len(word):
                break
            best = max(best, self.begin.get(word[:k], 0.0))
        return best

    def readings(self, word: str) -> list[tuple[str, float]]:
        """Class symbols a word can be read as, with what each weighs."""
        found = self.classes.get(word, [])
        if word[:3] in self.starts and (weight := self.insult(word)):
            return [(INSULT, weight), *found]
        return found or [(OTHER, 0.0)]

    def clause(self, words: list[str]) -> float:
        """Weight of the best path through a clause."""
        read = [self.readings(w) for w in words]
        if not any(x in WEIGHED for r in read for x, _ in r):
            return 0.0
        arcs = self.arcs
        best = {0: 0.0}
        for r in read:
            ahead: dict[int, float] = {}
            for state, so_far in best.items():
                for symbol, weight in r:
                    for to, factor in arcs.get((state, symbol), ()):
                        value = so_far + weight * factor
                        if value >= ahead.get(to, 0.0):
                            ahead[to] = value
            best = ahead
        return max((v for s, v in best.items() if s in self.final), default=0.0)

    def evidence(self, text: str) -> float:
        total, starts = 0.0, self.starts
        for c in CLAUSE.split(text.lower()):
            words = [x for w in c.split() if (x := w.strip(EDGES))]
            if any(w[:3] in starts for w in words):
                total += self.clause(words)
        return total

    def score(self, text: str) -> float:
        z = self.slope * min(self.evidence(text), SATURATION) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    for b in batches:
        for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update(features(text))
    names = list(toxic.keys() | clean.keys())  # a clean count may weigh against an arc of another task
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[f] for f in part], pa.int64()), pa.array([clean[f] for f in part], pa.int64())], ["feature", "t", "c"])


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS, max_arcs: int = MAX_ARCS, least_seen: int = LEAST_SEEN) -> Grammar:
    """Arcs and calibration from the labelled rows that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    train = texts.join(F.broadcast(chosen), "doc_id").select("text", "toxic").persist()  # at most max_rows rows of labels, texts in executors
    n = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic or not n_clean:
        train.unpersist()
        return Grammar(SEED)
    summed = train.mapInArrow(_count, "feature string, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    weight = F.log((F.col("t") + 0.1) / n_toxic) - F.log((F.col("c") + 0.5) / n_clean)
    best = summed.where(F.col("t") >= least_seen).where((F.col("t") + 0.0) / n_toxic > 20 * (F.col("c") + 0.5) / n_clean).withColumn("w", weight)
    arcs = {r["feature"]: min(float(r["w"]), 6.0) for r in best.orderBy(F.desc("t"), F.desc("w"), "feature").limit(max_arcs).collect()}
    grammar = Grammar(arcs or SEED)
    sent = spark.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sent.value.evidence(t) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], ["x", "toxic"])

    points = [(min(r["x"], SATURATION), r["toxic"]) for r in train.mapInArrow(run, "x double, toxic int").collect()]  # at most max_rows pairs of numbers
    train.unpersist()
    grammar.slope, grammar.bias = _logistic(points)
    return grammar


def _logistic(points: list[tuple[float, int]], steps: int = 25) -> tuple[float, float]:
    """Slope and bias by Newton's method, slightly regularised; classes weigh by their size."""
    points = sorted(points)
    a, b = 1.0, -2.0
    for _ in range(steps):
        ga = gb = haa = hab = hbb = 0.0
        for x, y in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * x + b))))
            d, v = p - y, p * (1 - p)
            ga, gb, haa, hab, hbb = ga + d * x, gb + d, haa + v * x * x, hab + v * x, hbb + v
        ga, haa, gb, hbb = ga + 0.1 * a, haa + 0.1, gb + 0.01 * b, hbb + 0.01
        det = haa * hbb - hab * hab
        if det <= 1e-9:
            break
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
        a, b = max(0.05, min(20.0, a)), max(-10.0, min(-0.5, b))
    return a, b


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, score, predicted for every document."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(grammar)
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([g.score(t) for t in b.column(0).to_pylist()], pa.float64())], ["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
