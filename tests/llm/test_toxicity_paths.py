"""The composed machine against every path through its parts, and odd rows."""

from __future__ import annotations

import itertools
import random

import pytest

from dubsar.llm import toxicity as tx


def brute(grammar: tx.Grammar, words: list[str]) -> float:
    """The heaviest way to read each word and to run each machine on its own over the reading."""

    def factors(machine: tx.Transducer, symbols: tuple) -> list[tuple[float, ...]]:
        paths = [(machine.start, ())]
        for x in symbols:
            paths = [(t, (*done, f)) for s, done in paths for t, f in machine.arcs.get((s, x), ())]
        return [done for s, done in paths if s in machine.final]

    best = 0.0
    for reading in itertools.product(*(grammar.readings(w) for w in words)):
        each = [factors(m, tuple(x for x, _ in reading)) for m in tx.machines()]
        for chosen in itertools.product(*each):
            total = 0.0
            for k, (_, weight) in enumerate(reading):
                for f in chosen:
                    weight *= f[k]
                total += weight
            best = max(best, total)
    return best


def test_best_path_by_enumeration():
    rng = random.Random(3)
    grammar = tx.Grammar({"zarbol$": 3.0, "scu": 2.0, "he$": 0.4})
    words = ["zarbol", "scum", "he", "you", "not", "said", "kill", "calm", "line"]
    for _ in range(600):
        clause = [rng.choice(words) for _ in range(rng.randint(0, 6))]
        assert grammar.clause(clause) == pytest.approx(brute(grammar, clause)), clause


def test_scope_is_by_position():
    g = tx.Grammar({"zarbol$": 3.0})
    weigh = lambda t: g.evidence(t)
    assert weigh("you are a zarbol") == weigh("zarbol that you") == pytest.approx(3.75)
    assert weigh("you went home and then saw a zarbol") == weigh("zarbol and then at last you") == pytest.approx(3.0)
    assert weigh("not a zarbol") == pytest.approx(1.8) and weigh("not one of them a zarbol") == pytest.approx(3.0)
    assert weigh("sagte zarbol") == pytest.approx(2.1) and weigh("zarbol sagte") == pytest.approx(3.0)
    assert weigh("calm. you. zarbol") == pytest.approx(3.0) and weigh("") == 0.0


def test_repeated_rows_clashing_labels_and_long_texts(spark):
    rows = [(i, "You zarbol and scum. filler" if i % 4 == 0 else "A calm line of words", "x") for i in range(200)]
    rows += [(1, "A calm line of words", "x"), (None, "You zarbol and scum. filler", "x"), (500, "calm words " * 50_000 + ". You zarbol and scum. filler", "x"), (501, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(4, 0), (None, 1), (8, None)], "doc_id long, toxic int")
    got = tx.score(docs, tx.learn(docs, labels)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((round(r["score"], 12), r["predicted"]))
    assert len(by[1]) == 1 and {p for _, p in by[None]} == {1} and {p for _, p in by[500]} == {1} and {p for _, p in by[501]} == {0}
