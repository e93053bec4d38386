"""What the prefilter lets go must be what the grammar matches."""

from __future__ import annotations

import random

from dubsar.llm import toxicity


def test_evidence_equals_the_grammar_without_prefilter():
    g = toxicity.Grammar({"idiot$": 3.0, "ab$": 2.0, "q$": 1.5, "zarb": 2.5})
    assert g.evidence("Well.Idiot") == 3.0 and g.evidence("so ab, then") == 2.0 and g.evidence("Q!") == 1.5
    rng = random.Random(8)
    bits = ["idiot", "Well", ".", "!", ";", "?", "\n", " ", ",", "ab", "q", "(", "zarbol", "not", "you", "kill", "x"]
    for _ in range(2000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(1, 8)))
        whole = sum(g.clause([x for w in c.split() if (x := w.strip(toxicity.EDGES))]) for c in toxicity.CLAUSE.split(t.lower()))
        assert g.evidence(t) == whole, repr(t)
