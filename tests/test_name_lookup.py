"""The order in which a name falls back on forms of the dictionary, against all candidates tried one after another."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dubsar.functions import lexicon as L
from dubsar.operators import annotate, names


def _ascii(s: str) -> str:
    for a, b in (*zip("₀₁₂₃₄₅₆₇₈₉", "0123456789", strict=True), *L.UNICODE_LETTERS.items()):
        s = s.replace(a, b)
    return s


def _tried(name: str) -> list[str]:
    forms = [name, _ascii(name)]
    return forms + [f[: -len(s)] for f in forms for s in L.DICTIONARY_SUFFIXES if f.endswith(s)]


PARTS = ["na", "sa₆", "sa6", "ta", "-ta", "-sze3", "-še₃", "-ra", "-e", "-ka", "-kam", "-me", "-ke4", "-ke₄", "š", "sz", "-", "lu2"]


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_fallback_order(spark, monkeypatch, most):
    monkeypatch.setattr(names, "MOST_BROADCAST", most)
    rng = random.Random(5)
    make = lambda: "".join(rng.choices(PARTS, k=rng.randint(1, 4)))
    forms = sorted({make() for _ in range(2_500)})
    asked = [make() for _ in range(1_500)] + ["-ta", "zz", ""]
    known = spark.createDataFrame([(f, f"C {f}", "PN", "personal_name", 1) for f in forms], names.NAMES)
    given = spark.createDataFrame([(a, i) for i, a in enumerate(asked)] + [(None, -1)], "name string, id int")
    got = {r["id"]: r["canonical"] for r in names.look_up(given, known).collect()}
    of = {f: f"C {f}" for f in forms}
    want = {i: next((of[k] for k in _tried(a) if k in of), None) for i, a in enumerate(asked)} | {-1: None}
    assert got == want and sum(v is not None for v in got.values()) > 300


def test_annotation_falls_back_alike(spark):
    rng = random.Random(6)
    keys = ["".join(rng.choices(PARTS, k=rng.randint(1, 3))) for _ in range(400)]
    table = F.create_map(*(F.lit(x) for k in sorted(set(keys[:200])) for x in (k, f"C {k}")))
    got = [r["e"] for r in spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string").select("i", annotate._entry(table, F.col("k")).alias("e")).orderBy("i").collect()]
    of = set(keys[:200])
    assert got == [next((f"C {c}" for c in (k, *(k[: -len(s)] for s in L.CASE_SUFFIXES if k.endswith(s))) if c in of), None) for k in keys]
