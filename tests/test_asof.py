"""The as-of join against brute force: many phases, hot keys, ties, open ends."""

from __future__ import annotations

import random
from bisect import bisect_left

import pytest

from dubsar.operators import asof

SCHEMA = "name string, at long, id int, _v string"


def _expected(rows, phases):
    by: dict = {}
    for k, until, office in phases:
        if k is not None:
            by.setdefault(k, {}).setdefault(2**63 - 1 if until is None else until, []).append(office)
    ends = {k: sorted(v) for k, v in by.items()}
    out = []
    for name, at, i, _ in rows:
        office = None
        if name in ends:
            j = bisect_left(ends[name], -(2**63) if at is None else at)
            office = min(by[name][ends[name][min(j, len(ends[name]) - 1)]])
        out.append((name, at, i, office))
    return sorted(out, key=lambda r: r[2])


@pytest.mark.parametrize("many", [False, True])
def test_as_of_equals_brute_force(spark, many):
    rng = random.Random(7)
    keys = [f"k{i}" for i in range(20)]
    n = 500 if many else 3
    phases = [(k, rng.randint(0, 3_000), f"o{rng.randint(0, 9)}") for k in keys[:18] for _ in range(rng.randint(1, n))]
    phases += [(k, None, "open") for k in keys[:9]] + [(None, 5, "nobody's"), ("k0", 100, "tie b"), ("k0", 100, "tie a")]
    phases += [("hot", i, f"p{i}") for i in range(10_000)] if many else []
    rows = [(rng.choice(keys), rng.randint(-5, 3_100), i, "clash") for i in range(3_000)]
    rows += [("hot", 77, 10_000 + i, None) for i in range(1_500)] + [("hot", rng.randint(0, 11_000), 20_000 + i, None) for i in range(1_500)]
    rows += [(None, 5, 1, None), ("k0", None, 2, None), ("k0", 100, 3, None), ("k19", 4, 4, None)]
    given = spark.createDataFrame([(*r[:3], "x") for r in rows], "name string, at long, id int, extra string")
    got = asof.as_of(given, spark.createDataFrame(phases, "name string, until long, office string"), "name", "at", "until")
    assert got.columns == ["name", "at", "id", "extra", "office"]
    key = lambda r: (r[2], repr(r))
    assert sorted(((r["name"], r["at"], r["id"], r["office"]) for r in got.collect()), key=key) == sorted(_expected(rows, phases), key=key)


def test_both_ways_agree_and_empty_sides(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 9, 2), ("b", 1, 3)], "name string, at long, id int")
    phases = spark.createDataFrame([("a", 5, "first"), ("a", 8, "second")], "name string, until long, office string")
    for few in (10_000, 0):
        monkeypatch.setattr(asof, "MOST_PHASES", few)
        assert {(r["id"], r["office"]) for r in asof.as_of(rows, phases, "name", "at", "until").collect()} == {(1, "first"), (2, "second"), (3, None)}
        assert asof.as_of(rows.limit(0), phases, "name", "at", "until").collect() == []
    assert {r["office"] for r in asof.as_of(rows, phases.limit(0), "name", "at", "until").collect()} == {None}
