"""Timelines brought up to date against timelines built anew."""

from __future__ import annotations

import random

from dubsar.operators import analytics, maintained

SCHEMA = "lens string, key string, tablet string, count long, animal string, tx string, period_y string, period_m string, pos long, seq int"


def _of(rng: random.Random, pos: int) -> list[tuple]:
    year = f"Y{rng.randint(1, 3)}"
    month = rng.choice([None, f"{year}.{rng.randint(1, 2)}"])
    return [(rng.choice(analytics.LENSES), f"k{rng.randint(0, 6)}", f"P{pos}", rng.randint(0, 9), "a", "tx", year, month, pos, seq) for seq in range(rng.randint(0, 5))]


def test_updates_equal_a_full_build(spark, tmp_path):
    rng = random.Random(8)
    now = {pos: _of(rng, pos) for pos in range(120)}
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    every = lambda tablets: [r for rows in tablets.values() for r in rows]
    path = str(tmp_path / "state")
    maintained.create(frame(every(now)), path, buckets=8)
    for step in (30, 1, 119):
        touched = sorted(rng.sample(range(120 + step), step))
        old = [r for pos in touched for r in now.get(pos, [])]
        for pos in touched:
            now[pos] = [] if rng.random() < 0.3 else _of(rng, pos)
        maintained.update(spark, path, frame(old), frame([r for pos in touched for r in now[pos]]))
        for lens in analytics.LENSES:
            want = analytics.timeline(frame(every(now)), lens)
            got = maintained.timeline(spark, path, lens).select(*want.columns)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), (step, lens)
    assert maintained.latest(spark, path) == 3


def test_only_touched_buckets_are_read(spark, tmp_path, monkeypatch):
    rows = [("animal", f"k{i % 40}", f"P{i}", i, "a", "tx", "Y1", None, i, 0) for i in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "state")
    maintained.create(frame(rows), path, buckets=16)
    seen = []
    real = maintained._by_cell
    monkeypatch.setattr(maintained, "_by_cell", lambda facts, *sums: (seen.append(facts), real(facts, *sums))[1])
    maintained.update(spark, path, frame([rows[399]]), frame([]))  # the largest of k39 goes
    files = {f.split("_bucket=")[1].split("/")[0] for f in seen[-1].inputFiles() if "_bucket=" in f}
    plan = spark._jvm.PythonSQLUtils.explainString(seen[-1]._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(_buckets" in plan and len(files) >= 1
    top = {r["key"]: r["max_count"] for r in maintained.timeline(spark, path).where("granularity = 'total'").collect()}
    assert top["k39"] == 359 and top["k38"] == 398
