"""The manifest against trees built in plain Python, on odd rows."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from dubsar.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, h int, g string, p string"


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(hashes: list[str]) -> list[list[str]]:
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([_h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def _siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        at = i - i % 16
        out.append(("".join(level[at:i]), "".join(level[i + 1 : at + 16])))
        i //= 16
    return out


def _expected(rows: list[tuple]) -> list[tuple]:
    leaves = sorted(((r[1] is not None, (r[1] or "").encode()), (r[0] is not None, r[0] or 0), _h(*map(_field, r[:5])), r) for r in rows)
    groups: dict = {}
    for source, _, h, row in leaves:
        groups.setdefault(source, []).append((h, row))
    trees = {s: _tree([h for h, _ in g]) for s, g in groups.items()}
    top = _tree([t[-1][0] for t in trees.values()])
    out = []
    for k, (s, g) in enumerate(groups.items()):
        for i, (h, row) in enumerate(g):
            path = _siblings(trees[s], i) + _siblings(top, k)
            out.append((row[0], h, trees[s][-1][0], top[-1][0], _h(*(a + b for a, b in path))))
    return out


def _rows(sources: int) -> list[tuple]:
    rows = [(i, "hot", "en", i, f"text {i}") for i in range(600)]
    rows += [(i, f"s{k}é", None, None, None if i % 2 else "") for k in range(sources) for i in range(k % 20)]
    rows += [(None, None, "en", 1, "a"), (None, None, "en", 1, "b"), (5, None, "en", 1, "c"), (5, None, "en", 1, "c"), (3, "", "-", 0, "ü" * 200_000)]
    return rows


@pytest.mark.parametrize("sources", [0, 40])
def test_manifest_equals_trees(spark, sources):
    rows = _rows(sources)
    docs = spark.createDataFrame([(*r, "clash", 0, "g", "p") for r in rows], SCHEMA)
    found = merkle.manifest(docs, upper=merkle.leaf(text=F.upper("text")))
    found = found.withColumn("proof", merkle.digest(merkle.proof(F.col("path")))).withColumn("back", merkle.folded(F.col("leaf"), F.col("path")))
    got = found.withColumn("changed", merkle.folded(F.col("upper"), F.col("path"))).collect()
    key = lambda t: (t[0] is not None, t[0] or 0, *t[1:])
    assert sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in got), key=key) == sorted(_expected(rows), key=key)
    assert all(r["back"] == r["root"] for r in got)
    assert all((r["changed"] == r["root"]) == (r["upper"] == r["leaf"]) for r in got)


def test_lone_leaf_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", "en", 4, "text")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = merkle.manifest(docs).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["path"] == []
    assert merkle.manifest(docs.limit(0)).collect() == []
