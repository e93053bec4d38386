"""Every stage of the pipeline, and what the operators promise, on odd rows."""

from __future__ import annotations

import itertools
import random

import pytest

import corpus_pipeline
from dubsar.llm import decontaminate, near_dedup, secret_scans, token_counts, warc
from dubsar.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _hit string, _key string, _id string, N_TOKENS string, fail_bits string"
PROSE = " ".join(f"word{k} of" for k in range(40))
KEY = "token = abcdef123456"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), "h", "k", "i", "n", "f") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_on_odd_rows(spark, sf_dir, name, stage):
    rows = [(1, PROSE), (1, PROSE), (2, PROSE), (None, PROSE), (None, None), (3, ""), (4, PROSE.replace("word", "other") + " \x01\x02 " + KEY), (5, "long text of words " * 30_000)]
    got = stage(spark, frame(spark, rows), sf_dir).collect()
    if name == "quality rules":
        assert sorted((r["doc_id"] or 0, len(r["text"])) for r in got) == sorted((i or 0, len(t)) for i, t in rows[:4] + rows[6:7])
    elif name == "near-dedup":
        assert sorted(r["doc_id"] or 0 for r in got) == [0, 1, 3, 4, 5]
    elif name == "secret scans":
        assert {r["text"] for r in got if r["doc_id"] == 4} == {rows[6][1].replace("abcdef123456", "[REDACTED-ASSIGN]")} and len(got) == len(rows)
        assert all(r["n_chars"] == len(r["text"] or "") for r in got)
    else:
        assert len(got) == len(rows)
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert all(list(r.asDict()) == SCHEMA.replace(" long", "").replace(" string", "").split(", ") for r in got)
    assert stage(spark, frame(spark, []), sf_dir).count() == 0


def test_contaminated_rows_without_id_go(spark):
    items = spark.createDataFrame([(1, PROSE), (1, PROSE), (None, PROSE)], "item_id long, text string")
    docs = frame(spark, [(None, "before " + PROSE), (None, "clean text"), (7, PROSE), (7, PROSE)])
    assert [r["text"] for r in decontaminate.decontaminate(docs, items).collect()] == ["clean text"]


def test_near_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    a, b = PROSE, PROSE.replace("word", "thing")
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (None, a)]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in near_dedup.near_classes(frame(spark, rows)).collect())
    assert got == [(0, 5), (5, 5), (5, 5), (7, 5), (9, 5)]


@pytest.mark.parametrize("size", [49, 60, 500])
def test_large_buckets_lose_no_pair(spark, size):
    """Members of one bucket that share nothing else: every pair of different components comes out."""
    facts = {c: 0 for c in near_dedup.FACTS} | {"n": 100}
    rows = [(1, k, k, *facts.values()) for k in range(size)]
    placed = spark.createDataFrame(rows, "bucket long, uid long, comp long, " + ", ".join(f"{c} long" for c in near_dedup.FACTS))
    got = {(r["a"], r["b"]) for r in near_dedup._within(placed).collect()}
    assert got == set(itertools.combinations(range(size), 2))


def test_parities_never_part_what_the_threshold_links():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(4, 400))
        both = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        k = int(n // 8)
        a, b = near_dedup.np.unique(both[:n]), near_dedup.np.unique(np.concatenate([both[k:n], both[n : n + int(rng.integers(0, k + 1))]]))
        shared = len(np.intersect1d(a, b))
        if 100 * shared >= 75 * (len(a) + len(b) - shared):
            apart = int(np.bitwise_count((near_dedup.parities(a) ^ near_dedup.parities(b)).view(np.uint64)).sum())
            assert 175 * apart <= 25 * (len(a) + len(b))


def test_null_payload_and_large_pages(spark):
    rows = [(1, None, None), (2, "u", "x" * 70_000), (None, "u", "y"), (2, "u", "x" * 70_000), (3, "u", "z" * 1_100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, payload string")
    got = sorted(((r["page_id"] or 0), r["payload_bytes"], r["record_type"]) for r in warc.round_trip(pages).collect())
    assert got == [(0, 1, "response"), (1, 0, "response"), (2, 70_000, "response"), (2, 70_000, "response"), (3, 1_100_000, "response")]


def test_column_names_clash_in_any_case(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, N_BYTES string, Over_Limit string")
    assert token_counts.token_counts(docs, tokenizer_path("word_bpe_49k.json")).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_redaction_keeps_control_characters(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(["\x01", "\x02", "\x03", "\x04", "a", " "]) for _ in range(12)) + " " + KEY for _ in range(100)]
    got = {r["doc_id"]: r["text"] for r in secret_scans.cleaned(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: t.replace("abcdef123456", "[REDACTED-ASSIGN]") for i, t in enumerate(texts)}
