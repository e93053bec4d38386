"""String kernels against sets of n-grams, long texts against one piece, und, held-out accuracy."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pytest

from dubsar.llm import language_id
from dubsar.llm.queries import QUERIES

TEXTS = ["The cat sat on the mat.", "Die Katze sitzt auf der Matte", "le chat, LE chat", "x", "été 1998: Ärger!", "the mat sat"]
SCHEMA = "doc_id long, text string, lang string, held_out string, score int"


def _grams(text: str, n: int) -> set[str]:
    spaced = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text} ")
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    return {spaced[i : i + n] for i in range(len(spaced) - n + 1)}


def _kernel(a: str, b: str, known: list[set[str]]) -> float:
    out = 0.0
    for n in range(1, language_id.SPECTRUM + 1):
        x, y = _grams(a, n) & known[n], _grams(b, n) & known[n]
        out += len(x & y) / math.sqrt(max(len(x), 1) * max(len(y), 1))
    return out / language_id.SPECTRUM


def test_kernel_equals_sets():
    model = language_id.Model(TEXTS)
    known = [set(), *(set().union(*(_grams(t, n) for t in TEXTS)) for n in range(1, language_id.SPECTRUM + 1))]
    asked = [*TEXTS, "Der Mat, the Katze ñandú", "ñ", "", "   7 "]
    got, letters = model.kernel(asked)
    want = [[_kernel(a, b, known) for b in TEXTS] for a in asked]
    assert np.allclose(got, want, atol=1e-5) and letters.tolist() == [True] * 8 + [False, False]


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_pieces_of_a_long_text(monkeypatch, piece):
    spectrum = language_id.Spectrum(TEXTS)
    texts = [" ".join(TEXTS * 3), "  the    cat   1   2 ...   sat", "7 " * 50 + "le  ", "." * 40]
    whole = spectrum.presence(texts)
    monkeypatch.setattr(language_id, "PIECE", piece)
    parts = spectrum.presence(texts)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


def test_odd_rows(spark):
    rows = [(i, f"the {w} of the house and the {w}", "en") for i, w in enumerate(["cat", "dog", "sun", "tree"] * 5)]
    rows += [(100 + i, f"die {w} und das haus ist nicht {w}", "de") for i, w in enumerate(["katze", "hund", "sonne", "baum"] * 5)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "12 !? 34", "en"), (203, "the house " * 100_000, None), (None, "das haus und die katze", "de"), (5, "the sun", "en"), (5, "the sun", "en")]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    model = language_id.learn(docs)
    assert sorted(model.languages) == ["de", "en"]
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (200, 201, 202, 203, None)] == ["und", "und", "und", "en", "de"] and by[200]["score"] == 0.0
    assert all(r["lang_pred"] == ("en" if r["doc_id"] < 100 else "de") for r in got if r["doc_id"] is not None and r["doc_id"] < 200)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None, "", 0), (2, "7", "en", "", 0)], SCHEMA)
    model = language_id.learn(docs)
    assert model is None and {r["lang_pred"] for r in language_id.predict(docs, model).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), None).collect() == []


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    said = QUERIES["op11_language_id"](spark, at).where("held_out").join(spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "lang"), "doc_id").select("lang", "lang_pred").collect()
    assert len(said) > 2_000 and sum(r["lang"] == r["lang_pred"] for r in said) / len(said) > 0.99
