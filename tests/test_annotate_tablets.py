"""Annotation by shared lines against annotation within the row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from dubsar.operators import annotate, extract
from dubsar.plans import queries
from tests.test_line_table import LINES, MARKS, SCHEMA, _told

MORE = ["na-lu-ta", "ur-{d}nanna-sze3", "[na]-lu-ta", "<<ki>> na-lu-ta", "giri3 na-lu sukkal", "ga 2(disz) udu", "mu us2-sa ma2 {d}en-ki", "kiszib3 na-lu", "[x]-lu i3-dab5", "ΑΣ-ta", "KI NA-LU-TA", "5(disz) sila4 ga"]


def _extracted(spark):
    rng = random.Random(3)
    texts = ["\n".join(f"{i + 1}. {rng.choice(LINES + MORE)}" if rng.random() < 0.8 else rng.choice(MARKS) for i in range(rng.randint(0, 15))) for _ in range(60)]
    return extract.extract(spark.createDataFrame([(str(i), "d", t, "AS.05.03.00", i, "clash") for i, t in enumerate([*texts, None, texts[0]])], SCHEMA)).localCheckpoint()


def test_shared_lines_equal_rows(spark, monkeypatch):
    x = _extracted(spark)
    names = spark.createDataFrame([("na-lu", "Nalu", "PN"), ("umma{ki}", "Umma", "SN")], "form string, canonical string, pos string")
    glossary = spark.createDataFrame([("dub-sar", "scribe")], "atf string, meaning string")
    assert _told(annotate.annotate_tablets(x)) == _told(annotate.annotate(x))
    assert _told(annotate.annotate_tablets(x, names, glossary)) == _told(annotate.annotate(x, names, glossary))
    monkeypatch.setattr(extract, "HOT", 2.0)  # no line is hot
    assert _told(annotate.annotate_tablets(x)) == _told(annotate.annotate(x))


def test_frequent_lines_are_annotated_once(spark, sf_dir, monkeypatch):
    kept = {}
    real = annotate.stored
    monkeypatch.setattr(annotate, "stored", lambda df, name: kept.setdefault(name, real(df, name)))
    annotate.annotate_tablets(queries._x(spark, sf_dir))
    told, counted = kept["told"], kept["told-lines"]
    n = counted.agg(F.sum("n")).first()[0]
    assert told.count() == told.select(*annotate._LINE_KEY).distinct().count() <= 1 / extract.HOT
    assert counted.join(told, list(annotate._LINE_KEY), "left_semi").agg(F.sum("n")).first()[0] > 0.75 * n
