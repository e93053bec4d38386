"""Evaluation suite, snippets, glossary, routes, exports and steps over small files."""

from __future__ import annotations

import datetime
import json
import os
import zipfile

import pytest

from dubsar.operators import names
from dubsar.plans import jobs
from dubsar.sources import readers

TEXT = "@tablet\n@obverse\n1. 5(disz) udu niga\n2. ki na-sa6-ta\n3. ur-mes i3-dab5"


def test_ground_truth_suite_and_report(spark, tmp_path):
    entry = {"atf": TEXT, "rul": "Amar-Suen", "yr": "05", "mo": "09", "dy": "03", "des": "T", "conf": "high"}
    (tmp_path / "store.json").write_text(json.dumps({"1": entry, "2": entry}))
    want = [
        {"id": "1", "source": "cdli", "expected": {"source": "na-sa6", "total_animals": 5, "ruler": None}},
        {"id": "2", "source": "edge_case", "expected": {"receiver": "lugal"}},
        {"id": "9", "source": "cdli", "expected": {"source": "na-sa6"}},
    ]
    (tmp_path / "truth.json").write_text(json.dumps({"_meta": {}, "tablets": want}))
    run = lambda suite: jobs.run_ground_truth(spark, str(tmp_path / "store.json"), str(tmp_path / "truth.json"), suite)
    whole = run(None).persist()
    assert {(r["tablet_id"], r["field"], r["passed"]) for r in whole.collect()} == {("1", "source", True), ("1", "total_animals", True), ("2", "receiver", False)}
    assert {r["tablet_id"] for r in run("gold").collect()} == {"1"}
    stable = spark.createDataFrame([("1", True)], "tablet_id string, passed boolean")
    made = jobs.report(whole, stable, str(tmp_path / "report.json"), datetime.date(2024, 1, 2))
    assert made == json.loads((tmp_path / "report.json").read_text()) and made["date"] == "2024-01-02"
    assert made["summary"] == {"gt_pass": 1, "gt_total": 2, "reg_stable": 1, "reg_total": 1} and made["ground_truth_results"][1]["failed_fields"] == ["receiver"]


def test_snippets_and_issue_list(spark, tmp_path):
    given = spark.createDataFrame([("a", "3(disz) udu"), ("b", TEXT)], "id_text string, text string")
    assert {r["tablet_id"]: r["total_animals"] for r in jobs.extract_snippets(given).collect()} == {"a": 3, "b": 5}
    for tablet in ("7", None):
        readers.append_issue(str(tmp_path / "issues.md"), "lost sheep", tablet, datetime.date(2024, 1, 2))
    heads = [line for line in (tmp_path / "issues.md").read_text().splitlines() if line.startswith("##")]
    assert heads == ["## [2024-01-02] P7 — lost sheep", "## [2024-01-02] snippet — lost sheep"]


def test_glossary_and_missing_dictionary(spark, tmp_path):
    entries = [{"cf": "udu", "gw": "sheep", "pos": "N", "icount": "9", "forms": [{"n": "udu", "icount": "9"}, {"n": "kuₓ", "icount": "1"}]}, {"cf": "kur", "gw": "enter", "pos": "V", "icount": "2", "forms": [{"n": "kuₓ", "icount": "2"}]}]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("epsd2/gloss-sux.json", json.dumps({"entries": entries}))
    built = jobs.build_glossary(spark, str(tmp_path / "z.zip"), str(tmp_path / "glossary"))
    assert [(r["citation"], r["attestations"]) for r in built.orderBy("idx").collect()] == [("udu", 9), ("kur", 2)]
    assert {r["meaning"] for r in names.glossary_lookup(built).collect()} == {"sheep"}
    assert readers.read_names(spark, str(tmp_path / "nothing")).count() == 0 and readers.read_names(spark, None).columns == readers.read_names(spark, str(tmp_path / "nothing")).columns


def test_routes_and_export(spark, tmp_path):
    tablets = spark.createDataFrame([(i, str(i), f"T{i}", TEXT, "Amar-Suen.05.09.03") for i in (1, 2, 3)], "pos long, id_text string, designation string, transliteration string, dates_referenced string")
    service = jobs.Service(tablets)
    told = lambda url: [json.loads(r["json"]) for r in service.respond(url).collect()]
    assert len(told("/api/index")) == 3 and len(told("/api/random")) == 1
    assert {(r["period"], r["total_count"]) for r in told("/api/animals_timeline?exclude=3,x") if r["granularity"] == "year"} == {("AS.05", 10)}
    assert len(told("/api/animals_cell?animal=udu&period=AS.05.09&granularity=month")) == 3 and told("/api/stats")
    assert service.respond("/api/recipients_timeline?lens=destination&flow=external").columns == service.respond("/api/timeline").columns == ["json"]
    (timeline,) = told("/api/timeline")
    assert {k: len(v) for k, v in timeline.items()} == {"officials": service.officials()[0].count(), "edges": service.officials()[1].count(), "periods": service.officials()[2].count()}
    assert [r["official"] for r in timeline["officials"]] == [r["official"] for r in service.officials()[0].collect()]
    with pytest.raises(KeyError):
        service.respond("/api/unknown")
    assert service.export("1", str(tmp_path / "one.json")) and json.loads((tmp_path / "one.json").read_text())["tablet_id"] == "1"
    assert not service.export("none", str(tmp_path / "none.json")) and not (tmp_path / "none.json").exists()


def test_steps_run_where_due(spark, tmp_path):
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    touch = lambda path, at: (open(path, "w").close(), os.utime(path, (at, at)))
    touch(source, 1_000)
    steps = [("copy", output, [source, str(tmp_path / "absent")], lambda: touch(output, 2_000))]
    assert jobs.run_steps(spark, steps) == ["copy"] and jobs.run_steps(spark, steps) == []
    assert jobs.run_steps(spark, steps, force=True) == ["copy"]
    touch(source, 3_000)
    assert jobs.run_steps(spark, steps) == ["copy"]
    assert jobs.run_steps(spark, [("same age", output, [output], lambda: None)]) == ["same age"]
